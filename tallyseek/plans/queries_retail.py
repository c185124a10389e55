"""Retail enrichment and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyseek.functions import calendar as cal
from tallyseek.operators import features as ft
from tallyseek.operators import retail as rl
from tallyseek.operators.forecasting import (
    horizon_split,
    regression_metrics,
    simple_fit,
    time_segments,
)
from tallyseek.plans.facts import retail_facts, sales_lines, table, with_events
from tallyseek.plans.registry import query
from tallyseek.plans.sqltext import normal_sql, quoted

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _case(value: str, table_: dict, default: str = "NULL") -> str:
    arms = " ".join(
        f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in table_.items()
    )
    return f"CASE {value} {arms} ELSE {default} END"


def _season_sql(date: str) -> str:
    return (
        f"CASE WHEN month({date}) IN (12, 1, 2) THEN 'Winter'"
        f" WHEN month({date}) IN (3, 4, 5) THEN 'Spring'"
        f" WHEN month({date}) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"
    )


PRODUCT_LIST = "[" + ", ".join(quoted(row[0]) for row in rl.PRODUCTS) + "]"
CATEGORY = {row[0]: row[1] for row in rl.PRODUCTS}
SHELF = {row[0]: row[2] for row in rl.PRODUCTS}

HOLIDAY_ROWS = ", ".join(
    f"({i}, {quoted(n)}, {m}, {d})" for i, (n, m, d) in enumerate(cal.HOLIDAYS)
)
LINES_SQL = f"""lines AS (SELECT l_shipdate::DATE AS Date, l_orderkey, l_linenumber, l_partkey,
  l_suppkey, l_extendedprice / l_quantity AS Unit_Price, l_quantity::INTEGER AS Purchase_Quantity,
  {PRODUCT_LIST}[l_partkey % 10 + 1] AS Product, p_size AS Stocks
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""


@query(
    "season_enrich",
    f"""SELECT o_orderkey, {_season_sql("o_orderdate")} AS Season FROM orders""",
)
def season_enrich(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", cal.season(F.col("o_orderdate")).alias("Season")
    )


@query(
    "weekday",
    """SELECT o_orderkey, dayname(o_orderdate) AS Day_of_Week,
  CAST(year(o_orderdate) AS INTEGER) AS "Year", CAST(month(o_orderdate) AS INTEGER) AS "Month",
  CAST(day(o_orderdate) AS INTEGER) AS "Day" FROM orders""",
)
def weekday(spark, folder):
    date = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        cal.weekday_name(date).alias("Day_of_Week"),
        *[part.alias(name) for name, part in cal.date_parts(date).items()],
    )


@query(
    "category_and_shelf_life",
    f"""SELECT p_partkey, p, {_case("p", CATEGORY, "'Other'")} AS Category,
  {_case("p", SHELF)} AS Shelf_Life FROM (SELECT p_partkey,
  CASE WHEN p_size % 11 = 10 THEN p_name ELSE {PRODUCT_LIST}[p_size % 11 + 1] END AS p FROM part)""",
)
def category_and_shelf_life(spark, folder):
    """Parts whose product is known or not: unknown ones get `Other` and a reject row."""
    slot = F.col("p_size") % 11
    names = F.array(*[F.lit(row[0]) for row in rl.PRODUCTS])
    parts = table(spark, folder, "part").select(
        "p_partkey", F.coalesce(F.get(names, slot), F.col("p_name")).alias("Product")
    )
    products = rl.product_table(spark)
    known, missing = rl.with_shelf_life(rl.with_category(parts, products), products)
    return known.unionByName(missing, allowMissingColumns=True).withColumnRenamed("Product", "p")


@query(
    "restock",
    f"""WITH {LINES_SQL} SELECT {LINE_SQL}, Stocks,
  CASE WHEN Stocks < 10 THEN 1 ELSE {_case("Product", SHELF)} END AS days FROM lines""",
)
def restock(spark, folder):
    products = rl.product_table(spark)
    known, _ = rl.with_shelf_life(sales_lines(spark, folder), products)
    days = rl.restock_days(F.col("Stocks"), F.col("Shelf_Life"))
    return known.select(*LINE_KEY, "Stocks", days.alias("days"))


def _uplift_sql() -> str:
    arms = " OR ".join(
        f"({_season_sql('Date')} = {quoted(s)} AND Product IN ({', '.join(map(quoted, p))}))"
        for s, p in rl.SEASON_FAVOURITES.items()
    )
    return f"CASE WHEN {arms} THEN 5 ELSE 0 END"


@query("demand_uplift", f"WITH {LINES_SQL} SELECT {LINE_SQL}, {_uplift_sql()} AS uplift FROM lines")
def demand_uplift(spark, folder):
    uplift = rl.season_uplift(cal.season(F.col("Date")), F.col("Product"))
    return sales_lines(spark, folder).select(*LINE_KEY, uplift.alias("uplift"))


HOLIDAY_SQL = f"""holidays(place, name, month, day) AS (VALUES {HOLIDAY_ROWS}),
near AS (SELECT o_orderkey, o_orderdate::DATE AS d, first(name ORDER BY place) AS name,
  first(h ORDER BY place) AS h FROM (SELECT o_orderkey, o_orderdate, place, name,
    make_date(year(o_orderdate), month, day) AS h FROM orders CROSS JOIN holidays)
  WHERE h BETWEEN o_orderdate::DATE AND o_orderdate::DATE + 3 GROUP BY ALL),
moved AS (SELECT o.o_orderkey, n.name AS Event,
  coalesce(h - 1, o_orderdate::DATE) AS Date
  FROM orders o LEFT JOIN near n USING (o_orderkey))"""


@query(
    "next_holiday",
    f"""WITH {HOLIDAY_SQL} SELECT o_orderkey, Event, CAST(Date AS DATE) AS "Date" FROM moved""",
)
def next_holiday(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("Date")
    )
    return rl.align_to_holiday(orders).select("o_orderkey", "Event", "Date")


@query(
    "event_group",
    f"""WITH {HOLIDAY_SQL}, named AS (SELECT o_orderkey, coalesce(Event,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Birthdays' WHEN '2-HIGH' THEN 'Special Promotion'
  WHEN '3-MEDIUM' THEN 'None' WHEN '5-LOW' THEN 'Holiday' END) AS event
  FROM moved JOIN orders USING (o_orderkey))
SELECT o_orderkey, event, CASE
  WHEN event IS NULL OR event = 'None' THEN 'None'
  WHEN event IN (SELECT name FROM holidays) THEN 'Holiday'
  WHEN event = 'Special Promotion' THEN 'Promotion'
  WHEN event = 'Birthdays' THEN 'Daily event' END AS event_group,
  CASE WHEN event = 'Holiday' THEN 'Holiday'
  WHEN event IS NULL OR event = 'None' THEN 'None'
  WHEN event IN (SELECT name FROM holidays) THEN 'Holiday'
  WHEN event = 'Special Promotion' THEN 'Promotion'
  WHEN event = 'Birthdays' THEN 'Daily event' END AS kept_group FROM named""",
)
def event_group(spark, folder):
    """Holiday names, promotions, occasions, an already grouped value and missing events."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("Date")
    )
    other = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Birthdays")
        .when(F.col("o_orderpriority") == "2-HIGH", "Special Promotion")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "None")
        .when(F.col("o_orderpriority") == "5-LOW", "Holiday")
    )
    named = rl.align_to_holiday(orders).select(
        "o_orderkey", F.coalesce("Event", other).alias("event")
    )
    return named.withColumns(
        {
            "event_group": rl.event_group(F.col("event")),
            "kept_group": rl.event_group(F.col("event"), keep_grouped=True),
        }
    )


PRICE_ROWS = ", ".join(
    f"({quoted(p)}, {base}::DOUBLE, {w}::DOUBLE, {s}::DOUBLE, {m}::DOUBLE)"
    for p, _, _, base, w, s, m in rl.PRODUCTS
)
FACTOR_ROWS = ", ".join(
    f"({rl.FIRST_PRICE_YEAR + i}, {f}::DOUBLE)" for i, f in enumerate(rl.INFLATION)
)


@query(
    "indexed_price",
    f"""WITH {LINES_SQL},
prices(Product, base, winter, summer, mild) AS (VALUES {PRICE_ROWS}),
factors(year, factor) AS (VALUES {FACTOR_ROWS}),
years AS (SELECT y, coalesce((SELECT product(factor) FROM factors WHERE year < y), 1) AS index
  FROM (SELECT DISTINCT year(Date + INTERVAL 9 YEAR) AS y FROM lines)),
dated AS (SELECT {LINE_SQL}, Product, CAST(Date + INTERVAL 9 YEAR AS DATE) AS Date FROM lines)
SELECT {LINE_SQL}, Product, Date AS "Date", round(base * index * CASE {_season_sql("Date")}
  WHEN 'Winter' THEN winter WHEN 'Summer' THEN summer ELSE mild END, 2) AS Unit_Price,
  year(Date) > 2025 AS price_extrapolated
FROM dated JOIN prices USING (Product) JOIN years ON y = year(Date)""",
)
def indexed_price(spark, folder):
    """Prices of the sales lines, with dates moved nine years on, into the index years."""
    lines = sales_lines(spark, folder).select(
        *LINE_KEY, "Product", F.to_date(F.add_months("Date", 9 * 12)).alias("Date")
    )
    return rl.with_indexed_price(lines, rl.product_table(spark))


@query(
    "purchase_gaps",
    f"""WITH {LINES_SQL}, days AS (SELECT Product, Date, count(*) AS purchases FROM lines
  GROUP BY ALL), gaps AS (SELECT *, lag(Date) OVER (PARTITION BY Product ORDER BY Date) AS previous
  FROM days)
SELECT Product, Date AS "Date", purchases, previous, CAST(Date - previous AS INTEGER) AS gap_days,
  coalesce(Date - previous > 4, false) AS over_limit FROM gaps""",
)
def purchase_gaps(spark, folder):
    return rl.purchase_gaps(sales_lines(spark, folder))


@query(
    "date_cutoff",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Date" FROM orders
WHERE o_orderdate <= DATE '1998-06-30'""",
)
def date_cutoff(spark, folder):
    end = F.lit("1998-06-30").cast("timestamp_ntz")
    orders = rl.until(table(spark, folder, "orders"), end, "o_orderdate")
    return orders.select("o_orderkey", F.to_date("o_orderdate").alias("Date"))


@query(
    "date_parse",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN NULL
  ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""",
)
def date_parse(spark, folder):
    """Day-first dates, every seventh of them written the wrong way round."""
    day_first = F.date_format("o_orderdate", "dd.MM.yyyy")
    wrong = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 7 == 3, wrong).otherwise(day_first)
    return table(spark, folder, "orders").select(
        "o_orderkey", cal.parse_day_first(text).alias("parsed")
    )


@query(
    "code_mapping",
    """SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1
  WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END AS code,
  CASE event_type WHEN 'view' THEN 'XGBoost' WHEN 'click' THEN 'CatBoost'
  WHEN 'signup' THEN 'LightGBM' WHEN 'purchase' THEN 'LinearRegression' END AS model
FROM events""",
)
def code_mapping(spark, folder):
    """Event and model names to codes and spellings; unknown names give null."""
    kind = F.col("event_type")
    event, model = F.lit("Party"), F.lit("prophet")
    for source, event_name, name in (
        ("view", "None", "xgboost"),
        ("click", "Holiday", "CATBOOST"),
        ("signup", "Daily event", "LightGBM"),
        ("purchase", "Promotion", "linearRegression"),
    ):
        event = F.when(kind == source, event_name).otherwise(event)
        model = F.when(kind == source, name).otherwise(model)
    return table(spark, folder, "events").select(
        "event_id",
        "event_type",
        rl.encode_event(event).alias("code"),
        rl.model_name(model).alias("model"),
    )


@query(
    "label_encode",
    """SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS type_code,
  dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_code FROM part""",
)
def label_encode(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    coded = ft.label_encode(parts, "p_type", "type_code")
    coded = ft.label_encode(coded, "p_brand", "brand_code")
    return coded.select("p_partkey", "p_type", "type_code", "brand_code")


@query(
    "fixed_label_encode",
    f"""SELECT o_orderkey, CAST(list_position(['Winter', 'Spring', 'Summer', 'Autumn'],
  {_season_sql("o_orderdate")}) - 1 AS INTEGER) AS season_code FROM orders""",
)
def fixed_label_encode(spark, folder):
    code = ft.fixed_code(cal.season(F.col("o_orderdate")), ft.FIXED_CATEGORIES["Season"])
    return table(spark, folder, "orders").select("o_orderkey", code.alias("season_code"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DAYS = ft.FIXED_CATEGORIES["Day_of_Week"]


@query(
    "one_hot",
    "SELECT o_orderkey, "
    + ", ".join(
        f"(o_orderpriority = {quoted(p)})::DOUBLE AS {quoted(f'priority_{p}').replace(chr(39), chr(34))}"
        for p in PRIORITIES[1:]
    )
    + ", "
    + ", ".join(
        f'(dayname(o_orderdate) = {quoted(d)})::DOUBLE AS "Day_of_Week_{d}"' for d in DAYS[1:]
    )
    + " FROM orders",
)
def one_hot(spark, folder):
    """Sorted categories from the data, and a fixed category list; both drop the first."""
    orders = table(spark, folder, "orders")
    found = ft.categories_of(orders, ("o_orderpriority",))["o_orderpriority"]
    columns = ft.one_hot(F.col("o_orderpriority"), "priority", found)
    columns |= ft.one_hot(cal.weekday_name(F.col("o_orderdate")), "Day_of_Week", DAYS)
    return orders.select("o_orderkey", *[column.alias(name) for name, column in columns.items()])


@query(
    "standardize",
    "SELECT p_partkey, "
    + ", ".join(
        f"round((p.{c} - s.{c}_m) / s.{c}_d, 6) AS {c}" for c in ("p_size", "p_retailprice")
    )
    + """, 0.0::DOUBLE AS fixed FROM part p, (SELECT avg(p_size) AS p_size_m,
  stddev_pop(p_size) AS p_size_d, avg(p_retailprice) AS p_retailprice_m,
  stddev_pop(p_retailprice) AS p_retailprice_d FROM part) s""",
)
def standardize(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.lit(3.0).alias("fixed")
    )
    columns = ["p_size", "p_retailprice", "fixed"]
    scaled = ft.standardize(parts, columns)
    return scaled.select("p_partkey", *[F.round(c, 6).alias(c) for c in columns])


@query(
    "feature_noise",
    f"""SELECT p_partkey, round(p_size + 0.1 * {normal_sql("p_partkey", 42)}, 6) AS size,
  round(p_retailprice + 0.1 * {normal_sql("p_partkey", 43)}, 6) AS price FROM part""",
)
def feature_noise(spark, folder):
    """Every part's two features with the noise that training adds."""
    parts = table(spark, folder, "part").select(
        "p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("values")
    )
    noisy = parts.withColumn("values", ft.noisy(F.col("values"), F.col("p_partkey")))
    return noisy.select(
        "p_partkey", F.round(F.col("values")[0], 6).alias("size"), F.round(F.col("values")[1], 6).alias("price")
    )


@query(
    "event_features",
    f"""WITH {LINES_SQL}, e AS (SELECT {LINE_SQL}, CASE WHEN EXISTS (
  SELECT 1 FROM (VALUES {HOLIDAY_ROWS}) h(place, name, month, day)
  WHERE make_date(year(Date), month, day) BETWEEN Date AND Date + 3) THEN 'Holiday' ELSE 'None' END AS grouped
  FROM lines)
SELECT *, (grouped = 'None')::DOUBLE AS "Event_Grouped_None" FROM e""",
)
def event_features(spark, folder):
    """The event of every sale, its group and its encoded column."""
    data = with_events(retail_facts(spark, folder))
    recipe = ft.fit_recipe(data, with_event=True)
    raw = ft.encoded_columns(recipe.categories, True, "keep")
    names = [c for c in recipe.columns if c.startswith("Event_Grouped")]
    grouped = rl.event_group(F.col("Event"), keep_grouped=True).alias("grouped")
    return data.select(*LINE_KEY, grouped, *[raw[c].alias(c) for c in names])


@query(
    "time_series_folds",
    """WITH p AS (SELECT o_orderkey, o_orderdate,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(CASE WHEN place < n - 5 * (n // 6) THEN 0
  ELSE (place - (n - 5 * (n // 6))) // (n // 6) + 1 END AS INTEGER) AS segment FROM p""",
)
def time_series_folds(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderdate", "o_orderkey")
    return time_segments(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "segment")


@query(
    "linear_fit",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""",
)
def linear_fit(spark, folder):
    fit = simple_fit(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return fit.select(
        F.round("slope", 6).alias("slope"),
        F.round("intercept", 4).alias("intercept"),
        F.round("r2", 6).alias("r2"),
    )


@query(
    "fit_metrics",
    """SELECT l_returnflag, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse,
  round(avg(abs(e)), 6) AS mae, round(1 - avg(e * e) / var_pop(l_quantity), 6) AS r2
FROM (SELECT l_returnflag, l_quantity, l_quantity - l_extendedprice / 2000 AS e FROM lineitem)
GROUP BY l_returnflag""",
)
def fit_metrics(spark, folder):
    """Errors of a rule of thumb (quantity = price / 2000) per return flag."""
    scored = table(spark, folder, "lineitem").withColumn(
        "guess", F.col("l_extendedprice") / 2000
    )
    metrics = regression_metrics(scored, "l_quantity", "guess", ("l_returnflag",))
    return metrics.select(
        "l_returnflag", *[F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae", "r2")]
    )


@query(
    "horizon_split",
    f"""WITH {LINES_SQL} SELECT part, count(*) AS rows, sum(Purchase_Quantity)::BIGINT AS quantity
FROM (SELECT CASE WHEN year(Date) <= 2000 THEN 'train' ELSE 'test' END AS part, * FROM lines
  WHERE year(Date) <= 2001) GROUP BY part""",
)
def horizon(spark, folder):
    train, test = horizon_split(sales_lines(spark, folder), 2000)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.count("*").alias("rows"), F.sum("Purchase_Quantity").alias("quantity")
    )


ENRICHED_SQL = f"""WITH {LINES_SQL},
daily AS (SELECT o_orderdate::DATE AS Date, count(*)::INTEGER AS Num_Customers,
  sum(o_totalprice) AS Sales FROM orders GROUP BY ALL)
SELECT {LINE_SQL}, Product, {_season_sql("Date")} AS Season, dayname(Date) AS Day_of_Week,
  coalesce(Num_Customers, 0) AS Num_Customers, round(coalesce(Sales, 0), 2) AS Sales,
  CASE {_season_sql("Date")}
    WHEN 'Winter' THEN ['Snowy', 'Cold', 'Cloudy'] WHEN 'Spring' THEN ['Sunny', 'Rainy', 'Cloudy']
    WHEN 'Summer' THEN ['Sunny', 'Hot', 'Cloudy'] ELSE ['Rainy', 'Cloudy', 'Windy']
  END[day(Date) % 3 + 1] AS Weather,
  {_case("Product", CATEGORY)} AS Category, Stocks,
  CASE WHEN Stocks < 10 THEN 1 ELSE {_case("Product", SHELF)} END AS Days_Until_Next_Purchase,
  Purchase_Quantity FROM lines LEFT JOIN daily USING (Date)"""


@query("retail_facts", ENRICHED_SQL)
def facts(spark, folder):
    """The forecast input: every enrichment applied to the sales lines."""
    return retail_facts(spark, folder).select(
        *LINE_KEY, "Product", "Season", "Day_of_Week", "Num_Customers",
        F.round("Sales", 2).alias("Sales"), "Weather", "Category", "Stocks",
        "Days_Until_Next_Purchase", "Purchase_Quantity",
    )


@query(
    "feature_recipe",
    f"""WITH f AS ({ENRICHED_SQL}), one(feature, varies) AS (
  SELECT unnest(['Unit_Price', 'Num_Customers', 'Sales', 'Stocks', 'Shelf_Life', 'Days_Until_Next_Purchase',
    'Year', 'Month', 'Day', 'Season_Encoded']), true
  UNION ALL SELECT 'Product_' || v, true FROM (SELECT DISTINCT Product AS v FROM f ORDER BY v OFFSET 1)
  UNION ALL SELECT 'Day_of_Week_' || v, true FROM (SELECT DISTINCT Day_of_Week AS v FROM f ORDER BY v OFFSET 1)
  UNION ALL SELECT 'Weather_' || v, true FROM (SELECT DISTINCT Weather AS v FROM f ORDER BY v OFFSET 1)
  UNION ALL SELECT 'Category_' || v, true FROM (SELECT DISTINCT Category AS v FROM f ORDER BY v OFFSET 1)
  UNION ALL SELECT 'Event_Grouped_None', true)
SELECT feature, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS deviation FROM one""",
)
def feature_recipe(spark, folder):
    """Mean and deviation of every encoded, scaled feature: 0 and 1, or 0 and 0."""
    data = with_events(retail_facts(spark, folder))
    recipe = ft.fit_recipe(data, with_event=True)
    names = F.array(*map(F.lit, recipe.columns))
    cells = data.select(F.posexplode(recipe.values()).alias("at", "value"))
    return (
        cells.groupBy("at")
        .agg(
            # Plus zero: a mean just below zero rounds to minus zero.
            (F.round(F.avg("value"), 6) + 0.0).alias("mean"),
            F.round(F.stddev_pop("value"), 6).alias("deviation"),
        )
        .select(names[F.col("at")].alias("feature"), "mean", "deviation")
    )
