"""Enrichment rules for retail facts.

Every dimension here is a short fixed list, so the lookups are broadcast joins or plain
expressions and no fact row is shuffled.
"""

from __future__ import annotations

from itertools import accumulate
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyseek.functions.calendar import (
    HOLIDAYS,
    next_holiday,
    purchase_date,
    season,
    weekday_name,
)
from tallyseek.operators.sizing import inline_table

# Product, category, shelf life in days, base price in 2004, price factors in
# winter, in summer and in the other two seasons.
PRODUCTS = (
    ("Milk", "Dairy", 7, 4, 1.3, 1.2, 1.1),
    ("Eggs", "Dairy", 21, 4, 1.8, 1.5, 1.3),
    ("Chicken", "Meat", 5, 15, 1.3, 1.2, 1.1),
    ("Tomatoes", "Vegetables", 10, 5, 2.5, 2.0, 1.6),
    ("Apples", "Fruits", 30, 2, 2.2, 1.5, 1.2),
    ("Salmon", "Seafood", 3, 16, 2.3, 2.0, 1.7),
    ("Cheese", "Dairy", 9, 20, 1.4, 1.1, 1.2),
    ("Lettuce", "Vegetables", 5, 2, 3.0, 2.2, 1.6),
    ("Pork", "Meat", 7, 16, 1.6, 1.3, 1.4),
    ("Potatoes", "Vegetables", 9, 1, 1.4, 1.2, 1.1),
)

# Yearly inflation factors from 2004 on.
FIRST_PRICE_YEAR = 2004
INFLATION = (
    1.123, 1.103, 1.116, 1.166, 1.223, 1.123, 1.091, 1.046, 0.998, 1.005, 1.249,
    1.433, 1.124, 1.137, 1.098, 1.041, 1.05, 1.1, 1.266, 1.051, 1.065,
)

# Products that sell more in a season.
SEASON_FAVOURITES = {
    "Summer": ("Tomatoes", "Lettuce", "Apples", "Chicken"),
    "Winter": ("Milk", "Cheese", "Pork", "Potatoes"),
    "Spring": ("Lettuce", "Tomatoes", "Eggs", "Salmon"),
    "Autumn": ("Apples", "Pork", "Potatoes", "Chicken"),
}
FAVOURITE_UPLIFT = 5

# Event groups and the codes of the request form.
PROMOTIONS = ("Special Promotion", "Seasonal Event")
OCCASIONS = ("Birthdays", "Corporate Event")
EVENT_CODES = {"None": 0, "Holiday": 1, "Daily event": 2, "Promotion": 3}
MODEL_NAMES = {
    "xgboost": "XGBoost",
    "catboost": "CatBoost",
    "lightgbm": "LightGBM",
    "linearregression": "LinearRegression",
    "decisiontree": "DecisionTree",
    "decision_tree": "DecisionTree",
}

RESTOCK_BELOW = 10
MAX_GAP_DAYS = 4


def product_table(spark: SparkSession, products=PRODUCTS) -> DataFrame:
    columns = {
        "Product": "string",
        "Category": "string",
        "Shelf_Life": "int",
        "base_price": "double",
        "winter_factor": "double",
        "summer_factor": "double",
        "mild_factor": "double",
    }
    return inline_table(spark, products, columns)


def price_index(factors=INFLATION, first_year=FIRST_PRICE_YEAR) -> list[tuple[int, float]]:
    """`(year, index)`: the product of all factors before the year, up to one year past them."""
    indexes = accumulate(factors, mul, initial=1.0)
    return list(enumerate(indexes, start=first_year))


def with_category(facts: DataFrame, products: DataFrame) -> DataFrame:
    """Category of the product, `Other` when unknown."""
    lookup = F.broadcast(products.select("Product", "Category"))
    return facts.join(lookup, "Product", "left").withColumn(
        "Category", F.coalesce("Category", F.lit("Other"))
    )


def with_shelf_life(facts: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with `Shelf_Life`, and the facts whose product has none."""
    lookup = F.broadcast(products.select("Product", "Shelf_Life"))
    return facts.join(lookup, "Product"), facts.join(lookup, "Product", "left_anti")


def with_indexed_price(
    facts: DataFrame,
    products: DataFrame,
    date: str = "Date",
    index: list[tuple[int, float]] | None = None,
) -> DataFrame:
    """Add `Unit_Price` and `price_extrapolated`.

    Base price x inflation since 2004 x season factor, 2 decimals.  Years before the table
    count as its first year; years after it keep the last index and are flagged.  An unknown
    product costs 0.
    """
    index = index or price_index()
    low, high = index[0][0], index[-1][0]
    yearly = inline_table(facts.sparkSession, index, {"year": "int", "index": "double"})
    year = F.least(F.greatest(F.year(date), F.lit(low)), F.lit(high))
    dated = facts.withColumns(
        {"year": year, "price_extrapolated": F.year(date) > high, "_season": season(F.col(date))}
    )
    priced = dated.join(F.broadcast(yearly), "year", "left").join(
        F.broadcast(
            products.select("Product", "base_price", "winter_factor", "summer_factor", "mild_factor")
        ),
        "Product",
        "left",
    )
    factor = (
        F.when(F.col("_season") == "Winter", F.col("winter_factor"))
        .when(F.col("_season") == "Summer", F.col("summer_factor"))
        .otherwise(F.col("mild_factor"))
    )
    price = F.coalesce(F.col("base_price"), F.lit(0.0)) * F.col("index") * F.coalesce(factor, F.lit(1.0))
    return priced.withColumn("Unit_Price", F.round(price, 2)).drop(
        "year", "index", "_season", "base_price", "winter_factor", "summer_factor", "mild_factor"
    )


def restock_days(stocks: Column, shelf_life: Column) -> Column:
    return F.when(stocks < RESTOCK_BELOW, F.lit(1)).otherwise(shelf_life)


def event_group(event: Column, keep_grouped: bool = False) -> Column:
    """Holiday, Promotion, Daily event or None; anything else is null.

    A missing event and the text `None` both count as no event.  `keep_grouped` lets values
    that already name a group pass.
    """
    grouped = (
        F.when(event.isNull() | (event == "None"), F.lit("None"))
        .when(event.isin([name for name, _, _ in HOLIDAYS]), F.lit("Holiday"))
        .when(event.isin(list(PROMOTIONS)), F.lit("Promotion"))
        .when(event.isin(list(OCCASIONS)), F.lit("Daily event"))
    )
    return grouped.when(event.isin(list(EVENT_CODES)), event) if keep_grouped else grouped


def align_to_holiday(facts: DataFrame, date: str = "Date", reach_days: int = 3) -> DataFrame:
    """Move a date within reach of a holiday to the day before it; add `Event`."""
    holiday = next_holiday(F.col(date), reach_days)
    return (
        facts.withColumn("_holiday", holiday)
        .withColumn("Event", F.col("_holiday")["name"])
        .withColumn(date, purchase_date(F.col(date), F.col("_holiday")))
        .drop("_holiday")
    )


def purchase_gaps(
    facts: DataFrame, product: str = "Product", date: str = "Date", max_gap: int = MAX_GAP_DAYS
) -> DataFrame:
    """`product, date, purchases, previous, gap_days, over_limit`, one row per product and day.

    Days are counted before the window, so a product's window holds calendar days, not sales.
    """
    days = facts.groupBy(product, date).agg(F.count("*").alias("purchases"))
    previous = F.lag(date).over(Window.partitionBy(product).orderBy(date))
    gap = F.datediff(F.col(date), F.col("previous"))
    return (
        days.withColumn("previous", previous)
        .withColumn("gap_days", gap)
        .withColumn("over_limit", F.coalesce(gap > max_gap, F.lit(False)))
    )


def until(facts: DataFrame, end: Column, date: str = "Date") -> DataFrame:
    return facts.filter(F.col(date) <= end)


def season_uplift(season_name: Column, product: Column) -> Column:
    """Extra units for a season's favourites."""
    favoured = F.lit(False)
    for name, products in SEASON_FAVOURITES.items():
        favoured = favoured | ((season_name == name) & product.isin(list(products)))
    return F.when(favoured, F.lit(FAVOURITE_UPLIFT)).otherwise(F.lit(0))


def encode_event(event: Column) -> Column:
    """Code of a request's event name; null rejects it."""
    code = F.lit(None).cast("int")
    for name, number in EVENT_CODES.items():
        code = F.when(event == name, F.lit(number)).otherwise(code)
    return code


def model_name(name: Column) -> Column:
    """Proper spelling of a model name in any case; null rejects it."""
    spelling = F.create_map(*[F.lit(part) for pair in MODEL_NAMES.items() for part in pair])
    return F.try_element_at(spelling, F.lower(name))


def enrich(facts: DataFrame, date: str = "Date") -> DataFrame:
    """Season, weekday, category, shelf life, price and restock interval in one pass."""
    spark = facts.sparkSession
    products = product_table(spark)
    dated = facts.withColumns(
        {"Season": season(F.col(date)), "Day_of_Week": weekday_name(F.col(date))}
    )
    known, _ = with_shelf_life(with_category(dated, products), products)
    priced = with_indexed_price(known, products, date)
    return priced.withColumn(
        "Days_Until_Next_Purchase", restock_days(F.col("Stocks"), F.col("Shelf_Life"))
    )
