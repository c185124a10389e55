import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyseek.functions import calendar as cal
from tallyseek.operators import features as ft
from tallyseek.operators import forecasting as fc
from tallyseek.operators import retail as rl
from tallyseek.operators.corpus_stats import keyed_normal
from tallyseek.operators.positions import with_group_position, with_position
from tallyseek.plans import forecast as fo

# Product, stock, category, price, shelf life and days until the next purchase on 2025-01-08.
GOLDEN = [
    ("Milk", 28, "Dairy", 56.38, 7, 7), ("Eggs", 6, "Dairy", 78.07, 21, 1),
    ("Chicken", 8, "Meat", 211.43, 5, 1), ("Tomatoes", 25, "Vegetables", 135.53, 10, 10),
    ("Apples", 23, "Fruits", 47.71, 30, 30), ("Salmon", 7, "Seafood", 399.01, 3, 1),
    ("Cheese", 22, "Dairy", 303.59, 9, 9), ("Lettuce", 24, "Vegetables", 65.06, 5, 5),
    ("Pork", 27, "Meat", 277.57, 7, 7), ("Potatoes", 30, "Vegetables", 15.18, 9, 9),
]


def test_enrichment_golden_rows(spark):
    facts = spark.createDataFrame(
        [(dt.date(2025, 1, 8), row[0], row[1]) for row in GOLDEN], "Date date, Product string, Stocks int"
    )
    got = {r.Product: r for r in rl.enrich(facts).collect()}
    for product, _, category, price, shelf, days in GOLDEN:
        row = got[product]
        assert (row.Season, row.Day_of_Week) == ("Winter", "Wednesday")
        assert (row.Category, row.Unit_Price, row.Shelf_Life) == (category, price, shelf)
        assert (row.Days_Until_Next_Purchase, row.price_extrapolated) == (days, False)


def test_prices_outside_the_index(spark):
    facts = spark.createDataFrame(
        [(dt.date(1990, 7, 1), "Milk"), (dt.date(2030, 7, 1), "Milk"), (dt.date(2010, 7, 1), "Tea")],
        "Date date, Product string",
    )
    got = {r.Date.year: r for r in rl.with_indexed_price(facts, rl.product_table(spark)).collect()}
    assert got[1990].Unit_Price == 4.8 and not got[1990].price_extrapolated
    assert got[2030].price_extrapolated
    assert got[2010].Unit_Price == 0


def test_holiday_alignment(spark):
    days = ["2024-01-01", "2023-12-30", "2024-03-05", "2024-03-04", "2024-11-08"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "Date date")
    moved = [(str(r.Date), r.Event) for r in rl.align_to_holiday(df).collect()]
    assert moved == [
        ("2023-12-31", "New Year"), ("2023-12-30", None), ("2024-03-07", "Women's Day"),
        ("2024-03-04", None), ("2024-11-08", "Day of Ukrainian Language"),
    ]


def test_date_parsing(spark):
    texts = ["08.01.2025", "8.1.2025", "31.02.2025", "2025-01-08", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.d for r in df.select(cal.parse_day_first(F.col("t")).alias("d")).collect()]
    assert got == [dt.date(2025, 1, 8), dt.date(2025, 1, 8), None, None, None]


def test_positions_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = {(r.k, r.v): r.position for r in with_group_position(df, ["k"], ["v"]).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert all(got["hot", v] == i for i, v in enumerate(hot))
    assert got["k3", 3] == 0
    total = {r.v: r.position for r in with_position(df, ["v"]).collect()}
    assert total == {i: i for i in range(300)}


def test_time_segments_sizes(spark):
    seg = fc.time_segments(spark.range(20).withColumnRenamed("id", "t"), ["t"])
    sizes = {r.segment: r["count"] for r in seg.groupBy("segment").count().collect()}
    assert sizes == {0: 5, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3}
    assert fc.train_rows(seg, 2).agg(F.max("t")).first()[0] == 7
    with pytest.raises(ValueError):
        fc.time_segments(spark.range(3).withColumnRenamed("id", "t"), ["t"])


def test_one_hot_rejects_or_keeps_unknown_values(spark):
    df = spark.createDataFrame([("Windy",)], "Weather string")
    kept = ft.one_hot(F.col("Weather"), "Weather", ft.FIXED_CATEGORIES["Weather"], "keep")
    assert set(df.select(*kept.values()).first()) == {0.0}
    strict = ft.one_hot(F.col("Weather"), "Weather", ft.FIXED_CATEGORIES["Weather"])
    with pytest.raises(PySparkException):
        df.select(*strict.values()).collect()


def test_standardize_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in (1, 2, 3, 4)], "x double, c double")
    got = ft.standardize(df, ["x", "c"]).orderBy("x").collect()
    assert [round(r.x, 4) for r in got] == [-1.3416, -0.4472, 0.4472, 1.3416]
    assert {r.c for r in got} == {0.0}


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "Purchase_Quantity double, prediction double")
    row = fc.regression_metrics(df).first()
    assert (round(row.mse, 6), round(row.mae, 6)) == (1.666667, 1.0)
    assert round(row.r2, 6) == 0.375


def facts(spark, years=range(2019, 2025)):
    rows = []
    for year in years:
        for day in range(1, 29):
            for i, (product, stock, category, price, shelf, days) in enumerate(GOLDEN):
                quantity = 10 + 2 * i + (5 if stock < 10 else 0)
                rows.append((dt.date(year, 1 + day % 12, day), product, stock + day % 3, 100 + day,
                             1000.0 + day, price, shelf, days, category, "Cloudy" if day % 2 else "Sunny",
                             "New Year" if day == 1 else None, quantity))
    df = spark.createDataFrame(
        rows,
        "Date date, Product string, Stocks int, Num_Customers int, Sales double, Unit_Price double,"
        " Shelf_Life int, Days_Until_Next_Purchase int, Category string, Weather string,"
        " Event string, Purchase_Quantity int",
    )
    return df.withColumns(
        {"Season": cal.season(F.col("Date")), "Day_of_Week": cal.weekday_name(F.col("Date"))}
    )


def test_train_and_predict(spark):
    train, test = fc.horizon_split(facts(spark), 2023)
    order = ["Date", "Product"]
    trained = fo.train("LinearRegression", train, test, order, with_event=True, noise=0.0, folds=3)
    assert trained.metrics["r2"] > 0.99
    tree = fo.train(
        "decision_tree", train, test, order,
        points=[{"max_depth": d, "min_split": 4, "min_leaf": 2} for d in (2, 6)], folds=2,
    )
    assert tree.params["max_depth"] == 6
    assert [row["max_depth"] for row in tree.board] == [6, 6, 2, 6, 2]
    record = fo.run_record(spark, tree).first()
    assert record.model == "DecisionTree" and record.mse >= 0
    recipe = ft.Recipe.from_json(trained.recipe.to_json())
    assert recipe == trained.recipe
    scored = fo.predict(trained, test)
    assert "Predict_Quantity" in scored.columns and "Purchase_Quantity" not in scored.columns
    assert fo.predict_test(trained, test).count() == test.count()
    days = spark.createDataFrame(
        [(dt.date(2025, 1, 8), "Holiday", 5508, 3.4e6, 12, "Snowy")],
        "Date date, Event string, Num_Customers int, Sales double, Stocks int, Weather string",
    )
    assert fo.predict(trained, fo.forecast_rows(days)).count() == 10
    with pytest.raises(ValueError):
        fo.forecast_rows(days.withColumn("Event", F.lit("Party")))
    with pytest.raises(ValueError):
        fo.resolve_model("prophet")


def test_trees_are_fitted_on_few_partitions(spark):
    """Statistics of a tree's nodes travel once per partition, so these are bound by the cores, and no row is lost."""

    class Seen:
        def fit(self, rows):
            return rows.rdd.getNumPartitions(), rows.count()

    rows = spark.range(100, numPartitions=60).select(F.col("id").alias("Purchase_Quantity"), F.lit(0).alias("features"))
    assert fc.fit_rows(Seen(), rows) == (2 * spark.sparkContext.defaultParallelism, 100)


def test_noise_is_keyed(spark):
    df = spark.range(2000).select(F.array(F.lit(0.0), F.lit(0.0)).alias("v"), F.col("id").alias("k"))
    noise = lambda d: {r.k: tuple(r.n) for r in d.select("k", ft.noisy(F.col("v"), F.col("k")).alias("n")).collect()}
    first = noise(df)
    assert first == noise(df.repartition(5))
    values = [x for pair in first.values() for x in pair]
    mean = sum(values) / len(values)
    assert abs(mean) < 0.01 and 0.09 < (sum(v * v for v in values) / len(values)) ** 0.5 < 0.11
    assert len(set(values)) == len(values)


def test_noise_in_batches_is_the_keyed_draw(spark):
    """A batch of rows draws what the column expression does: long and null keys, no values, arrays of several lengths."""
    df = spark.createDataFrame(
        [(-(2**62), [0.0] * 3), (7, [1.0]), (None, [0.0, 2.0]), (8, []), (9, None)], "k long, v array<double>"
    )
    rows = df.select("k", "v", ft.noisy(F.col("v"), F.col("k"), 0.5, 42).alias("n")).collect()
    assert [r.n is None for r in rows] == [False] * 4 + [True]
    for r in rows[:4]:
        draws = [spark.range(1).select(keyed_normal(F.lit(r.k).cast("long"), 42 + i)).scalar() for i in range(len(r.v))]
        draws = spark.range(1).select(F.array(*draws).cast("array<double>").alias("d")).first().d
        assert r.n == pytest.approx([v + 0.5 * d for v, d in zip(r.v, draws)], abs=1e-12)


def test_requests_are_validated(spark):
    requests = spark.createDataFrame(
        [("08.01.2025", "Holiday", "CatBoost"), ("2025", "Holiday", "CatBoost"),
         ("08.01.2025", "Party", "CatBoost"), ("08.01.2025", "None", "prophet")],
        "date string, event string, model string",
    )
    good, bad = fo.validated_requests(requests)
    assert good.count() == 1 and bad.count() == 3


def test_least_squares_of_all_folds_read_the_rows_once(spark, monkeypatch):
    """Every fold's fit and the refit are those of all their rows, without fitting on the rows themselves."""
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a, b = rng.normal(size=2).tolist()
        # The third is twice the first, the fourth starts in the third segment, the fifth is constant.
        rows.append((i // 70, [a, b, 2 * a, float(i > 200 and i % 3 == 0), 0.1], 3 * a - b + 50.0 + i % 5))
    df = spark.createDataFrame(rows, "segment int, v array<double>, Purchase_Quantity double")
    segmented = df.select("segment", "Purchase_Quantity", array_to_vector("v").alias("features"))
    whole = {fold: fc.linear_regression().fit(fc.train_rows(segmented, fold)) for fold in (1, 3, 5, 9)}
    sizes, plain = [], fc.LinearRegression.fit
    monkeypatch.setattr(fc.LinearRegression, "fit", lambda self, rows: sizes.append(rows.count()) or plain(self, rows))
    fit = fc.segment_fit(segmented, fc.linear_regression())
    for fold, model in whole.items():
        mine = {r.i: r.prediction for r in fit(fold).transform(segmented.withColumn("i", F.xxhash64("features"))).collect()}
        for r in model.transform(fc.train_rows(segmented, fold).withColumn("i", F.xxhash64("features"))).collect():
            assert abs(mine[r.i] - r.prediction) < 1e-4
    result = fc.grid_search(segmented, fc.MODELS["LinearRegression"])
    assert abs(result.rows[0]["mean_mse"] - 2) < 0.5 and result.params == {}
    assert len(sizes) == len(whole) + 6 and max(sizes) <= 12
    broken = segmented.withColumn("Purchase_Quantity", F.when(F.col("segment") < 2, F.col("Purchase_Quantity")))
    with pytest.raises(Exception, match="finite"):
        fc.segment_fit(broken, fc.linear_regression())


def test_recipe_has_the_scales_of_the_raw_features(spark):
    """An unknown category counts as none, and a missing number is an error, in the scales as in the vectors."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    some = facts(spark, range(2019, 2021))
    holes = some.withColumn("Weather", F.when(F.col("Num_Customers") % 5 > 0, F.col("Weather")))
    for df in (some, holes, some.unionByName(holes)):
        recipe = ft.fit_recipe(df, with_event=True)
        grouped = df.withColumn("Event_Grouped", rl.event_group(F.col("Event"), keep_grouped=True))
        raw = ft.encoded_columns(recipe.categories, True, "keep")
        vectors = grouped.select(array_to_vector(F.array(*raw.values())).alias("raw"))
        stats = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("raw")).alias("s")).select("s.*").first()
        assert recipe.columns == list(raw)
        for c, mean, variance in zip(raw, stats["mean"], stats["variance"]):
            deviation = (variance * (stats["count"] - 1) / stats["count"]) ** 0.5
            assert recipe.means[c] == pytest.approx(mean, abs=1e-12) and recipe.deviations[c] == pytest.approx(deviation, abs=1e-9)
    with pytest.raises(PySparkException):
        ft.fit_recipe(some.withColumn("Stocks", F.when(F.col("Num_Customers") % 7 > 0, F.col("Stocks"))))
    assert ft.category_counts(holes, ("Weather",))["Weather"] == {
        r.Weather: r["count"] for r in holes.filter("Weather IS NOT NULL").groupBy("Weather").count().collect()
    }


def test_a_forecast_computes_its_facts_once(spark, monkeypatch):
    from tallyseek.plans import queries_forecast as qf

    asked = []
    lines = facts(spark, range(1998, 2002)).withColumns({c: F.lit(1) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")})
    monkeypatch.setattr(qf, "retail_facts", lambda *_: asked.append(1) or lines)
    row = qf.linear_forecast(spark, "").first()
    assert (row.tested, row.consistent, asked) == (280, True, [1])
