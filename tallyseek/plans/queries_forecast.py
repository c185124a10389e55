"""Model training and scoring queries over the retail facts: full presets, all years.

Training rows are all years up to LAST_TRAIN_YEAR, test rows the year after, the last in the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyseek.operators.forecasting import horizon_split, regression_metrics, rows_to_table
from tallyseek.operators.sizing import run_folder, store
from tallyseek.plans.facts import FACT_ORDER, retail_facts, table, with_events
from tallyseek.plans.forecast import (
    fit_preset,
    forecast_rows,
    predict,
    predict_test,
    run_record,
    train,
)
from tallyseek.plans.queries_retail import LINES_SQL
from tallyseek.plans.registry import query
from tallyseek.sources.tables import read_predictions, write_predictions

LAST_TRAIN_YEAR = 2000

TEST_ROWS = f"(WITH {LINES_SQL} SELECT count(*) FROM lines WHERE year(Date) = {LAST_TRAIN_YEAR + 1})"


def _parts(spark, folder, with_event=False):
    """Training facts, and test facts stored: a model is tested and its predictions are checked or written on the same rows."""
    facts = retail_facts(spark, folder)
    train_facts, test_facts = horizon_split(with_events(facts) if with_event else facts, LAST_TRAIN_YEAR)
    return train_facts, store(test_facts, "tested")


def _trained(parts, name, noise=0.1):
    return train(name, *parts, FACT_ORDER, noise=noise)


def _checked_record(spark, test_facts, trained):
    """Model and parameters, tested rows, and whether metrics and predictions are consistent."""
    scored = predict_test(trained, test_facts)
    again = regression_metrics(scored, prediction="Predicted_Purchase_Quantity").first()
    same = all(abs(again[k] - trained.metrics[k]) <= 1e-6 * max(1.0, abs(again[k])) for k in ("mse", "rmse", "mae", "r2"))
    return run_record(spark, trained).select(
        "model", "params", F.lit(scored.count()).cast("long").alias("tested"), F.lit(same).alias("consistent"),
        # The target is near its mean's error or better: a fit that learned nothing is at 0.
        (F.col("r2") > -0.05).alias("sane"),
    )


def _record_sql(model: str, params: str) -> str:
    return f"""SELECT '{model}' AS model, '{params}' AS params, {TEST_ROWS} AS tested,
  true AS consistent, true AS sane"""


@query("linear_forecast", _record_sql("LinearRegression", ""))
def linear_forecast(spark, folder):
    parts = _parts(spark, folder)
    return _checked_record(spark, parts[1], _trained(parts, "LinearRegression", noise=0.0))


@query("tree_forecast", _record_sql("DecisionTree", "max_depth=14, min_split=16, min_leaf=15"))
def tree_forecast(spark, folder):
    """The tree preset by its five folds."""
    parts = _parts(spark, folder)
    return _checked_record(spark, parts[1], _trained(parts, "decision_tree"))


def _preset_record(spark, folder, name):
    parts = _parts(spark, folder)
    trained = fit_preset(name, *parts, FACT_ORDER, path=run_folder(spark, "encoded"))
    return _checked_record(spark, parts[1], trained)


@query("gbt_forecast_a", _record_sql("CatBoost", "rounds=500, rate=0.04, depth=7"))
def gbt_forecast_a(spark, folder):
    """The first boosting preset, fitted once over its saved encoded table."""
    return _preset_record(spark, folder, "CatBoost")


@query("gbt_forecast_b", _record_sql("LightGBM", "rounds=200, rate=0.1, depth=7"))
def gbt_forecast_b(spark, folder):
    return _preset_record(spark, folder, "LightGBM")


@query("gbt_forecast_c", _record_sql("XGBoost", "rounds=50, rate=0.15, depth=8"))
def gbt_forecast_c(spark, folder):
    return _preset_record(spark, folder, "XGBoost")


@query(
    "model_leaderboard",
    """SELECT unnest([1, 2, 3, 4, 5]) AS place, 14 AS max_depth, 16 AS min_split, 15 AS min_leaf, true AS ordered""",
)
def model_leaderboard(spark, folder):
    """The tree preset's grid over five time folds, five rows spread over the sorted grid."""
    board = _trained(_parts(spark, folder), "DecisionTree").board
    rows = [
        {"place": i + 1, **{k: row[k] for k in ("max_depth", "min_split", "min_leaf")},
         "ordered": row["mean_mse"] >= board[0]["mean_mse"] and row["std_mse"] >= 0}
        for i, row in enumerate(board)
    ]
    table_ = rows_to_table(spark, rows)
    return table_.select(*[F.col(c).cast("int") for c in ("place", "max_depth", "min_split", "min_leaf")], "ordered")


@query(
    "stored_predictions",
    f"SELECT 'DecisionTree' AS model, {TEST_ROWS} AS rows, true AS bounded",
)
def stored_predictions(spark, folder):
    """Test predictions of two models stored by model, one of them twice; one model read back."""
    parts = _parts(spark, folder)
    path = run_folder(spark, "predictions")
    linear = _trained(parts, "LinearRegression", noise=0.0)
    tree = fit_preset("DecisionTree", *parts, FACT_ORDER)
    for trained in (linear, tree, tree):
        write_predictions(predict_test(trained, parts[1]), path)
    guess = F.col("Predicted_Purchase_Quantity")
    return read_predictions(spark, path, "DecisionTree").groupBy("model").agg(
        F.count("*").alias("rows"), F.every(guess.between(1, 50)).alias("bounded")
    )


@query(
    "event_day_forecast",
    """SELECT count(DISTINCT o_orderdate::DATE) * 20 AS rows, count(DISTINCT o_orderdate::DATE) AS days,
  true AS events_differ FROM orders""",
)
def event_day_forecast(spark, folder):
    """Quantities of the ten products for every order day, with a holiday and without one.

    The model is trained with events, so the event changes the forecast of the same day.
    """
    trained = train(
        "LinearRegression", *_parts(spark, folder, with_event=True), FACT_ORDER, with_event=True, noise=0.0
    )
    orders = table(spark, folder, "orders").withColumn("Date", F.to_date("o_orderdate"))
    daily = orders.groupBy("Date").agg(
        F.count("*").cast("int").alias("Num_Customers"), F.sum("o_totalprice").alias("Sales")
    )
    days = daily.withColumns(
        {
            "Event": F.explode(F.array(F.lit("Holiday"), F.lit("None"))),
            "Stocks": F.lit(12),
            "Weather": F.lit("Cloudy"),
        }
    )
    both = predict(trained, forecast_rows(days)).groupBy("Date", "Product").agg(
        F.count("*").alias("n"),
        (F.max("Predict_Quantity") - F.min("Predict_Quantity")).alias("difference"),
    )
    return both.agg(
        F.sum("n").alias("rows"),
        F.count_distinct("Date").alias("days"),
        F.every(F.col("difference") > 1e-9).alias("events_differ"),
    )
