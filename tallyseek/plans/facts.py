"""The shared test tables seen as corpus, questions and retail facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseek.functions.calendar import next_holiday, season, weekday_name
from tallyseek.operators.retail import PRODUCTS, product_table, restock_days
from tallyseek.operators.sizing import attach, inline_table, materialize, wide_scan
from tallyseek.plans.forecast import seasonal_weather_table

# Total order of the facts: (l_orderkey, l_linenumber) repeats.
FACT_ORDER = ["Date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "Unit_Price"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a file stream.

    The path is a pattern: a table is one file or a folder of files, and a stream's plain path must be a folder.
    """
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}.parquet}}")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source"
    )
    return wide_scan(docs)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def product_names(spark: SparkSession) -> DataFrame:
    """`slot, Product` in the order of the product list."""
    rows = [(slot, row[0]) for slot, row in enumerate(PRODUCTS)]
    return inline_table(spark, rows, {"slot": "bigint", "Product": "string"})


def sales_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with `Date, Product, Stocks, Unit_Price, Purchase_Quantity`."""
    lines = table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("Date"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("Unit_Price"),
        F.col("l_quantity").cast("int").alias("Purchase_Quantity"),
        (F.col("l_partkey") % len(PRODUCTS)).alias("slot"),
    )
    sizes = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("Stocks")
    )
    named = lines.join(F.broadcast(product_names(spark)), "slot").drop("slot")
    return attach(named, sizes, "l_partkey")


def retail_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with every column a forecast recipe reads.

    Customers and sales of a day come from its orders; the weather is one of the season's
    kinds, picked by the day of the month.
    """
    # One row per calendar day, stored: the size check and the join read it.
    daily = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(
        F.count("*").cast("int").alias("Num_Customers"), F.sum("o_totalprice").alias("Sales")
    )
    daily = materialize(daily.filter(F.col("Date").isNotNull()))
    dated = sales_lines(spark, folder).withColumns(
        {
            "Season": season(F.col("Date")),
            "Day_of_Week": weekday_name(F.col("Date")),
            "place": F.dayofmonth("Date") % 3,
            "Event": F.lit(None).cast("string"),
        }
    )
    products = product_table(spark).select("Product", "Category", "Shelf_Life")
    return (
        attach(dated, daily, "Date")
        .join(F.broadcast(seasonal_weather_table(spark)), ["Season", "place"])
        .drop("place")
        .join(F.broadcast(products), "Product")
        .fillna({"Num_Customers": 0, "Sales": 0.0})
        .withColumn("Days_Until_Next_Purchase", restock_days(F.col("Stocks"), F.col("Shelf_Life")))
    )


def with_events(facts: DataFrame) -> DataFrame:
    """Facts whose sales within three days before a holiday carry its name as the event."""
    return facts.withColumn("Event", next_holiday(F.col("Date"))["name"])
