"""Corpus pipeline: language ID, exact dedup, near-dedup, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of `documents`; the last one adds
how many words the mix takes.  `run` writes each stage's result to the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseek.llm import common, decontamination, exact_dedup, language_id, mixing, near_dedup
from tallyseek.operators.sizing import run_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with an identifiable language; `und` (null, or without a letter) goes.

    The model learns from the documents' own non-null languages.
    """
    model = language_id.fit_backoff(docs)
    return language_id.identify(docs, model, COLUMNS).filter("lang_pred <> 'und'").select(COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (blanks normalised) the row with the smallest id stays."""
    return _keep(docs, lambda given: exact_dedup.exact_dedup(given, row_col="_row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return _keep(docs, lambda given: near_dedup.near_dedup(given, row_col="_row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; other rows with the same or a null id stay."""
    numbered = _numbered(docs)
    found = decontamination.contaminated(numbered, common.table(spark, sf_dir, "benchmark"), row_col="_row")
    leaks = found.select("row").distinct()
    return numbered.join(leaks, F.col("_row") == F.col("row"), "left_anti").select(COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with size, source_size, target and taken."""
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    taken = mixing.mix_sources(numbered, row_col="_row").filter("taken > 0").drop("doc_id")
    return numbered.join(taken.hint("shuffle_hash"), F.col("_row") == F.col("row")).drop("_row", "row")


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row"))


def _keep(docs: DataFrame, decide) -> DataFrame:
    """The rows that `decide` keeps.

    Rows are told by their number in the stored table, the same at every read, so repeated rows and ids are no exception.
    """
    numbered = _numbered(docs)
    stay = decide(numbered).filter("kept").select("row").hint("shuffle_hash")
    return numbered.join(stay, F.col("_row") == F.col("row"), "left_semi").select(COLUMNS)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = common.table(spark, sf_dir, "documents")
    folder = run_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


# SQL cannot express language ID, signatures and fingerprints; tests compare each stage with a brute-force version.
ORACLE_SQL = None
