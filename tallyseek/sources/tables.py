"""Chunk, index and result tables: write, read, combine, repair, list, delete."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseek.functions.text import whitespace_tokens, word_tokens
from tallyseek.operators.dense import hashed_embedding
from tallyseek.operators.lexical import (
    LexicalIndex,
    chunk_rows,
    dealt,
    idf_table,
    index_of,
    term_rows,
)
from tallyseek.operators.pruning import frequent_terms
from tallyseek.operators.positions import with_group_position
from tallyseek.operators.ranking import ranked_lists
from tallyseek.operators.sizing import materialize


# Folders of a chunk table, and files per folder and write.
SOURCE_BUCKETS, BUCKET_FILES = 64, 8


def source_bucket(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(SOURCE_BUCKETS)).cast("int")


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks in folders by a hash of their source; `source` stays a text column.

    Rows are placed first, so a folder gets a few files however many sources or tasks there
    are, and a source with most of the rows still spreads over several writers.
    """
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(BUCKET_FILES))
    placed = chunks.withColumn("bucket", source_bucket(F.col("source")))
    placed.repartition(F.col("bucket"), salt).write.mode(mode).partitionBy("bucket").parquet(path)


def read_stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def delete_stored_source(spark: SparkSession, path: str, source: str | None) -> None:
    """Remove a source's rows from a stored chunk table; only its folder is rewritten."""
    bucket = spark.range(1).select(source_bucket(F.lit(source).cast("string"))).first()[0]
    stored = spark.read.parquet(path).filter(F.col("bucket") == bucket).drop("bucket")
    # Stored aside first: the folder that is read is the one that is overwritten.
    left = materialize(delete_source(stored, source))
    left.write.mode("overwrite").parquet(f"{path}/bucket={bucket}")


def write_chunk_csv(chunks: DataFrame, path: str) -> None:
    """`chunk_id, content` as CSV with doubled quotes."""
    chunks.select("chunk_id", "content").write.mode("overwrite").options(
        header=True, quote='"', escape='"'
    ).csv(path)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.select("chunk_id", "embedding").write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_embeddings_tsv(embeddings: DataFrame, path: str) -> None:
    """Id and components separated by tabs."""
    embeddings_tsv(embeddings).write.mode("overwrite").text(path)


def embeddings_tsv(embeddings: DataFrame) -> DataFrame:
    parts = F.transform("embedding", lambda component: component.cast("string"))
    return embeddings.select(
        F.concat_ws("\t", F.col("chunk_id").cast("string"), parts).alias("value")
    )


def read_embeddings_tsv(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return (
        spark.read.text(path)
        .filter(~F.col("value").startswith("news_id\t"))
        .select(
            parts[0].alias("chunk_id"),
            F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("embedding"),
        )
    )


def write_index(chunks: DataFrame, path: str, tokenizer=whitespace_tokens) -> LexicalIndex:
    """Build and write the index; every table but the first is counted from the written rows.

    Rows are sorted by term within each file, so a reader that asks for few terms skips row
    groups.
    """
    spark = chunks.sparkSession
    rows = term_rows(dealt(chunks), tokenizer)
    rows.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    written = index_of(rows)
    written.terms.write.mode("overwrite").parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    frequent_terms(terms).write.mode("overwrite").parquet(f"{path}/frequent")
    idf = idf_table(terms, written.corpus.select("n").scalar())
    chunk_rows(rows, spark.read.parquet(f"{path}/frequent"), idf).write.mode("overwrite").parquet(f"{path}/chunks")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    """Index over written tables; a missing table is an error."""
    try:
        index = index_of(spark.read.parquet(f"{path}/rows"))
        chunks, terms, frequent = (spark.read.parquet(f"{path}/{name}") for name in ("chunks", "terms", "frequent"))
    except AnalysisException as missing:
        raise FileNotFoundError(f"no index under {path}") from missing
    return replace(index, chunks=chunks, terms=terms, frequent=frequent, has_norms=True)


def combine_sources(chunk_tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, chunk_tables)


def repair_ids(chunks: DataFrame, key: str = "chunk_id", order=("source", "pos")) -> DataFrame:
    """Make ids unique: the first row keeps its id, the i-th repeat becomes `id_i`.

    Only the narrow keys are numbered, in a range sort that splits one hot id over many
    tasks.  Rows carry a number of their own, so rows that are equal in `order` are told apart
    too.  A new id that another row has already is repaired in turn; null ids are one id, `null`.
    """
    rows = materialize(
        chunks.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("null"))).withColumn(
            "_row", F.monotonically_increasing_id()
        )
    )
    ids = rows.select("_row", F.col(key).alias("_id"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    places = [f"_o{i}" for i in range(len(order))] + ["_row"]
    while True:
        numbered = with_group_position(ids, ["_id"], places, "_repeat")
        ids = materialize(
            numbered.withColumn(
                "_id",
                F.when(F.col("_repeat") > 0, F.concat_ws("_", "_id", F.col("_repeat").cast("string"))).otherwise(F.col("_id")),
            ).drop("_repeat")
        )
        if ids.groupBy("_id").count().filter("count > 1").isEmpty():
            break
    return (
        rows.drop(key)
        .join(ids.select("_row", F.col("_id").alias(key)), "_row")
        .select(*chunks.columns)
    )


def delete_source(chunks: DataFrame, source: str | None) -> DataFrame:
    """All rows of other sources; rows without a source are a source of their own."""
    return chunks.filter(~F.col("source").eqNullSafe(F.lit(source)))


def list_sources(chunks: DataFrame) -> DataFrame:
    """`source, chunks`; no rows means there are no datasets."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"))


def reindex(chunks: DataFrame, path: str, tokenizer=whitespace_tokens) -> LexicalIndex | None:
    """Rebuild the term index; None, and an index without rows, when no chunk is left."""
    index = write_index(chunks, path, tokenizer)
    return index if chunks.head(1) else None


def reindex_all(cleaned: DataFrame, raw: DataFrame, path: str) -> None:
    """Rebuild the three indexes of a corpus: terms for BM25+, TF-IDF with norms, vectors.

    `cleaned` and `raw` hold `chunk_id, content`.  A corpus without chunks leaves empty tables, so
    nothing of an earlier corpus can be found.
    """
    spark = raw.sparkSession
    write_index(cleaned, f"{path}/bm25")
    write_index(raw, f"{path}/tfidf", word_tokens)
    vectors = hashed_embedding(raw, "chunk_id", F.col("content"))
    write_embeddings(vectors, f"{path}/vectors")
    spark.catalog.refreshByPath(path)


def read_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The stored table, or `build()` stored and read back."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("ignore").parquet(path)
        return spark.read.parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions by model; a model that is stored again replaces its earlier rows."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "model"
    ).parquet(path)


def read_predictions(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Rows of one model; only its folder is read."""
    return spark.read.parquet(path).filter(F.col("model") == model)


def write_ranking(rankings: Mapping[str, DataFrame], questions: DataFrame, path: str) -> None:
    """`question, doc_id` CSV per ranker."""
    for model, ranking in rankings.items():
        result_table(ranking, questions).write.mode("overwrite").options(
            header=True, quote='"', escape='"'
        ).csv(f"{path}/{model}")


def result_table(ranking: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question: its text and the ids of its best chunks, best first."""
    lists = ranked_lists(ranking)
    return questions.select("query_id", "question").join(lists, "query_id", "left")
