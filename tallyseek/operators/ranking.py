"""Top-k selection shared by every ranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores are compared at this precision, so two equal texts tie in spite of float sums
# that were added up in another order; ties then go to the smaller id.
RANK_DECIMALS = 9


def comparable(score: Column) -> Column:
    return F.round(score, RANK_DECIMALS)


def top_k(
    scores: DataFrame,
    k: int,
    query: str = "query_id",
    item: str = "chunk_id",
    score: str = "score",
    ascending: bool = False,
) -> DataFrame:
    """The k best items per query with `rank` from 1.

    `row_number() <= k` runs below the shuffle first, so each task sends at most k rows per
    query.
    """
    value = comparable(F.col(score))
    order = Window.partitionBy(query).orderBy(
        value.asc() if ascending else value.desc(), F.col(item).asc()
    )
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_lists(ranking: DataFrame, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """One row per query: item ids joined by blanks, best first."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("id"))))
    return ranking.groupBy(query).agg(
        F.array_join(F.transform(pairs, lambda pair: pair["id"]), " ").alias("doc_id")
    )


def parse_ranked_lists(lists: DataFrame, query: str = "query_id") -> DataFrame:
    """Inverse of `ranked_lists`: one row per id, rank from 1."""
    exploded = lists.select(query, F.posexplode(F.split("doc_id", " ")).alias("pos", "chunk_id"))
    return exploded.filter(F.col("chunk_id") != "").select(
        query, "chunk_id", (F.col("pos") + 1).alias("rank")
    )
