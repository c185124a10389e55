"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyseek.llm.common import WORD, stored, text_or_empty
from tallyseek.operators.positions import with_position

# Hash digits (hexadecimal) per histogram level, and levels: 3 digits are 4096 buckets; 5 levels use 60 bits.
DIGITS, LEVELS = 3, 5
SHARE = 1.5
MOST_REPEATS = 2.0
WEIGHTS = (3.0, 1.0, 2.0)


def words(column: str = "text") -> Column:
    """Number of words; a null text has none."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """(source, source_size, target): budgets by weight, none above `most` times its source's size.

    `sizes` has one row per source.  Weights go to sources by code point, null last, repeating.  The
    total is `share` of all sizes.  Each round fixes the sources whose share by weight exceeds their limit and
    shares the rest anew, until none is above; a round is one aggregate over sources.
    """
    placed = with_position(
        sizes.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], "place"
    ).drop("_null")
    table = stored(
        placed.withColumn(
            "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
        )
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, limit = None, F.col("source_size") * F.lit(most)
    while True:
        free = F.lit(True) if level is None else (F.col("weight") * F.lit(level) <= limit)
        row = table.agg(
            F.sum(F.when(free, 0.0).otherwise(limit)).alias("fixed"),
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        new = (share * total - row["fixed"]) / row["weight"]
        if level is not None and new == level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level), limit) if level is not None else limit
    return table.select("source", "source_size", target.cast("double").alias("target"))


def draw(*parts: Column) -> Column:
    """60 hash bits of values as 15 hexadecimal digits: fixed, so reruns and other engines draw the same."""
    joined = F.concat_ws(":", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts])
    return F.substring(F.md5(joined.cast("binary")), 1, DIGITS * LEVELS)


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_REPEATS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; with `row_col` (a number that tells rows apart) also row.

    A source whose target is r times its size takes every document floor(r) times; the rest of its
    budget goes to the documents with the smallest hashes.  The hash threshold is found from
    histograms of words by source and hash bucket: all buckets below the one where the budget runs out are taken, and only
    that bucket is split further, level by level.  The document on the threshold is taken in part, so a source's taken words are its target rounded down.
    Hashes are of id and text; if equal rows of both meet on the threshold, it is refined further by a hash of the row's number, so that
    a source's words come out the same however many of its ids are null or repeated.
    Null texts and empty texts have size 0 and take 0; null sources are one source; an empty table gives no rows.
    """
    spark = docs.sparkSession
    narrow = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words(text_col).alias("size"),
            draw(F.col(id_col), F.col(text_col)).alias("h"),
            (F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()).alias("row"),
        ).withColumn("h", F.concat("h", draw(F.col("row"))))
    )
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    )
    # State of the search per source: hash prefix of the open bucket and the words still wanted inside it.
    state = stored(
        targets.withColumn("rest", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long"))
        .withColumn("prefix", F.lit(""))
    )
    level = 0
    # The second half of the levels tells equal rows apart and is needed only if some meet on a threshold.
    while level < LEVELS or (level < 2 * LEVELS and not state.filter("rest > 0 AND edge_rows > 1").isEmpty()):
        level += 1
        upto = DIGITS * level
        inside = narrow.filter("size > 0").join(
            state.filter("rest > 0").select(F.col("source").alias("s"), "prefix"),
            F.col("source").eqNullSafe(F.col("s")) & F.col("h").startswith(F.col("prefix")),
        )
        bucket = F.substring("h", 1, upto).alias("bucket")
        hist = inside.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        # At most 4096 buckets per source and level.
        running = hist.select(
            F.col("source").alias("s"),
            "bucket",
            "words",
            "n",
            F.sum("words").over(Window.partitionBy("source").orderBy("bucket")).alias("upto"),
        )
        open_bucket = (
            running.join(
                state.select(F.col("source").alias("t"), F.col("rest").alias("wanted")), F.col("s").eqNullSafe(F.col("t"))
            )
            .filter("upto > wanted AND upto - words <= wanted")
            .groupBy("s")
            .agg(F.min(F.struct("bucket", (F.col("wanted") - F.col("upto") + F.col("words")).alias("left"), "words", "n")).alias("b"))
        )
        joined = state.join(open_bucket, F.col("source").eqNullSafe(F.col("s")), "left")
        state = stored(
            joined.select(
                "source", "source_size", "target", "whole",
                F.when(F.col("b").isNotNull(), F.col("b.left")).otherwise(F.col("rest")).alias("rest"),
                F.coalesce("b.bucket", "prefix").alias("prefix"),
                F.when(F.col("b").isNotNull(), F.col("b.words")).alias("edge_words"),
                F.when(F.col("b").isNotNull(), F.col("b.n")).alias("edge_rows"),
            )
        )
    thresholds = state.withColumnRenamed("source", "s")
    known = F.substring("h", 1, DIGITS * level)
    part = (
        F.when(known < F.col("prefix"), F.col("size"))
        .when(
            (known == F.col("prefix")) & (F.col("edge_words") > 0),
            F.floor(F.col("rest") * F.col("size") / F.col("edge_words")),
        )
        .otherwise(F.lit(0))
        .cast("long")
    )
    return narrow.join(thresholds, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"), *(["row"] if row_col else [])
    )
