"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseek.operators.sizing import attach, materialize

# The six ASCII blanks: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_part(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """Written once to the session's checkpoint folder, so that lost executors cost no recomputation."""
    return materialize(df)


def connected(links: DataFrame) -> DataFrame:
    """Smallest member of each connected component: `links` (a, b) to rows (id, root).

    Every node points at the smallest id it has seen; each round takes the minimum over its
    neighbours and then follows the pointers twice (root of root), so a chain of n links needs about log n rounds.
    Only tables move: rows stay on the cluster, the driver sees one counter per round.  Ids without
    a link do not appear.  Null ends are ignored.
    """
    pairs = stored(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
        .select("p.a", "p.b")
        .distinct()
    )
    roots = stored(
        pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root"))
    )
    while True:
        seen = (
            pairs.join(roots.withColumnRenamed("id", "b"), "b")
            .groupBy("a")
            .agg(F.min("root").alias("near"))
        )
        lower = roots.join(seen.withColumnRenamed("a", "id"), "id").select(
            "id", "root", F.least("root", "near").alias("low")
        )
        # Hook the old root too, so that whole trees merge and not only their rim.
        hooks = lower.filter("low < root").groupBy(F.col("root").alias("id")).agg(F.min("low").alias("hook"))
        hooked = stored(
            lower.join(hooks, "id", "left").select("id", "root", F.least("low", "hook").alias("low"))
        )
        jump = hooked.select(F.col("id").alias("low"), F.col("low").alias("further"))
        nxt = stored(hooked.join(jump, "low").select("id", F.col("further").alias("root"), F.col("root").alias("old")))
        roots = nxt.select("id", "root")
        if nxt.filter("root <> old").isEmpty():
            return roots


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with a `_number` that tells them apart; add it to a table before a join, so that a sample is drawn below the join."""
    return docs.withColumn("_number", F.monotonically_increasing_id())


def bounded_sample(docs: DataFrame, key: str, rows: int, by: str | None = None) -> DataFrame:
    """About `rows` rows (per value of `by`, if given; none of a null one), all of them if there are fewer.  `_number` is used if `docs` has one.

    Only for fitting classifiers.  Every row has a draw of its own, from `key` and its number, so rows that share an id, or
    have none, are neither all in nor all out.  One counting pass; the share is a number, no sort and no limit, and values of `by` may be as
    many as they like.  Numbers hold for one reading: store what is read more than once.
    """
    told = docs if "_number" in docs.columns else numbered(docs)
    place = F.pmod(F.xxhash64(F.col(key), F.col("_number"), F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    if by is None:
        return told.filter(place < rows / max(docs.count(), 1)).select(docs.columns)
    counts = docs.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_of"))
    return attach(told, counts, by).filter(place < rows / F.col("_of")).select(docs.columns)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Columns of one length as one compressed value, so that a shuffle carries few and narrow rows."""
    raw = len(arrays[0]).to_bytes(4) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(4) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    """The columns of `pack`, given their types."""
    raw = pa.decompress(blob[4:], int.from_bytes(blob[:4]), codec="zstd", asbytes=True)
    n, at, out = int.from_bytes(raw[:4]), 4, []
    for kind in kinds:
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out
