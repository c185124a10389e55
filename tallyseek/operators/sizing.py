"""Size checks behind every broadcast, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it has at most this many narrow rows.
BROADCAST_ROWS = 1_000_000

# A key is hot when it holds at least 1/HOT_SHARE of all rows; shares add up to 1, so
# there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode with none configured.

    On several machines a temporary folder would be a different disk for each executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyseek-")
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into reliable storage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute once into a compressed columnar table next to the session's checkpoints: for wide rows, a fraction of `materialize`'s bytes."""
    path = run_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys over all shuffle partitions, for work that is heavy for its bytes: not merged at run time."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def wide_scan(df: DataFrame) -> DataFrame:
    """A scan of a stored table, dealt out if it has fewer tasks than there are cores.

    Work on texts costs far more than moving them once, and a small file is one task.  A large table is read by
    many tasks and stays where it is.  Only for plain scans, whose number of tasks is known without running them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if tasks >= cores else df.repartition(cores)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` has at most `rows` rows; reads no more than needed to tell."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def attach(
    facts: DataFrame, lookup: DataFrame, key: str, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Left join `facts` to a lookup with one row per key, whatever the key skew.

    A lookup within `rows` is broadcast.  Beyond that the hot keys' lookup rows (at most
    HOT_SHARE of them) are broadcast and only the facts with other keys are shuffled.
    """
    if fits(lookup, rows):
        return facts.join(F.broadcast(lookup), key, "left")
    hot = hot_keys(facts, key)
    hot_lookup = lookup.join(F.broadcast(hot), key, "left_semi")
    tagged = facts.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cold = tagged.filter(F.col("_hot").isNull()).drop("_hot").join(lookup, key, "left")
    warm = tagged.filter(F.col("_hot")).drop("_hot").join(F.broadcast(hot_lookup), key, "left")
    return cold.unionByName(warm)


def hot_keys(facts: DataFrame, key: str) -> DataFrame:
    """Keys that hold at least 1/HOT_SHARE of the rows: never more than HOT_SHARE rows."""
    counts = materialize(facts.filter(F.col(key).isNotNull()).groupBy(key).count())
    total = counts.agg(F.sum("count")).scalar()
    return counts.filter(F.col("count") * HOT_SHARE >= total).select(key)


def inline_table(spark: SparkSession, rows, columns: dict[str, str]) -> DataFrame:
    """A short fixed list as a one-partition table of literals."""
    structs = [
        F.struct(
            *[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns.items())]
        )
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, next to the session's checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"
