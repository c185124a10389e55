"""Row numbers without a single-task window.

`row_number()` pulls a whole group into one task, which fails for a group that holds a
third of all rows, and for no group at all.  Here a range sort spreads even one hot key over
many tasks; each row gets its place in its task, and only the per-task counts are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyseek.operators.sizing import materialize

# monotonically_increasing_id holds the partition above this bit, the row's place below it.
PLACE_BITS = 33


def sorted_places(df: DataFrame, order: list[str]) -> DataFrame:
    """Add `_part` and `_place`: the row's range partition and its place in it.

    The result is stored, so the places stay what they are however often they are read and
    whichever executor is lost.  Pass narrow rows: keys and the order columns.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_at", F.monotonically_increasing_id())
    return materialize(
        tagged.select(
            *df.columns,
            F.shiftright("_at", PLACE_BITS).cast("int").alias("_part"),
            F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place"),
        )
    )


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based position in the total order of `order`; one count per task is summed."""
    placed = sorted_places(df, order)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, stored: every job that reads the positions joins it.
    starts = materialize(
        counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_part", "_place", "_start")
    )


def with_group_position(
    df: DataFrame, group: list[str], order: list[str], name: str = "position"
) -> DataFrame:
    """0-based position of each row among the rows with the same `group`, by `order`.

    A group's rows in one task are contiguous, so the group needs one row per task it
    touches: its first place there and its count.
    """
    placed = sorted_places(df, [*group, *order])
    pieces = placed.groupBy("_part", *group).agg(
        F.min("_place").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = pieces.select(
        "_part", *group, "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    renamed = starts.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(group)})
    renamed = renamed.withColumnRenamed("_part", "_p")
    condition = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        condition = condition & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(renamed, condition).select(
        *df.columns, (F.col("_start") + F.col("_place") - F.col("_first")).alias(name)
    )
