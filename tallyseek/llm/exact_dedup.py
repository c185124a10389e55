"""Exact dedup by sorting the content.

Texts are normalised, dealt to sampled ranges of their leading bytes, sorted inside each range with
Spark's spilling sort, and compared in full with their neighbour.  A group of copies larger than one
range is split over several ranges by id; at most two runs per range touch a border, and only those are joined up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseek.llm.common import BLANKS, stored, text_or_empty

# Leading characters that the sampled splitters carry; longer common prefixes are split by digest and id.
SPLITTER_CHARS = 48

RUNS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("run", T.LongType()),
        T.StructField("first", T.BooleanType()),
        T.StructField("last_run", T.BooleanType()),
        T.StructField("run_keep", T.LongType()),
        T.StructField("run_size", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)


def normalised(column: str = "text"):
    """Runs of ASCII blanks become one space; null becomes the empty text."""
    return F.regexp_replace(text_or_empty(column), BLANKS, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbouring texts in one sorted range; keeps ids and digests, never texts."""
    ids, digests, rows, starts, before = [], [], [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index("norm"))
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = ~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        if before is not None:
            new[0] = texts[0].as_py() != before
        before = texts[-1].as_py()
        ids.append(batch.column(batch.schema.get_field_index("doc_id")))
        digests.append(batch.column(batch.schema.get_field_index("digest")))
        rows.append(batch.column(batch.schema.get_field_index("row")))
        starts.append(new)
    if not ids:
        return
    new = np.concatenate(starts)
    run = np.cumsum(new) - 1
    all_ids = pa.chunked_array(ids).combine_chunks()
    keeps = all_ids.take(pa.array(np.flatnonzero(new)))
    sizes = np.bincount(run)
    part = TaskContext.get().partitionId()
    whole = pa.RecordBatch.from_arrays(
        [
            all_ids,
            pa.chunked_array(digests).combine_chunks(),
            pa.array(np.full(len(run), part, dtype=np.int32)),
            pa.array(run.astype(np.int64)),
            pa.array(new),
            pa.array(run == run[-1]),
            keeps.take(pa.array(run)),
            pa.array(sizes[run].astype(np.int64)),
            pa.chunked_array(rows).combine_chunks(),
        ],
        names=RUNS.fieldNames(),
    )
    for start in range(0, whole.num_rows, 50_000):
        yield whole.slice(start, 50_000)


def _border_fixes(runs: DataFrame) -> list[tuple]:
    """(part, run, keep, size, head) for runs that continue in the next range.

    Reads two short rows per range, so it is bounded by the number of partitions, not of rows.
    """
    borders = (
        runs.filter("first AND (run = 0 OR last_run)")
        .select("part", "run", "digest", "run_keep", "run_size")
        .orderBy("part", "run")
        .collect()
    )
    fixes, chain = [], []

    def close():
        parts = {r["part"] for r in chain}
        if len(parts) > 1:
            size = sum(r["run_size"] for r in chain)
            for i, r in enumerate(chain):
                fixes.append((r["part"], r["run"], chain[0]["run_keep"], size, i == 0))
        chain.clear()

    for row in borders:
        if chain and bytes(chain[-1]["digest"]) != bytes(row["digest"]):
            close()
        chain.append(row)
    close()
    return fixes


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and row (of `row_col`, else null).

    Texts are equal when equal after every run of ASCII blanks is one space; null equals the empty
    text.  The row with the smallest id of a group stays; null ids come last, and of rows with the same
    id and text exactly one is `kept`; `row_col` (a long) tells which.  Other columns are not read.  An empty table gives no rows.
    """
    norm = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        normalised(text_col).alias("norm"),
        (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"),
    ).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    order = [F.substring("norm", 1, SPLITTER_CHARS), F.col("digest"), F.col("doc_id").asc_nulls_last()]
    ranged = norm.repartitionByRange(*order).sortWithinPartitions(
        order[0], "digest", "norm", F.col("doc_id").asc_nulls_last()
    )
    runs = stored(ranged.select("doc_id", "digest", "norm", "row").mapInArrow(_runs, RUNS))
    fixes = docs.sparkSession.createDataFrame(
        _border_fixes(runs), "part int, run long, keep long, size long, head boolean"
    )
    return runs.join(F.broadcast(fixes), ["part", "run"], "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("run_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", "run_size").alias("group_size"),
        (F.col("first") & F.coalesce("head", F.lit(True))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )
