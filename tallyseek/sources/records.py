"""Records of quoted CSV files and entries of JSON objects, read in ranges by many tasks.

A line end outside quotes ends a record, and it is outside if an even number of quotes precede it.  So a first pass counts the
quotes of every range, their running sum tells in which state each range begins, and a second pass puts the lines of a range
together.  Only records that straddle ranges meet in a shuffle.  An object is cut at commas likewise: one outside strings, inside
the outer braces only, ends an entry, so the state is that of quotes and the depth of braces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyseek.operators.sizing import fits, materialize

# A field with the comma before it; the quantifiers are possessive, so long cells neither backtrack nor recurse.
_FIELD = r',(?:"(?:[^"]++|"")*+"[^,]*+|[^,]*+)'
_PART = "number long, at int, head boolean, open boolean, text string"


def _lines(spark: SparkSession, paths: list[str], end: str = "\n") -> DataFrame:
    lines = spark.read.option("lineSep", end).text(paths)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


class _Parts:
    """Rows of records of one kind: whole ones, or the parts of those that straddle ranges."""

    def __init__(self, torn: bool, joiner: str):
        self.torn, self.joiner, self.rows, self.size = torn, joiner, [], 0
        self.number, self.at, self.head, self.held = None, -1, False, []

    def begin(self, number: int, head: bool) -> None:
        """A range; `head` if its first lines continue a record of the range before."""
        self.number, self.at, self.head = number, -1, head

    def close(self, unfinished: bool) -> None:
        if self.held and self.torn == (self.head or unfinished):
            self.rows.append((self.number, self.at, self.head, unfinished, self.joiner.join(self.held)))
            self.size += len(self.rows[-1][-1])
        self.held = []

    def open(self, line: str) -> None:
        self.at, self.head = self.at + 1, False
        self.held.append(line)

    def full(self) -> bool:
        return self.size > 1 << 23 or len(self.rows) > 20_000

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[]] * 5
        self.rows, self.size = [], 0
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _PART.split(", ")])


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the rows of each range in a batch."""
    edges = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]).tolist() if len(numbers) else []
    return list(zip(edges, [*edges[1:], len(numbers)]))


def _together(batches: Iterator[pa.RecordBatch], torn: bool) -> Iterator[pa.RecordBatch]:
    """Rows (number, inside, value) of lines, range by range, to records."""
    parts, inside = _Parts(torn, "\n"), 0
    for batch in batches:
        odd = pc.bit_wise_and(pc.count_substring(batch.column(2), '"'), 1).to_numpy(zero_copy_only=False)
        numbers, begins = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        texts = batch.column(2).to_pylist()
        for s, e in _runs(numbers):
            if numbers[s] != parts.number:
                parts.close(bool(inside))
                inside = int(begins[s])
                parts.begin(int(numbers[s]), bool(inside))
            before = (inside + np.r_[0, np.cumsum(odd[s:e])]) % 2
            for text, within in zip(texts[s:e], before[:-1].tolist()):
                if within:
                    parts.held.append(text)
                    continue
                parts.close(False)
                # An empty line is no record.
                if text not in ("", "\r"):
                    parts.open(text)
            inside = int(before[-1])
        if parts.full():
            yield parts.batch()
    parts.close(bool(inside))
    yield parts.batch()


def _assembled(lines: DataFrame, starts: DataFrame, together: Callable, joiner: str) -> DataFrame:
    """`path, block, at, record` of lines, with `starts` telling the number and state (columns after it) of each range."""
    # Lines keep their order only below a broadcast; there is one row per range.
    if not fits(starts):
        raise ValueError("too many ranges; raise spark.sql.files.maxPartitionBytes")
    state = [c for c in starts.columns if c not in ("path", "block", "number", "broken")]
    begins = F.broadcast(starts.select("path", "block", "number", *state))
    ranges = lines.join(begins, ["path", "block"], "left").select(
        F.coalesce("number", F.raise_error(F.lit("the ranges of the files have changed"))).alias("number"), *state, "value"
    )

    def made(torn: bool) -> DataFrame:
        parts = ranges.mapInArrow(partial(together, torn=torn), _PART)
        return parts.join(F.broadcast(starts.select("number", "path", "block")), "number")

    complete = made(False).select("path", "block", "at", F.col("text").alias("record"))
    order = Window.partitionBy("path").orderBy("block", "at")
    torn = made(True).withColumn("_record", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(order))
    mended = (
        torn.groupBy("path", "_record")
        .agg(F.min(F.struct("block", "at")).alias("p"), F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("t"))
        .select("path", "p.block", "p.at", F.array_join("t.text", joiner).alias("record"))
    )
    return complete.unionByName(mended)


def _before(column: str) -> Column:
    """Sum over the ranges of the file before this one."""
    window = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def csv_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """`path, block, at, record`: every record of all files in one plan, the header among them.

    `block` and `at` (from 0) order the records of a file.  Quotes stand around whole cells and are doubled inside them; a file that ends
    inside quotes is an error.  Lines end with LF or CRLF, empty ones are skipped, a UTF-8 mark is dropped.
    """
    lines = _lines(spark, paths)
    odd = F.pmod(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))), F.lit(2))
    blocks = lines.groupBy("path", "block").agg(odd.alias("odd"))
    starts = materialize(blocks.select(
        "path", "block", F.xxhash64("path", "block").alias("number"),
        F.pmod(_before("odd"), F.lit(2)).cast("int").alias("inside"),
        F.pmod(F.sum("odd").over(Window.partitionBy("path")), F.lit(2)).alias("broken"),
    ))
    if broken := starts.filter("broken = 1").first():
        raise ValueError(f"quotes are not closed in {broken.path}")
    records = _assembled(lines, starts, _together, "\n")
    marked = F.when((F.col("block") == 0) & (F.col("at") == 0), F.ltrim(F.col("record"), F.lit("\ufeff"))).otherwise(F.col("record"))
    return records.withColumn("record", F.rtrim(marked, F.lit("\r")))


def cells(record: Column) -> Column:
    """The cells of a record; an empty one without quotes is null."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(0))

    def cell(field: Column) -> Column:
        text = F.substring(field, 2, 2**31 - 1)
        inner = F.replace(F.regexp_replace(text, r'(?s)^"(.*)"[^"]*$', "$1"), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(text, F.lit('"')), inner).otherwise(F.nullif(text, F.lit("")))

    return F.transform(fields, cell)


def column_names(header: Column) -> Column:
    """Names of the cells of a header: an empty one is told by its place, repeated ones get it appended."""

    def name(cell: Column, i: Column) -> Column:
        alike = F.filter(header, lambda other: F.lower(other) == F.lower(cell))
        place = i.cast("string")
        return F.when(F.coalesce(cell, F.lit("")) == "", F.concat(F.lit("_c"), place)).when(F.size(alike) > 1, F.concat(cell, place)).otherwise(cell)

    return F.transform(header, name)


_ESCAPE = re.compile(r"\\.", re.S)
_SHAPE = r'["{}\[\]]'


def _shape(segment: str, inside: int) -> tuple[int, int, int]:
    """State after a piece of JSON that begins inside or outside a string: inside, change of depth, lowest change on the way."""
    depth = low = 0
    for part in _ESCAPE.sub("", segment).split('"'):
        if not inside:
            for c in part:
                if c in "{[":
                    depth += 1
                elif c in "]}":
                    depth -= 1
                    low = min(low, depth)
        inside ^= 1
    # There is one part more than quotes.
    return inside ^ 1, depth, low


_RANGE = "path string, block long, odd int, outside_depth int, inside_depth int"


def _range_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quote parity of each range, and its change of depth if it begins outside and inside a string."""
    found: dict[tuple, list[int]] = {}
    for batch in batches:
        for key in pa.Table.from_batches([batch]).group_by(["path", "block"]).aggregate([]).to_pylist():
            found.setdefault((key["path"], key["block"]), [0, 0, 0])
        special = batch.filter(pc.match_substring_regex(batch.column(2), _SHAPE))
        for path, block, text in zip(*(special.column(i).to_pylist() for i in range(3))):
            state = found[path, block]
            odd = state[0]
            for side in (0, 1):
                after, depth, _ = _shape(text, odd ^ side)
                state[1 + side] += depth
                state[0] = after ^ side
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[i] for k in found], type=t) for i, t in enumerate((pa.string(), pa.int64()))]
        + [pa.array([v[i] for v in found.values()], type=pa.int32()) for i in range(3)],
        names=[x.split()[0] for x in _RANGE.split(", ")],
    )


def _entries_together(batches: Iterator[pa.RecordBatch], torn: bool) -> Iterator[pa.RecordBatch]:
    """Rows (number, inside, depth, first, value) of what stands between commas, range by range, to entries without the outer braces."""
    parts, inside, depth, done = _Parts(torn, ","), 0, 0, False
    fault = "malformed JSON: something else than one object"

    def within() -> bool:
        return bool(inside or depth > 1)

    for batch in batches:
        special = pc.match_substring_regex(batch.column(4), _SHAPE).to_pylist()
        numbers = batch.column(0).to_numpy()
        begins = [batch.column(i).to_pylist() for i in (1, 2, 3)]
        texts = batch.column(4).to_pylist()
        for s, e in _runs(numbers):
            if numbers[s] != parts.number:
                parts.close(within())
                inside, depth, first = (int(b[s]) for b in begins)
                done = not first and not inside and depth < 1
                parts.begin(int(numbers[s]), within())
            for text, shaped in zip(texts[s:e], special[s:e]):
                if done:
                    raise ValueError(fault)
                begun = depth == 0
                if begun:
                    text = text.lstrip(" \t\r\n\ufeff")
                    if text and text[0] != "{":
                        raise ValueError(fault)
                    done, depth, text = not text, int(bool(text)), text[1:]
                    if done:
                        continue
                after, change, low = _shape(text, inside) if shaped else (inside, 0, 0)
                done = depth + change == 0
                if done:
                    text = text.rstrip()[:-1]
                    low = _shape(text, inside)[2] if text else 0
                if depth + low < 1 or (done and after):
                    raise ValueError(fault)
                if within():
                    parts.held.append(text)
                elif not (begun and done and not text.strip()):
                    parts.close(False)
                    parts.open(text)
                inside, depth = after, depth + change
        if parts.full():
            yield parts.batch()
    parts.close(within())
    yield parts.batch()


def json_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """`path, block, at, key, value`: the entries of one JSON object per file, in the order of `block` and `at`.

    Values that are no strings are JSON text.  What is no object is an error; blank files have no entries.
    """
    lines = _lines(spark, paths, ",")
    states = lines.mapInArrow(_range_shapes, _RANGE).withColumn("inside", F.pmod(_before("odd"), F.lit(2)).cast("int"))
    change = F.when(F.col("inside") == 1, F.col("inside_depth")).otherwise(F.col("outside_depth"))
    whole = Window.partitionBy("path")
    starts = materialize(states.withColumn("change", change).select(
        "path", "block", F.xxhash64("path", "block").alias("number"), "inside", _before("change").cast("int").alias("depth"),
        (F.col("block") == F.min("block").over(whole)).cast("int").alias("first"),
        ((F.pmod(F.sum("odd").over(whole), F.lit(2)) != 0) | (F.sum("change").over(whole) != 0)).alias("broken"),
    ))
    if broken := starts.filter("broken").first():
        raise ValueError(f"malformed JSON: no whole object in {broken.path}")
    entry = F.when(F.rlike("record", F.lit(r"\A\s*\z")), F.raise_error(F.lit("malformed JSON: an empty entry")).cast("string")).otherwise(
        F.concat(F.lit("{"), "record", F.lit("}"))
    )
    parsed = F.from_json(entry, "map<string,string>", {"mode": "FAILFAST"})
    entries = _assembled(lines, starts, _entries_together, ",").select("path", "block", "at", F.map_entries(parsed)[0].alias("e"))
    return entries.select("path", "block", "at", "e.key", "e.value")
