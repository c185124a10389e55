"""SimHash near-dedup with covering locality-sensitive hashing: no pair within the radius is missed.

Each bit position i of the 64 has a vector m(i) of radius + 1 bits, not zero.  Table v, for every vector v but zero, looks at the
positions whose m(i) has an odd product with v.  Two fingerprints that differ in at most `radius` positions give as many linear
equations in radius + 1 unknowns, so some v is orthogonal to all of them: in that table the two agree on every bit looked at.
With radius 3 there are 15 tables of 34 or 35 bits.

A bucket with too many fingerprints is dealt anew by the bits it does not look at yet: cut into radius + 1 blocks, one
block at least is free of differences.  This is repeated until all buckets are small; it ends because the bits do.  So every
comparison is of a bounded bucket, nothing is capped, and a bucket adds a spanning forest of its links, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseek.llm.common import connected, shuffle_parts, stored
from tallyseek.operators.sizing import attach, materialize

BITS, RADIUS, SHINGLE_WORDS, SEED = 64, 3, 3, 42
# Buckets of more fingerprints are dealt anew; up to SMALL, pairs are compared side by side for all buckets at once.
BUCKET, SMALL = 2048, 8
# Shingles whose bits are counted at a time.
COUNTED = 1 << 18


def fingerprint(raw: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64 bits that more than half of the text's shingle hashes have; 0 without words."""
    tokens = raw.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    span = min(words, len(tokens))
    begins, stops = (ends - sizes)[: len(tokens) - span + 1], ends[span - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(begins), COUNTED):
        some = zip(begins[at : at + COUNTED].tolist(), stops[at : at + COUNTED].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in some], dtype="<u8")
        total += _bit_counts(hashes)
    bits = np.flatnonzero(total * 2 > len(begins))
    return int(np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))) if len(bits) else 0


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the least significant one."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            column = batch.column(last)
            prints = [fingerprint(v.as_buffer().to_pybytes(), words, seed) if v.is_valid else 0 for v in column]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(last)], pa.array(np.array(prints, dtype=np.uint64).view(np.int64))],
                names=[*batch.schema.names[:-1], "print"],
            )

    return run


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """The `keep` columns and `print`: the fingerprint as a signed long; null and blank texts have 0."""
    given = docs.select(*keep, F.col(text_col).alias("_text"))
    out = T.StructType([*[given.schema[c] for c in keep], T.StructField("print", T.LongType())])
    return given.mapInArrow(_fingerprints(words, seed), out)


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The bits that each table looks at, as numbers."""
    vectors = (1 << (radius + 1)) - 1
    spots = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (spots[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(free: int, parts: int) -> list[int]:
    """The positions of `free` in `parts` masks of nearly equal size, neighbours in different masks."""
    spots = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << i for i in spots[k::parts]) for k in range(parts)]


def _forest(radius: int):
    """Links of each bucket: rows come sorted by bucket, so only the last bucket of a batch waits for the next batch."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[edge, len(keys)])
        left = np.repeat(size, size) - (np.arange(len(keys)) - np.repeat(edge, size)) - 1
        small = np.repeat(size <= SMALL, size)
        for gap in range(1, SMALL):
            at = np.flatnonzero(small & (left >= gap))
            at = at[np.bitwise_count(prints[at] ^ prints[at + gap]) <= radius]
            if len(at):
                yield pa.record_batch([prints[at].view(np.int64), prints[at + gap].view(np.int64)], schema=schema)
        for start, count in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist()):
            a, b = _spanning(np.unique(prints[start : start + count]), radius)
            if len(a):
                yield pa.record_batch([a.view(np.int64), b.view(np.int64)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            prints = np.r_[prints, batch.column(1).to_numpy().view(np.uint64)]
            if len(keys):
                cut = int(np.searchsorted(keys, keys[-1]))
                yield from pairs(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
        yield from pairs(keys, prints)

    return run


def _spanning(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between different fingerprints: each one joins the tree that first reaches it."""
    rest, a, b = prints, [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            new = rest[near]
            if len(new):
                a.append(np.full(len(new), at)), b.append(new)
                front += list(new)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect exactly what all pairs of `print` (different values) within the radius connect."""
    spark = prints.sparkSession
    free = [~m & ((1 << BITS) - 1) for m in covering_masks(BITS, radius)]
    tables = [
        F.struct(F.xxhash64(F.lit(v), F.col("print").bitwiseAND(F.lit(_signed(~f & ((1 << BITS) - 1))))).alias("key"), F.lit(_signed(f)).alias("free"))
        for v, f in enumerate(free)
    ]
    rows = prints.select("print", F.explode(F.array(*tables)).alias("t")).select("t.key", "print", "t.free")
    found = None
    while True:
        # Buckets whose bits are used up hold at most 2^radius fingerprints and are compared at any size.
        crowded = rows.filter(F.bit_count("free") > radius).groupBy("key").count().filter(F.col("count") > bucket)
        crowded = materialize(crowded.select("key", F.lit(True).alias("hot")))
        told = attach(rows, crowded, "key")
        calm = told.filter("hot IS NULL").select("key", "print").repartition(shuffle_parts(spark), "key")
        links = stored(calm.sortWithinPartitions("key").mapInArrow(_forest(radius), "a long, b long").distinct())
        found = links if found is None else found.unionByName(links)
        if crowded.isEmpty():
            return found
        cuts = [(_signed(f), k, _signed(part), _signed(f & ~part)) for f in free for k, part in enumerate(_blocks(f, radius + 1))]
        free = sorted({f & ~part for f in free for part in _blocks(f, radius + 1)})
        # At most 15 * 4^level short rows.
        plan = F.broadcast(spark.createDataFrame(cuts, "free long, block int, part long, rest long").distinct())
        rows = stored(
            told.filter("hot").join(plan, "free").select(
                F.xxhash64("key", "block", F.col("print").bitwiseAND(F.col("part"))).alias("key"), "print", F.col("rest").alias("free")
            )
        )


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits) and component_id.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest id reachable over links, its own included.
    A null or blank text has fingerprint zero and links like any other; equal fingerprints are one.  Null ids keep their rows but
    name no component, unless nothing else is in it (then null).  Repeated rows and ids stay; other columns are not read; an empty table gives
    no rows.  Texts of any length are taken whole.
    """
    printed = stored(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"]))
    prints = stored(printed.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = connected(near_links(prints, radius, bucket)).select(F.col("id").alias("print"), "root")
    members = stored(prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")))
    names = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = attach(members, names, "root").select("print", "component_id")
    return attach(printed, named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
