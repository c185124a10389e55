"""Near-dedup by BagMinHash signatures of word-shingle multisets, bands, and exact verification.

A text is the multiset of its five-word shingles.  Each shingle with weight w owns independent Poisson processes
over the dyadic weight ranges [0,1), [1,2), [2,4), ... below w; a point of a range survives if its level lies below w.  The first
surviving point in each of HASHES registers is the signature; two signatures agree in a register with probability
sum of minima / sum of maxima, the weighted Jaccard similarity.  Points are drawn in order of time up to a horizon that fills the
registers, so the cost does not grow with the number of hashes times the number of shingles.

Texts that share a band are candidates.  Candidates are linked as stars, their components are dealt to
tasks (large ones as a grid of bounded blocks), and every pair inside is compared on its exact multisets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseek.llm.common import connected, stored
from tallyseek.llm.shingles import blocks, mix, shingle_hashes, word_hashes
from tallyseek.operators.sizing import attach

HASHES, BANDS, ROWS = 128, 32, 4
# Similarity 0.8 as 9 * common >= 4 * (size + size).
NINE, FOUR = 9, 4
# A block of the verification grid holds at most about so many texts and words.
BLOCK_TEXTS, BLOCK_WORDS = 1000, 1_000_000

_MASK48 = np.uint64((1 << 48) - 1)


def multisets(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 48-bit shingle, weight) of each distinct shingle of each text; at most 65,536 texts."""
    keys = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    weights = np.diff(np.r_[new, len(keys)])
    return (keys[new] >> np.uint64(48)).astype(np.int64), keys[new] & _MASK48, weights


def bag_signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Signatures (texts x HASHES) as bit patterns of the points' times; texts without shingles keep all ones."""
    times = np.full(texts * HASHES, np.inf)
    total = np.bincount(owner, weights=weight, minlength=texts)
    process = [(owner, shingle, np.ones(len(owner)), np.zeros(len(owner), np.int64), weight)]
    low, width = 1, 1
    while len(weight) and (weight > low).any():
        heavy = weight > low
        process.append(
            (owner[heavy], shingle[heavy], np.full(heavy.sum(), float(width)), np.full(heavy.sum(), low), weight[heavy])
        )
        low, width = low * 2, low * 2
    own, base, rate, level, most = (np.concatenate(x) for x in zip(*process))
    seed = mix(base + mix(level.astype(np.uint64)))
    now, points = np.zeros(len(own)), np.zeros(len(own), np.uint64)
    horizon = np.where(total > 0, HASHES * (np.log(HASHES) + 6) / np.maximum(total, 1), 0.0)

    def random(at):
        return mix(seed[at] + points[at] * np.uint64(0xD1B54A32D192ED03))

    def settle(at):
        """Put the processes' present points into their registers if their level lies below the shingle's weight."""
        mark = mix(random(at))
        deep = level[at] + ((mark >> np.uint64(32)) % rate[at].astype(np.uint64)).astype(np.int64)
        good = deep < most[at]
        np.minimum.at(times, own[at][good] * HASHES + (mark[good] % np.uint64(HASHES)).astype(np.int64), now[at][good])

    pending, waiting = np.arange(len(own)), []
    while True:
        while len(pending):
            points[pending] += np.uint64(1)
            u = (random(pending) >> np.uint64(11)).astype(np.float64)
            now[pending] -= np.log((u + 0.5) * 2.0**-53) / rate[pending]
            ok = now[pending] <= horizon[own[pending]]
            # A process past the horizon waits with its point, which comes next if the horizon grows.
            waiting.append(pending[~ok])
            pending = pending[ok]
            settle(pending)
        empty = np.isinf(times.reshape(texts, HASHES)).any(axis=1) & (total > 0)
        if not empty.any():
            break
        horizon = np.where(empty, horizon * 2, horizon)
        held = np.concatenate(waiting)
        ready = now[held] <= horizon[own[held]]
        waiting, pending = [held[~ready]], held[ready]
        settle(pending)
    return times.view(np.uint64).reshape(texts, HASHES)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys per signature."""
    cut = signatures.reshape(len(signatures), BANDS, ROWS)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signatures), 1))
    for r in range(ROWS):
        keys = mix(keys ^ cut[:, :, r])
    return keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for at in range(0, batch.num_rows, 1000):
            for first, raws in blocks(texts.slice(at, 1000).to_pylist()):
                words, owner = word_hashes(raws)
                ends = np.searchsorted(owner, np.arange(len(raws) + 1))
                digests = [
                    hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(ends[:-1], ends[1:])
                ]
                hashes, owners, _ = shingle_hashes(words, owner)
                keys = band_keys(bag_signatures(*multisets(hashes, owners), len(raws))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at + first, len(raws)),
                        batch.column(2).slice(at + first, len(raws)),
                        pa.array(digests, type=pa.binary()),
                        pa.array(np.diff(ends)),
                        pa.ListArray.from_arrays(np.arange(0, (len(raws) + 1) * BANDS, BANDS, dtype=np.int32), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "row", "digest", "n_words", "bands"],
                )


class _Sets:
    """Exact multisets of a few texts, as 0/1 features (shingle, how many-th)."""

    def __init__(self, raws: list[bytes]):
        words, owner = word_hashes(raws)
        hashes, owners, _ = shingle_hashes(words, owner)
        order = np.lexsort((hashes, owners))
        h, o = hashes[order], owners[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        nth = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        features = mix(h ^ (nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        self.sizes = np.bincount(o, minlength=len(raws))
        values, inverse, counts = np.unique(features, return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        column = np.cumsum(counts > 1) - 1
        self.cols, self.rows = column[inverse[shared]], o[shared]
        self.n, self.width = len(raws), int((counts > 1).sum())

    def common(self) -> np.ndarray:
        """Sum of minima for every pair, by products of bounded slices of the feature matrix."""
        out = np.zeros((self.n, self.n), dtype=np.float32)
        order = np.argsort(self.cols, kind="stable")
        cols, rows = self.cols[order], self.rows[order]
        for a in range(0, self.width, 4096):
            lo, hi = np.searchsorted(cols, [a, a + 4096])
            part = np.zeros((self.n, min(4096, self.width - a)), dtype=np.float32)
            part[rows[lo:hi], cols[lo:hi] - a] = 1.0
            out += part @ part.T
        return out


def similar_links(raws: list[bytes], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with weighted Jaccard >= 0.8; with `sides`, only pairs across them."""
    sets = _Sets(raws)
    both = NINE * sets.common() >= FOUR * (sets.sizes[:, None] + sets.sizes[None, :])
    both &= (sets.sizes[:, None] > 0) & (sets.sizes[None, :] > 0)
    if sides is not None:
        side = np.asarray(sides)
        both &= side[:, None] != side[None, :]
    parent = list(range(len(raws)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for a, b in zip(*np.nonzero(np.triu(both, 1))):
        ra, rb = root(int(a)), root(int(b))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            links.append((int(a), int(b)))
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by grid cell: (key, digest, side, text) to verified links between digests."""
    key, digests, sides, raws = None, [], [], []

    def links():
        seen = {}
        keep = [i for i, d in enumerate(digests) if seen.setdefault((d, sides[i]), i) == i]
        ds, ss, rs = [digests[i] for i in keep], [sides[i] for i in keep], [raws[i] for i in keep]
        found = similar_links(rs, ss if len(set(ss)) > 1 else None) if len(ds) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([ds[a] for a, _ in found], type=pa.binary()), pa.array([ds[b] for _, b in found], type=pa.binary())],
            names=["a", "b"],
        )

    for batch in batches:
        keys, new_digests, new_sides = (batch.column(i).to_pylist() for i in range(3))
        texts = batch.column(3)
        for i, k in enumerate(keys):
            if k != key:
                if len(digests) > 1:
                    yield links()
                key, digests, sides, raws = k, [], [], []
            raw = (texts[i].as_py() or "").lower().encode()
            words, _ = word_hashes([raw])
            # Another row may share the id; only the text that was sketched counts.
            if len(words) and hashlib.blake2b(words.tobytes(), digest_size=16).digest() == new_digests[i]:
                digests.append(new_digests[i])
                sides.append(new_sides[i])
                raws.append(raw)
    if len(digests) > 1:
        yield links()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row: row number, doc_id, digest of its words (null without words), n_words, band keys; stored."""
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row.alias("row"))
    return stored(given.mapInArrow(_sketch, "doc_id long, row long, digest binary, n_words long, bands array<long>"))


def candidate_links(texts: DataFrame) -> DataFrame:
    """Stars: every text of a band bucket is linked with the bucket's smallest digest, its head.

    A text has at most BANDS heads.  It is linked to the smallest of them only, and that one to the others; such
    links between heads repeat from text to text and are kept once, so a large group has little more links than texts.
    """
    keys = texts.select("digest", F.explode("bands").alias("band"))
    heads = keys.groupBy("band").agg(F.min("digest").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    mine = (
        keys.join(heads, "band")
        .filter("a <> digest")
        .groupBy("digest")
        .agg(F.sort_array(F.collect_set("a")).alias("heads"))
    )
    ends = F.concat(F.array("digest"), F.slice("heads", F.lit(2), F.size("heads")))
    return mine.select(F.get("heads", F.lit(0)).alias("a"), F.explode(ends).alias("b")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size (rows), kept, row (of `row_col`, else a number of its own).

    Classes are the connected components of "weighted Jaccard of five-word shingle multisets >= 0.8", words being
    lower-cased runs of non-blanks; class_id is the class's smallest id and exactly one row, the first with that id, is kept.  Texts of
    1 to 4 words are one shingle.  Null and blank texts are similar to nothing, so each is its own class.  Null ids come after all others.
    Of the columns only id and text are read.  A `row_col` has to be the same at every read.
    """
    if row_col is None:
        # Texts are read twice and joined by row, so the numbers have to stay.
        docs, row_col = stored(docs.select(id_col, text_col, F.monotonically_increasing_id().alias("_row"))), "_row"
    rows = sketches(docs, id_col, text_col, row_col)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    texts = stored(
        rows.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    )
    groups = connected(candidate_links(texts))
    members = groups.withColumnRenamed("id", "digest").join(texts.select("digest", "first", "n_words"), "digest")
    sized = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    placed = attach(members, stored(sized.select("root", parts.alias("parts"))), "root").withColumn(
        "block", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    )
    wanted = placed.select("digest", "root", "parts", "block", F.col("first.row").alias("row"))
    given = docs.select(F.col(text_col).alias("text"), F.col(row_col).cast("long").alias("row"))
    cells = (
        given.join(wanted.hint("shuffle_hash"), "row")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.struct("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("cell"),
            "digest", F.when(F.col("block") == F.col("other"), 0).otherwise(F.col("block")).alias("side"), "text",
        )
    )
    return _classes(rows, texts, _verified(cells))


def _verified(cells: DataFrame) -> DataFrame:
    keyed = cells.select(
        F.concat(F.hex("cell.root"), F.lit(":"), F.col("cell.i").cast("string"), F.lit(":"), F.col("cell.j").cast("string")).alias("key"),
        "digest", "side", "text",
    )
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a binary, b binary")


def _classes(rows: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    linked = texts.select("digest", "first", "copies").join(connected(links).withColumnRenamed("id", "digest"), "digest")
    totals = stored(linked.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size")))
    # A class may hold a third of all texts: `attach` broadcasts the totals, or those of hot classes.
    classed = attach(linked.select("digest", "root"), totals, "root").select("digest", "head", "class_size")
    by_text = texts.join(classed, "digest", "left").select(
        "digest", F.coalesce("head", "first").alias("head"), F.coalesce("class_size", "copies").alias("class_size")
    )
    return rows.select("doc_id", "row", "digest").join(by_text, "digest", "left").select(
        "doc_id",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("head").isNull() | (F.col("head.row") == F.col("row"))).alias("kept"),
        "row",
    )
