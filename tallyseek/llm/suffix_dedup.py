"""Exact substring dedup from a sorted array of candidate suffixes.

A byte goes if a LENGTH-byte string covers it that also starts earlier (smaller id, or the same text further left).

Every LENGTH-byte window has an anchor: its leftmost ANCHOR-gram with the smallest hash.  Equal windows have equal anchors at
the same offset, so only windows whose anchor occurs twice in the corpus need sorting, and all windows equal to one another meet in the
task that owns the anchor.  Consecutive windows with one anchor travel together as a run.

A task orders its suffixes deep-shallow: multikey quicksort on eight-byte symbols to SHALLOW bytes,
then a blind trie (Patricia) for every group that still agrees.  First the runs are sorted as wholes; where an anchor has
different runs, their windows are sorted as suffixes.  Neighbours that agree in LENGTH bytes are one string, and all but its first occurrence are marked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyseek.llm.common import pack, shuffle_parts, stored, text_or_empty, unpack
from tallyseek.llm.shingles import mix
from tallyseek.operators.sizing import attach

LENGTH, ANCHOR = 100, 32
SHALLOW = 32
# Bytes hashed at a time, bytes whose repeats are found inside one task, and bytes of text per shuffle partition.
HASH_BLOCK, LOCAL_BLOCK, PART_BYTES = 1 << 20, 1 << 24, 1 << 25
NO_ID = (1 << 63) - 1

_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_STEPS = [int(x) | 1 for x in mix(np.arange(5, dtype=np.uint64) + np.uint64(991))]


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors(raws: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, place in text, hash, first and last window start in text) of all anchors of the texts, in order."""
    width = length - ANCHOR + 1
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(np.uint64), none, none
    h = _BYTES[data]
    for level, step in enumerate(_STEPS):
        gap = 1 << level
        h = h[:-gap] * np.uint64(step) + h[gap:]
    h = mix(h)
    low = sliding(h, width, np.minimum)
    # A place is the smallest of some window if no window around it has a minimum above its hash's own.
    padded = np.r_[np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]
    at = np.flatnonzero(sliding(padded, width, np.maximum) == h)
    value, n = h[at], len(at)
    left, right = np.full(n, -1, np.int64), np.full(n, len(data), np.int64)
    for found, side, better in ((left, -1, np.less_equal), (right, 1, np.less)):
        open_, j = np.arange(n), 1
        while len(open_):
            other = open_ + side * j
            ok = (other >= 0) & (other < n)
            open_, other = open_[ok], other[ok]
            ok = np.abs(at[other] - at[open_]) < width
            open_, other = open_[ok], other[ok]
            hit = better(value[other], value[open_])
            found[open_[hit]] = at[other[hit]]
            open_ = open_[~hit]
            j += 1
    text = np.searchsorted(ends, at, side="right")
    begin = np.r_[0, ends][text]
    first = np.maximum(np.maximum(at - width + 1, left + 1), begin)
    last = np.minimum(np.minimum(at, right - width), ends[text] - length)
    ok = first <= last
    text, begin = text[ok], begin[ok]
    return text, at[ok] - begin, value[ok], first[ok] - begin, last[ok] - begin


def _blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _all_anchors(raws: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    parts = []
    for a, b in _blocks([len(r) for r in raws], HASH_BLOCK):
        text, *rest = anchors(raws[a:b], length)
        parts.append((text + a, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _gathered(batches: Iterator[pa.RecordBatch], text_column: int, limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """Rows (without the text) and texts of about `limit` bytes at a time."""
    rows, raws, size = [], [], 0
    for batch in batches:
        others = [batch.column(i).to_pylist() for i in range(batch.num_columns) if i != text_column]
        for i, value in enumerate(batch.column(text_column)):
            raw = value.as_buffer().to_pybytes() if value.is_valid else b""
            rows.append([o[i] for o in others])
            raws.append(raw)
            size += len(raw)
            if size >= limit:
                yield rows, raws
                rows, raws, size = [], [], 0
    if rows:
        yield rows, raws


# A block's anchors travel as columns: hash, id, step from the place before, whether the block repeats it.
_ANCHOR = [np.uint64, np.int64, np.int32, np.uint8]


def _anchor_rows(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raws in _gathered(batches, 1, LOCAL_BLOCK):
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            text, place, value, _, _ = _all_anchors(raws, length)
            order = np.argsort(value, kind="stable")
            same = value[order][1:] == value[order][:-1]
            first, shared = np.ones(len(value), bool), np.zeros(len(value), bool)
            first[order] = np.r_[True, ~same][: len(value)]
            shared[order] = (np.r_[same, False] | np.r_[False, same])[: len(value)]
            out = []
            # Repeats inside the block are known and need not meet other tasks: a hot anchor sends one row per block.
            known = np.flatnonzero(~first)
            if len(known):
                out.append((int(value[known[0]] % np.uint64(parts)), True, _packed(value, ids[text], place, shared, known)))
            part = (value % np.uint64(parts)).astype(np.int64)
            some = np.flatnonzero(first)
            some = some[np.argsort(part[some], kind="stable")]
            bounds = np.searchsorted(part[some], np.arange(parts + 1))
            for p in range(parts):
                if bounds[p] < bounds[p + 1]:
                    out.append((p, False, _packed(value, ids[text], place, shared, some[bounds[p] : bounds[p + 1]])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], type=pa.int32()), pa.array([r[1] for r in out], type=pa.bool_()), pa.array([r[2] for r in out], type=pa.binary())],
                names=["part", "known", "payload"],
            )

    return run


def _packed(value, ids, place, shared, some) -> bytes:
    return pack([value[some], ids[some], np.diff(place[some], prepend=0).astype(np.int32), shared[some].astype(np.uint8)])


def _shared_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places whose anchor has another row in this partition, and those known before."""
    found: dict[int, list] = {}
    for batch in batches:
        for part, known, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            key, ids, step, shared = unpack(payload, _ANCHOR)
            place = np.cumsum(step, dtype=np.int32)
            if known:
                yield _places(ids, place)
            else:
                found.setdefault(part, []).append((key, ids, place, shared > 0))
    for columns in found.values():
        key, ids, place, known = (np.concatenate(c) for c in zip(*columns))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order] = np.r_[same, False] | np.r_[False, same]
        keep = twice | known
        yield _places(ids[keep], place[keep])


def _places(ids: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place)], names=["doc_id", "place"])


RUN_FIELDS = "key long, doc_id long, version long, start int, windows int, bytes binary, done boolean"


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raws in _gathered(batches, 3, LOCAL_BLOCK):
            order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1]))
            rows, raws = [rows[i] for i in order], [raws[i] for i in order]
            text, place, value, first, last = _all_anchors(raws, length)
            wanted = np.concatenate(
                [np.unique(np.asarray(r[2], dtype=np.uint64)) | np.uint64(i << 40) for i, r in enumerate(rows)]
            )
            here = (text.astype(np.uint64) << np.uint64(40)) | place.astype(np.uint64)
            at = np.minimum(np.searchsorted(wanted, here), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == here)
            seen: dict[bytes, tuple] = {}
            out: list[list] = [[], [], [], [], [], [], []]
            for t, v, a, b in zip(text[hit].tolist(), value[hit].view(np.int64).tolist(), first[hit].tolist(), last[hit].tolist()):
                doc, version = rows[t][0], rows[t][1]
                raw = raws[t][a : b + length]
                who = (doc, version, a)
                # The first equal run of the block stands for all; the others start later, so they are marked at once.
                done = seen.setdefault(raw, who) != who
                for col, x in zip(out, (doc if done else v, doc, version, a, b - a + 1, None if done else raw, done)):
                    col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            for s in range(0, len(out[0]), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[s : s + 20_000], type=k) for c, k in zip(out, kinds)],
                    names=["key", "doc_id", "version", "start", "windows", "bytes", "done"],
                )

    return run


class BlindTrie:
    """Patricia trie over byte strings of one length; equal strings share a leaf."""

    def __init__(self):
        self.root = None

    def insert(self, string: bytes, mark: int) -> None:
        if self.root is None:
            self.root = (string, [mark])
            return
        node = self.root
        while isinstance(node[1], dict):
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == string:
            node[1].append(mark)
            return
        differ = int.from_bytes(other) ^ int.from_bytes(string)
        at = len(string) - (differ.bit_length() + 7) // 8
        leaf = (string, [mark])
        parent, node = None, self.root
        while isinstance(node[1], dict) and node[0] < at:
            parent, node = node, node[1][string[node[0]]]
        if isinstance(node[1], dict) and node[0] == at:
            node[1][string[at]] = leaf
            return
        branch = (at, {other[at]: node, string[at]: leaf})
        if parent is None:
            self.root = branch
        else:
            parent[1][string[parent[0]]] = branch

    def leaves(self) -> list[list[int]]:
        """Marks of equal strings, leaf by leaf in byte order."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node[1], dict):
                todo.extend(child for _, child in sorted(node[1].items(), reverse=True))
            else:
                out.append(node[1])
        return out


def deep_shallow(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by length, then bytes, and for each place in the order whether it equals the one before.

    Shallow: each round splits every open group by its next eight bytes.  Deep: groups that agree in SHALLOW
    bytes go into blind tries.
    """
    n = len(starts)
    flat = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    order = np.lexsort((starts, lengths))
    new = np.r_[True, np.diff(lengths[order]) != 0] if n else np.zeros(0, bool)
    for depth in range(0, SHALLOW, 8):
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group] if n else group
        active = np.flatnonzero(size > 1)
        if not len(active):
            break
        some = order[active]
        symbol = np.ascontiguousarray(flat[(starts[some] + depth)[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
        # Symbols past a string's end are cut off; strings of one group have one length.
        over = np.maximum(depth + 8 - lengths[some], 0)
        symbol = np.where(over >= 8, np.uint64(0), symbol >> (np.minimum(over, 7).astype(np.uint64) * np.uint64(8)))
        by = np.lexsort((symbol, group[active]))
        order[active] = some[by]
        changed = np.r_[True, symbol[by][1:] != symbol[by][:-1]]
        new[active] |= changed
    equal = np.zeros(n, bool)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.r_[heads, n])
    for head, size in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        trie = BlindTrie()
        for i in order[head : head + size].tolist():
            trie.insert(data[starts[i] : starts[i] + lengths[i]], i)
        at = head
        for leaf in trie.leaves():
            order[at : at + len(leaf)] = leaf
            equal[at + 1 : at + len(leaf)] = True
            at += len(leaf)
    return order, equal


def _later(order: np.ndarray, equal: np.ndarray, who: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(marked, first): per string whether an equal one comes earlier by `who`, and the number of its first equal."""
    group = np.cumsum(~equal) - 1
    by = np.lexsort((*[w[order] for w in reversed(who)], group))
    order, group = order[by], group[by]
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[heads], np.diff(np.r_[heads, len(order)]))
    marked = np.zeros(len(order), bool)
    for w in who:
        marked |= w != w[first]
    return marked, first


def _sorted_marks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, raws = [[], [], [], [], []], []
        for batch in batches:
            done = batch.column(6).to_numpy(zero_copy_only=False)
            values = [batch.column(i).to_numpy() for i in range(5)]
            if done.any():
                yield _spans(values[1][done], values[2][done], values[3][done], values[3][done] + values[4][done] - 1 + length)
            for col, v in zip(cols, values):
                col.append(v[~done])
            raws.extend(batch.column(5).filter(pa.array(~done)).to_pylist())
        if not raws:
            return
        key, doc, version, start, windows = (np.concatenate(c) for c in cols)
        data = b"".join(raws)
        lengths = np.array([len(r) for r in raws], dtype=np.int64)
        del raws
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        marked, first = _later(*deep_shallow(data, begin, lengths), [doc, version, start])
        yield _spans(doc[marked], version[marked], start[marked], start[marked] + windows[marked] - 1 + length)
        # One of each different run; anchors with several of them have their windows sorted.
        rep = np.flatnonzero(first == np.arange(len(first)))
        rep = rep[np.argsort(key[rep], kind="stable")]
        several = np.zeros(len(rep), bool)
        same = key[rep][1:] == key[rep][:-1]
        several[1:] |= same
        several[:-1] |= same
        rep = rep[several]
        for a, b in _same_key_blocks(key[rep], windows[rep]):
            some = rep[a:b]
            count = windows[some].astype(np.int64)
            run_of = np.repeat(some, count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            suffix = begin[run_of] + step
            at = start[run_of].astype(np.int64) + step
            late, _ = _later(
                *deep_shallow(data, suffix, np.full(len(suffix), length, np.int64)), [doc[run_of], version[run_of], at]
            )
            cut = np.flatnonzero(late)
            if not len(cut):
                continue
            breaks = np.r_[True, (np.diff(cut) != 1) | (run_of[cut][1:] != run_of[cut][:-1])]
            from_, to = cut[breaks], cut[np.r_[breaks[1:], True]]
            yield _spans(doc[run_of[from_]], version[run_of[from_]], at[from_], at[to] + length)

    return run


def _same_key_blocks(keys: np.ndarray, windows: np.ndarray, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Slices that hold whole keys and about `limit` windows."""
    if not len(keys):
        return
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.add.reduceat(windows.astype(np.int64), heads).tolist()
    bounds = np.r_[heads, len(keys)]
    for a, b in _blocks(sizes, limit):
        yield int(bounds[a]), int(bounds[b])


def _spans(doc, version, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(version), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))],
        names=["doc_id", "version", "start", "end"],
    )


def remove_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is left, maximal removed runs) of a text; touching spans are one run."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    left, at = [], 0
    for a, b in merged:
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return b"".join(left), [(a, b) for a, b in merged]


def _shuffle_width(docs: DataFrame) -> int:
    """Shuffle partitions: the session's number, or more if a partition would get over PART_BYTES of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_parts(docs.sparkSession), math.ceil(total / PART_BYTES))


def repeated_spans(docs: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, version, start, end) byte spans covered by repeated strings; `docs` has doc_id (no nulls), version, text."""
    found = docs.select(_node().alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _anchor_rows(length, parts), "part int, known boolean, payload binary"
    )
    places = found.repartition(parts, "part").mapInArrow(_shared_places, "doc_id long, place int")
    by_doc = stored(places.groupBy("doc_id").agg(F.collect_set("place").alias("places")))
    wanted = by_doc.withColumnRenamed("doc_id", "id").hint("shuffle_hash")
    given = _placed(docs, parts).join(wanted, F.col("node") == F.col("id")).select("doc_id", "version", "places", "text")
    runs = given.mapInArrow(_runs(length), RUN_FIELDS)
    return runs.repartition(parts, "key").mapInArrow(
        _sorted_marks(length), "doc_id long, version long, start int, end int"
    )


def _placed(docs: DataFrame, parts: int) -> DataFrame:
    """Texts as bytes, dealt by document; both joins of a job read this one exchange."""
    return docs.select(_node().alias("node"), "doc_id", "version", F.col("text").cast("binary").alias("text")).repartition(parts, "node")


def _node() -> Column:
    """One number for each document: the id, or 64 hash bits of id and version where rows share an id."""
    return F.when(F.col("version") == 0, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "version"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes that stay), spans (start, end).

    Texts are UTF-8 bytes, null is empty; texts below `length` bytes lose nothing.  Strings are judged on the input.  Null ids come
    last.  Rows with the same id are ordered by their text's hash, and rows with the same id and text are one document, so
    they lose the same bytes.  Other columns are not read.
    """
    given = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty(text_col).alias("text")
    )
    repeats = stored(given.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("again")))
    # Rows that share an id, or have none, are told by their text, so that none gets the others' places.
    given = attach(given, repeats, "doc_id").select("doc_id", "text", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("version"))
    parts = _shuffle_width(given)
    spans = (
        repeated_spans(given, parts, length)
        .groupBy(_node().alias("id"))
        .agg(F.collect_set(F.struct("version", "start", "end")).alias("spans"))
        .hint("shuffle_hash")
    )
    joined = _placed(given, parts).join(spans, F.col("node") == F.col("id"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, version, spans_ in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                left, gone = remove_spans(raw, [(s["start"], s["end"]) for s in spans_ or [] if s["version"] == version])
                for col, x in zip(
                    out,
                    (len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left, [{"start": a, "end": b} for a, b in gone]),
                ):
                    col.append(x)
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=k) for c, k in zip(out, kinds)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
            )

    result = joined.select("doc_id", "text", "version", "spans").mapInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: int, end: int>>",
    )
    return result.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
