"""Periodic runs of words: maximal stretches that repeat with a period, found from suffix trees.

For each text: Ukkonen's suffix tree of its words and of their reversal, an Euler tour of each with a sparse table of string
depths (constant-time lowest common ancestor, hence longest common extension), and from the order of the leaves the longest
Lyndon word at every place, for the order of words and for its reverse.  Every run has a Lyndon root among them, so extending
each candidate in both directions yields all runs; each is reported once, with its smallest period.

Trees are built only over words that can lie in a run.  A run of n words with period q has n - q >= n / 2 words that recur q
further on, so with `least` words or more it is covered by grams of `least // 2` words that occur twice in the text.  Stretches
not so covered are left out of the trees, with a symbol of its own between those that remain; no run crosses such a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseek.llm.shingles import mix

LEAST_WORDS = 12
# Texts are compared with themselves in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def suffix_tree(symbols: list[int]) -> tuple[list[int], list[int], list[dict | None]]:
    """(first, last, children) of each node's edge, by Ukkonen's online construction; node 0 is the root.

    An edge is symbols[first:last]; leaves have no children.  The last symbol occurs once, so each suffix has a leaf.
    """
    n = len(symbols)
    first, last, link, kids = [0], [0], [0], [{}]
    node = edge = depth = pending = 0
    for i, symbol in enumerate(symbols):
        pending += 1
        fresh = 0
        while pending:
            if not depth:
                edge = i
            child = kids[node].get(symbols[edge])
            if child is None:
                kids[node][symbols[edge]] = len(first)
                first.append(i), last.append(n), link.append(0), kids.append(None)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                width = last[child] - first[child]
                if kids[child] is not None and depth >= width:
                    edge, depth, node = edge + width, depth - width, child
                    continue
                middle = first[child] + depth
                if symbols[middle] == symbol:
                    if fresh:
                        link[fresh] = node
                    depth += 1
                    break
                split = len(first)
                kids[node][symbols[edge]] = split
                first.append(first[child]), last.append(middle), link.append(0)
                kids.append({symbols[middle]: child, symbol: split + 1})
                first[child] = middle
                first.append(i), last.append(n), link.append(0), kids.append(None)
                if fresh:
                    link[fresh] = split
                fresh = split
            pending -= 1
            if node:
                node = link[node]
            elif depth:
                depth -= 1
                edge = i - pending + 1
    return first, last, kids


class Extensions:
    """Longest common extensions of places in `symbols`, and the order of its suffixes."""

    def __init__(self, symbols: list[int]):
        n = len(symbols)
        first, last, kids = suffix_tree(symbols)
        tour, self.rank, at, leaves = [0], [0] * n, [0] * n, 0
        path = [(0, iter(sorted(kids[0].items())))]
        while path:
            depth, below = path[-1]
            for _, child in below:
                deeper = depth + last[child] - first[child]
                if kids[child] is None:
                    suffix = n - deeper
                    self.rank[suffix], at[suffix] = leaves, len(tour)
                    leaves += 1
                    tour += (deeper, depth)
                else:
                    tour.append(deeper)
                    path.append((deeper, iter(sorted(kids[child].items()))))
                    break
            else:
                path.pop()
                if path:
                    tour.append(path[-1][0])
        self.at = np.array(at)
        # Row k: the least string depth of 2^k neighbours of the tour.
        self.least = [np.array(tour, dtype=np.int32)]
        while (gap := 1 << (len(self.least) - 1)) * 2 <= len(tour):
            row = self.least[-1]
            self.least.append(np.minimum(row[:-gap], row[gap:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b (different places)."""
        x, y = self.at[a], self.at[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level).tolist():
            some = level == k
            row = self.least[k]
            out[some] = np.minimum(row[low[some]], row[high[some] + 1 - (1 << k)])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank, or the length."""
    n = len(rank)
    out, open_ = [n] * n, []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def runs_of(symbols: list[int], least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least `least` symbols and two periods, by start, then period.

    First and last symbol occur once each.
    """
    n = len(symbols)
    ahead, behind = Extensions(symbols), Extensions(symbols[::-1])
    starts, ends = [], []
    # A Lyndon word of an order ends where the next smaller suffix begins; no suffix is a prefix of another, so the
    # reverse order of words has the reverse order of suffixes.
    for rank in (ahead.rank, [-r for r in ahead.rank]):
        after = np.array(next_smaller(rank))
        at = np.flatnonzero(after < n)
        at = at[at > 0]
        starts.append(at), ends.append(after[at])
    i, j = np.concatenate(starts), np.concatenate(ends)
    before = behind.common(n - i, n - j)
    length = before + (j - i) + ahead.common(i, j)
    ok = (length >= least) & (length >= 2 * (j - i))
    return np.unique(np.stack([(i - before)[ok], length[ok], (j - i)[ok]], axis=1), axis=0)


def _covered(ids: np.ndarray, owner: np.ndarray, gram: int) -> np.ndarray:
    """Whether each word lies in a gram that its text holds twice; equal hashes of different grams only add words."""
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    if len(ids) < gram:
        return cover[:-1] > 0
    size = len(ids) - gram + 1
    hashes = mix(owner[:size].astype(np.uint64))
    for k in range(gram):
        hashes = mix(hashes ^ ids[k : k + size].astype(np.uint64))
    at = np.flatnonzero(owner[:size] == owner[gram - 1 :])
    order = np.argsort(hashes[at])
    value = hashes[at][order]
    same = value[1:] == value[:-1]
    twice = at[order[np.r_[same, False] | np.r_[False, same]]] if len(value) else at
    cover[twice] += 1
    cover[twice + gram] -= 1
    return np.cumsum(cover[:-1]) > 0


def text_runs(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[np.ndarray]:
    """Runs of each text, given as words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for words in texts for w in words], dtype=np.int64)
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    cover = _covered(ids, owner, max(1, least // 2))
    change = np.diff(np.r_[False, cover, False].astype(np.int8))
    left, right = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    by_text: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(left.tolist(), right.tolist()):
        # Covered words of neighbouring texts may touch.
        while a < b:
            text = int(owner[a])
            end = min(b, int(begin[text] + sizes[text]))
            if end - a >= least:
                by_text.setdefault(text, []).append((a, end))
            a = end
    for text, pieces in by_text.items():
        symbols, places, border = [len(known)], [0], len(known) + 1
        for a, b in pieces:
            symbols += ids[a:b].tolist()
            places += range(a - int(begin[text]), b - int(begin[text]))
            symbols.append(border)
            places.append(0)
            border += 1
        found = runs_of(symbols, least)
        found[:, 0] = np.array(places)[found[:, 0]]
        out[text] = found
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _run_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, texts = 0, 0, []
            column = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                value = column[i]
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                # Without an argument, split knows the six ASCII blanks and no other.
                texts.append(raw.split())
                size += len(raw)
                if size >= BLOCK_BYTES or i + 1 == batch.num_rows:
                    yield _answer(batch.slice(start, len(texts)), texts, least)
                    start, size, texts = i + 1, 0, []

    return run


def _answer(batch: pa.RecordBatch, texts: list[list[bytes]], least: int) -> pa.RecordBatch:
    runs = text_runs(texts, least)
    flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    offsets = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
    parts = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(k) for k in range(batch.num_columns - 1)],
            pa.array([len(w) for w in texts], type=pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(_RUN))),
            pa.array([collapse(w, r) for w, r in zip(texts, runs)], type=pa.binary()),
        ],
        names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, keep: list[str], text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row per input row: the `keep` columns, n_words, runs (start, length, period; by start, then period) and collapsed.

    A run is a stretch of consecutive words `[^\\x20\\x09-\\x0D]+` with smallest period q and at least max(least, 2 q) words that
    neither neighbour extends; `collapsed` is the text without the words that some run holds after its first period, joined
    by one space.  A null or blank text has no words, no runs and an empty `collapsed`.  Each row is judged by itself, so repeated rows,
    repeated or null ids are no exception; other columns are not read.  An empty table gives no rows.  Texts of any length are taken whole;
    a task holds one block and the trees of one text, about a kilobyte for each of its words that recurs in a gram.
    """
    given = docs.select(*keep, F.col(text_col).alias("_text"))
    out = T.StructType(
        [
            *[given.schema[c] for c in keep],
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("_collapsed", T.BinaryType()),
        ]
    )
    found = given.mapInArrow(_run_rows(least), out)
    return found.select(*keep, "n_words", "runs", F.col("_collapsed").cast("string").alias("collapsed"))
