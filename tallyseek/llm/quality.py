"""Quality by ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseek.llm.common import bounded_sample
from tallyseek.llm.shingles import blocks, mix, word_hashes

# Bounds of the fitted model: rated documents it learns from and hashed weights it has.
TRAIN_DOCS = 10_000
WEIGHTS = 1 << 15
ROUNDS = 150
PENALTY = 2e-4

# Character classes of the shape marks, by byte: ASCII symbols and digits.
_SYMBOL, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_DIGIT[48:58] = True
_MARKS = mix(np.arange(64 * 5, dtype=np.uint64) + np.uint64(31_337))


def hashed_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed feature, value) over lower-cased texts: damped word counts of unit length, and shape marks.

    Shape marks are steps of the shares of symbols, repeated neighbours, distinct words and digits, and the number of
    words.  A text without words has only its marks.
    """
    texts = len(raws)
    words, owner = word_hashes(raws)
    keys, counts = np.unique(owner * WEIGHTS + ((words >> np.uint64(20)) % np.uint64(WEIGHTS)).astype(np.int64), return_counts=True)
    row, values = keys // WEIGHTS, 1.0 + np.log(counts)
    length = np.sqrt(np.bincount(row, weights=values * values, minlength=texts))
    n = np.bincount(owner, minlength=texts)
    again = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=texts) if len(words) else n
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    sizes = np.maximum(np.diff(np.r_[0, ends]), 1)
    some = np.maximum(n, 1)
    marks = [np.log2(n + 1), 40 * again / some, 40 * np.bincount(row, minlength=texts) / some]
    for kind in (_SYMBOL, _DIGIT):
        total = np.r_[0, np.cumsum(kind[data])]
        marks.append(120 * (total[ends] - total[np.r_[0, ends[:-1]]]) / sizes)
    steps = [np.minimum(m.astype(np.int64), 63) + 64 * i for i, m in enumerate(marks)]
    at = np.r_[keys % WEIGHTS, *[(_MARKS[m] % np.uint64(WEIGHTS)).astype(np.int64) for m in steps]]
    return (
        np.r_[row, np.tile(np.arange(texts), len(steps))],
        at,
        np.r_[values / np.maximum(length[row], 1e-9), np.full(texts * len(steps), 0.5)],
    )


class OrdinalModel:
    """One weight vector for all grades and increasing thresholds: P(grade > k) = logistic(w.x - t_k)."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, raws: list[bytes]) -> np.ndarray:
        """Per text P(grade >= each grade but the lowest), not increasing."""
        row, at, values = hashed_features(raws)
        z = np.bincount(row, weights=self.weights[at] * values, minlength=len(raws))
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -30, 30)))


def fit_cumulative(rows: np.ndarray, at: np.ndarray, values: np.ndarray, levels: np.ndarray, n_levels: int):
    """Full-batch adaptive gradient descent on the cumulative-link likelihood.

    Thresholds are a first value plus exponentials, so that they stay in order.  `rows`, `at`, `values`: the
    sparse features; `levels`: each row's grade number.
    """
    n = len(levels)
    weights, past = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-8)
    share = np.array([(levels > k).mean() for k in range(n_levels - 1)])
    first = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    base = np.r_[first[:1], np.log(np.maximum(np.diff(first), 1e-2))]
    base_past = np.full(len(base), 1e-8)
    above = levels[:, None] > np.arange(n_levels - 1)[None, :]
    reached = levels[:, None] >= np.arange(n_levels - 1)[None, :]
    for step in range(ROUNDS):
        t = np.cumsum(np.r_[base[:1], np.exp(base[1:])])
        z = np.bincount(rows, weights=values * weights[at], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -30, 30)))
        # Likelihood of a grade is the difference of neighbouring tails; its slope by each tail:
        padded = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        chance = np.maximum(padded[np.arange(n), levels] - padded[np.arange(n), levels + 1], 1e-9)
        sign = above.astype(float) * 0.0
        low = levels - 1
        has_low, has_up = low >= 0, levels < n_levels - 1
        sign[np.flatnonzero(has_low), low[has_low]] += 1.0
        sign[np.flatnonzero(has_up), levels[has_up]] -= 1.0
        slope = sign * p * (1 - p) / chance[:, None] * reached.clip(0, 1)
        by_z = slope.sum(axis=1)
        grad = -np.bincount(at, weights=values * by_z[rows], minlength=WEIGHTS) / n + PENALTY * weights
        grad_t = slope.sum(axis=0) / n
        tail = np.cumsum(grad_t[::-1])[::-1]
        grad_base = np.r_[tail[:1], tail[1:] * np.exp(base[1:])]
        past += grad**2
        base_past += grad_base**2
        weights -= 0.5 * grad / np.sqrt(past)
        base -= 0.1 * grad_base / np.sqrt(base_past)
    return weights, np.cumsum(np.r_[base[:1], np.exp(base[1:])])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raws in blocks(batch.column(0).to_pylist()):
            row, at, values = hashed_features(raws)
            order = np.argsort(row, kind="stable")
            offsets = pa.array(np.searchsorted(row[order], np.arange(len(raws) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(offsets, pa.array(at[order].astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(values[order].astype(np.float32))),
                    batch.column(1).slice(first, len(raws)),
                ],
                names=["at", "values", "grade"],
            )


def fit_quality(rated: DataFrame, text_col: str = "text", grade_col: str = "grade", key: str = "doc_id") -> OrdinalModel | None:
    """Fit on at most about TRAIN_DOCS rated rows; null grades teach nothing; None if there is no rating."""
    sample = bounded_sample(rated.filter(F.col(grade_col).isNotNull()), key, TRAIN_DOCS)
    found = (
        sample.select(F.col(text_col).alias("text"), F.col(grade_col).cast("int").alias("grade"))
        .mapInArrow(_feature_rows, "at array<int>, values array<float>, grade int")
        .toArrow()
        .combine_chunks()
    )
    if not found.num_rows:
        return None
    grade = found.column("grade").to_numpy()
    grades = sorted(set(grade.tolist()))
    if len(grades) < 2:
        return OrdinalModel(grades, np.zeros(WEIGHTS), np.zeros(0))
    lists = found.column("at").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    at = lists.flatten().to_numpy()
    values = found.column("values").combine_chunks().flatten().to_numpy().astype(float)
    levels = np.searchsorted(grades, grade)
    weights, thresholds = fit_cumulative(np.repeat(np.arange(len(grade)), lengths), at, values, levels, len(grades))
    return OrdinalModel(grades, weights.astype(np.float32), thresholds)


def score_quality(docs: DataFrame, model: OrdinalModel | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row with expected_grade, tail_prob (of the highest grade) and grade (most likely).

    Null and empty texts are scored by their length mark alone.  Without a model the three are null.
    """
    given = docs.select(*keep, F.col(text_col).alias("_text"))
    if model is None:
        return given.drop("_text").select(
            "*", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_prob"),
            F.lit(None).cast("int").alias("grade"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        grades = np.asarray(fitted.grades)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 1000):
                for first, raws in blocks(texts.slice(at, 1000).to_pylist()):
                    tails = fitted.tails(raws)
                    ends = np.ones((len(raws), 1))
                    chances = -np.diff(np.hstack([ends, tails, 0 * ends]), axis=1)
                    top = tails[:, -1] if tails.shape[1] else ends[:, 0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[c.slice(at + first, len(raws)) for c in batch.columns[:-1]],
                            pa.array(grades[0] + tails @ np.diff(grades).astype(float)),
                            pa.array(top),
                            pa.array(grades[np.argmax(chances, axis=1)].astype(np.int32)),
                        ],
                        names=[*batch.schema.names[:-1], "expected_grade", "tail_prob", "grade"],
                    )

    schema = given.drop("_text").schema.add("expected_grade", "double").add("tail_prob", "double").add("grade", "integer")
    return given.mapInArrow(run, schema)
