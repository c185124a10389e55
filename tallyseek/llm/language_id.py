"""Language identification by known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyseek.llm.common import bounded_sample, stored

# Bounds of the fitted model: training documents per language, words and n-grams kept per language.
TRAIN_DOCS = 3000
KEEP_WORDS = 20_000
KEEP_GRAMS = 20_000
LONGEST_GRAM = 5
# Unseen words of one task whose scores are remembered; a memory bound, not a cut: others are computed again.
MEMO = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return [w for w in _LETTERS.findall((text or "").lower()) if w.isalpha()]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between its edge marks."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class BackoffModel:
    """Log frequencies of words and n-grams per language."""

    def __init__(self, langs: list[str], counts: dict[int, dict[str, dict[str, int]]]):
        """counts: per level (0 words, n n-grams) and language, the kept entries with their counts."""
        self.langs = sorted(langs)
        self.levels: dict[int, tuple[dict[str, int], np.ndarray]] = {}
        for level, per_lang in counts.items():
            keys = sorted({k for lang in self.langs for k in per_lang.get(lang, {})})
            place = {k: i for i, k in enumerate(keys)}
            table = np.full((len(keys), len(self.langs)), 0.5)
            for j, lang in enumerate(self.langs):
                for k, n in per_lang.get(lang, {}).items():
                    table[place[k], j] += n
            self.levels[level] = (place, np.log(table / np.maximum(table.sum(axis=0), 1)))

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the word's known n-grams of the longest length that has any."""
        for n in range(LONGEST_GRAM, 0, -1):
            place, table = self.levels.get(n, ({}, None))
            known = [i for g in grams(word, n) if (i := place.get(g)) is not None]
            if known:
                return table[known].mean(axis=0)
        return np.zeros(len(self.langs))

    def scorer(self):
        """A function text -> (lang, score); it keeps its own bounded memo of unseen words."""
        place, table = self.levels.get(0, ({}, np.zeros((0, len(self.langs)))))
        memo: dict[str, np.ndarray] = {}

        def score(text: str | None) -> tuple[str, float]:
            counted = Counter(letter_words(text))
            if not counted or not self.langs:
                return "und", 0.0
            rows, times, rest = [], [], np.zeros(len(self.langs))
            for word, n in counted.items():
                at = place.get(word)
                if at is not None:
                    rows.append(at)
                    times.append(n)
                    continue
                found = memo.get(word)
                if found is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    found = memo[word] = self.unseen(word)
                rest = rest + n * found
            total = rest + np.asarray(times, dtype=float) @ table[rows] if rows else rest
            level = total / math.sqrt(sum(counted.values()))
            likely = np.exp(level - level.max())
            best = int(np.argmax(likely))
            return self.langs[best], float(likely[best] / likely.sum())

        return score


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counted.setdefault(lang, Counter()).update(letter_words(text))
    for lang, words in counted.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), type=pa.int64())],
            names=["lang", "word", "n"],
        )


def fit_backoff(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key: str = "doc_id") -> BackoffModel:
    """Fit on at most about TRAIN_DOCS documents per language that has one; null languages teach nothing."""
    sample = bounded_sample(docs.filter(F.col(lang_col).isNotNull()), key, TRAIN_DOCS, by=lang_col)
    words = stored(
        sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(_count_words, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    pieces = F.explode(
        F.array(*[F.lit(n) for n in range(1, LONGEST_GRAM + 1)])
    ).alias("level")
    cut = words.select("lang", "n", marked.alias("m"), pieces).filter(F.length("m") >= F.col("level"))
    gram_counts = (
        cut.select(
            "lang", "level", "n",
            F.explode(
                F.transform(F.sequence(F.lit(1), F.length("m") - F.col("level") + 1), lambda i: F.substr("m", i, F.col("level")))
            ).alias("word"),
        )
        .groupBy("lang", "level", "word")
        .agg(F.sum("n").alias("n"))
    )
    every = words.filter("n > 1").select("lang", F.lit(0).alias("level"), "word", "n").unionByName(gram_counts)
    best = Window.partitionBy("lang", "level").orderBy(F.desc("n"), "word")
    kept = (
        every.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= F.when(F.col("level") == 0, KEEP_WORDS).otherwise(KEEP_GRAMS))
        .select("level", "lang", "word", "n")
        .toArrow()
    )
    counts: dict[int, dict[str, dict[str, int]]] = {}
    langs = set()
    for level, lang, word, n in zip(*(column.to_pylist() for column in kept.columns)):
        counts.setdefault(level, {}).setdefault(lang, {})[word] = n
        langs.add(lang)
    return BackoffModel(sorted(langs), counts)


def identify(docs: DataFrame, model: BackoffModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, with lang_pred and score (0 to 1).

    Every word of the whole text counts.  A text that is null or has no letter is `und` with score 0, and so is every
    text if the model has no language.  Ties go to the first language by name.  Only `keep` and the text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # The text goes to the workers once: as a kept column, or after them.
    place = keep.index(text_col) if text_col in keep else len(keep)
    kept = len(keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            found = [score(x.as_py()) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())],
                names=[*batch.schema.names[:kept], "lang_pred", "score"],
            )

    given = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("_text")]))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return given.mapInArrow(predict, schema)
