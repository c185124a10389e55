"""Spelling variants: words one edit apart, found with asymmetric chunks.

Of two words the shorter one (of equal length the smaller) contributes two disjoint chunks, its halves; the other contributes
its positional grams of that size.  One edit leaves a half untouched, at a place shifted by no more than one:
the first half stays where it is, the second is shifted by the difference in length.  So only the grams at these places can
join; each candidate is verified.

A chunk that too many words share is dealt anew: what is not compared yet of the shorter word is halved
again, and again one half is untouched.  This ends at a single code point, where the words that still meet differ in that one
alone.  No partner is capped and no frequent chunk is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseek.llm.common import stored
from tallyseek.operators.sizing import attach, materialize

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
# Letters of U+00C0 to U+00FF are C3 80 to C3 BF in UTF-8.
LETTERS = rb"(?:[a-z]|\xc3[\x80-\xbf])+"
# Words are counted together for texts of about so many bytes.
BLOCK_BYTES = 1 << 23
# A chunk whose candidate pairs are more than this is dealt anew.
CROWD = 4096

# (id or None, lower-cased run) to the word it counts as, both in UTF-8.
Alter = Callable[[int | None, bytes], bytes]


def _count_rows(least: int, alter: Alter | None):
    letters = re.compile(LETTERS)

    def rows(total: Counter) -> pa.RecordBatch:
        kept = [w for w in total if len(w) - w.count(b"\xc3") >= least]
        return pa.record_batch([pa.array(kept, pa.binary()), pa.array([total[w] for w in kept], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = Counter(), 0
        for batch in batches:
            ids = batch.column(0)
            for i, value in enumerate(batch.column(1)):
                if not value.is_valid:
                    continue
                # bytes.lower knows A-Z only.
                raw = value.as_buffer().to_pybytes().lower()
                size += len(raw)
                if alter is None:
                    total.update(letters.findall(raw))
                else:
                    key = ids[i].as_py()
                    for found, n in Counter(letters.findall(raw)).items():
                        total[alter(key, found)] += n
                if size >= BLOCK_BYTES:
                    yield rows(total)
                    total, size = Counter(), 0
        yield rows(total)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, alter: Alter | None = None) -> DataFrame:
    """Rows (word, n): maximal runs of Latin letters, A-Z lower-cased, of at least `least` code points, with their occurrences.

    `alter` may change a run of a document before it is counted.  Null texts have no words.
    """
    given = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    counted = given.mapInArrow(_count_rows(least, alter), "word binary, n long")
    return counted.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _sides(vocabulary: DataFrame) -> DataFrame:
    """Each word as the shorter side (gap null) and as the longer one, for partners of its length and of one less.

    `low` and `high` bound what is not compared yet of the shorter word; the longer one has `gap` more there.
    """
    size = F.length("word")
    roles = F.array(
        F.struct(F.lit(None).cast("int").alias("gap"), size.alias("high")),
        F.struct(F.lit(0).alias("gap"), size.alias("high")),
        F.struct(F.lit(1).alias("gap"), (size - 1).alias("high")),
    )
    return vocabulary.select("word", "n", F.explode(roles).alias("r")).select(
        F.xxhash64("r.high").alias("key"), "word", "n", "r.gap", F.lit(0).alias("low"), "r.high"
    )


def _halved(rows: DataFrame) -> DataFrame:
    """Two rows per row, one for each half that may be untouched."""
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    shift = F.coalesce("gap", F.lit(0))
    first = F.substring("word", F.col("low") + 1, middle - F.col("low"))
    second = F.substring("word", middle + shift + 1, F.col("high") - middle)
    halves = F.array(
        F.struct(F.xxhash64("key", F.lit(1), first).alias("key"), middle.alias("low"), F.col("high").alias("high")),
        F.struct(F.xxhash64("key", F.lit(2), second).alias("key"), F.col("low").alias("low"), middle.alias("high")),
    )
    return rows.select("word", "n", "gap", F.explode(halves).alias("h")).select("h.key", "word", "n", "gap", "h.low", "h.high")


def near_words(vocabulary: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words of `vocabulary` (word, n; each word once) that differ by one code point, each pair once."""
    rows = _halved(_sides(vocabulary))
    found = None
    while True:
        # An end that cannot be halved is joined at any size: its words differ in that one code point.
        meet = rows.filter("high - low > 1").groupBy("key").agg(F.count("gap").alias("longer"), F.count("*").alias("all"))
        crowded = materialize(meet.filter((F.col("longer") * (F.col("all") - F.col("longer"))) > crowd).select("key", F.lit(True).alias("hot")))
        told = attach(rows, crowded, "key")
        calm = told.filter("hot IS NULL")
        a = calm.filter("gap IS NULL").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = calm.filter("gap IS NOT NULL").select("key", "gap", F.col("word").alias("b"), F.col("n").alias("b_n"))
        near = a.join(b.hint("shuffle_hash"), (a["key"] == b["key"]) & ((F.col("gap") == 1) | (F.col("a") < F.col("b")))).filter(
            F.levenshtein("a", "b", 1) == 1
        )
        pairs = stored(near.select("a", "a_n", "b", "b_n").distinct())
        found = pairs if found is None else found.unionByName(pairs)
        if crowded.isEmpty():
            return found.distinct()
        rows = stored(_halved(told.filter("hot").select(rows.columns)))


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root) for each word with a form: the last word that the forms lead to.

    A form occurs at least twice as often as its word, so a chain is short; each round doubles the steps taken.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(attach(roots, further, "root"))
        roots = stepped.select("word", F.coalesce("next", "root").alias("root"))
        if stepped.filter("next IS NOT NULL").isEmpty():
            return roots


def spelling_variants(counts: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """One row per word of `counts` (word, n; one row a word) with at least `least` occurrences: word, form, root, n, n_near, form_n.

    Words are near if one inserted, deleted or replaced code point is all that tells them apart.  A word's form is its near
    word with the most occurrences (ties: first in code-point order) if these are at least `ratio` times its own, else null; its root is the last word on
    the way from form to form, itself without one; n_near counts its near words.  Null words are left out; other columns are not read; an
    empty table gives no rows.
    """
    vocabulary = stored(counts.select("word", F.col("n").cast("long").alias("n")).filter((F.col("n") >= least) & F.col("word").isNotNull()))
    pairs = near_words(vocabulary, crowd)
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")).alias("near")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("form")).alias("near")),
    )
    best = (
        pairs.select(F.explode(ways).alias("w"))
        .groupBy("w.word")
        .agg(F.min("w.near").alias("best"), F.count("*").alias("n_near"))
    )
    chosen = -F.col("best.less") >= ratio * F.col("n")
    linked = stored(
        vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _followed(linked.filter("form IS NOT NULL"))
    return linked.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
