"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

For every document window as long as a benchmark item, and holding at least one of the benchmark's five-word shingles (others have similarity 0
to every item), a 64-bit SimHash of the window's shingles is looked up among the items of the same length.  A document shorter than
an item is one window, looked up among the longer items that it can be similar to.  RADIUS + 1
blocks of the fingerprint index the items: two fingerprints within RADIUS agree in at least one block, so no such pair is missed.  Pairs within
the radius are verified on their exact shingle multisets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyseek.llm.common import stored, text_or_empty
from tallyseek.operators.sizing import fits

SHINGLE = 5
# Fingerprints of windows at similarity 0.8 differ in 9.7 of 64 bits on average, standard deviation 2.9.
RADIUS = 19
# Item shingles up to this many rows (about 32 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 250_000


def _words(column: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text_or_empty(column)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """use(value) with `value` computed once per row, however often `use` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shingle(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(SHINGLE)])


def _shingles(words: Column, start: Column, count: Column) -> Column:
    """Hashes of `count` shingles from word `start` on; empty if count is below 1."""
    none = F.array().cast("array<bigint>")
    return F.when(count >= 1, F.transform(F.sequence(start, start + count - 1), lambda i: _shingle(words, i))).otherwise(none)


def simhash(shingles: Column) -> Column:
    """Bit k is set if more than half of the shingle hashes have it set; counts run in two 32-bit lanes per sum."""
    lanes = F.lit(0x0000000100000001)
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda s: F.aggregate(
            shingles, F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftrightunsigned", x, s).bitwiseAND(lanes)
        ),
    )

    def bits(v: Column) -> Column:
        half = F.size(shingles)

        def set_bit(lane, at):
            return F.when(lane * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(31)),
            F.lit(0).cast("long"),
            lambda a, s: a.bitwiseOR(set_bit(F.get(v, s).bitwiseAND(F.lit(0xFFFFFFFF)), s)).bitwiseOR(
                set_bit(F.call_function("shiftrightunsigned", F.get(v, s), F.lit(32)), s + 32)
            ),
        )

    return _bound(sums, bits)


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """radius + 1 structs (block, value) that cut the 64 bits into nearly equal blocks."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.call_function("shiftrightunsigned", fingerprint, F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"),
            )
            for i, (a, b) in enumerate(zip(edges, edges[1:]))
        ]
    )


def counted(shingles: Column) -> Column:
    """The multiset as a set: the k-th copy of a shingle is told from the others."""
    numbered = _bound(
        F.array_sort(shingles),
        lambda v: F.transform(v, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(v, x).cast("int"))),
    )
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(numbered)


def benchmark_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Stored: item_id, n_words, shingles, fingerprint, members; items below five words have no shingle and are left out."""
    words = items.select(F.col(id_col).alias("item_id"), F.array(_words(text_col)).alias("w")).withColumn("w", F.explode("w"))
    cut = words.select("item_id", F.size("w").alias("n_words"), F.array(_shingles(F.col("w"), F.lit(0), F.size("w") - SHINGLE + 1)).alias("s"))
    cut = cut.filter(F.col("n_words") >= SHINGLE).select("item_id", "n_words", F.explode("s").alias("shingles"))
    return stored(cut.select("*", simhash(F.col("shingles")).alias("fingerprint"), counted(F.col("shingles")).alias("members")))


def contaminated(
    docs: DataFrame, items: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """Pairs (doc_id, item_id, start_word, n_words, similarity): each item's most similar window of each row.

    Similarity is the weighted Jaccard of the multisets of five-word shingles of an item and of a window of as many
    words, or of the whole document if it has fewer, 0.8 or more; words are lower-cased runs of letters and digits.  Of equally similar windows the first counts.  Null and
    short texts match nothing; rows are told by id and text together (64 hash bits), so only rows equal in both are one.  With `row_col` (a
    number that tells rows apart, the same at every read) each row is a document, and the pairs have it as `row`.  Other columns are not read.
    """
    known = benchmark_items(items)
    small = F.broadcast if fits(known.select(F.explode("shingles").alias("h")), BROADCAST_SHINGLES) else (lambda df: df)
    places = (
        known.select("n_words", F.posexplode("shingles").alias("place", "h"))
        .distinct()
        .groupBy("h")
        .agg(F.collect_set(F.struct("n_words", "place")).alias("seen"))
    )
    number = F.col(row_col).cast("long") if row_col else F.xxhash64(F.col(id_col).cast("long"), text_col)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), number.alias("row"))
    every = given.select("row", F.posexplode(_bound(_words("text"), lambda w: _shingles(w, F.lit(0), F.size(w) - SHINGLE + 1))).alias("at", "h"))
    starts = (
        every.join(small(places), "h")
        .select("row", "at", F.explode("seen").alias("p"))
        .select("row", F.struct(F.col("p.n_words").alias("n_words"), F.greatest(F.col("at") - F.col("p.place"), F.lit(0)).alias("start")).alias("s"))
        .groupBy("row")
        .agg(F.collect_set("s").alias("starts"))
    )
    chosen = given.join(starts.hint("shuffle_hash"), "row").select(
        "row",
        "doc_id",
        F.explode(
            _bound(
                _words("text"),
                lambda w: F.transform(
                    F.array_distinct(
                        F.transform(
                            # A text shorter than an item is one window; with under 0.8 of the item's shingles it is not similar.
                            F.filter("starts", lambda s: (s["n_words"] - SHINGLE + 1) * 4 <= (F.size(w) - SHINGLE + 1) * 5),
                            lambda s: F.struct(
                                s["n_words"].alias("wanted"),
                                F.least(s["n_words"], F.size(w)).alias("n_words"),
                                # A window that would end past the text is moved back to end with it.
                                F.greatest(F.least(s["start"], F.size(w) - s["n_words"]), F.lit(0)).alias("start"),
                            ),
                        )
                    ),
                    lambda s: F.struct(s["wanted"], s["n_words"], s["start"], _shingles(w, s["start"], s["n_words"] - SHINGLE + 1).alias("shingles")),
                ),
            )
        ).alias("v"),
    )
    windows = chosen.select("row", "doc_id", "v.wanted", "v.n_words", "v.start", "v.shingles").withColumn("fingerprint", simhash(F.col("shingles")))
    keyed = windows.withColumn("key", F.explode(blocks(F.col("fingerprint"), radius)))
    index = known.select(
        "item_id", F.col("n_words").alias("item_words"), F.col("fingerprint").alias("item_print"), "members",
        F.explode(blocks(F.col("fingerprint"), radius)).alias("item_key"),
    )
    far = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))
    # A pair within the radius may agree in several blocks; it goes on from the first one only.
    differing = F.col("fingerprint").bitwiseXOR(F.col("item_print"))
    first = F.array_position(F.transform(blocks(differing, radius), lambda b: b["value"] == 0), F.lit(True)) - 1
    pairs = keyed.join(
        small(index),
        (F.col("wanted") == F.col("item_words")) & (F.col("key") == F.col("item_key")) & (far <= radius),
    ).filter(first == F.col("key.block"))
    common = F.size(F.array_intersect(counted(F.col("shingles")), F.col("members")))
    # Shingles of the item and of the window together.
    size = F.size("members") + F.size("shingles")
    return (
        pairs.select("row", "doc_id", "item_id", "start", "n_words", common.alias("common"), size.alias("size"))
        .filter(F.col("common") * 9 >= F.col("size") * 4)
        .groupBy("row", "doc_id", "item_id")
        .agg(
            F.max_by(F.struct("start", "n_words", "common", "size"), F.struct("common", -F.col("start"))).alias("best")
        )
        .select(
            "doc_id", "item_id", F.col("best.start").alias("start_word"), "best.n_words",
            (F.col("best.common") / (F.col("best.size") - F.col("best.common"))).alias("similarity"),
            *(["row"] if row_col else []),
        )
    )
