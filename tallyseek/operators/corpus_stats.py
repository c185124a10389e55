"""Corpus statistics.  Lengths and words are counted first, so later steps see few rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseek.functions.text import whitespace_tokens


def length_counts(texts: DataFrame, column: str = "content") -> DataFrame:
    """`length, texts`: one row per distinct length."""
    return (
        texts.filter(F.col(column).isNotNull())
        .groupBy(F.length(column).alias("length"))
        .agg(F.count("*").alias("texts"))
    )


def length_summary(texts: DataFrame, column: str = "content") -> DataFrame:
    """One row: count, mean, sample deviation, minimum, quartiles, maximum.

    All of it follows from the count per length: the exact, interpolated quartiles weigh
    each length by its count, and the deviation comes from the centred squares.
    """
    counts = length_counts(texts, column)
    total = counts.agg(
        F.sum("texts").alias("n"), (F.sum(F.col("length") * F.col("texts"))).alias("chars")
    )
    mean = total.select(F.col("chars") / F.col("n")).scalar()
    centred = F.col("length") - mean
    quartiles = F.percentile(F.col("length"), F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.col("texts"))
    return counts.agg(
        F.sum("texts").alias("count"),
        (F.sum(F.col("length") * F.col("texts")) / F.sum("texts")).alias("mean"),
        F.sqrt(F.sum(F.col("texts") * centred * centred) / (F.sum("texts") - 1)).alias("std"),
        F.min("length").alias("min"),
        quartiles.alias("_q"),
        F.max("length").alias("max"),
    ).select(
        "count", "mean", "std", "min",
        F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"),
        "max",
    )


def length_histogram(texts: DataFrame, bins: int = 50, column: str = "content") -> DataFrame:
    """`bin, low, high, texts` for equal bins between the extremes; the last one is closed.

    Lengths are whole numbers, so the division below is exact at every bin edge.
    """
    counts = length_counts(texts, column)
    low = counts.agg(F.min("length")).scalar()
    width = counts.agg(F.max("length") - F.min("length")).scalar()
    place = F.when(width == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("length") - low) * bins / width), F.lit(bins - 1))
    )
    filled = counts.groupBy(place.cast("bigint").alias("bin")).agg(F.sum("texts").alias("texts"))
    edges = counts.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (low + width * F.col("id") / bins).alias("low"),
        (low + width * (F.col("id") + 1) / bins).alias("high"),
    )
    return edges.join(filled, "bin", "left").select(
        "bin", "low", "high", F.coalesce("texts", F.lit(0)).alias("texts")
    )


def word_frequency(texts: DataFrame, column: str = "content") -> DataFrame:
    """`word, frequency`; a hot word is one row per task by the time it is shuffled."""
    words = texts.select(F.explode(whitespace_tokens(F.col(column))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("frequency"))


def top_words(frequencies: DataFrame, n: int = 30) -> DataFrame:
    return frequencies.orderBy(F.desc("frequency"), F.asc("word")).limit(n)


def word_range(top: DataFrame, start: int = 0, end: int = 25) -> DataFrame:
    """Rows `start` to `end` of a top list; a range beyond the list is an error."""
    if start < 0 or end > top.count():
        raise ValueError(f"range {start}:{end} is outside the available words")
    place = F.row_number().over(Window.orderBy(F.desc("frequency"), F.asc("word")))
    return (
        top.withColumn("_place", place)
        .filter((F.col("_place") > start) & (F.col("_place") <= end))
        .drop("_place")
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """`left_column, right_column, correlation` for all pairs, from one aggregation."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"),
                 F.col(f"`{x}|{y}`").alias("correlation"))
        for x, y in pairs
        for a, b in ({(x, y), (y, x)})
    ]
    return row.select(F.inline(F.array(*cells)))


def with_multiplicative_noise(
    df: DataFrame, column: str, key: Column, share: float = 0.14, seed: int = 42
) -> DataFrame:
    """x + x * share * N(0, 1), with a draw that depends on the row's key only.

    Box-Muller on two hashes of the key: the same rows get the same noise however they are
    partitioned, also when a lost task is run again.
    """
    return df.withColumn(column, F.col(column) * (1 + share * keyed_normal(key, seed)))


def keyed_normal(key: Column, seed) -> Column:
    """A standard normal draw that is a function of key and seed.

    The two uniform numbers are 12 hexadecimal digits each of one MD5, so that other engines
    can draw the same.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    digest = F.md5(F.concat_ws("/", key.cast("string"), seed.cast("string")))
    scale = float(1 << 48)

    def uniform(start: int) -> Column:
        return F.conv(F.substring(digest, start, 12), 16, 10).cast("double")

    radius = F.sqrt(-2 * F.log((uniform(1) + 1) / scale))
    return radius * F.cos(2 * 3.141592653589793 * uniform(13) / scale)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def keyed_normals(key: pa.Array, count: pa.Array, seed: pa.Array) -> pa.Array:
    """`keyed_normal` of key and seed, seed + 1, … for `count` numbers, a batch of rows at a time.

    The same MD5 digits: 12 hexadecimal ones are six bytes.  Keys of one length are digested together.
    """
    counts = np.maximum(pc.fill_null(count, 0).to_numpy(zero_copy_only=False).astype("int64"), 0)
    seeds = seed.to_numpy(zero_copy_only=False)
    ends = np.cumsum(counts)
    draws = np.empty(int(ends[-1]) if len(ends) else 0)
    starts, scale = ends - counts, float(1 << 48)
    for rows, prefixes in _by_length(key):
        for number in np.unique(seeds[rows]).tolist():
            mine = seeds[rows] == number
            for i in range(counts[rows[mine]].max(initial=0)):
                asked = mine & (counts[rows] > i)
                first, second, third = _md5_words(prefixes[asked], b"%d" % (number + i))
                high = (first.byteswap().astype("float64") * 65536) + (second.byteswap() >> 16)
                low = ((second.byteswap() & 65535).astype("float64") * 4294967296) + third.byteswap()
                draws[starts[rows[asked]] + i] = np.sqrt(-2 * np.log((high + 1) / scale)) * np.cos(2 * 3.141592653589793 * low / scale)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("int32")), pa.array(draws))


def _by_length(key: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows whose text before the number has one length, and these texts' bytes: the key and a slash, or nothing for no key."""
    text = pc.fill_null(key.cast(pa.large_binary()), b"")
    ends = np.frombuffer(text.buffers()[1], "int64")[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", "uint8")
    lengths = np.where(key.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), -1)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        found = np.full((len(rows), length + 1), ord("/"), "uint8")
        if length > 0:
            found[:, :length] = data[ends[rows][:, None] + np.arange(length)]
        yield rows, found


_MD5_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_MD5_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_MD5_PLACES = [(1, 0), (5, 1), (3, 5), (7, 0)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_words(prefixes: np.ndarray, end: bytes) -> tuple[np.ndarray, ...]:
    """The first three words of the MD5 of every prefix with the same end, in columns; texts beyond one block go one by one."""
    rows, length = len(prefixes), prefixes.shape[1] + len(end)
    if length > 55 or rows < 64:
        digests = b"".join(md5(prefix.tobytes() + end).digest() for prefix in prefixes)
        return tuple(np.frombuffer(digests, "<u4").reshape(-1, 4).T[:3])
    block = np.zeros((rows, 64), "uint8")
    block[:, : prefixes.shape[1]] = prefixes
    block[:, prefixes.shape[1] : length] = np.frombuffer(end, "uint8")
    block[:, length] = 128
    filled = length // 4 + 1
    words = np.ascontiguousarray(block.view("<u4")[:, :filled].T)
    a, b, c, d = (np.full(rows, word, "uint32") for word in _MD5_START)
    mixed = np.empty_like(a)
    for step in range(64):
        turn, at = divmod(step, 16)
        if turn == 0:
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            np.bitwise_not(d, out=mixed)
            mixed |= b
            mixed ^= c
        factor, shift = _MD5_PLACES[turn]
        place = (factor * at + shift) % 16
        a += mixed
        # Behind the text a word is the same for all: its length in bits, or nothing.
        a += np.uint32((_MD5_SINES[step] + (8 * length if place == 14 else 0)) & 0xFFFFFFFF)
        if place < filled:
            a += words[place]
        by = _MD5_TURNS[turn][at % 4]
        np.right_shift(a, np.uint32(32 - by), out=mixed)
        a <<= np.uint32(by)
        a |= mixed
        a += b
        a, b, c, d = d, a, b, c
    return tuple(found + np.uint32(word) for found, word in zip((a, b, c), _MD5_START))
