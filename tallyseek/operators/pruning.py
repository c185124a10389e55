"""Exact top-k over postings without scoring every posting of frequent terms.

The most frequent terms have slots, and each chunk carries its counts of them as a short array, its profile.  A question's
other terms are rare: their postings are matched in full.  The chunks so found are scored exactly, rare terms from the match and frequent ones from the
profile in the chunk's own row, and the k-th best of them is a threshold that the answer cannot fall below.

Only chunks without any rare term are left.  If each frequent term of the question has a floor, and what the floors add up
to stays below the threshold, then a chunk that reaches no floor cannot reach the threshold: it is never a row.  Floors are chosen from counted
levels of each term's impact, so that they let as few postings through as the threshold allows; whatever they are, the answer is exact.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseek.operators.ranking import top_k
from tallyseek.operators.sizing import BROADCAST_ROWS, HOT_SHARE, fits, materialize, spread

# Terms with a slot, and levels that their impacts are counted in.
PROFILE_TERMS, LEVELS = 512, 16
# Chunks per wanted answer whose scores give the threshold, taken by their rare terms.
SEEDS = 20
# Matched rows up to which scoring all of them is cheaper than the extra passes.
PRUNE_FROM = 20_000_000
# Scores this close may tie once they are rounded for comparison.
MARGIN = 1e-8


@dataclass(frozen=True)
class Measure:
    """A score that is a sum of weight * posting(tf, dl) * factor(norm) over the terms of a question.

    posting * factor is a posting's impact, and grows with tf; `edges` are the bounds of its levels, from 0 up.
    """

    name: str
    posting: Callable[[Column, Column], Column]
    factor: Callable[[Column], Column]
    edges: tuple[float, ...]
    normed: bool = False

    def impact(self, tf: Column, dl: Column, norm: Column) -> Column:
        return self.posting(tf, dl) * self.factor(norm)


def match(
    postings: DataFrame,
    weighted: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    keep: Callable[[Callable[[str], Column]], Column] | None = None,
) -> DataFrame:
    """Join postings to `query_id, term, …, df` rows on the term, if `keep` (given the row's columns by name) holds.

    Small query side: one broadcast row per term, so a posting is looked up once and keeps
    its `chunk_id` partitioning; rows that are not kept never come into being.
    Otherwise a shuffle join on `(term, salt)`, where a term gets salts in proportion to its
    share of the postings and the query rows are repeated once per salt.
    """
    if fits(weighted, broadcast_rows):
        details = [c for c in weighted.columns if c not in ("term", "df")]
        per_term = weighted.groupBy("term").agg(
            F.collect_list(F.struct(*details)).alias("_asked")
        )
        asked = F.col("_asked")
        if keep is not None:
            asked = F.filter(asked, lambda entry: keep(lambda name: entry[name]))
        return postings.join(F.broadcast(per_term), "term").select(
            *postings.columns, F.inline(asked)
        )
    frequencies = materialize(weighted.select("term", "df").distinct())
    total = frequencies.agg(F.sum("df")).scalar()
    salts = F.greatest(F.lit(1), F.ceil(F.col("df") * HOT_SHARE / total)).cast("int")
    salted = frequencies.select("term", salts.alias("salts"))
    # Terms with two or more salts hold over 1/HOT_SHARE of the postings each.
    hot = salted.filter(F.col("salts") > 1)
    left = postings.join(F.broadcast(hot), "term", "left").withColumn(
        "salt", F.pmod(F.xxhash64("chunk_id"), F.coalesce("salts", F.lit(1))).cast("int")
    )
    right = (
        weighted.drop("df")
        .join(F.broadcast(hot), "term", "left")
        .withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
        )
    )
    joined = left.drop("salts").join(right.drop("salts"), ["term", "salt"]).drop("salt")
    return joined if keep is None else joined.filter(keep(F.col))


def frequent_terms(terms: DataFrame, count: int = PROFILE_TERMS) -> DataFrame:
    """`term, slot` of the terms with the highest df; any choice is right, this one prunes best."""
    top = terms.orderBy(F.desc("df"), "term").limit(count).select("term").collect()
    return _short(terms.sparkSession, [(r["term"], slot) for slot, r in enumerate(top)], "term string, slot int")


def _short(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """At most PROFILE_TERMS rows as a table that no job has to read again."""
    return spark.createDataFrame(rows, schema)


def profile_array(entries: Column) -> Column:
    """Counts by slot, of `slot, tf` structs: 0 for a slot in between, nothing after the last one."""

    def filled(ordered: Column) -> Column:
        def with_gap(entry: Column, at: Column) -> Column:
            before = F.coalesce(F.get(ordered, at - 1)["slot"], F.lit(-1))
            return F.concat(F.array_repeat(F.lit(0), entry["slot"] - before - 1), F.array(entry["tf"]))

        return F.flatten(F.transform(ordered, with_gap))

    return F.get(F.transform(F.array(F.sort_array(entries)), filled), F.lit(0))


def profile_entries(chunks: DataFrame) -> DataFrame:
    """`chunk_id, dl, norm, slot, tf` of the frequent terms that a chunk holds."""
    return chunks.select("chunk_id", "dl", "norm", F.posexplode("profile").alias("slot", "tf")).filter("tf > 0")


def impact_levels(chunks: DataFrame, measure: Measure) -> DataFrame:
    """`slot, top, counts`: highest impact of each frequent term, and its chunks by level of impact."""
    entries = profile_entries(chunks)
    impact = measure.impact(F.col("tf"), F.col("dl"), F.col("norm"))
    level = reduce(add, [(impact >= edge).cast("int") for edge in measure.edges[1:-1]])
    counts = F.array(*[F.count_if(F.col("level") == j) for j in range(LEVELS)])
    levels = (
        entries.select("slot", impact.alias("impact"), level.alias("level"))
        .groupBy("slot")
        .agg(F.max("impact").alias("top"), counts.alias("counts"))
    )
    return _short(chunks.sparkSession, levels.collect(), "slot int, top double, counts array<bigint>")


def rare_pairs(index, weighted: DataFrame, measure: Measure, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`chunk_id, query_id, partial` of all chunks with a rare term of the question, partitioned by chunk."""
    rare = weighted.join(F.broadcast(index.frequent.select("term")), "term", "left_anti")
    gained = F.col("weight") * measure.posting(F.col("tf"), F.col("dl"))
    matched = match(index.postings, rare, broadcast_rows).select("chunk_id", "query_id", gained.alias("gained"))
    return spread(matched, "chunk_id").groupBy("chunk_id", "query_id").agg(F.sum("gained").alias("partial"))


def frequent_pairs(index, floors: DataFrame, measure: Measure, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`chunk_id, query_id, slot, floor` of the profile entries that reach the question's floor."""
    entries = profile_entries(index.chunks).withColumnRenamed("slot", "term")
    reached = entries.select("chunk_id", "term", measure.impact(F.col("tf"), F.col("dl"), F.col("norm")).alias("impact"))
    # A floor of its own for every question and term: postings below it are not matched.
    return match(reached, floors, broadcast_rows, lambda get: F.col("impact") >= get("floor"))


def rescored(pairs: DataFrame, index, weighted: DataFrame, measure: Measure, small: bool) -> DataFrame:
    """`chunk_id, query_id, gain`: exact scores of pairs whose rare terms add up to `partial`.

    A question's frequent terms travel as a list of at most PROFILE_TERMS entries and are looked up in the chunk's row.
    """
    slots = (
        weighted.join(F.broadcast(index.frequent), "term")
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("slot", "weight")).alias("slots"))
    )
    rows = index.chunks.join(pairs, "chunk_id").join(F.broadcast(slots) if small else slots, "query_id", "left")

    def gained(total: Column, asked: Column) -> Column:
        tf = F.coalesce(F.get(F.col("profile"), asked["slot"]), F.lit(0))
        return total + F.when(tf > 0, asked["weight"] * measure.posting(tf, F.col("dl"))).otherwise(0.0)

    frequent = F.when(F.col("slots").isNull(), F.lit(0.0)).otherwise(F.aggregate("slots", F.lit(0.0), gained))
    gain = F.coalesce((F.col("partial") + frequent) * measure.factor(F.col("norm")), F.lit(0.0))
    return rows.select("chunk_id", "query_id", gain.alias("gain"))


def _floors_of(weights: np.ndarray, tops: np.ndarray, counts: np.ndarray, edges: np.ndarray, budget: float) -> np.ndarray:
    """A floor for each term; weight * floor adds up to `budget` at most, and the postings below are as many as can be.

    The best trade of skipped postings for budget at a common price; the price is found by bisection.
    """
    floors = np.minimum(edges[None, :], tops[:, None] * (1 + 1e-9))
    cost = weights[:, None] * floors
    skipped = np.concatenate([np.zeros((len(counts), 1)), np.cumsum(counts, axis=1)], axis=1)
    rows = np.arange(len(weights))
    best = np.zeros(len(weights))
    low, high = 1e-9, 1e12
    for _ in range(60):
        price = (low * high) ** 0.5
        pick = np.argmax(skipped - price * cost, axis=1)
        if cost[rows, pick].sum() <= budget:
            best, high = floors[rows, pick], price
        else:
            low = price
    return best


def term_floors(index, weighted: DataFrame, thresholds: DataFrame, measure: Measure) -> DataFrame:
    """`query_id, term (the slot), floor, df` of the questions' frequent terms, given `query_id, theta`.

    Without a threshold a floor is 0, which every posting reaches.
    """
    levels = index.levels_of(measure)
    asked = weighted.join(F.broadcast(index.frequent), "term").join(F.broadcast(levels), "slot")
    entries = F.collect_list(F.struct("slot", "weight", "top", "counts", "df"))
    per_question = asked.groupBy("query_id").agg(entries.alias("terms")).join(thresholds, "query_id", "left")
    kind = weighted.schema["query_id"].dataType
    out = T.StructType([T.StructField("query_id", kind), T.StructField("term", T.IntegerType()), T.StructField("floor", T.DoubleType()), T.StructField("df", T.LongType())])
    edges = np.array(measure.edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = []
            for query, terms, theta in zip(frame["query_id"], frame["terms"], frame["theta"]):
                floors = np.zeros(len(terms))
                budget = 0.0 if pd.isna(theta) else theta * (1 - 1e-12) - MARGIN
                if budget > 0:
                    floors = _floors_of(
                        np.array([t["weight"] for t in terms]), np.array([t["top"] for t in terms]),
                        np.stack([np.asarray(t["counts"]) for t in terms]), edges, budget,
                    )
                found += [(query, t["slot"], float(f), t["df"]) for t, f in zip(terms, floors)]
            yield pd.DataFrame(found, columns=["query_id", "term", "floor", "df"])

    return per_question.mapInPandas(run, out)


class Scorer:
    """Scores of chunks for questions, given `query_id, term, weight, df` rows.

    What matching everything would cost is known beforehand: the sum of df.  Up to `prune_from` rows every matching chunk is scored
    once; beyond, only the postings that can matter are matched.  The answers are the same.
    """

    def __init__(
        self, index, weighted: DataFrame, measure: Measure, broadcast_rows: int = BROADCAST_ROWS, prune_from: int = PRUNE_FROM
    ):
        self.index, self.weighted, self.measure, self.broadcast_rows = index, weighted, measure, broadcast_rows
        rows, cost = weighted.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
        # Bounds the questions, their lists of terms and their floors as well.
        self.small, self.prunes = rows <= broadcast_rows, cost > prune_from
        if self.prunes:
            self.rare = materialize(rare_pairs(index, weighted, measure, broadcast_rows))
        else:
            self.every = materialize(self._all())

    def _all(self) -> DataFrame:
        gained = F.col("weight") * self.measure.posting(F.col("tf"), F.col("dl"))
        matched = match(self.index.postings, self.weighted, self.broadcast_rows).select("chunk_id", "query_id", gained.alias("gained"))
        sums = spread(matched, "chunk_id").groupBy("chunk_id", "query_id").agg(F.sum("gained").alias("gain"))
        if not self.measure.normed:
            return sums
        scaled = F.coalesce(F.col("gain") * self.measure.factor(F.col("norm")), F.lit(0.0))
        return sums.join(self.index.chunks.select("chunk_id", "norm"), "chunk_id").select("chunk_id", "query_id", scaled.alias("gain"))

    def _rescored(self, pairs: DataFrame) -> DataFrame:
        return rescored(pairs, self.index, self.weighted, self.measure, self.small)

    def only(self, questions: DataFrame) -> Scorer:
        """The same for fewer questions (`query_id`); nothing is matched again."""
        fewer = copy.copy(self)
        fewer.weighted = materialize(self.weighted.join(questions, "query_id", "left_semi"))
        name = "rare" if self.prunes else "every"
        setattr(fewer, name, getattr(self, name).join(fewer.weighted.select("query_id").distinct(), "query_id", "left_semi"))
        return fewer

    def best(self, k: int) -> DataFrame:
        """`chunk_id, query_id, gain` of some pairs, among them the k best of each question and all that tie with them."""
        if not self.prunes:
            return self.every
        floors = materialize(term_floors(self.index, self.weighted, self.thresholds(k), self.measure))
        reached = frequent_pairs(self.index, floors, self.measure, self.broadcast_rows)
        pairs = self.rare.unionByName(reached.select("chunk_id", "query_id", F.lit(0.0).alias("partial")))
        sums = spread(pairs, "chunk_id").groupBy("chunk_id", "query_id").agg(F.sum("partial").alias("partial"))
        return self._rescored(sums)

    def thresholds(self, k: int) -> DataFrame:
        """`query_id, theta`: the k-th best score among some chunks of each question, if it has k of them.

        These are the best by their rare terms; for a question with too few such, the chunks of its rarest frequent term.
        """
        ranked = materialize(top_k(self.rare, SEEDS * k, score="partial"))
        served = ranked.filter(F.col("rank") == k).select("query_id")
        others = self.weighted.join(served, "query_id", "left_anti").join(F.broadcast(self.index.frequent), "term")
        leads = others.groupBy("query_id").agg(F.min_by(F.struct("slot", "df"), F.struct("df", "slot")).alias("lead"))
        leads = leads.select("query_id", F.col("lead.slot").alias("term"), F.col("lead.df").alias("df"), F.lit(0.0).alias("floor"))
        led = frequent_pairs(self.index, leads, self.measure, self.broadcast_rows).select("chunk_id", "query_id", F.lit(0.0).alias("partial"))
        seeds = ranked.drop("rank").unionByName(led).groupBy("chunk_id", "query_id").agg(F.sum("partial").alias("partial"))
        kth = top_k(self._rescored(seeds), k, score="gain").filter(F.col("rank") == k)
        return kth.select("query_id", F.col("gain").alias("theta"))

    def of(self, pairs: DataFrame) -> DataFrame:
        """`chunk_id, query_id, gain` of the given pairs (each once); those that share no term have 0, chunks outside the index no row."""
        asked = pairs.select("chunk_id", "query_id")
        if not self.prunes:
            return asked.join(self.every, ["chunk_id", "query_id"], "left").fillna(0.0, ["gain"])
        partial = asked.join(self.rare, ["chunk_id", "query_id"], "left").fillna(0.0, ["partial"])
        return self._rescored(partial)
