"""BM25+ and TF-IDF over index tables.

Terms are counted inside the chunk's row and only the counts are exchanged.  The query
side is small and checked; when it is not, hot terms are salted.  Top-k answers come from a scan of the texts (`scan`), or
from index tables, where they prune the postings of frequent terms (`pruning`); `bm25_gains` and `tfidf_scores` give every matching chunk's score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyseek.functions.text import whitespace_tokens, word_tokens
from tallyseek.operators.pruning import LEVELS, PRUNE_FROM, Measure, Scorer, frequent_terms, impact_levels, match, profile_array
from tallyseek.operators.ranking import top_k
from tallyseek.operators.scan import (
    SCAN_TERMS,
    asked_bags,
    by_question,
    distinct_keys,
    dot_top_k,
    term_bags,
    vocabulary_of,
    weighed_bags,
)
from tallyseek.operators.sizing import BROADCAST_ROWS, fits, materialize, spread, store

Tokenizer = Callable[[Column], Column]

# The term of a chunk's own row; tokens are never empty.
CHUNK_ROW = ""

# Terms whose idf is broadcast; the postings of all rarer ones are joined by term.
HEAD_TERMS = 250_000


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.5
    b: float = 0.75
    delta: float = 1.0


# The question service uses the defaults, the batch ranking a smaller delta.
SERVICE_PARAMS = Bm25Params()
BATCH_PARAMS = Bm25Params(delta=0.5)


def term_rows(
    chunks: DataFrame,
    tokenizer: Tokenizer = whitespace_tokens,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """`chunk_id, term, dl, tf`: all an index is made of.

    Texts are not exchanged here: tokens are counted by chunk and term before the shuffle, of which chunks that are `dealt`
    need none.

    Besides its terms every chunk with text has one row of its own, under the empty term, so
    sizes and lengths need no second look at the texts.  With a (broadcastable) vocabulary
    only its terms are kept.  Chunks without text have no row.
    """
    if "content" not in chunks.columns:
        raise ValueError("the chunk table has no 'content' column")
    # No filter: it would be pushed below a dealt-out scan, and the text's expressions with it.
    tokens = F.when(F.col("content") != "", tokenizer(F.col("content")))
    terms = F.explode(F.concat(F.array(F.lit(CHUNK_ROW)), "tokens"))
    kept = chunks.select("chunk_id", tokens.alias("tokens")).select("chunk_id", F.size("tokens").alias("dl"), terms.alias("term"))
    if vocabulary is not None:
        own_term = vocabulary.sparkSession.range(1).select(F.lit(CHUNK_ROW).alias("term"))
        wanted = vocabulary.select("term").unionByName(own_term)
        kept = kept.join(F.broadcast(wanted), "term", "left_semi")
    counted = kept.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    return counted.select("chunk_id", "term", "dl", "tf")


def bag_rows(chunks: DataFrame, tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """`term_rows` of chunks with distinct ids: each text is counted in its row, and nothing is exchanged."""
    own = F.array(F.struct(F.lit(CHUNK_ROW).alias("terms"), F.lit(1).alias("tfs")))
    entries = F.inline(F.concat(own, F.arrays_zip("terms", "tfs"))).alias("term", "tf")
    return term_bags(chunks, tokenizer).select("chunk_id", "dl", entries).select("chunk_id", "term", "dl", F.col("tf").cast("long").alias("tf"))


def dealt(chunks: DataFrame) -> DataFrame:
    """The texts by chunk over all partitions, for the index of a whole vocabulary.

    Its rows have more bytes than the texts, and would be moved twice: to be counted, and to be put together by chunk.
    """
    return spread(chunks, "chunk_id")


def document_frequency(postings: DataFrame) -> DataFrame:
    """`term, df`; hot terms shrink to one row per task before the shuffle."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """`query_id, term, qtf`: repeated query tokens collapse to a count."""
    tokens = tokenizer(F.col("question"))
    return (
        queries.select("query_id", F.explode(tokens).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / df)


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


@dataclass(frozen=True)
class LexicalIndex:
    """The index tables of one corpus: build once, save, score many question tables."""

    chunks: DataFrame  # chunk_id, dl, norm (TF-IDF; null where not counted), profile (tf by slot)
    postings: DataFrame  # chunk_id, term, dl, tf
    terms: DataFrame  # term, df
    corpus: DataFrame  # n, avgdl
    frequent: DataFrame  # term, slot
    levels: DataFrame | None = None  # measure, slot, top, counts, if stored
    has_norms: bool = False

    def levels_of(self, measure: Measure) -> DataFrame:
        """Levels of impact under a measure: the stored ones, else counted from the profiles."""
        if self.levels is not None:
            known = self.levels.filter(F.col("measure") == measure.name).drop("measure")
            if not known.isEmpty():
                return known
        return impact_levels(self.chunks, measure)


def chunk_rows(rows: DataFrame, frequent: DataFrame, idf: DataFrame | None = None, broadcast_rows: int = HEAD_TERMS) -> DataFrame:
    """`chunk_id, dl, norm, profile` of `term_rows`; norms only with `idf` (term, df, idf).

    Of rows that are `dealt` only sums and profiles are exchanged.  The idf of terms outside the head is joined by term for their
    postings alone, and only their sums by chunk meet the others.
    """
    known, weight, tail = frequent, F.lit(None).cast("double"), None
    if idf is not None:
        head, tail = split_idf(idf, broadcast_rows)
        known, weight = frequent.join(head, "term", "full"), F.col("tf") * F.col("idf")
    placed = rows.join(F.broadcast(known), "term", "left")
    entry = F.when(F.col("slot").isNotNull(), F.struct("slot", F.col("tf").cast("int").alias("tf")))
    kept = placed.select("chunk_id", "dl", (weight * weight).alias("square"), entry.alias("entry"))
    grouped = kept.groupBy("chunk_id").agg(
        F.first("dl").alias("dl"), F.sum("square").alias("square"), F.collect_list("entry").alias("entries")
    )
    square = F.col("square")
    if tail is not None:
        rare = placed.filter((F.col("term") != CHUNK_ROW) & F.col("idf").isNull()).select("chunk_id", "term", "tf")
        added = rare.join(tail, "term").groupBy("chunk_id").agg(F.sum(weight * weight).alias("rest")).withColumnRenamed("chunk_id", "_id")
        grouped = grouped.join(added, F.col("chunk_id").eqNullSafe(F.col("_id")), "left")
        both = F.coalesce("square", F.lit(0.0)) + F.coalesce("rest", F.lit(0.0))
        square = F.when(F.coalesce("square", "rest").isNotNull(), both)
    return grouped.select("chunk_id", "dl", F.sqrt(square).alias("norm"), profile_array(F.col("entries")).alias("profile"))


def split_idf(idf: DataFrame, rows: int = HEAD_TERMS) -> tuple[DataFrame, DataFrame | None]:
    """`term, idf` of the terms of highest df, at most `rows` of them, to broadcast, and those of the others, if any.

    The head holds most postings of any corpus; the rest are rare terms, none of which is a hot key.
    """
    # By powers of two, so few numbers come back.
    sizes = idf.groupBy(F.floor(F.log2("df")).cast("int").alias("power")).count().collect()
    cut, held = None, 0
    for power, count in sorted(((r["power"], r["count"]) for r in sizes), reverse=True):
        if held + count > rows:
            cut = power
            break
        held += count
    if cut is None:
        return idf.select("term", "idf"), None
    in_head = F.floor(F.log2("df")) > cut
    return idf.filter(in_head).select("term", "idf"), idf.filter(~in_head).select("term", "idf")


def idf_table(terms: DataFrame, n: int) -> DataFrame:
    return terms.select("term", "df", smooth_idf(F.lit(n), F.col("df")).alias("idf"))


def index_of(rows: DataFrame) -> LexicalIndex:
    """Index tables as views of `term_rows`; only the frequent terms are picked now."""
    postings = rows.filter(F.col("term") != CHUNK_ROW)
    terms = document_frequency(postings)
    frequent = frequent_terms(terms)
    return LexicalIndex(chunk_rows(rows, frequent), postings, terms, corpus_totals(rows), frequent)


def corpus_totals(rows: DataFrame) -> DataFrame:
    """`n, avgdl`: chunks and their mean length, one row."""
    return rows.filter(F.col("term") == CHUNK_ROW).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def with_norms(index: LexicalIndex) -> LexicalIndex:
    """The index with TF-IDF norms, counted once if it has none."""
    if index.has_norms:
        return index
    idf = idf_table(index.terms, index.corpus.select("n").scalar())
    weighed = reduce(DataFrame.unionByName, weighed_postings(index.postings, idf)).withColumn("weight", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    chunks = index.chunks.drop("norm").join(norms, "chunk_id", "left")
    return replace(index, chunks=materialize(chunks), has_norms=True)


def weighed_postings(postings: DataFrame, idf: DataFrame, broadcast_rows: int = HEAD_TERMS) -> list[DataFrame]:
    """The postings with their term's `idf`: those of the head where they are, the others, if any, moved by term."""
    head, tail = split_idf(idf, broadcast_rows)
    if tail is None:
        return [postings.join(F.broadcast(head), "term")]
    marked = postings.join(F.broadcast(head), "term", "left")
    return [marked.filter("idf IS NOT NULL"), marked.filter("idf IS NULL").drop("idf").join(tail, "term")]


def build_index(chunks: DataFrame, tokenizer: Tokenizer = whitespace_tokens) -> LexicalIndex:
    """Index tables over the whole vocabulary, computed when used."""
    return index_of(term_rows(chunks, tokenizer))


def store_index(
    chunks: DataFrame, tokenizer: Tokenizer = whitespace_tokens, asked: DataFrame | None = None
) -> LexicalIndex:
    """Index tables computed once: the texts are read and cut into terms a single time.

    With `asked` query terms that fit a broadcast only their postings are kept, which is all
    that BM25+ needs; norms need the whole vocabulary and are null then.
    """
    vocabulary = None
    if asked is not None:
        distinct = asked.select("term").distinct()
        vocabulary = distinct if fits(distinct) else None
    rows = materialize(term_rows(chunks if vocabulary is not None else dealt(chunks), tokenizer, vocabulary))
    postings = rows.filter(F.col("term") != CHUNK_ROW)
    terms = materialize(document_frequency(postings))
    totals = corpus_totals(rows)
    corpus = chunks.sparkSession.createDataFrame(totals.collect(), totals.schema)
    frequent = frequent_terms(terms)
    idf = None if vocabulary is not None else idf_table(terms, corpus.select("n").scalar())
    chunk_table = materialize(chunk_rows(rows, frequent, idf))
    return LexicalIndex(chunk_table, postings, terms, corpus, frequent, has_norms=idf is not None)


def bm25_query_weights(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """`query_id, term, weight, df` with weight = qtf * idf; unknown terms drop out."""
    n = index.corpus.select("n").scalar()
    known = index.terms.join(
        F.broadcast(asked) if fits(asked) else asked, "term"
    )
    return known.select(
        "query_id", "term", (F.col("qtf") * bm25_idf(n, F.col("df"))).alias("weight"), "df"
    )


def saturation(params: Bm25Params, avgdl: float) -> Callable[[Column, Column], Column]:
    """What a posting adds per weight."""

    def value(tf: Column, dl: Column) -> Column:
        length_norm = params.k1 * (1 - params.b + params.b * dl / avgdl)
        return tf * (params.k1 + 1) / (length_norm + tf)

    return value


def bm25_measure(index: LexicalIndex, params: Bm25Params = SERVICE_PARAMS) -> Measure:
    # A corpus without length has no postings.
    avgdl = index.corpus.first()["avgdl"] or 1.0
    edges = tuple((params.k1 + 1) * j / LEVELS for j in range(LEVELS + 1))
    return Measure(f"bm25 {params.k1} {params.b}", saturation(params, avgdl), lambda norm: F.lit(1.0), edges)


# Unit weights are mostly small, so their levels get wider upwards.
TFIDF_MEASURE = Measure(
    "tfidf", lambda tf, dl: tf.cast("double"), lambda norm: 1 / norm,
    tuple((j / LEVELS) ** 3 for j in range(LEVELS + 1)), normed=True,
)


def bm25_gains(
    index: LexicalIndex,
    weighted: DataFrame,
    params: Bm25Params = SERVICE_PARAMS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """`chunk_id, query_id, gain`: the score above the query's baseline, of every matching chunk."""
    gained = F.col("weight") * bm25_measure(index, params).posting(F.col("tf"), F.col("dl"))
    return (
        match(index.postings, weighted, broadcast_rows)
        .groupBy("chunk_id", "query_id")
        .agg(F.sum(gained).alias("gain"))
    )


def bm25_baseline(weighted: DataFrame, params: Bm25Params = SERVICE_PARAMS) -> DataFrame:
    """`query_id, baseline`: what a chunk without any of the query's terms scores."""
    return weighted.groupBy("query_id").agg(
        (F.sum("weight") * F.lit(params.delta)).alias("baseline")
    )


def rank_with_unmatched(
    gains: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, score: str = "gain"
) -> DataFrame:
    """Top k over all chunks, given the scores of those above zero.

    Chunks that match nothing tie at zero, and ties go to the smaller id, so the k smallest
    ids are the only unmatched chunks that can be needed.
    """
    smallest = (
        chunks.select("chunk_id")
        .orderBy("chunk_id")
        .limit(k)
        .agg(F.collect_list("chunk_id"))
        .scalar()
    )
    unmatched = queries.select(
        F.explode(smallest).alias("chunk_id"), "query_id", F.lit(0.0).alias(score)
    )
    shortlist = top_k(
        gains.select("chunk_id", "query_id", score).unionByName(unmatched), 2 * k, score=score
    )
    best = shortlist.groupBy("query_id", "chunk_id").agg(F.max(score).alias(score))
    return top_k(best, k, score=score)


@dataclass(frozen=True)
class ScanSides:
    """Both sides of a scan: sums of products by slot are the scores above the baseline."""

    chunks: DataFrame  # chunk_id, slots, vals: one row per chunk with text
    questions: DataFrame  # query_id, slots, vals: questions with a known term
    weighted: DataFrame  # query_id, term, weight, df
    slots: int


def scan_vocabulary(chunks: DataFrame, queries: DataFrame, asked: DataFrame, limit: int = SCAN_TERMS) -> DataFrame | None:
    """The terms to look up in a scan; None where ids repeat or are missing, or the terms are too many, and index tables must do."""
    if not queries.filter(F.col("query_id").isNull()).isEmpty() or not distinct_keys(chunks, "chunk_id"):
        return None
    return vocabulary_of(asked, limit)


def bm25_sides(chunks: DataFrame, asked: DataFrame, vocabulary: DataFrame, params: Bm25Params = SERVICE_PARAMS) -> ScanSides:
    """BM25+ for a scan: the texts are read once, and only the asked terms' counts are kept."""
    known = _slot_order(vocabulary)
    bags = store(asked_bags(chunks, whitespace_tokens, known), "bags")
    slot_df = bags.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("df"))
    terms = slot_df.join(F.broadcast(vocabulary), "slot").select("term", "df")
    index = _scan_index(bags, terms)
    weighted = materialize(bm25_query_weights(index, asked))
    posting = bm25_measure(index, params).posting
    vals = F.transform("tfs", lambda tf: posting(tf, F.col("dl")))
    return ScanSides(bags.select("chunk_id", "slots", vals.alias("vals")), by_question(weighted, vocabulary), weighted, len(known))


def store_bags(chunks: DataFrame) -> DataFrame:
    """Each text's word counts, stored: for TF-IDF and other scores of the same texts."""
    return store(term_bags(chunks, word_tokens), "bags")


def tfidf_sides(chunks: DataFrame, asked: DataFrame, vocabulary: DataFrame, bags: DataFrame | None = None) -> ScanSides:
    """TF-IDF for a scan: the texts are read once, if not before (`bags`), and kept as one row of counts per chunk."""
    known = _slot_order(vocabulary)
    bags = store_bags(chunks) if bags is None else bags
    terms = materialize(document_frequency(bags.select(F.explode("terms").alias("term"))))
    index = _scan_index(bags, terms)
    weighted = materialize(tfidf_query_weights(index, asked))
    head, tail = split_idf(idf_table(terms, index.corpus.first()["n"]))
    return ScanSides(weighed_bags(bags, known, head.toArrow(), tail), by_question(weighted, vocabulary), weighted, len(known))


def _slot_order(vocabulary: DataFrame) -> list[str]:
    return vocabulary.orderBy("slot").toPandas()["term"].tolist()


def _scan_index(bags: DataFrame, terms: DataFrame) -> LexicalIndex:
    """What weights need to know; there are no postings."""
    totals = bags.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    corpus = bags.sparkSession.createDataFrame(totals.collect(), totals.schema)
    return LexicalIndex(bags, None, terms, corpus, None)


def _scanned(sides: ScanSides, queries: DataFrame, k: int) -> DataFrame:
    """`query_id, chunk_id, score, rank` of every question, also of those without a known term."""
    every = queries.select("query_id").distinct().join(sides.questions, "query_id", "left")
    none = F.lit(None).cast("array<double>").alias("dense")
    return dot_top_k(sides.chunks.select("*", none), every.select("*", none), k)


def bm25_top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 3,
    params: Bm25Params = SERVICE_PARAMS,
    index: LexicalIndex | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    prune_from: int = PRUNE_FROM,
) -> DataFrame:
    """`query_id, chunk_id, score, rank` of the k best chunks per question.

    Texts are scanned; an index that is given, or `prune_from`, takes the index tables.
    """
    asked = query_terms(queries)
    if index is None and prune_from == PRUNE_FROM:
        vocabulary = scan_vocabulary(chunks, queries, asked, min(SCAN_TERMS, broadcast_rows))
        if vocabulary is not None:
            sides = bm25_sides(chunks, asked, vocabulary, params)
            return _above_baseline(_scanned(sides, queries, k), sides.weighted, params, "score")
    index = index or store_index(chunks, asked=asked)
    # Read by the size check, the match and the baseline.
    weighted = materialize(bm25_query_weights(index, asked))
    gains = Scorer(index, weighted, bm25_measure(index, params), broadcast_rows, prune_from).best(k)
    return _above_baseline(rank_with_unmatched(gains, queries, index.chunks, k), weighted, params, "gain")


def _above_baseline(ranked: DataFrame, weighted: DataFrame, params: Bm25Params, gain: str) -> DataFrame:
    score = F.col(gain) + F.coalesce("baseline", F.lit(0.0))
    return ranked.join(bm25_baseline(weighted, params), "query_id", "left").select("query_id", "chunk_id", score.alias("score"), "rank")


def tfidf_matrix(index: LexicalIndex, broadcast_rows: int = HEAD_TERMS) -> DataFrame:
    """`chunk_id, term, weight` with unit rows."""
    index = with_norms(index)
    idf = idf_table(index.terms, index.corpus.select("n").scalar())
    norms = index.chunks.select("chunk_id", "norm")
    # Each part meets the norms on its own, so that the first stays where it is.
    weight = (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight")
    parts = [part.join(norms, "chunk_id").select("chunk_id", "term", weight) for part in weighed_postings(index.postings, idf, broadcast_rows)]
    return reduce(DataFrame.unionByName, parts)


def tfidf_query_vectors(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """`query_id, term, weight, idf, df` with unit rows over the known terms."""
    n = index.corpus.select("n").scalar()
    known = index.terms.join(F.broadcast(asked) if fits(asked) else asked, "term").select(
        "query_id",
        "term",
        smooth_idf(n, F.col("df")).alias("idf"),
        "df",
        "qtf",
    )
    raw = known.withColumn("raw", F.col("qtf") * F.col("idf"))
    norms = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("qnorm"))
    return raw.join(norms, "query_id").select(
        "query_id", "term", (F.col("raw") / F.col("qnorm")).alias("weight"), "idf", "df"
    )


def tfidf_query_weights(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """`query_id, term, weight, df`: what a posting's tf / norm counts in the cosine."""
    return tfidf_query_vectors(index, asked).select(
        "query_id", "term", (F.col("weight") * F.col("idf")).alias("weight"), "df"
    )


def tfidf_scores(
    index: LexicalIndex, asked: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """`chunk_id, query_id, cosine` of the chunks that share a term with the question."""
    index = with_norms(index)
    vectors = tfidf_query_vectors(index, asked)
    dots = (
        match(index.postings, vectors, broadcast_rows)
        .groupBy("chunk_id", "query_id")
        .agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    )
    return dots.join(index.chunks.select("chunk_id", "norm"), "chunk_id").select(
        "chunk_id", "query_id", (F.col("dot") / F.col("norm")).alias("cosine")
    )


def tfidf_top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 3,
    index: LexicalIndex | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    prune_from: int = PRUNE_FROM,
    bags: DataFrame | None = None,
) -> DataFrame:
    """`query_id, chunk_id, score, rank` by cosine of TF-IDF vectors; scanned or by index tables like `bm25_top_k`.

    A scan takes the chunks' `store_bags`, if they are given.
    """
    asked = query_terms(queries, word_tokens)
    if index is None and prune_from == PRUNE_FROM:
        vocabulary = scan_vocabulary(chunks, queries, asked, min(SCAN_TERMS, broadcast_rows))
        if vocabulary is not None:
            return _scanned(tfidf_sides(chunks, asked, vocabulary, bags), queries, k)
    index = with_norms(index or store_index(chunks, word_tokens))
    weighted = materialize(tfidf_query_weights(index, asked))
    gains = Scorer(index, weighted, TFIDF_MEASURE, broadcast_rows, prune_from).best(k)
    ranked = rank_with_unmatched(gains, queries, index.chunks, k)
    return ranked.select("query_id", "chunk_id", F.col("gain").alias("score"), "rank")


def top1_accuracy(ranking: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of labelled questions whose best chunk is the labelled one."""
    best = ranking.filter(F.col("rank") == 1).select("query_id", "chunk_id")
    hit = F.col("chunk_id").eqNullSafe(F.col("doc_id")).cast("double")
    return (
        labels.select("query_id", "doc_id")
        .join(best, "query_id", "left")
        .agg(F.avg(hit).alias("accuracy"), F.count("*").alias("questions"))
    )
