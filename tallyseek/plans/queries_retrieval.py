"""Ranking, voting and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyseek.functions.text import clean_for_embedding, strip_punctuation, word_tokens
from tallyseek.operators import fusion
from tallyseek.operators import lexical as lx
from tallyseek.operators.dense import hashed_bag_embedding, hashed_embedding, nearest
from tallyseek.operators.ranking import parse_ranked_lists, ranked_lists
from tallyseek.plans import retrieval as rt
from tallyseek.plans.facts import corpus, questions, table
from tallyseek.plans.queries_text import clean_sql
from tallyseek.plans.registry import query
from tallyseek.plans.sqltext import bm25_ctes, hashed_ctes, ranked, tfidf_ctes


def plain_corpus(spark, folder):
    docs = corpus(spark, folder)
    return docs.withColumn("content", strip_punctuation(F.col("content")))


def plain_questions(spark, folder):
    asked = questions(spark, folder)
    return asked.withColumn("question", strip_punctuation(F.col("question")))


def rounded(ranking):
    return ranking.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


RANKED_COLUMNS = "query_id, chunk_id, round({score}, 6) AS score, CAST(rank AS INTEGER) AS rank"


@query(
    "bm25_plus_top3",
    f"""WITH {bm25_ctes()} SELECT {RANKED_COLUMNS.format(score="score")}
FROM ({ranked("bm_all", 3)})""",
)
def bm25_plus_top3(spark, folder):
    """Service parameters, three documents per question."""
    return rounded(lx.bm25_top_k(plain_corpus(spark, folder), plain_questions(spark, folder), 3))


@query(
    "pruned_bm25_top3",
    f"""WITH {bm25_ctes()} SELECT {RANKED_COLUMNS.format(score="score")}
FROM ({ranked("bm_all", 3)})""",
)
def pruned_bm25_top3(spark, folder):
    """The same answers with postings of frequent terms left out, as beyond PRUNE_FROM matched rows."""
    return rounded(lx.bm25_top_k(plain_corpus(spark, folder), plain_questions(spark, folder), 3, prune_from=0))


@query(
    "bm25_batch_top5",
    f"""WITH {bm25_ctes(delta=0.5)} SELECT {RANKED_COLUMNS.format(score="score")}
FROM ({ranked("bm_all", 5)})""",
)
def bm25_batch_top5(spark, folder):
    """Batch parameters, five documents per question."""
    docs, asked = plain_corpus(spark, folder), plain_questions(spark, folder)
    return rounded(lx.bm25_top_k(docs, asked, 5, lx.BATCH_PARAMS))


@query(
    "term_statistics",
    f"""WITH {bm25_ctes()} SELECT term, df, round(ln((n + 1) / df), 6) AS bm25_idf,
  round(ln((n + 1) / (df + 1)) + 1, 6) AS smooth_idf FROM bm_df, bm_n""",
)
def term_statistics(spark, folder):
    """Document frequency and both idf forms of the whole vocabulary."""
    index = lx.store_index(plain_corpus(spark, folder))
    n = index.corpus.select("n").scalar()
    return index.terms.select(
        "term",
        "df",
        F.round(lx.bm25_idf(n, F.col("df")), 6).alias("bm25_idf"),
        F.round(lx.smooth_idf(n, F.col("df")), 6).alias("smooth_idf"),
    )


@query(
    "tfidf_matrix",
    f"WITH {tfidf_ctes()} SELECT chunk_id, term, round(weight, 6) AS weight FROM tf_weight",
)
def tfidf_matrix(spark, folder):
    index = lx.store_index(corpus(spark, folder), word_tokens)
    matrix = lx.tfidf_matrix(index)
    return matrix.select("chunk_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "tfidf_top3",
    f"""WITH {tfidf_ctes()} SELECT {RANKED_COLUMNS.format(score="cosine")}
FROM ({ranked("tf_all", 3, "cosine")})""",
)
def tfidf_top3(spark, folder):
    return rounded(lx.tfidf_top_k(corpus(spark, folder), questions(spark, folder), 3))


@query(
    "pruned_tfidf_top3",
    f"""WITH {tfidf_ctes()} SELECT {RANKED_COLUMNS.format(score="cosine")}
FROM ({ranked("tf_all", 3, "cosine")})""",
)
def pruned_tfidf_top3(spark, folder):
    return rounded(lx.tfidf_top_k(corpus(spark, folder), questions(spark, folder), 3, prune_from=0))


EMBEDDING_PAIRS = """pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id,
  list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id)"""


def neighbours(spark, folder, k):
    vectors = table(spark, folder, "embeddings")
    return nearest(
        vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"),
        vectors.select(F.col("vec_id").alias("query_id"), "embedding"),
        k,
        exclude_same_id=True,
    )


@query(
    "embedding_top3",
    f"""WITH {EMBEDDING_PAIRS} SELECT query_id, chunk_id, round(1 - score, 6) AS distance,
  CAST(rank AS INTEGER) AS rank FROM ({ranked("pairs", 3, "score")})""",
)
def embedding_top3(spark, folder):
    """The three nearest other vectors of every vector, by cosine distance."""
    return neighbours(spark, folder, 3).select(
        "query_id", "chunk_id", F.round(1 - F.col("score"), 6).alias("distance"), "rank"
    )


@query(
    "top1_accuracy",
    f"""WITH {EMBEDDING_PAIRS}, best AS ({ranked("pairs", 1, "score")})
SELECT round(avg(CASE WHEN a.label = b.label THEN 1 ELSE 0 END), 6) AS accuracy,
  count(*) AS questions
FROM best JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_id""",
)
def top1_accuracy(spark, folder):
    """How often the nearest other vector carries the vector's own label."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    best = neighbours(spark, folder, 1)
    found = best.join(labels.withColumnRenamed("vec_id", "chunk_id"), "chunk_id").select(
        "query_id", F.col("label").alias("chunk_id"), "rank"
    )
    truth = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("doc_id"))
    return lx.top1_accuracy(found, truth).withColumn("accuracy", F.round("accuracy", 6))


def rankings(spark, folder):
    """Three rankers' top-3 lists for every question."""
    docs, asked = corpus(spark, folder), questions(spark, folder)
    bags = lx.store_bags(docs)
    return {
        "bm25plus": lx.bm25_top_k(
            plain_corpus(spark, folder), plain_questions(spark, folder), 3, lx.BATCH_PARAMS
        ),
        "tf_idf": lx.tfidf_top_k(docs, asked, 3, bags=bags),
        "m3": nearest(
            hashed_bag_embedding(bags),
            hashed_embedding(asked, "query_id", F.col("question")),
            3,
        ),
    }


VOTE_CTES = f"""{bm25_ctes(delta=0.5)}, {tfidf_ctes()}, {hashed_ctes()},
r1 AS ({ranked("bm_all", 3)}), r2 AS ({ranked("tf_all", 3, "cosine")}),
r3 AS ({ranked("hv_all", 3, "cosine")}),
votes AS (SELECT *, count(*) OVER (PARTITION BY query_id, model) AS list_length FROM (
  SELECT query_id, chunk_id, rank, 0.48 AS weight, 'bm25plus' AS model FROM r1 UNION ALL
  SELECT query_id, chunk_id, rank, 0.44, 'tf_idf' FROM r2 UNION ALL
  SELECT query_id, chunk_id, rank, 0.42, 'm3' FROM r3))"""


def _vote_sql(points: str) -> str:
    return f"""WITH {VOTE_CTES}
SELECT query_id, chunk_id, round(CAST(sum({points}) AS DOUBLE), 6) AS score FROM votes
GROUP BY query_id, chunk_id"""


def _votes(spark, folder):
    return fusion.ballots(rankings(spark, folder), fusion.RANKER_WEIGHTS)


def _scored(votes):
    return votes.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("weighted_rank_vote", _vote_sql("CAST(weight AS DOUBLE) / rank"))
def weighted_rank_vote(spark, folder):
    return _scored(fusion.weighted_vote(_votes(spark, folder)))


@query("borda_vote", _vote_sql("list_length - rank + 1"))
def borda_vote(spark, folder):
    return _scored(fusion.borda_vote(_votes(spark, folder)))


@query("reciprocal_vote", _vote_sql("1.0::DOUBLE / rank"))
def reciprocal_vote(spark, folder):
    return _scored(fusion.reciprocal_vote(_votes(spark, folder)))


COMBINED_SQL = f"""WITH {VOTE_CTES}, total AS (SELECT query_id, chunk_id,
  sum((CAST(weight AS DOUBLE) + 1) / rank + list_length - rank + 1) AS points
  FROM votes GROUP BY query_id, chunk_id),
best AS ({ranked("total", 3, "points")})"""


@query(
    "combined_vote_top3",
    f"{COMBINED_SQL} SELECT {RANKED_COLUMNS.format(score='points')} FROM best",
)
def combined_vote_top3(spark, folder):
    return rounded(fusion.combined_vote(_votes(spark, folder), 3))


@query(
    "ensemble_lists",
    f"""{COMBINED_SQL} SELECT query_id, string_agg(chunk_id::VARCHAR, ' ' ORDER BY rank) AS doc_id
FROM (SELECT query_id, chunk_id::VARCHAR AS chunk_id,
  row_number() OVER (PARTITION BY query_id ORDER BY round(points, 9) DESC, chunk_id::VARCHAR)
  AS rank FROM total) WHERE rank <= 3 GROUP BY query_id""",
)
def ensemble_lists(spark, folder):
    """Result tables with blank-joined ids, parsed back and voted on."""
    lists = {model: ranked_lists(ranking) for model, ranking in rankings(spark, folder).items()}
    return fusion.ensemble(lists)


@query(
    "parsed_lists",
    f"""WITH {tfidf_ctes()} SELECT query_id, chunk_id::VARCHAR AS chunk_id,
  CAST(rank AS INTEGER) AS rank FROM ({ranked("tf_all", 3, "cosine")})""",
)
def parsed_lists(spark, folder):
    ranking = lx.tfidf_top_k(corpus(spark, folder), questions(spark, folder), 3)
    return parse_ranked_lists(ranked_lists(ranking))


def turn_questions(spark, folder):
    """Every conversation turn as a question."""
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question")
    )


def hybrid(spark, folder, k=5, ask=questions):
    """All three scores over all documents: BM25+ on cleaned, the others on raw texts.

    Questions that the cleaning chain empties are not asked.
    """
    docs = corpus(spark, folder)
    clean_docs = docs.withColumn("content", clean_for_embedding(F.col("content")))
    asked, _ = rt.clean_questions(ask(spark, folder))
    bags = lx.store_bags(docs)
    return rt.hybrid_texts_top_k(
        clean_docs,
        docs,
        hashed_bag_embedding(bags),
        asked,
        hashed_embedding(asked, "query_id", F.col("question")),
        k,
        bags=bags,
    )


CLEAN_SQL = clean_sql("text")
HYBRID_CTES = f"""{bm25_ctes(CLEAN_SQL)}, {tfidf_ctes()}, {hashed_ctes()},
fused AS (SELECT p.query_id, p.chunk_id,
  0.4::DOUBLE * coalesce(b.score, 0) + 0.3::DOUBLE * coalesce(t.cosine, 0)
  + 0.3::DOUBLE * coalesce(v.cosine, 0) AS fused
  FROM (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark, documents
    WHERE {clean_sql("documents.text")} <> '' AND {clean_sql("benchmark.text")} <> '') p
  LEFT JOIN hv_all v USING (query_id, chunk_id)
  LEFT JOIN bm_all b USING (query_id, chunk_id)
  LEFT JOIN tf_all t USING (query_id, chunk_id)),
best AS ({ranked("fused", 5, "fused")})"""


@query(
    "hybrid_top5",
    f"WITH {HYBRID_CTES} SELECT {RANKED_COLUMNS.format(score='fused')} FROM best",
)
def hybrid_top5(spark, folder):
    return rounded(hybrid(spark, folder))


@query(
    "hybrid_turns_top3",
    f"""WITH benchmark AS (SELECT conv_id * 1000 + turn AS item_id, text FROM conversations),
{HYBRID_CTES.replace(ranked("fused", 5, "fused"), ranked("fused", 3, "fused"))}
SELECT {RANKED_COLUMNS.format(score='fused')} FROM best""",
)
def hybrid_turns_top3(spark, folder):
    """The hybrid search for every turn of every conversation at once."""
    return rounded(hybrid(spark, folder, 3, turn_questions))


@query(
    "context_prompt",
    f"""WITH {HYBRID_CTES}, ctx AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS context
  FROM best JOIN documents ON doc_id = chunk_id GROUP BY query_id)
SELECT query_id, context, 'Context: ' || substr(context, 1, 1024) || chr(10) || 'Question: '
  || text || chr(10) || 'Answer:' AS prompt FROM ctx JOIN benchmark ON item_id = query_id""",
)
def context_prompt(spark, folder):
    """Contents of the hybrid hits, joined in rank order and put into a prompt."""
    hits = rt.attach_content(hybrid(spark, folder), corpus(spark, folder))
    asked = questions(spark, folder).join(rt.contexts(hits), "query_id")
    prompt = rt.answer_prompt(F.col("question"), F.col("context"))
    return asked.select("query_id", "context", prompt.alias("prompt"))


@query(
    "lexical_prompt",
    f"""WITH {bm25_ctes()}, ctx AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS context
  FROM ({ranked("bm_all", 3)}) JOIN documents ON doc_id = chunk_id GROUP BY query_id)
SELECT query_id, 'Питання: ' || text || '. Ключові документи: ' || substr(context, 1, 512) AS prompt
FROM ctx JOIN benchmark ON item_id = query_id""",
)
def lexical_prompt(spark, folder):
    """BM25+ top 3 only, short prompt."""
    ranking = lx.bm25_top_k(plain_corpus(spark, folder), plain_questions(spark, folder), 3)
    hits = rt.attach_content(ranking, corpus(spark, folder))
    asked = questions(spark, folder).join(rt.contexts(hits), "query_id")
    return asked.select(
        "query_id", rt.keyed_prompt(F.col("question"), F.col("context")).alias("prompt")
    )
