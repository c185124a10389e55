import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyseek.functions.text import word_tokens
from tallyseek.operators import dense, fusion
from tallyseek.operators import lexical as lx
from tallyseek.operators.ranking import ranked_lists, top_k
from tallyseek.plans import retrieval as rt

DOCS = [(1, "a b b c"), (2, "a a d"), (3, "e"), (4, ""), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "chunk_id long, content string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(
        [(1, "b a b"), (2, "zzz"), (3, "e e")], "query_id long, question string"
    )


def brute_bm25(k1=1.5, b=0.75, delta=1.0):
    texts = {i: t.split() for i, t in DOCS if t}
    n = len(texts)
    avgdl = sum(map(len, texts.values())) / n
    df = {}
    for tokens in texts.values():
        for term in set(tokens):
            df[term] = df.get(term, 0) + 1

    def score(question, tokens):
        total = 0.0
        for term in question.split():
            if term in df:
                tf = tokens.count(term)
                norm = k1 * (1 - b + b * len(tokens) / avgdl) + tf
                total += math.log((n + 1) / df[term]) * (delta + tf * (k1 + 1) / norm)
        return total

    return {
        q: sorted(((-round(score(text, t), 9), i) for i, t in texts.items()))
        for q, text in ((1, "b a b"), (2, "zzz"), (3, "e e"))
    }


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_bm25_equals_brute_force(docs, asked, rows):
    got = lx.bm25_top_k(docs, asked, 3, broadcast_rows=rows).collect()
    expected = brute_bm25()
    for q, best in expected.items():
        mine = sorted((r.rank, r.chunk_id, round(r.score, 9)) for r in got if r.query_id == q)
        assert mine == [(at + 1, i, -s) for at, (s, i) in enumerate(best[:3])]


def test_batch_delta_changes_the_baseline(docs, asked):
    got = lx.bm25_top_k(docs, asked, 3, lx.BATCH_PARAMS).collect()
    best = {r.query_id: r.score for r in got if r.rank == 1}
    assert best[3] == pytest.approx(-brute_bm25(delta=0.5)[3][0][0])


@pytest.mark.parametrize(("ranker", "rows"), [(lx.bm25_top_k, 1_000_000), (lx.tfidf_top_k, 0)])
def test_pruned_answers_are_the_whole_ones(spark, ranker, rows, monkeypatch):
    """Few slots, so that rare and frequent terms, floors and the shuffle join all take part."""
    import random

    from tallyseek.operators import pruning

    monkeypatch.setattr(lx, "frequent_terms", lambda terms: pruning.frequent_terms(terms, 12))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    texts = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 80)))) for i in range(300)] + [(900, None), (901, "")]
    texts += [(1000 + i, texts[i][1]) for i in range(20)]
    docs = spark.createDataFrame(texts, "chunk_id long, content string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for i in range(25)] + [(99, "none")], "query_id long, question string")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert key(ranker(docs, asked, 4, broadcast_rows=rows, prune_from=0)) == key(ranker(docs, asked, 4))


def test_floors_leave_out_postings(spark, monkeypatch):
    """Frequent postings are matched only above their floors."""
    import random

    from tallyseek.operators import pruning

    monkeypatch.setattr(lx, "frequent_terms", lambda terms: pruning.frequent_terms(terms, 41))
    rng = random.Random(5)
    texts = [(i, " ".join(["the"] * rng.randint(1, 3) + [f"f{i % 40}"] * rng.randint(1, 4) + [f"r{i % 997}"])) for i in range(2000)]
    docs = spark.createDataFrame(texts, "chunk_id long, content string")
    asked = spark.createDataFrame([(i, f"the f{i} r{i}") for i in range(30)], "query_id long, question string")
    index = lx.store_index(docs)
    weighted = lx.materialize(lx.bm25_query_weights(index, lx.query_terms(asked)))
    measure = lx.bm25_measure(index)
    scorer = pruning.Scorer(index, weighted, measure, prune_from=0)
    floors = pruning.term_floors(index, weighted, scorer.thresholds(1), measure)
    matched = scorer.rare.count() + pruning.frequent_pairs(index, floors, measure).count()
    assert matched * 10 <= lx.match(index.postings, weighted).count()


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_tfidf_broadcast_and_split_joins_agree(spark, rows):
    docs = spark.createDataFrame(
        [(1, "aa bb bb"), (2, "aa cc"), (3, "dd")], "chunk_id long, content string"
    )
    asked = spark.createDataFrame([(1, "BB aa qq")], "query_id long, question string")
    got = {r.chunk_id: r.score for r in lx.tfidf_top_k(docs, asked, 3, broadcast_rows=rows).collect()}
    idf = {t: math.log(4 / (d + 1)) + 1 for t, d in {"aa": 2, "bb": 1, "cc": 1, "dd": 1}.items()}
    vec = lambda counts: {t: c * idf[t] for t, c in counts.items()}
    cos = lambda x, y: sum(v * y.get(t, 0) for t, v in x.items()) / math.sqrt(
        sum(v * v for v in x.values()) * sum(v * v for v in y.values())
    )
    q = vec({"aa": 1, "bb": 1})
    assert got[1] == pytest.approx(cos(q, vec({"aa": 1, "bb": 2})))
    assert got[2] == pytest.approx(cos(q, vec({"aa": 1, "cc": 1})))
    assert got[3] == 0


def test_missing_content_column(spark):
    with pytest.raises(ValueError):
        lx.build_index(spark.range(1).withColumnRenamed("id", "chunk_id"))


def _vectors(spark, n, d, seed, key):
    rng = np.random.default_rng(seed)
    data = [(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(n, d)))]
    data[3] = (3, [0.0] * d)
    data[5] = (5, data[4][1])
    return spark.createDataFrame(data, f"{key} long, embedding array<double>"), data


@pytest.mark.parametrize("limits", [{}, {"block": 2, "cell_vectors": 7}])
def test_nearest_of_a_table_in_itself(spark, limits):
    """Both sides are one table with the same column; without length a vector neither finds nor is found."""
    table, rows = _vectors(spark, 30, 6, 3, "vec_id")
    vectors = table.select(F.col("vec_id").alias("chunk_id"), "embedding")
    questions = table.select(F.col("vec_id").alias("query_id"), "embedding")
    found = dense.nearest(vectors, questions, 2, exclude_same_id=True, **limits).collect()
    got = {(r.query_id, r["rank"]): r.chunk_id for r in found}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if any(v)}
    want = {
        (q, at): i
        for q, v in unit.items()
        for at, (_, i) in enumerate(sorted((-round(float(v @ w), 9), i) for i, w in unit.items() if i != q)[:2], start=1)
    }
    assert got == want


def test_nearest_over_slices_of_one_task(spark, monkeypatch):
    """The best so far are carried from slice to slice, ties and the last slice included."""
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(50, 4))
    matrix[40:] = matrix[:10]
    frame = pd.DataFrame({"chunk_id": np.arange(50)[::-1], "embedding": list(matrix)})
    asked = matrix[5:12] / np.linalg.norm(matrix[5:12], axis=1)[:, None]
    monkeypatch.setattr(dense, "SLICE_SCORES", 42)
    (found,) = dense._hits([frame[:20], frame[20:]], np.arange(7), asked, 3, False)
    scores = np.round(matrix / np.linalg.norm(matrix, axis=1)[:, None] @ asked.T, 9)
    for q, ids in found.groupby("query_id")["chunk_id"]:
        best = sorted(zip(-scores[:, q], frame["chunk_id"]))[:3]
        assert sorted(ids) == sorted(i for _, i in best)


@pytest.mark.parametrize("limits", [{}, {"block": 4, "cell_vectors": 7}])
def test_nearest_equals_brute_force(spark, limits):
    vectors, rows = _vectors(spark, 40, 6, 1, "chunk_id")
    questions, asked = _vectors(spark, 10, 6, 2, "query_id")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in dense.nearest(vectors, questions, 4, **limits).collect()}
    for q, vector in asked:
        a = np.array(vector)
        if not a.any():
            continue
        scored = []
        for i, other in rows:
            b = np.array(other)
            if b.any():
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), i))
        for at, (_, i) in enumerate(sorted(scored)[:4], start=1):
            assert got[q, at] == i
    assert len(got) == 9 * 4


def test_embed_runs_the_encoder_in_batches(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, "c")], "chunk_id int, content string")

    def make():
        return lambda batch: np.array([[len(t), 1.0] for t in batch])

    got = {r.chunk_id: r.embedding for r in dense.embed(texts, make, batch_size=1).collect()}
    assert got == {1: [2.0, 1.0], 2: [1.0, 1.0]}
    assert dense.embed_cleaned(texts, make).count() == 2


def test_votes(spark):
    ranked = "query_id int, chunk_id string, rank int"
    lists = {
        "bm25plus": spark.createDataFrame([(1, "a", 1), (1, "b", 2)], ranked),
        "tf_idf": spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "a", 3)], ranked),
    }
    votes = fusion.ballots(lists, {"bm25plus": 0.5, "tf_idf": 0.4})
    score = lambda df: {r.chunk_id: round(r.score, 6) for r in df.collect()}
    weighted = score(fusion.weighted_vote(votes))
    borda = score(fusion.borda_vote(votes))
    reciprocal = score(fusion.reciprocal_vote(votes))
    assert weighted == {"a": round(0.5 + 0.4 / 3, 6), "b": 0.65, "c": 0.2}
    assert borda == {"a": 3.0, "b": 4.0, "c": 2.0}
    assert reciprocal == {"a": 1.333333, "b": 1.5, "c": 0.5}
    combined = fusion.combined_vote(votes, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in combined] == ["b", "a"]
    result = fusion.ensemble({m: ranked_lists(df) for m, df in lists.items()}, {"bm25plus": 0.5, "tf_idf": 0.4})
    assert result.first().doc_id == "b a c"


def test_top_k_breaks_ties_by_id(spark):
    scores = spark.createDataFrame(
        [(1, 9, 0.1 + 0.2), (1, 2, 0.3), (1, 5, 0.1)], "query_id int, chunk_id int, score double"
    )
    assert [(r.chunk_id, r["rank"]) for r in top_k(scores, 2).orderBy("rank").collect()] == [(2, 1), (9, 2)]


def test_hybrid_depths_agree(spark, docs):
    questions = spark.createDataFrame(
        [(i, t, t) for i, t in enumerate(["a b", "e", "zz", "d a", "c"])],
        "query_id long, question string, clean string",
    )
    embed = lambda df, key, text: dense.hashed_embedding(df, key, F.col(text), 8)
    args = (
        lx.store_index(docs),
        lx.store_index(docs, lx.word_tokens),
        embed(docs.filter("content <> ''").withColumn("content", F.concat_ws(" ", "content", F.lit("xx yy"))), "chunk_id", "content"),
        questions,
        embed(questions.withColumn("question", F.concat_ws(" ", "question", F.lit("yy"))), "query_id", "question"),
        2,
    )
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    whole = key(rt.hybrid_top_k(*args, depth=100))
    assert key(rt.hybrid_top_k(*args, depth=1)) == whole == key(rt.hybrid_top_k(*args, depth=2, prune_from=0))


def test_questions_without_tokens_are_rejected(spark):
    asked = spark.createDataFrame([(1, "Привіт!"), (2, "?!")], "query_id int, question string")
    good, bad = rt.clean_questions(asked)
    assert [r.query_id for r in good.collect()] == [1]
    assert [r.query_id for r in bad.collect()] == [2]


def test_prompts(spark):
    row = spark.range(1).select(
        rt.answer_prompt(F.lit("q"), F.lit("abcdef"), 3).alias("a"),
        rt.system_prompt("before {context} after", F.lit("c")).alias("b"),
    ).first()
    assert row.a == "Context: abc\nQuestion: q\nAnswer:"
    assert row.b == "before c after"


def _hybrid(spark, docs, asked, vectors, asked_vectors):
    from tallyseek.functions.text import word_tokens
    from tallyseek.plans.retrieval import hybrid_top_k

    texts = spark.createDataFrame(docs, "chunk_id int, content string")
    questions = spark.createDataFrame(asked, "query_id int, question string, clean string")
    return hybrid_top_k(
        lx.store_index(texts), lx.store_index(texts, word_tokens),
        spark.createDataFrame(vectors, "chunk_id int, embedding array<float>"), questions,
        spark.createDataFrame(asked_vectors, "query_id int, embedding array<float>"), 2,
    ).orderBy("query_id", "rank").collect()


def test_hybrid_keeps_a_document_without_a_vector(spark):
    docs = [(1, "я"), (2, "zz other"), (3, "third text")]
    hits = _hybrid(spark, docs, [(1, "я zz", "я zz")], [(2, [1.0, 0.0]), (3, [0.0, 1.0])], [(1, [1.0, 0.0])])
    assert {h.chunk_id for h in hits} == {1, 2}


def test_hybrid_without_any_question_vector(spark):
    docs = [(1, "a b"), (2, "c d"), (3, "e f")]
    vectors = [(i, [float(i)] * 8) for i in (1, 2, 3)]
    hits = _hybrid(spark, docs, [(1, "c", "c"), (2, "e", "e")], vectors, [])
    assert [h.chunk_id for h in hits if h.rank == 1] == [2, 3]


def test_terms_are_counted_in_the_row(spark):
    docs = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, None), (4, " ")], "chunk_id int, content string")
    rows = lx.term_rows(docs)
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    got = {(r.chunk_id, r.term): (r.dl, r.tf) for r in rows.collect()}
    assert got == {(1, ""): (5, 1), (1, "a"): (5, 1), (1, "b"): (5, 3), (1, "c"): (5, 1), (4, ""): (0, 1)}


def test_rows_are_put_together_by_chunk_before_they_move(spark):
    chunks = spark.createDataFrame([(i, f"common shared w{i % 7} only{i}") for i in range(40)], "chunk_id int, content string")
    index = lx.store_index(chunks, word_tokens)
    idf = lx.idf_table(index.terms, index.corpus.first()["n"])
    plan = lx.chunk_rows(index.postings, index.frequent, idf)._jdf.queryExecution().executedPlan().toString()
    # Top down: the first exchange stands above an aggregation; before, the rows themselves were dealt out by chunk.
    assert "Exchange hashpartitioning(chunk_id" in plan and "partial_collect_list" in plan.split("Exchange hashpartitioning(chunk_id")[1]
    assert "REPARTITION_BY_NUM" not in plan


def test_rare_terms_beyond_the_head_count_in_norms_and_weights(spark):
    texts = [(i, f"common shared w{i % 7} only{i}") for i in range(40)] + [(None, "common no id"), (99, "alone"), (98, "%")]
    chunks = spark.createDataFrame(texts, "chunk_id int, content string")
    index = lx.store_index(chunks, word_tokens)
    idf = lx.idf_table(index.terms, index.corpus.first()["n"])
    rows = lx.term_rows(chunks, word_tokens)

    def norms(limit):
        found = lx.chunk_rows(rows, index.frequent, idf, limit).collect()
        return {r["chunk_id"]: (r["dl"], r["norm"] and round(r["norm"], 9), tuple(r["profile"] or [])) for r in found}

    def weights(limit):
        return sorted((r["chunk_id"], r["term"], round(r["weight"], 9)) for r in lx.tfidf_matrix(index, limit).collect())

    assert norms(0) == norms(3) == norms(1000) and norms(3)[98] == (0, None, ())
    assert weights(0) == weights(3) == weights(1000) and len(weights(3)) == 40 * 4 + 1


def test_a_scan_in_a_grid_gives_the_products(spark):
    """More questions than a block, entries that are matrix products and others, missing lists, a chunk that shares nothing."""
    from tallyseek.operators.scan import dot_top_k

    rng = np.random.default_rng(3)
    schema = "slots array<int>, vals array<double>, dense array<double>"

    def side(n, shift):
        rows = []
        for i in range(n):
            slots = [0, 1, *sorted(rng.choice(np.arange(2, 60), rng.integers(0, 6), replace=False).tolist())]
            rows.append((i + shift, slots, rng.random(len(slots)).tolist(), rng.random(3).tolist()))
        return [*rows, (n + shift, None, None, None), (n + shift + 1, [99], [1.0], None)]

    chunks, asked = side(70, 500), side(30, 0)

    def dots(a, b):
        x, y = dict(zip(a[1] or [], a[2] or [])), dict(zip(b[1] or [], b[2] or []))
        return sum(v * y.get(s, 0.0) for s, v in x.items()) + sum(p * q for p, q in zip(a[3] or [], b[3] or []))

    expected = {q[0]: sorted((-round(dots(c, q), 9), c[0]) for c in chunks)[:4] for q in asked}
    left = spark.createDataFrame(chunks, f"chunk_id long, {schema}")
    right = spark.createDataFrame(asked, f"query_id long, {schema}")
    for block, cell in ((1000, 1000), (7, 20)):
        got = {}
        for r in dot_top_k(left, right, 4, block, cell).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-round(r.score, 9), r.chunk_id))
        assert got == expected


def test_many_questions_copy_neither_side(spark, monkeypatch):
    """The chunks are stored once, however many groups of questions scan them, and a group is a bounded number of blocks."""
    from tallyseek.operators import scan

    left = spark.range(50).selectExpr("id AS chunk_id", "array(int(id % 7)) AS slots", "array(double(id)) AS vals", "CAST(NULL AS array<double>) AS dense")
    right = spark.range(40).selectExpr("id AS query_id", "array(int(id % 7)) AS slots", "array(1.0D) AS vals", "CAST(NULL AS array<double>) AS dense")
    stored, plain, groups, best = [], scan.store, [], scan.top_k
    monkeypatch.setattr(scan, "store", lambda df, name: stored.append((name, df.count())) or plain(df, name))
    monkeypatch.setattr(scan, "top_k", lambda df, k: groups.append(df.select("query_id").distinct().count()) or best(df, k))
    rows = scan.dot_top_k(left, right, 2, block=3).collect()
    assert stored == [("chunks", 50), ("asked", 40)]
    assert sum(groups) == 40 and len(groups) == 4
    best_ids = {i: sorted((j for j in range(50) if j % 7 == i % 7), reverse=True)[:2] for i in range(40)}
    assert {(r.query_id, r["rank"]): r.chunk_id for r in rows} == {(i, place + 1): j for i, ids in best_ids.items() for place, j in enumerate(ids)}


def test_hybrid_over_texts_needs_no_list_and_agrees_with_the_index_tables(spark, docs, monkeypatch):
    questions = spark.createDataFrame(
        [(i, t, t) for i, t in enumerate(["a b", "e", "zz", "d a aa bb", "c"])], "query_id long, question string, clean string"
    )
    words = spark.createDataFrame([*DOCS, (6, "aa bb aa"), (7, "bb cc")], docs.schema)
    embed = lambda df, key, text: dense.hashed_embedding(df, key, F.col(text), 8)
    vectors, asked = embed(words, "chunk_id", "content"), embed(questions, "query_id", "question")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    expected = key(rt.hybrid_top_k(lx.store_index(words), lx.store_index(words, lx.word_tokens), vectors, questions, asked, 3))
    monkeypatch.setattr(rt, "hybrid_top_k", None)
    assert key(rt.hybrid_texts_top_k(words, words, vectors, questions, asked, 3)) == expected


def test_rankers_over_texts_store_no_posting(spark, docs, asked, monkeypatch):
    monkeypatch.setattr(lx, "term_rows", None)
    assert lx.bm25_top_k(docs, asked, 2).count() == lx.tfidf_top_k(docs, asked, 2).count() == 6


def test_repeated_ids_are_ranked_by_index_tables(spark, asked):
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "e")], "chunk_id long, content string")
    hits = lx.bm25_top_k(twice, asked, 2)
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in hits.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 1, 2), (3, 2, 1)]


def test_votes_cut_each_text_into_words_once(spark, tmp_path, monkeypatch):
    """TF-IDF and the hashed vectors share one count of the words; ids may be null or repeated."""
    from tallyseek.plans import queries_retrieval as qr

    texts = [(1, "aa bb bb"), (2, "cc, aa!"), (2, "dd"), (3, None), (4, ""), (None, "bb Ee ee"), (5, "? a")]
    docs = spark.createDataFrame(texts, "chunk_id long, content string")
    vectors = lambda df: sorted((r.chunk_id or 0, *r.embedding) for r in df.collect())
    plain = vectors(dense.hashed_embedding(docs, "chunk_id", F.col("content")))
    assert vectors(dense.hashed_bag_embedding(lx.store_bags(docs))) == plain and len(plain) == 3
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(["aa bb", "cc dd aa", "ee"])], "doc_id long, text string, source string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(1, "bb"), (2, "dd ee")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(dense, "word_tokens", lambda text: lx.word_tokens(F.when(text.contains("aa"), F.raise_error(F.lit("cut again"))).otherwise(text)))
    best = {r.query_id: r.chunk_id for r in qr.combined_vote_top3(spark, str(tmp_path)).filter("rank = 1").collect()}
    assert best[1] == 0 and set(best) == {1, 2}
