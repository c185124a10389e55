import re
import zlib
from collections import Counter

import pytest

from tallyseek.llm import decontamination, language_id, mixing, quality, secrets, toxicity
from tests.llm.fixtures import edge_docs, edge_rows, no_docs, sentences


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_decontamination_agrees_with_brute_force(spark):
    item, twice = sentences(31, 70), "again and again " * 12
    dirty = words(item)
    dirty[20] = "changed"
    moved = words(item)
    moved.insert(22, "inserted")
    rows = edge_rows() + [
        (50, sentences(32, 70) + " " + item + ". " + sentences(33, 10)), (51, " ".join(dirty)), (52, sentences(34, 30) + " " + " ".join(moved)),
        (53, item.upper()), (54, " ".join(words(item)[:50])), (55, twice + sentences(35, 9)), (56, item + " " + item), (None, item),
    ]
    items = [(1, item), (2, twice), (3, "four words are few"), (4, None), (5, ""), (6, item), (7, sentences(36, 600))]
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, h string")
    found = decontamination.contaminated(edge_docs(spark, rows), table).collect()

    def grams(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for d, t in rows:
        g = grams(words(t))
        for i, it in items:
            m = grams(words(it))
            for s in range(len(g) - len(m) + 1) if m else ():
                if not set(g[s : s + len(m)]) & set(m):
                    continue
                c = sum((Counter(g[s : s + len(m)]) & Counter(m)).values())
                if 9 * c >= 8 * len(m):
                    want[d, i] = max(want.get((d, i), (0, 0)), (c / (2 * len(m) - c), -s))
    assert {(r.doc_id, r.item_id): (r.similarity, -r.start_word) for r in found} == want
    assert (50, 1) in want and (51, 1) in want and (54, 1) not in want


def test_decontamination_blocks_miss_nothing(spark):
    """All fingerprints within the radius share a block, whatever the bits."""
    import random

    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, decontamination.RADIUS)):
            b ^= 1 << bit
        rows.append((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    table = spark.createDataFrame(rows, "a long, b long")
    from pyspark.sql import functions as F

    shared = F.size(F.array_intersect(decontamination.blocks(F.col("a")), decontamination.blocks(F.col("b"))))
    assert table.filter(shared == 0).count() == 0


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([(1, sentences(1, 20))], "item_id long, text string")
    assert decontamination.contaminated(no_docs(spark), items).collect() == []
    assert decontamination.contaminated(edge_docs(spark), items.limit(0)).collect() == []


def test_mixing_budgets(spark):
    found = mixing.mix_sources(edge_docs(spark)).collect()
    assert len(found) == len(edge_rows())
    taken, size, target = Counter(), {}, {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    total = sum(r.size for r in found)
    assert sum(target.values()) == pytest.approx(min(1.5 * total, 2 * total))
    for size, t in target.items():
        assert t <= 2 * size and abs(taken[size] - t) <= len(found)
    again = mixing.mix_sources(edge_docs(spark)).collect()
    assert Counter(found) == Counter(again)
    assert mixing.mix_sources(no_docs(spark)).collect() == []


def test_mixing_with_one_small_source(spark):
    """A capped source takes every document twice; the rest of its share goes to the others."""
    rows = [(i, "w " * (5 + i % 7)) for i in range(300)]
    docs = spark.createDataFrame([(d, t, "a" if d < 6 else "b") for d, t in rows], "doc_id long, text string, source string")
    found = mixing.mix_sources(docs).collect()
    assert all(r.taken == 2 * r.size for r in found if r.doc_id < 6)
    b = [r for r in found if r.doc_id >= 6]
    assert sum(r.taken for r in b) == int(b[0].target)


def test_language_backoff(spark):
    rows = []
    for i in range(60):
        rows.append((i, sentences(i % 3, 60, 40), "aa"))
        rows.append((100 + i, sentences(70 + i % 3, 60, 40).upper().replace("A", "Z"), "bb"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_backoff(docs)
    assert model.langs == ["aa", "bb"]
    score = model.scorer()
    assert all(score(t)[0] == lang for _, t, lang in rows)
    # Unseen words fall back to their n-grams.
    assert score("zzzzq zzzz")[0] == "bb"
    for empty in (None, "", " 12 ² 34 !?"):
        assert score(empty) == ("und", 0.0)
    found = language_id.identify(edge_docs(spark), model, ["doc_id", "id"]).collect()
    assert len(found) == len(edge_rows()) and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (7, 8, 10)} == {"und"}
    nothing = language_id.fit_backoff(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(edge_docs(spark), nothing, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(no_docs(spark), model, ["doc_id"]).collect() == []


def test_clause_grammar_context():
    model = toxicity.ClauseGrammar({"fool": 2.0}, {"idio": 1.5})

    def emitted(text):
        return {toxicity.PATTERNS[i]: x for i, x in enumerate(model.emissions(text)) if x}

    assert emitted("what a fool.") == {"insult": 2.0}
    assert emitted("You are a fool") == {"insult+target": 2.0}
    assert emitted("he is not a fool. fine") == {"insult+negated": 2.0}
    assert emitted('she said "fool" again') == {"insult+reported": 2.0}
    assert emitted("not here and there the fool") == {"insult": 2.0}
    assert emitted("you said he is no idiotes, kill") == {"insult+negated+reported+target": 1.5, "threat+negated+reported+target": 1.0}
    assert emitted("you. fool") == {"insult": 2.0}
    assert emitted("") == emitted(None) == emitted("nothing here") == {}


def test_toxicity_learns_words_and_beginnings(spark):
    rows = []
    for i in range(300):
        text, toxic = sentences(i, 40), i % 3 == 0
        if toxic:
            text = text.replace(" ", " blockhead ", 1) if i % 2 else text + f". vequ{chr(97 + i % 20)}{chr(97 + i % 7)}"
        rows.append((i, text, int(toxic)))
    docs = spark.createDataFrame(rows + [(900, "no label", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit_grammar(docs)
    found = toxicity.score_toxicity(docs, model, ["doc_id"]).collect()
    right = sum(r.predicted == rows[r.doc_id][2] for r in found if r.doc_id < 300)
    assert right >= 297
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(edge_docs(spark), model, ["doc_id", "key"]).collect()}
    assert scores[7] == scores[8] == scores[10] < 0.5
    assert toxicity.score_toxicity(no_docs(spark), model, ["doc_id"]).collect() == []
    untaught = toxicity.fit_grammar(docs.filter("toxic IS NULL"))
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, untaught, ["doc_id"]).collect())


def test_quality_orders_grades(spark):
    rows = []
    for i in range(360):
        grade = i % 3
        text = [" | ".join(sentences(i, 30).split()), sentences(i, 60) + " rough edges", sentences(i, 60) + " fine prose"][grade]
        rows.append((i, text, grade))
    docs = spark.createDataFrame(rows + [(999, "unrated", None)], "doc_id long, text string, grade int")
    model = quality.fit_quality(docs)
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    found = quality.score_quality(docs, model, ["doc_id"]).collect()
    assert sum(r.grade == r.doc_id % 3 for r in found if r.doc_id < 360) > 330
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_prob <= 1 for r in found)
    assert len(quality.score_quality(edge_docs(spark), model, ["doc_id", "row"]).collect()) == len(edge_rows())
    assert quality.fit_quality(docs.filter("grade IS NULL")) is None
    assert quality.score_quality(edge_docs(spark), None, ["doc_id"]).filter("grade IS NOT NULL").count() == 0
    assert {r.grade for r in quality.score_quality(docs, quality.fit_quality(docs.filter("grade = 1")), ["doc_id"]).collect()} == {1}
    assert quality.score_quality(no_docs(spark), model, ["doc_id"]).collect() == []


def test_secret_scan(spark):
    import random

    rng = random.Random(2)
    rows, labels = [], {}
    for i in range(200):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        value = key if i % 2 else f"{sentences(i, 1)}.{i}@mail{i % 7}.example.com"
        rows.append((i, f"{sentences(i, 12)} {'token = ' if i % 2 else 'mail '}{value} {sentences(i + 1, 5)}"))
        labels[i] = i % 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    context = secrets.fit_context(docs)
    found = secrets.candidates(docs, context)
    labelled = spark.createDataFrame(list(labels.items()), "doc_id long, label int")
    forest = secrets.fit_forest(found.join(labelled.filter("doc_id % 4 < 2"), "doc_id"))
    scored = secrets.scan_secrets(found, forest).collect()
    assert {r.doc_id for r in scored if r.secret} == {i for i in labels if labels[i]}
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] == r.candidate for r in scored)
    edge = secrets.scan_secrets(secrets.candidates(edge_docs(spark), context), forest)
    assert not {r.doc_id for r in edge.collect()} & {7, 8, 10}
    assert secrets.fit_forest(found.join(labelled.filter("label = 1"), "doc_id")) is None
    assert secrets.scan_secrets(found, None).filter("secret").count() == found.count()
    assert secrets.candidates(no_docs(spark), context).collect() == []


def test_held_out_split_is_crc32(spark):
    from pyspark.sql import functions as F

    from tallyseek.llm.common import crc_part

    got = spark.range(50).select("id", crc_part("id", 5).alias("p"), F.lit(None).cast("long").alias("none")).collect()
    assert all(r.p == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_decontamination_of_documents_shorter_than_an_item(spark):
    item, long = sentences(81, 39), sentences(82, 80)
    w, v = words(item), words(long)
    rows = [
        (1, " ".join(w[:-1])), (2, " ".join(w[1:])), (3, " ".join(w[:34])), (4, " ".join(w[:30])), (5, " ".join(w[:20] + ["x"] + w[21:-1])),
        (6, " ".join(v[:64])), (7, " ".join(v[3:70])), (8, " ".join(v[:30])), (9, item), (10, "x " + " ".join(w[:-1])), (11, " ".join(w[:4])),
        (12, " ".join(v[5:75])), (13, " ".join(w[2:36])), (14, " ".join(v[:66])),
    ]
    items = [(1, item), (2, long), (3, " ".join(w[1:])), (4, " ".join(v[:78]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(edge_docs(spark, rows), table).collect()

    def grams(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for d, t in rows:
        for i, it in items:
            m, n = grams(words(it)), min(len(words(t)), len(words(it)))
            for s in range(len(words(t)) - n + 1):
                g = grams(words(t)[s : s + n])
                c = sum((Counter(g) & Counter(m)).values())
                if c and 9 * c >= 4 * (len(g) + len(m)):
                    want[d, i] = max(want.get((d, i), (0, 0, 0)), (c / (len(g) + len(m) - c), -s, n))
    assert {(r.doc_id, r.item_id): (r.similarity, -r.start_word, r.n_words) for r in found} == want
    assert (1, 1) in want and want[1, 1][0] == 34 / 35 and (4, 1) not in want


def test_secrets_rarer_than_the_sample(spark, monkeypatch):
    """Ten secrets in 20,000 findings and a sample of 200: the forest still learns both labels and removes what is harmless."""
    monkeypatch.setattr(secrets, "TRAIN_FINDINGS", 200)
    width = len(secrets.FEATURES)
    rows = [(i, 0, [float(i % 2000 == 0)] * 3 + [float(i % 7)] * (width - 3), int(i % 2000 == 0)) for i in range(20_000)]
    found = spark.createDataFrame(rows, "doc_id long, start int, features array<double>, label int")
    forest = secrets.fit_forest(found)
    assert forest is not None
    kept = secrets.scan_secrets(found, forest).filter("secret").collect()
    assert {r.doc_id for r in kept} == set(range(0, 20_000, 2000))
