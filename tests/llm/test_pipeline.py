import os

import pytest

import corpus_pipeline
from tallyseek.llm import near_dedup, queries
from tests.llm.fixtures import edge_docs, sentences
from tests.oracle_check import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(i, sentences(i, 80)) for i in range(30)] + [(40, sentences(3, 80)), (41, sentences(4, 80) + " tail"), (42, None), (43, "12 34")]
    rows += [(44, sentences(90, 30) + " " + sentences(99, 30)), (7, sentences(7, 80))]
    edge_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentences(99, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(sorted((r.doc_id for r in docs.select("doc_id").collect())))
    language, exact, near, clean, mixed = kept
    assert 42 not in language and 43 not in language and len(language) == 34
    assert exact == sorted(set(language) - {40}) and exact.count(7) == 1
    assert near == [i for i in exact if i != 41]
    assert clean == [i for i in near if i != 44]
    assert set(mixed) <= set(clean)
    assert {"size", "source_size", "target", "taken"} <= set(docs.columns)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    if name in queries.ORACLES:
        assert differences(found, connect(FOLDER), queries.ORACLES[name]) == []
    else:
        assert found.count() > 0


def test_rows_with_one_id_are_told_apart(spark, tmp_path):
    """Null and repeated ids: only the row that holds an item goes, and each other row is mixed once, with its own size."""
    leak = sentences(99, 30)
    rows = [(None, sentences(200 + i, 60 + i)) for i in range(6)] + [(5, sentences(300 + i, 80 + i)) for i in range(6)]
    rows += [(None, sentences(90, 30) + " " + leak), (5, leak + " " + sentences(91, 30)), (6, sentences(92, 70))]
    edge_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select(corpus_pipeline.COLUMNS)
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    texts = [t for _, t in rows if leak not in t]
    assert sorted(r.text for r in clean.collect()) == sorted(texts)
    clean.write.parquet(f"{tmp_path}/clean")
    mixed = corpus_pipeline.mix_to_weights(spark, spark.read.parquet(f"{tmp_path}/clean"), str(tmp_path)).collect()
    assert len({r.text for r in mixed}) == len(mixed) and all(r.size == len(r.text.split()) for r in mixed)
    near = near_dedup.near_dedup(edge_docs(spark, [(None, t) for t in texts] + [(None, texts[0] + " tail")])).collect()
    assert sorted(r.class_size for r in near) == [1] * (len(texts) - 1) + [2, 2] and sum(r.kept for r in near) == len(texts)
