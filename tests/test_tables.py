import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyseek.operators import lexical as lx
from tallyseek.plans.facts import table_stream
from tallyseek.sources import readers as rd
from tallyseek.sources import tables as tb
from tallyseek.streaming.ingest import read_ingested, start_ingest


def test_csv_rows_become_text(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_bytes(
        "﻿Date,Product,Event,Note\n2004-01-04,Potatoes,None,\n2004-01-05,Milk,Easter,\"a\nb \"\"c\"\"\"\n".encode()
    )
    rows = rd.read_csv_texts(spark, str(path)).orderBy("pos").collect()
    assert [r.content for r in rows] == [
        "Date = 2004-01-04, Product = Potatoes, Event = nan, Note = nan",
        'Date = 2004-01-05, Product = Milk, Event = Easter, Note = a\nb "c"',
    ]
    assert [(r.chunk_id, r.source) for r in rows] == [("1", "sales.csv"), ("2", "sales.csv")]


def test_row_text_needs_two_columns(spark):
    with pytest.raises(ValueError):
        rd.rows_to_text(spark.range(1))


def test_chunks_by_extension(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Привіт\n\nсвіт", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"k": {"n": 1}, "і": "ї"}), encoding="utf-8")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    names = [str(tmp_path / n) for n in ("a.txt", "b.json", "c.csv")]
    rows = {r.source: r for r in rd.read_chunks(spark, names).collect()}
    assert rows["a.txt"].content == "Привіт\n\nсвіт" and rows["a.txt"].clean
    assert rows["b.json"].content == '{\n  "k": {\n    "n": 1\n  },\n  "і": "ї"\n}'
    assert rows["c.csv"].content == "x = 1, y = 2" and not rows["c.csv"].clean
    with pytest.raises(ValueError):
        rd.read_chunks(spark, ["x.exe"])


def test_corpus_json_and_word_list(spark, tmp_path):
    (tmp_path / "corpus.json").write_text('{"1": " a", "2": "b"}')
    rows = rd.read_corpus_json(spark, str(tmp_path / "corpus.json")).collect()
    assert {(r.doc_id, r.content) for r in rows} == {("1", " a"), ("2", "b")}
    (tmp_path / "words.txt").write_text("і\n в \n\nі\n", encoding="utf-8")
    assert rd.read_word_list(spark, str(tmp_path / "words.txt")) == ["в", "і"]


def test_ids_are_repaired_in_order(spark):
    rows = [("1", "a", 1), ("1", "b", 1), ("2", "a", 2), ("1", "c", 1), ("2", "b", 2)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source string, pos int")
    got = {(r.source, r.pos): r.chunk_id for r in tb.repair_ids(chunks).collect()}
    assert got == {("a", 1): "1", ("b", 1): "1_1", ("c", 1): "1_2", ("a", 2): "2", ("b", 2): "2_1"}


def test_index_round_trip_and_empty_reindex(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b"), (2, "b c c")], "chunk_id int, content string")
    asked = spark.createDataFrame([(7, "c")], "query_id int, question string")
    path = str(tmp_path / "index")
    tb.reindex(chunks, path)
    best = lx.bm25_top_k(None, asked, 1, index=tb.read_index(spark, path)).first()
    assert best.chunk_id == 2
    assert tb.reindex(chunks.filter("chunk_id > 9"), path) is None
    assert tb.read_index(spark, path).terms.count() == 0
    with pytest.raises(FileNotFoundError):
        tb.read_index(spark, str(tmp_path / "nothing"))


def test_read_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tb.read_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1


def test_ingest_stream_appends(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    schema = "source string, content string"
    for batch, text in (("a", "перший текст"), ("b", "другий текст")):
        spark.createDataFrame([(batch, text)], schema).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        start_ingest(stream, store).awaitTermination()
    chunks, index = read_ingested(spark, store)
    assert {r.chunk_id for r in chunks.collect()} == {"a#1", "b#1"}
    assert {r.term: r.df for r in index.terms.collect()}["текст"] == 2
    assert index.corpus.first().n == 2


@pytest.mark.parametrize("files", [1, 3])
def test_table_streams_from_a_file_or_a_folder(spark, tmp_path, files):
    """A table may be one file or a folder of files; other tables beside it are not read."""
    for name, rows in (("documents", 7), ("documents2", 5)):
        for part in range(files):
            found = pa.table({"doc_id": list(range(part, rows, files))})
            path = tmp_path / f"{name}.parquet"
            if files > 1:
                path.mkdir(exist_ok=True)
                path = path / f"part-{part}.parquet"
            pq.write_table(found, path)
    stream = table_stream(spark, str(tmp_path), "documents")
    out = str(tmp_path / "out")
    started = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True)
    started.start(out).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == list(range(7))


def test_same_file_names_in_several_folders(spark):
    """Rows that are equal in every order column are still told apart."""
    rows = [("1", "x.txt", 1)] * 3 + [("1_1", "y.txt", 1), (None, "x.txt", 2), (None, "x.txt", 2)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source string, pos int")
    got = sorted(r.chunk_id for r in tb.repair_ids(chunks).collect())
    assert len(got) == 6 == len(set(got))
    assert {"1", "1_1", "1_2", "null", "null_1"} <= set(got)


def test_stored_source_is_deleted(spark, tmp_path):
    rows = [(i, s, "t") for i, s in enumerate(["007", "12", None, "007", "a/b"])]
    path = str(tmp_path / "chunks")
    tb.write_chunks(spark.createDataFrame(rows, "chunk_id int, source string, content string"), path)
    tb.delete_stored_source(spark, path, "007")
    left = tb.read_stored_chunks(spark, path)
    assert sorted(str(r.source) for r in left.collect()) == ["12", "None", "a/b"]
    assert dict(left.dtypes)["source"] == "string"
    tb.delete_stored_source(spark, path, None)
    assert {r.source for r in tb.read_stored_chunks(spark, path).collect()} == {"12", "a/b"}


def test_predictions_of_a_model_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    for model, value in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        tb.write_predictions(spark.createDataFrame([(value, model)], "x double, model string"), path)
    assert [r.x for r in tb.read_predictions(spark, path, "a").collect()] == [3.0]
    assert [r.x for r in tb.read_predictions(spark, path, "b").collect()] == [2.0]


def test_corpus_json_faults(spark, tmp_path):
    (tmp_path / "twice.json").write_text('{"1": "old", "2": "b", "1": "new"}')
    rows = rd.read_corpus_json(spark, str(tmp_path / "twice.json")).collect()
    assert {(r.doc_id, r.content) for r in rows} == {("1", "new"), ("2", "b")}
    (tmp_path / "broken.json").write_text('{"1": "a", ')
    with pytest.raises(Exception, match="(?i)malformed"):
        rd.read_corpus_json(spark, str(tmp_path / "broken.json")).collect()
