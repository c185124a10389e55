import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyseek.sources import readers as rd
from tallyseek.sources.records import cells, csv_records, json_entries


@pytest.fixture()
def small_ranges(spark):
    """Ranges of some 1000 bytes, so that many records of the files straddle two or more."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(path, rows, end="\n", mark=""):
    with open(path, "w", newline="", encoding="utf-8") as file:
        file.write(mark)
        csv.writer(file, lineterminator=end).writerows(rows)
    return str(path)


def sample(n, seed):
    draw = random.Random(seed)
    cell = lambda: "".join(draw.choice(['"', "\n", ",", " ", "a", "é", "\n\n", '""']) for _ in range(draw.choice([0, 3, 40, 400])))
    return [["id", "x,\n\"y\"", "z"]] + [[str(i), cell(), cell()] for i in range(n)]


@pytest.mark.parametrize("end, mark", [("\n", ""), ("\r\n", "﻿")])
def test_records_equal_to_csv_module(spark, small_ranges, tmp_path, end, mark):
    path = written(tmp_path / "a.csv", sample(60, 3), end, mark)
    found = csv_records(spark, [path])
    assert found.select("block").distinct().count() > 10
    rows = found.select("block", "at", cells(F.col("record")).alias("c")).orderBy("block", "at").collect()
    expected = [[c.replace("\r\n", "\n") for c in row] for row in csv.reader(open(path, newline="", encoding="utf-8-sig"))]
    assert [[c or "" for c in r.c] for r in rows] == expected


def test_ranges_equal_to_one_task(spark, small_ranges, tmp_path):
    path = written(tmp_path / "a.csv", sample(60, 4))
    ranges, whole = rd.read_csv_ranges(spark, path), rd.read_csv(spark, path)
    assert ranges.columns == whole.columns
    assert sorted(map(str, ranges.collect())) == sorted(map(str, whole.collect()))
    typed = "id int, `x,\n\"y\"` string, z string"
    with pytest.raises(ValueError, match="headers differ"):
        rd.read_csv_ranges(spark, path, spark.createDataFrame([], "a int").schema)
    schema = rd.T.StructType([rd.T.StructField(n, k) for n, k in zip(whole.columns, (rd.T.IntegerType(), rd.T.StringType(), rd.T.StringType()))])
    assert sorted(r.id for r in rd.read_csv_ranges(spark, path, schema).collect()) == list(range(60)), typed


def test_row_texts_of_many_files(spark, small_ranges, tmp_path):
    paths = []
    for i in range(3):
        rows = sample(20, i)
        rows[0] = [["a", "b", "c"], ["", "A", "a"], ["x", "y", "z"]][i]
        paths.append(written(tmp_path / f"f {i}+.csv", rows))
    found = rd.read_csv_texts(spark, paths).orderBy("source", "pos").collect()
    expected = []
    for i, path in enumerate(paths):
        header, *rows = csv.reader(open(path, newline="", encoding="utf-8"))
        names = [["a", "b", "c"], ["_c0", "A1", "a2"], ["x", "y", "z"]][i]
        for pos, row in enumerate(rows, 1):
            expected.append((f"f {i}+.csv", pos, ", ".join(f"{n} = {c or 'nan'}" for n, c in zip(names, row))))
    assert [(r.source, r.pos, r.content) for r in found] == expected


def test_faults(spark, tmp_path):
    whole = written(tmp_path / "a.csv", [["a", "b"], ["1", "2"]])
    for name, text, fault in (
        ("open.csv", 'a,b\n1,"2\n', "not closed"), ("head.csv", "a,b\n", "no rows"), ("empty.csv", "", "no rows"), ("one.csv", "a\n1\n", "two columns")
    ):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match=fault):
            rd.read_csv_texts(spark, [whole, str(tmp_path / name)])


def test_short_and_long_rows_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\r\n\r\n1\r\n,"",NA,9\n\n"x ""y"" z", 2 ,"3"\n')
    rows = rd.read_csv_texts(spark, str(tmp_path / "a.csv")).orderBy("pos").collect()
    assert [r.content for r in rows] == ["a = 1, b = nan, c = nan", "a = nan, b = , c = nan", 'a = x "y" z, b =  2 , c = 3']


def test_long_cells_do_not_recurse(spark):
    text = '"' + '""a' * 100_000 + '",b'
    row = spark.createDataFrame([(text,)], "t string").select(cells(F.col("t")).alias("c")).first()
    assert row.c == ['"a' * 100_000, "b"]


def test_json_entries_equal_to_json_module(spark, small_ranges, tmp_path):
    draw = random.Random(5)
    pieces = ['"', "\\", ",", "{", "}", "[", "]", ":", "\n", " ", "ї", '\\"', ",,", "a"]
    text = lambda: "".join(draw.choice(pieces) for _ in range(draw.choice([0, 2, 30, 300])))
    deep = lambda n: [text(), {text(): deep(n - 1)}] if n else draw.choice([1.5, True, None, text()])
    given = {f"{i}{text()}": text() if i % 4 else deep(i % 3) for i in range(80)}
    for name, options in (("a", {}), ("b", {"indent": 1, "ensure_ascii": False}), ("c", {"separators": (",", ":")})):
        (tmp_path / f"{name}.json").write_text(json.dumps(given, **options) + "\n", encoding="utf-8")
        found = {r.doc_id: r.content for r in rd.read_corpus_json(spark, str(tmp_path / f"{name}.json")).collect()}
        assert found.keys() == given.keys()
        for key, value in given.items():
            assert found[key] == value if isinstance(value, str) or value is None else json.loads(found[key]) == value


def test_json_ranges_and_repeated_keys(spark, small_ranges, tmp_path):
    path = str(tmp_path / "a.json")
    with open(path, "w") as file:
        file.write("\ufeff {" + ", ".join(f'"{i % 50}": "{i}, {"x, " * 20}"' for i in range(150)) + "} \n")
    entries = json_entries(spark, [path])
    assert entries.select("block").distinct().count() > 10 and entries.count() == 150
    assert {r.doc_id: r.content.split(",")[0] for r in rd.read_corpus_json(spark, path).collect()} == {str(i % 50): str(i) for i in range(100, 150)}


def test_json_faults_and_empty_files(spark, tmp_path):
    faults = ['{"a": "b"', '{"a": "b}', "[1, 2]", '{"a": 1} {"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1} {}', '{"a": 1}}', '{"a": 1,}', '{,"a": 1}', ', {"a": 1}', '{"a" 1}', "x"]
    for i, text in enumerate(faults):
        (tmp_path / f"f{i}.json").write_text(text)
        with pytest.raises(Exception):
            rd.read_corpus_json(spark, str(tmp_path / f"f{i}.json")).collect()
            pytest.fail(text)
    for i, text in enumerate(["", " \n", "{}", " { \n} "]):
        (tmp_path / f"e{i}.json").write_text(text)
    assert rd.read_corpus_json(spark, [str(tmp_path / f"e{i}.json") for i in range(4)]).count() == 0
