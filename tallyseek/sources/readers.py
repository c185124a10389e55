"""File sources: text, JSON, CSV, and the choice of reader by extension."""

from __future__ import annotations

import json
from functools import reduce
from os.path import splitext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseek.operators.chunking import chunk_texts
from tallyseek.operators.sizing import attach, materialize
from tallyseek.sources.records import cells, column_names, csv_records, json_entries

RETAIL_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.DateType()),
        T.StructField("Day_of_Week", T.StringType()),
        T.StructField("Season", T.StringType()),
        T.StructField("Weather", T.StringType()),
        T.StructField("Product", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("Unit_Price", T.DoubleType()),
        T.StructField("Num_Customers", T.IntegerType()),
        T.StructField("Sales", T.DoubleType()),
        T.StructField("Stocks", T.IntegerType()),
        T.StructField("Shelf_Life", T.IntegerType()),
        T.StructField("Days_Until_Next_Purchase", T.IntegerType()),
        T.StructField("Event", T.StringType()),
        T.StructField("Purchase_Quantity", T.IntegerType()),
    ]
)

# Cell texts that count as missing.
MISSING_TEXTS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

EXTRACTED_EXTENSIONS = (".pdf", ".docx")


def read_csv(
    spark: SparkSession, path, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Header CSV with quoted multi-line cells; a UTF-8 mark is dropped, blanks are data.

    With `multi_line=False`, for files without line ends inside cells, one file is split over
    many tasks.  Without a schema every column is text, which needs no extra pass over the files.
    """
    reader = spark.read.options(
        header=True,
        multiLine=multi_line,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        enforceSchema=False,
    )
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path)


def read_csv_ranges(spark: SparkSession, path, schema: T.StructType | None = None) -> DataFrame:
    """As `read_csv`, but a large file with line ends inside cells is read in ranges by many tasks.

    Files share one header, whose names must be those of the schema, in order; without a schema every column is text.
    Quotes stand around whole cells only (`records.csv_records`).
    """
    records = csv_records(spark, [path] if isinstance(path, str) else list(path))
    names = column_names(cells(F.col("record"))).alias("names")
    headers = records.filter("block = 0 AND at = 0").select(names).distinct().limit(2).collect()
    if not headers:
        return spark.createDataFrame([], schema or T.StructType())
    if len(headers) > 1 or (schema is not None and schema.names != headers[0].names):
        raise ValueError(f"headers differ: {[h.names for h in headers]}")
    schema = schema or T.StructType([T.StructField(name, T.StringType()) for name in headers[0].names])
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    data = records.filter("block > 0 OR at > 0")
    parsed = F.from_csv("record", F.lit(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)), options)
    return data.select(parsed.alias("_row")).select("_row.*")


def read_retail(spark: SparkSession, path) -> DataFrame:
    """Retail facts; the text `None` in `Event` is no event."""
    facts = read_csv(spark, path, RETAIL_SCHEMA)
    return facts.withColumn("Event", F.nullif("Event", F.lit("None")))


def read_corpus_json(spark: SparkSession, path, whole_files: bool = True) -> DataFrame:
    """Objects `{id: text}` as `doc_id, content`: one per file, or one per line.

    Text that is no object is an error, and of repeated keys of an object the last counts.  A large object is read in
    ranges by many tasks.
    """
    if whole_files:
        entries = json_entries(spark, [path] if isinstance(path, str) else list(path))
        last = F.max_by("value", F.struct("block", "at")).alias("content")
        return entries.groupBy("path", F.col("key").alias("doc_id")).agg(last).drop("path")
    objects = spark.read.text(path).filter(F.trim("value") != "")
    entries = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    numbered = objects.withColumn("_object", F.monotonically_increasing_id())
    listed = numbered.select("_object", F.posexplode(F.map_entries(entries)).alias("_at", "_entry"))
    return (
        listed.groupBy("_object", F.col("_entry.key").alias("doc_id"))
        .agg(F.max_by("_entry.value", "_at").alias("content"))
        .drop("_object")
    )


def read_texts(spark: SparkSession, path, skip_unreadable: bool = False) -> DataFrame:
    """`source, content`: one row per file; optionally skip files that cannot be read."""
    reader = spark.read
    if skip_unreadable:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("content")
    )


@F.pandas_udf(T.StringType())
def indented_json(texts: pd.Series) -> pd.Series:
    """JSON with an indent of 2 and unescaped letters; Spark's writer indents differently."""
    return texts.map(
        lambda text: json.dumps(json.loads(text), indent=2, ensure_ascii=False), na_action="ignore"
    )


def read_json_texts(spark: SparkSession, path) -> DataFrame:
    """`source, content`: every JSON file as indented text; files need not share a schema."""
    return read_texts(spark, path).withColumn("content", indented_json("content"))


def rows_to_text(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add `content`: `name = value` pairs in column order; a missing value reads `nan`."""
    columns = columns or rows.columns
    if len(columns) < 2:
        raise ValueError("row text needs at least two columns")
    pairs = [
        F.concat(F.lit(f"{name} = "), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan")))
        for name in columns
    ]
    return rows.withColumn("content", F.concat_ws(", ", *pairs))


def read_csv_texts(spark: SparkSession, path) -> DataFrame:
    """`chunk_id, source, pos, content`: one chunk per CSV row, numbered from 1 per file.

    `path` may be a list; the files need not share columns, and all are read in one plan and in ranges.  A file without
    rows is an error.
    """
    paths = [path] if isinstance(path, str) else list(path)
    records = csv_records(spark, paths)
    counts = materialize(records.groupBy("path", "block").agg(F.count("*").alias("n"), F.min(F.struct("at", "record")).alias("first")))
    by_file = counts.groupBy("path").agg(F.sum("n").alias("n"), F.min_by("first.record", "block").alias("header"))
    files = materialize(by_file.select("path", "n", column_names(cells(F.col("header"))).alias("names")))
    if few := files.filter("n < 2").first():
        raise ValueError(f"no rows in {few.path}")
    if len(set(spark.read.text(paths).inputFiles())) > files.count():
        raise ValueError(f"no rows in some of {paths}")
    if files.filter(F.size("names") < 2).first():
        raise ValueError("row text needs at least two columns")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        F.xxhash64("path", "block").alias("number"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.col("first.at").alias("lowest")
    )
    numbered = attach(records.withColumn("number", F.xxhash64("path", "block")), begins, "number")
    # The header is record 0 of its file.
    pos = F.col("before") + F.col("at") - F.col("lowest")
    rows = attach(numbered.withColumn("pos", pos).filter("pos > 0"), files.select("path", "names"), "path")
    filled = F.transform(cells(F.col("record")), lambda cell: F.when(~cell.isin(*MISSING_TEXTS), cell))
    pairs = F.transform("names", lambda name, i: F.concat(name, F.lit(" = "), F.coalesce(F.get("_cells", i), F.lit("nan"))))
    return rows.withColumn("_cells", filled).select(
        F.col("pos").cast("string").alias("chunk_id"),
        F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("source"),
        F.col("pos").cast("int").alias("pos"),
        F.array_join(pairs, ", ").alias("content"),
    )


def read_chunks(spark: SparkSession, paths: list[str], extract=None) -> DataFrame:
    """Chunk table of files of any supported type, with `clean` true where text gets cleaned.

    CSV rows are chunks of their own and stay as they are.  `extract(spark, paths)` may
    supply `source, content` for PDF and DOCX files.
    """
    by_extension: dict[str, list[str]] = {}
    for path in paths:
        by_extension.setdefault(splitext(path)[1].lower(), []).append(path)
    parts = []
    for extension, group in by_extension.items():
        if extension == ".csv":
            parts.append(read_csv_texts(spark, group).withColumn("clean", F.lit(False)))
            continue
        if extension == ".txt":
            texts = read_texts(spark, group)
        elif extension == ".json":
            texts = read_json_texts(spark, group)
        elif extension in EXTRACTED_EXTENSIONS and extract is not None:
            texts = extract(spark, group)
        else:
            raise ValueError(f"unsupported file type: {extension}")
        parts.append(chunk_texts(texts).withColumn("clean", F.lit(True)))
    if not parts:
        raise ValueError("no files given")
    return reduce(DataFrame.unionByName, parts)


def read_word_list(spark: SparkSession, path) -> list[str]:
    """Words of a one-per-line file, for `Lexicon.with_stop_words`."""
    words = spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''")
    return sorted(row.word for row in words.distinct().collect())
