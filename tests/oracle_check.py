"""Compare registered queries with their SQL in DuckDB: `python -m tests.oracle_check DIR [NAME…]`."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def make_session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyseek-check")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted by their text."""
    frame = frame.reindex(sorted(frame.columns), axis=1)
    text = frame.map(lambda v: "∅" if _missing(v) else (repr(float(v)) if isinstance(v, float) else str(v)))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def _missing(value) -> bool:
    return value is None or value is pd.NaT or (isinstance(value, float) and value != value)


def _rows(relation_rows, columns) -> pd.DataFrame:
    return pd.DataFrame(relation_rows, columns=columns, dtype=object)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT",
}


LAST = {"spark": 0.0}


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides agree in columns, types and rows."""
    found_rows = [tuple(r) for r in spark_df.collect()]
    LAST["spark"] = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = normal(_rows(cursor.fetchall(), columns))
    found = normal(_rows(found_rows, spark_df.columns))
    problems = []
    if list(expected.columns) != list(found.columns):
        return [f"columns {list(found.columns)} != {list(expected.columns)}"]
    for field in spark_df.schema:
        ours, theirs = KINDS.get(field.dataType.simpleString()), kinds[field.name]
        if ours != theirs:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} != {theirs}")
    if len(expected) != len(found):
        problems.append(f"rows {len(found)} != {len(expected)}")
    elif not expected.equals(found):
        bad = (expected != found).any(axis=1)
        problems.append(f"{int(bad.sum())} of {len(bad)} rows differ")
        for i in list(bad[bad].index[:2]):
            for c in expected.columns:
                if expected.at[i, c] != found.at[i, c]:
                    problems.append(f"  {c}: {found.at[i, c][:150]!r} != {expected.at[i, c][:150]!r}")
    return problems


def main() -> None:
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problems = differences(df, con, oracles[name])
                verdict = "ok" if not problems else "DIFF " + "\n     ".join(problems)
            else:
                rows = df.collect()
                LAST["spark"] = time.time()
                verdict = f"rows only: {len(rows)} {str(rows[:1])[:200]}"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        print(f"{LAST['spark'] - start:6.1f}s {time.time() - LAST['spark']:6.1f}s {name}: {verdict}", flush=True)


if __name__ == "__main__":
    main()
