"""Compare the registered queries with their SQL on the same tables: ``python tests/oracle_check.py DIR [query ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, None if nothing does."""
    got = spark_df.collect()
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = rows_of(spark_df.columns, got), rows_of(names, want)
    if a == b:
        return _types(spark_df, result.description)
    extra, missing = a - b, b - a
    head = f"rows {len(got)} vs {len(want)}, {sum(extra.values())} differ"
    return f"{head}\n   cols  {sorted(names)}\n   spark {list(extra)[:2]}\n   sql   {list(missing)[:2]}"


def _types(spark_df, description) -> str | None:
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "date": "DATE",
    }
    sql = {c[0]: str(c[1]) for c in description}
    wrong = {n: (t, sql[n]) for n, t in spark_df.dtypes if same.get(t) != sql[n]}
    return f"types {wrong}" if wrong else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in wanted or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                fault = compare(df, con, oracles[name])
            else:
                fault = f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            fault = f"{type(error).__name__}: {str(error)[:700]}"
        failed += fault is not None
        print(f"{'ok  ' if fault is None else 'DIFF'} {name:26s} {time.time() - began:6.2f}s {fault or ''}", flush=True)
    print(f"{failed} of {len(wanted or queries)} without an equal SQL result")
    return failed


if __name__ == "__main__":
    sys.exit(main())
