"""Compare registered queries with their DuckDB text.

``python tests/oracle.py [folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events".split()
FAMILY = {
    "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], int]:
    """What differs between a Spark result and the SQL text; empty when nothing does."""
    relation = connection.sql(sql)
    problems = []
    spark_types = {name: FAMILY.get(kind, kind) for name, kind in df.dtypes}
    duck_types = {name: str(kind) for name, kind in zip(relation.columns, relation.types)}
    if spark_types != duck_types:
        problems.append(f"schema {sorted(set(spark_types.items()) ^ set(duck_types.items()))}")
    got = rows_of(df.columns, df.collect())
    if set(df.columns) == set(relation.columns):
        expected = rows_of(relation.columns, relation.fetchall())
        if len(got) != len(expected):
            problems.append(f"rows {len(got)} vs {len(expected)}")
        elif got != expected:
            unlike = [(a, b) for a, b in zip(got, expected) if a != b]
            problems.append(f"values differ in {len(unlike)} rows, e.g. {unlike[0]}")
    return problems, len(got)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from shopledger.registry import QUERIES, oracle_queries, run

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, connection, oracle = session(), connect(folder), oracle_queries()
    good = 0
    for name in names:
        start = time.time()
        try:
            if name not in oracle:
                problems, count = ["no oracle"], 0
            else:
                problems, count = differences(run(name, spark, folder), connection, oracle[name])
        except Exception as error:  # report and go on with the next query
            problems, count = [f"{type(error).__name__} {str(error)[:700]}"], 0
        good += not problems
        print(f"{name:28s} {count:7d} {time.time() - start:6.2f}s {'ok' if not problems else problems}", flush=True)
    print(f"{good} of {len(names)} agree")


if __name__ == "__main__":
    main()
