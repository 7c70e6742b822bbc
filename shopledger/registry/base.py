"""Registered queries: name to function of (retail tables) giving a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.catalog import RetailTables
from ..sources.driver_views import VIEW_SQL, duckdb_view, from_driver, references

QUERIES: dict[str, Callable[[RetailTables], DataFrame]] = {}


def query(name: str):
    """Register a query under ``name``."""

    def register(function: Callable[[RetailTables], DataFrame]):
        QUERIES[name] = function
        return function

    return register


def presentable(df: DataFrame) -> DataFrame:
    """Plain output types: exact sums and ratios as doubles, whole numbers as bigint."""
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """Run a registered query on the driver's tables in ``folder``."""
    return presentable(QUERIES[name](from_driver(spark, folder)))


def _oracle_texts(kind: str = "key") -> dict[str, str]:
    """The blocks of the oracle files: queries (``key``), or the views (``view``) that some of them share."""
    texts = {}
    for path in sorted((Path(__file__).parent / "oracle").glob("*.sql")):
        blocks = re.split(r"^-- (key|view): (\w+)\n", path.read_text(), flags=re.M)[1:]
        for of, name, sql in zip(blocks[::3], blocks[1::3], blocks[2::3]):
            if of == kind:
                texts[name] = sql.strip().rstrip(";")
    return texts


def oracle_queries() -> dict[str, str]:
    """DuckDB text per query: the views it reads as leading CTEs, then the query itself. ``report_<key>`` is a view, too."""
    result, shared = {}, _oracle_texts("view")
    shared |= {f"report_{name}": sql for name, sql in _oracle_texts().items()}
    used = lambda sql: re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql, flags=re.I)
    for name, sql in _oracle_texts().items():
        needed: list[str] = []

        def need(view: str) -> None:
            if view in needed or view not in shared and view not in VIEW_SQL:
                return
            for inner in used(shared[view]) if view in shared else references(VIEW_SQL[view]):
                need(inner)
            needed.append(view)

        for word in used(sql):
            need(word)
        ctes = [f"{view} AS (\n{shared[view] if view in shared else duckdb_view(view)}\n)" for view in needed]
        if not ctes:
            result[name] = sql
        elif re.match(r"WITH\b", sql, flags=re.I):
            result[name] = "WITH " + ",\n".join(ctes) + ",\n" + sql[4:].lstrip()
        else:
            result[name] = "WITH " + ",\n".join(ctes) + "\n" + sql
    return result
