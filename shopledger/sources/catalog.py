"""Where the retail tables come from: parquet folders, catalog tables, DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .schema import conform


class RetailTables:
    """Retail tables by name, each resolved on first use and then kept."""

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame]):
        self.spark = spark
        self._load = load
        self._seen: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self._load(name)
        return self._seen[name]


def from_parquet(spark: SparkSession, root: str) -> RetailTables:
    """Tables stored as ``<root>/<table>``; partitioned folders are pruned by Spark."""
    return RetailTables(spark, lambda name: conform(spark.read.parquet(f"{root}/{name}")))


def from_catalog(spark: SparkSession, schema: str) -> RetailTables:
    """Tables of one schema of the session catalog."""
    return RetailTables(spark, lambda name: conform(spark.table(f"{schema}.{name}")))


def from_frames(spark: SparkSession, frames: Mapping[str, DataFrame]) -> RetailTables:
    """Tables given directly as DataFrames."""
    return RetailTables(spark, lambda name: frames[name])
