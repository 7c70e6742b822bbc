"""A table of the latest record per key, fed by a stream in batches that may be repeated.

Each batch is a folder named by its id, replaced whole when the batch runs again, and holds one row per key that the
batch brought. Reading takes the latest row per key over all batches, so neither a repeated batch nor the order of
batches changes the table. ``compact`` puts batches into a snapshot; a batch that a snapshot has is ignored from then on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.keys import latest_per_key


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def upsert(path: str, keys: Sequence[str], order: Sequence[str], tie_break: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``; the row with the largest ``order``, then ``tie_break``, is the key's latest."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, keys, order, tie_break).write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    return write


def _snapshot(spark: SparkSession, path: str) -> int | None:
    """The last batch of the newest finished snapshot; it is named as finished only after it is written."""
    done = f"{path}/finished"
    return spark.read.parquet(done).agg(F.max("through")).first()[0] if exists(spark, done) else None


def current(spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str], tie_break: Sequence[str]) -> DataFrame:
    """The latest row per key; ``schema`` is that of the records. Before the first batch the table is empty."""
    through, parts = _snapshot(spark, path), []
    if through is not None:
        parts.append(spark.read.schema(schema).parquet(f"{path}/snapshots/through={through}"))
    if exists(spark, f"{path}/changes"):
        changes = spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/changes")
        parts.append((changes if through is None else changes.where(F.col("batch") > through)).drop("batch"))
    if not parts:
        return spark.createDataFrame([], schema)
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return latest_per_key(whole, keys, order, tie_break)


def compact(spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str], tie_break: Sequence[str]) -> None:
    """Write a snapshot of all batches so far; the batches stay until the caller removes them."""
    if not exists(spark, f"{path}/changes"):
        return
    last = spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/changes").agg(F.max("batch")).first()[0]
    if last is None or last == _snapshot(spark, path):
        return
    table = current(spark, path, schema, keys, order, tie_break)
    table.write.mode("overwrite").parquet(f"{path}/snapshots/through={last}")
    spark.range(1).select(F.lit(last).cast("bigint").alias("through")).write.mode("append").parquet(f"{path}/finished")
