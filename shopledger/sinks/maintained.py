"""The daily view of sales and returns by store, kept as a table that is renewed day by day.

A day is a partition. Days are replaced whole (dynamic partition overwrite), so a renewal that is repeated, or that runs
again after a failure, leaves the same table. Some of its days are made and written at a time, so that it takes little
disk. A day that had facts gets a marker row when it is renewed, so one that has lost them is emptied and not left as it
was. What the facts of each day looked like is written after the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import time
from ..operators.keys import latest_per_key
from ..plans import retail
from ..sources.catalog import RetailTables
from .upsert import exists

DAY = time.DAY


def fingerprints(t: RetailTables, days: Sequence[int] | None = None) -> DataFrame:
    """Rows and hashes of the facts of each day; the order of rows does not matter, repeated rows count."""
    found = []
    for name in ("delivered_sales", "delivered_returns"):
        facts = t[name].where(time.on_days(days)) if days is not None else t[name]
        row = F.xxhash64(*[f"`{c}`" for c in facts.columns]).cast("decimal(38,0)")
        found.append(facts.select(DAY, F.lit(name).alias("fact"), row.alias("row")))
    both = found[0].unionByName(found[1])
    return both.groupBy(DAY, "fact").agg(F.count(F.lit(1)).alias("n"), F.sum("row").cast("string").alias("hash"))


def _kept(spark: SparkSession, path: str) -> DataFrame | None:
    """The fingerprints of the days as they were when each was last renewed."""
    if not exists(spark, f"{path}/facts"):
        return None
    found = spark.read.schema(f"{DAY} bigint, fact string, n bigint, hash string, renewal bigint").parquet(f"{path}/facts")
    return latest_per_key(found, [DAY, "fact"], ["renewal"], ["n"])


def refresh(t: RetailTables, path: str, days: Sequence[int] | None = None) -> None:
    """Renew the view under ``path`` for ``days`` (ids), from the facts of those days alone; all days by default.

    With ``days`` empty nothing is done. A change of products or lines that older facts point to is no change of those
    days' facts: renew all days then.
    """
    spark = t.spark

    def write(rows: DataFrame, mode: str, overwrite: str) -> None:
        rows.repartition(DAY).write.partitionBy(DAY).mode(mode).option("partitionOverwriteMode", overwrite).parquet(f"{path}/rows")

    def present(sums: DataFrame) -> DataFrame:
        return retail.dated_net(sums, t["calendar"]).withColumn("_present", F.lit(True))

    if days is None:
        # The first part replaces all there is.
        retail.store_sums_in_parts(t, lambda sums, some, part: write(present(sums), "append" if part else "overwrite", "static"))
        prints = fingerprints(t).withColumn("renewal", F.lit(0))
        prints.write.partitionBy("renewal").mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/facts")
        return
    if not days:
        return
    prints, kept, renewal, had = fingerprints(t, days), _kept(spark, path), 0, None
    if kept is not None:
        had = kept.where(time.on_days(days)).where("n > 0")
        gone = had.join(prints, [DAY, "fact"], "left_anti").select(DAY, "fact", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("hash"))
        prints = prints.unionByName(gone)
        renewal = 1 + (spark.read.parquet(f"{path}/facts").agg(F.max("renewal")).first()[0] or 0)

    def renew(sums: DataFrame, some: Column, part: int) -> None:
        rows = present(sums)
        if had is not None:
            rows = rows.unionByName(had.where(some).select(DAY, F.lit(False).alias("_present")).distinct(), allowMissingColumns=True)
        write(rows, "overwrite", "dynamic")

    retail.store_sums_in_parts(t, renew, time.on_days(days), min(retail.DAY_PARTS, len(days)))
    prints.write.mode("overwrite").parquet(f"{path}/facts/renewal={renewal}")


def changed_days(t: RetailTables, path: str) -> list[int]:
    """Days whose facts are not those that the view was made from: a bounded list, as days are calendar rows."""
    now, kept = fingerprints(t), _kept(t.spark, path)
    if kept is not None:
        kept = kept.where("n > 0").select(DAY, "fact", F.col("n").alias("_n"), F.col("hash").alias("_hash"))
        now = now.join(kept, [DAY, "fact"], "full_outer").where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("hash").eqNullSafe(F.col("_hash"))))
    return sorted(r[0] for r in now.where(F.col(DAY).isNotNull()).select(DAY).distinct().collect())


def maintain(t: RetailTables, path: str) -> list[int]:
    """Renew the days that have changed and return them."""
    days = changed_days(t, path)
    refresh(t, path, days)
    return days


def view(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the maintained view."""
    rows = spark.read.parquet(f"{path}/rows").where("_present").drop("_present")
    return rows.withColumn(DAY, F.col(DAY).cast("bigint"))
