"""Joins that stay balanced when a key is null for a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def spread_null_left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str]
) -> DataFrame:
    """Left join on equal keys whose null-key rows do not share one partition.

    A null key never matches, yet a shuffle join would send all those rows to
    one task. A second key, zero wherever a match is possible and a hash of
    ``spread_by`` elsewhere, spreads them over as many slots as there are shuffle partitions.
    """
    slots = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    null_key = F.lit(False)
    for name in on:
        null_key = null_key | F.col(name).isNull()
    slot = F.when(null_key, F.pmod(F.xxhash64(*spread_by), F.lit(slots))).otherwise(F.lit(0).cast("bigint"))
    always_zero = F.pmod(F.xxhash64(*on), F.lit(1))
    return (
        left.withColumn("_slot", slot)
        .join(right.withColumn("_slot", always_zero), on=[*on, "_slot"], how="left")
        .drop("_slot")
    )
