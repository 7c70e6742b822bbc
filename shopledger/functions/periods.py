"""Join of rows to the periods that hold their day, many and overlapping ones at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_periods(facts: DataFrame, periods: DataFrame, day: str, first: str, last: str, width: int = 16) -> DataFrame:
    """Each row of ``facts`` with every row of ``periods`` whose ``first`` to ``last`` (whole numbers) holds ``day``.

    Both sides meet on bins of ``width`` days, a period in each bin that it touches, and the days are compared within
    the bin: an equality join, so no side is repeated for every row of the other. A row lies in one bin and meets a
    period there once. Null days and periods with a null or reversed bound match nothing.
    """
    bin_of = lambda name: F.floor(F.col(name) / width).cast("bigint")
    whole = periods.where(F.col(first) <= F.col(last))
    binned = whole.withColumn("_bin", F.explode(F.sequence(bin_of(first), bin_of(last))))
    met = facts.where(F.col(day).isNotNull()).withColumn("_bin", bin_of(day)).join(binned, "_bin")
    return met.where(F.col(day).between(F.col(first), F.col(last))).drop("_bin")
