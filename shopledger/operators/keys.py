"""One row per key: latest records, newest snapshots, collapsed duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import ratio, total_order


def latest_per_key(
    df: DataFrame, key: Sequence[str], order: Sequence[str], tie_break: Sequence[str]
) -> DataFrame:
    """The row with the largest ``order`` per key; a null order loses, ties go to the largest ``tie_break``,
    which must tell rows apart.

    An aggregate rather than a window: each task keeps one row per key before
    the shuffle, so a key with many rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order, *tie_break)).alias("_row")
    return df.groupBy(*key).agg(newest).select(*key, "_row.*").select(*df.columns)


def latest_with_ties(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Every row at the newest date of its key.

    Tasks drop rows behind their own newest before the shuffle (window group limit).
    """
    window = Window.partitionBy(*key).orderBy(*total_order([(order, "desc")]))
    return df.withColumn("_rank", F.rank().over(window)).where(F.col("_rank") == 1).drop("_rank")


def snapshot_at_max(df: DataFrame, key: Sequence[str], day: str) -> DataFrame:
    """Rows at the newest day id of their key; rows without a day are left out.

    The newest days are one small row per key, found with partial maxima and
    joined back, so no key is gathered in one task.
    """
    newest = df.groupBy(*key).agg(F.max(day).alias(day))
    return df.join(newest, [*key, day]).select(*df.columns)


def collapse(
    df: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), maxes: Sequence[str] = (),
    mins: Sequence[str] = (), avgs: Sequence[str] = (),
) -> DataFrame:
    """Merge rows to one per key."""
    return df.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in maxes],
        *[F.min(c).alias(c) for c in mins],
        *[ratio(F.sum(c), F.count(c)).alias(c) for c in avgs],
    )


def last_value_of(df: DataFrame, key: Sequence[str], order: str, value: str, name: str = "last_value") -> DataFrame:
    """Value on the last-ordered row of each key, the largest one on ties."""
    return (
        df.groupBy(*key)
        .agg(F.max(F.struct(order, value)).alias("_last"))
        .select(*key, F.col(f"_last.{order}").alias(f"last_{order}"), F.col(f"_last.{value}").alias(name))
    )
