"""Shares, ranks and curves.

``bounded=True`` says that every group is a small summary (a year's frequency
buckets, a day's hours): a plain window does. The default makes no such
assumption and never puts a whole group into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, ratio, total_order
from ..functions.ordered import ordered_scan

#: Rows of a group for which its totals get one more join key, the keys per shuffle partition at most, and the groups that
#: may have more than one. A group that is not among these has less than one part in so many of all rows.
ROWS_PER_KEY, KEYS_PER_TASK, LARGEST_GROUPS = 1000, 8, 256


def with_group_values(
    df: DataFrame, by: Sequence[str], values: Mapping[str, Column], bounded: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Put aggregates of each row's group beside the row.

    Unbounded groups are aggregated on their own (partial sums first) and
    joined back, so a group holding much of the data is never gathered: by the measured rows of the largest groups
    (``hot_groups``) each is split into join keys, up to several for every task; the totals of all others stay one row. That
    reads ``df`` twice; ``source`` may name a cheaper place with the same rows,
    such as a written copy, to aggregate from.
    """
    if bounded:
        window = Window.partitionBy(*by)
        return df.select("*", *[value.over(window).alias(name) for name, value in values.items()])
    source = df if source is None else source
    if not by:
        totals = source.agg(F.struct(*[value.alias(name) for name, value in values.items()]).alias("_all"))
        scalar = totals.scalar()
        return df.withColumn("_all", scalar).select("*", *[F.col(f"_all.{name}").alias(name) for name in values]).drop("_all")
    totals = source.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *[value.alias(name) for name, value in values.items()])
    hot = hot_groups(totals, by, list(values)).scalar()
    place = F.array_position("_hot.group", F.xxhash64(*by))
    keys = F.when(place > 0, F.get("_hot.keys", place.cast("int") - 1)).otherwise(1)
    # No group is empty; the condition keeps the count here too, so that one aggregation serves both.
    copies = totals.where("_rows > 0").withColumn("_hot", hot).withColumn("_slot", F.explode(F.sequence(F.lit(0), keys - 1)))
    slotted = df.withColumn("_hot", hot).withColumn("_slot", F.pmod(F.xxhash64(*df.columns), keys).cast("int"))
    same = F.col("d._slot") == F.col("t._slot")
    for name in by:
        same = same & F.col(f"d.{name}").eqNullSafe(F.col(f"t.{name}"))
    joined = slotted.drop("_hot").alias("d").join(copies.drop("_hot", "_rows").alias("t"), same)
    return joined.select(*[F.col(f"d.`{c}`") for c in df.columns], *[F.col(f"t.{name}") for name in values])


def hot_groups(totals: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row ``_hot`` of arrays: hashes of the largest groups of ``totals`` and the join keys of each.

    ``totals`` has one row per group, its rows in ``_rows``. At most ``LARGEST_GROUPS`` groups of more than
    ``ROWS_PER_KEY`` rows are listed, whatever the data. The ``values`` are kept beside them, so that this and the
    totals share one aggregation.
    """
    most = KEYS_PER_TASK * int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = totals.where(F.col("_rows") > ROWS_PER_KEY).orderBy(F.desc("_rows")).limit(LARGEST_GROUPS)
    keys = F.least(F.lit(most), F.ceil(F.col("_rows") / ROWS_PER_KEY)).cast("int")
    lists = {"group": F.xxhash64(*by), "keys": keys, "totals": F.struct(*values)}
    return largest.agg(F.struct(*[F.collect_list(value).alias(name) for name, value in lists.items()]).alias("_hot"))


def share_of(
    df: DataFrame, measure: str, by: Sequence[str] = (), share: str = "share", total: str = "total",
    bounded: bool = False, source: DataFrame | None = None,
) -> DataFrame:
    """Part of the group or grand total; null when the total is zero."""
    return with_group_values(df, by, {total: F.sum(measure)}, bounded, source).withColumn(share, ratio(measure, total))


def ranks(
    df: DataFrame, measure: str, key: Sequence[str], by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """``row_number``, ``rank`` and ``dense_rank`` by descending measure, nulls last, ties in key order."""
    if not bounded:
        return ordered_scan(df, [(measure, "desc")], key, by).drop("group_rows")
    peers = Window.partitionBy(*by).orderBy(*total_order([(measure, "desc")]))
    rows = Window.partitionBy(*by).orderBy(*total_order([(measure, "desc"), *key]))
    return df.select(
        "*",
        F.row_number().over(rows).cast("bigint").alias("row_number"),
        F.rank().over(peers).cast("bigint").alias("rank"),
        F.dense_rank().over(peers).cast("bigint").alias("dense_rank"),
    )


def pareto(
    df: DataFrame, measure: str, key: Sequence[str], by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """``running``, ``total`` and ``cumulative_share`` by descending measure, one row at a time."""
    if bounded:
        rows = Window.partitionBy(*by).orderBy(*total_order([(measure, "desc"), *key]))
        scanned = df.select(
            "*",
            F.sum(measure).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running"),
            F.sum(measure).over(Window.partitionBy(*by)).alias("total"),
        )
    else:
        scanned = (
            ordered_scan(df, [(measure, "desc")], key, by, {"m": measure})
            .drop("row_number", "rank", "dense_rank", "group_rows")
            .withColumnsRenamed({"running_m": "running", "total_m": "total"})
        )
    return scanned.withColumn("cumulative_share", ratio("running", "total"))


def ranked_curve(df: DataFrame, measure: str, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All three ranks, share and cumulative share in one distributed scan."""
    return (
        ordered_scan(df, [(measure, "desc")], key, by, {"m": measure})
        .withColumn("share", ratio(measure, "total_m"))
        .withColumn("cumulative_share", ratio("running_m", "total_m"))
        .drop("group_rows", "running_m", "total_m")
    )


def running_total(
    df: DataFrame, measure: str, by: Sequence[str], order: Sequence[str], bounded: bool = False
) -> DataFrame:
    """Running sum within a group; ``order`` must make rows unique."""
    if bounded:
        window = Window.partitionBy(*by).orderBy(*total_order(order))
        return df.withColumn(
            "running", F.sum(measure).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        )
    *leading, last = order
    return (
        ordered_scan(df, leading or [last], [last], by, {"m": measure})
        .drop("row_number", "rank", "dense_rank", "group_rows", "total_m")
        .withColumnRenamed("running_m", "running")
    )


def rank_by_group_total(
    df: DataFrame, by: Sequence[str], sub: Sequence[str], measure: str, tie_break: Sequence[str],
    bounded: bool = False,
) -> DataFrame:
    """Row number within ``by``, rows of the larger sub-group total first."""
    totals = with_group_values(df, [*by, *sub], {"sub_total": F.sum(measure)}, bounded)
    return ranks(totals, "sub_total", tie_break, by, bounded).drop("rank", "dense_rank")


def top_n(df: DataFrame, measure: str, n: int, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows by descending measure, overall or per group.

    Both forms keep at most ``n`` rows per task (and group) before the shuffle.
    """
    order = total_order([(measure, "desc"), *key])
    if not by:
        return df.orderBy(*order).limit(n)
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_position", position).where(F.col("_position") <= n).drop("_position")


def top_flag(rank: str | Column, n: int) -> Column:
    """Label of the first ``n`` ranks against the rest."""
    return F.when(col(rank) <= n, f"Top {n}").otherwise("Other")


def group_stat(
    df: DataFrame, measure: str, by: Sequence[str], stat: str = "avg", name: str = "group_value",
    bounded: bool = False, source: DataFrame | None = None,
) -> DataFrame:
    """Mean, minimum, maximum, sum or count of the group beside each row."""
    if stat == "avg":
        # An exact sum over a count; Spark's decimal mean would be rounded early.
        parts = with_group_values(df, by, {"_sum": F.sum(measure), "_count": F.count(measure)}, bounded, source)
        return parts.withColumn(name, ratio("_sum", "_count")).drop("_sum", "_count")
    return with_group_values(df, by, {name: getattr(F, stat)(measure)}, bounded, source)
