"""Ranks and running sums over data of any size.

A window without a partition, or with one very large partition, runs in one
task. Here the rows are cut into ranges of the sort order, so a large group
spans as many ranges as it needs; each range computes its own ranks and running
sums, and a small table of per-range totals supplies what came before. The
bounds of the ranges come from the rows with the smallest hashes, so every use
of them agrees, and nothing runs or is written before the result is asked for.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .columns import col, order_names, total_order


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode without a setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="shopledger-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: Copies made inside each open ``copies_deleted_after``, innermost last.
_OWNERS: list[list[str]] = []


@contextmanager
def copies_deleted_after(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that are written inside the block when it ends.

    For a report that is built and written inside it; results that still read the copies must not leave the block.
    """
    _OWNERS.append([])
    try:
        yield
    finally:
        for path in _OWNERS.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_deleted_after_each(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of every query that is run inside the block as soon as it ends.

    Else they stay until the driver happens to collect its garbage. For reports that run in parts, each of them written.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def in_part(name: str, part: int, parts: int) -> Column:
    """Whether a row lies in one of ``parts`` parts of the values of a column, 0 to ``parts - 1``; null lies in one, too."""
    return F.pmod(F.xxhash64(name), F.lit(parts)) == part


def new_copy(spark: SparkSession) -> str:
    """The path of a new intermediate table in the shared folder."""
    path = f"{shared_folder(spark)}/shopledger-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from there.

    Unlike a checkpoint of rows, the copy is columnar: later steps read only the
    columns they need, and the planner knows its size. Two results can share it.
    ``compression`` is the session's by default.
    """
    spark = df.sparkSession
    path = new_copy(spark)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def _at_or_after(bound: Column, order: Sequence[str | tuple[str, str]]) -> Column:
    """Whether the row lies at or after ``bound``, a struct of the sort columns; nulls come last."""
    result = F.lit(True)
    for item in reversed(order):
        name, direction = (item, "asc") if isinstance(item, str) else item
        mine, other = F.col(name), bound[name]
        after = mine < other if direction == "desc" else mine > other
        after = F.coalesce(after, mine.isNull() & other.isNotNull())
        result = after | (mine.eqNullSafe(other) & result)
    return bound.isNotNull() & result


def with_range(df: DataFrame, order: Sequence[str | tuple[str, str]], ranges: int, name: str = "_bucket", sample: int = 16) -> DataFrame:
    """Add the number of the range of the sort order in which each row lies, 0 to ``ranges - 1``.

    The bounds are every ``sample``-th of the sorted ``sample * ranges`` rows with the smallest hashes of their sort
    columns: a bounded number, found in one pass, and the same whenever it is repeated.
    """
    keys = list(dict.fromkeys(order_names(order)))
    few = df.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(sample * ranges)
    place = F.row_number().over(Window.orderBy(*total_order(order)))
    every = few.withColumn("_place", place).where((F.col("_place") % sample == 0) & (F.col("_place") < sample * ranges))
    bounds = every.agg(F.sort_array(F.collect_list(F.struct("_place", F.struct(*keys).alias("key")))).alias("bounds"))
    steps = [1 << i for i in reversed(range(max(1, ranges.bit_length())))]

    def halve(at: Column, step: Column) -> Column:
        return F.when(_at_or_after(F.get("_bounds", at + step - 1)["key"], order), at + step).otherwise(at)

    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)
    return df.withColumn("_bounds", bounds.scalar()).withColumn(name, found).drop("_bounds")


def _same_as_previous_end(columns: Sequence[str], window) -> Column:
    same = F.lit(True)
    for name in columns:
        same = same & F.col(f"_first_{name}").eqNullSafe(F.lag(f"_last_{name}").over(window))
    return same


def ordered_scan(
    df: DataFrame,
    order: Sequence[str | tuple[str, str]],
    tie_break: Sequence[str],
    by: Sequence[str] = (),
    sums: Mapping[str, str | Column] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add positions and running sums per group without one task per group.

    Adds ``row_number``, ``rank``, ``dense_rank``, ``group_rows`` and, for each
    entry ``name: measure`` of ``sums``, ``running_<name>`` (rows up to and
    including this one) and ``total_<name>`` (whole group). ``rank`` and
    ``dense_rank`` follow ``order`` alone; ``tie_break`` must make rows unique
    and decides the row order. Null measures count as zero. ``buckets`` defaults
    to the session's number of shuffle partitions.
    """
    by, sums = list(by), dict(sums or {})
    ties = order_names(order)
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, measure in sums.items():
        df = df.withColumn(f"_m_{name}", F.coalesce(col(measure), F.lit(0)))
    placed = with_range(df, [*by, *order, *tie_break], buckets)

    rows = Window.partitionBy(*by, "_bucket").orderBy(*total_order(order), *total_order(tie_break))
    peers = Window.partitionBy(*by, "_bucket").orderBy(*total_order(order))
    running = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select(
        "*",
        F.row_number().over(rows).cast("bigint").alias("_row"),
        F.rank().over(peers).cast("bigint").alias("_rank"),
        F.dense_rank().over(peers).cast("bigint").alias("_dense"),
        *[F.sum(f"_m_{name}").over(running).alias(f"_run_{name}") for name in sums],
    )

    # One row per group and bucket. A group has at most one row per bucket, so
    # the windows below see no more rows per group than there are buckets.
    key = F.struct(*[F.col(name) for name in dict.fromkeys([*ties, *tie_break])])
    ends = F.struct(F.col("_row").alias("at"), key.alias("key"), F.col("_rank").alias("rank"), F.col("_dense").alias("dense"))
    summary = local.groupBy(*by, "_bucket").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(ends).alias("_head"),
        F.max(ends).alias("_tail"),
        *[F.sum(f"_m_{name}").alias(f"_sum_{name}") for name in sums],
    )
    for name in ties:
        summary = summary.withColumn(f"_first_{name}", F.col(f"_head.key.{name}"))
        summary = summary.withColumn(f"_last_{name}", F.col(f"_tail.key.{name}"))
    in_order = Window.partitionBy(*by).orderBy("_bucket")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    # A bucket continues a tie when its first value is the last one of the bucket before.
    summary = summary.withColumn(
        "_continues", _same_as_previous_end(ties, in_order) & F.lag("_rows").over(in_order).isNotNull()
    )
    summary = summary.select(
        "*",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        (
            F.coalesce(F.sum("_tail.dense").over(before), F.lit(0))
            - F.sum(F.col("_continues").cast("bigint")).over(in_order)
        ).alias("_dense_before"),
        F.sum("_rows").over(whole).alias("group_rows"),
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums],
        *[F.sum(f"_sum_{name}").over(whole).alias(f"total_{name}") for name in sums],
    )
    # Rank of the last tie, unless that tie began in an earlier bucket.
    tail_rank = F.when(
        ~(F.col("_continues") & (F.col("_tail.dense") == 1)), F.col("_rows_before") + F.col("_tail.rank")
    )
    summary = summary.withColumn("_tail_rank", tail_rank).withColumn(
        "_carried_rank", F.last("_tail_rank", ignorenulls=True).over(before)
    )
    offsets = summary.select(
        *by, "_bucket", "_rows_before", "_dense_before", "_continues", "_carried_rank", "group_rows",
        *[f"_before_{name}" for name in sums], *[f"total_{name}" for name in sums],
    )
    same_bucket = F.col("l._bucket") == F.col("o._bucket")
    for name in by:
        same_bucket = same_bucket & F.col(f"l.{name}").eqNullSafe(F.col(f"o.{name}"))
    joined = local.alias("l").join(offsets.alias("o"), same_bucket)
    kept = [c for c in df.columns if not c.startswith("_m_")]
    return joined.select(
        *[F.col(f"l.{c}") for c in kept],
        (F.col("_rows_before") + F.col("_row")).alias("row_number"),
        F.when(F.col("_continues") & (F.col("_rank") == 1), F.col("_carried_rank"))
        .otherwise(F.col("_rows_before") + F.col("_rank"))
        .alias("rank"),
        (F.col("_dense_before") + F.col("_dense")).alias("dense_rank"),
        F.col("group_rows"),
        *[(F.col(f"_before_{name}") + F.col(f"_run_{name}")).alias(f"running_{name}") for name in sums],
        *[F.col(f"total_{name}") for name in sums],
    )
