"""Reports in order: sorted, numbered files whose concatenation is the order of the report.

Rows are cut into ranges of the sort order and each range is sorted by itself, so no task sees the whole report. Rows
that agree in the sort columns are spread by a hash, so a value that most rows share does not fill one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col

#: A column, an expression, or either with its direction.
Order = str | Column | tuple[str | Column, str]


def rank_of(column: str, *values: object) -> Column:
    """Sort key of a fixed sequence of values; others come after them."""
    key = F.lit(len(values))
    for i, value in reversed(list(enumerate(values))):
        key = F.when(F.col(column) == value, i).otherwise(key)
    return key


def write_ordered(
    df: DataFrame, path: str, order: Sequence[Order], files: int | None = None, format: str = "parquet",
    mode: str = "errorifexists", **options: str,
) -> None:
    """Write ``df`` under ``path`` so that its files, by number, hold the rows in ``order``.

    Nulls come last in either direction. Rows that agree in ``order`` are ordered by a hash of all their columns.
    ``files`` is the number of ranges; by default adaptive execution sizes them.
    """
    taken = {c.lower() for c in df.columns}
    names, keys = [], []
    for item in order:
        value, direction = item if isinstance(item, tuple) else (item, "asc")
        name = f"_order_{len(names)}"
        while name in taken:
            name = "_" + name
        names.append((name, col(value)))
        keys.append(F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_last())
    plain = [f"`{c}`" for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    names += [("_order_hash", F.xxhash64(*plain)), ("_order_spread", F.monotonically_increasing_id())]
    keys += [F.col("_order_hash"), F.col("_order_spread")]
    keyed = df.select("*", *[value.alias(name) for name, value in names])
    placed = keyed.repartitionByRange(files, *keys) if files else keyed.repartitionByRange(*keys)
    placed = placed.sortWithinPartitions(*keys).drop(*[name for name, _ in names])
    placed.write.format(format).options(**options).mode(mode).save(path)


def in_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an ordered Parquet report, with ``position`` from 1 on.

    The driver holds one number per file.
    """
    rows = spark.read.parquet(path)
    columns = rows.columns
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("int")
    named = rows.select(*[f"`{c}`" for c in columns], number(r"^part-(\d+)").alias("_part"), number(r"-c(\d+)").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = sorted(tuple(r) for r in named.groupBy("_part", "_file").count().collect())
    before, offsets = 0, []
    for part, file, count in sizes:
        offsets += [F.lit(f"{part}-{file}"), F.lit(before)]
        before += count
    if not offsets:
        return rows.withColumn("position", F.lit(None).cast("bigint"))
    start = F.element_at(F.create_map(*offsets), F.concat_ws("-", "_part", "_file"))
    return named.withColumn("position", (start + F.col("_row") + 1).cast("bigint")).drop("_part", "_file", "_row")
