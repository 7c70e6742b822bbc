"""Total rows, pivots, dense grids and wide merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, zero_if_null


def with_total(
    df: DataFrame, keys: Sequence[str], totalled: str, label: str, aggregates: Sequence[Column]
) -> DataFrame:
    """Detail rows per key plus rows with ``totalled`` rolled up under ``label``.

    The total is told apart by ``grouping``, so a null key keeps its own row.
    """
    detail = [F.col(k) for k in keys]
    rest = [F.col(k) for k in keys if k != totalled]
    grouped = df.groupingSets([detail, rest], *detail).agg(F.grouping(totalled).alias("_is_total"), *aggregates)
    name = F.when(F.col("_is_total") == 1, label).otherwise(F.col(totalled))
    return grouped.withColumn(totalled, name).withColumn("is_total", F.col("_is_total") == 1).drop("_is_total")


def pivot_when(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple[Column, str | Column]], empty: object = None
) -> DataFrame:
    """Conditional sums as columns, all in one pass; ``empty`` fills sums without a row."""
    sums = []
    for name, (condition, measure) in columns.items():
        total = F.sum(F.when(condition, col(measure)))
        sums.append((total if empty is None else F.coalesce(total, F.lit(empty))).alias(name))
    return df.groupBy(*keys).agg(*sums)


def dense_grid(
    facts: DataFrame, keys: Sequence[str], dimension: str, values: DataFrame, measures: Sequence[str],
    only: str | None = None,
) -> DataFrame:
    """Every key with every value of a dimension; missing combinations are zero.

    ``in_grid`` is 1 where the value is in the dimension and null for facts
    outside it, which are kept. The distinct keys meet the values by chunk
    numbers, as many as there are shuffle partitions, so the grid is spread
    evenly whatever the length of the dimension; its cells go into one union
    and one group-by with the facts. With ``only``, keys that have no row where
    that column is true get no grid.
    """
    chunks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_scope = facts.where(F.col(only)) if only else facts
    every = F.sequence(F.lit(0), F.lit(chunks - 1))
    scope = in_scope.select(*keys).distinct().select(*keys, F.explode(every).alias("_chunk"))
    wanted = values.select(dimension).where(F.col(dimension).isNotNull()).distinct()
    wanted = wanted.withColumn("_chunk", F.pmod(F.xxhash64(dimension), F.lit(chunks)).cast("int"))
    cells = scope.join(wanted, "_chunk").select(
        *keys, dimension, *[F.lit(None).cast(facts.schema[m].dataType).alias(m) for m in measures],
        F.lit(1).cast("bigint").alias("in_grid"),
    )
    union = facts.select(*keys, dimension, *measures, F.lit(None).cast("bigint").alias("in_grid")).unionByName(cells)
    return union.groupBy(*keys, dimension).agg(
        *[zero_if_null(F.sum(m)).alias(m) for m in measures], F.max("in_grid").alias("in_grid")
    )


def basket_lines(sales: DataFrame, lines: DataFrame, locations: DataFrame) -> DataFrame:
    """Written sales with the channel of the store each line is attributed to."""
    line = lines.select("order_line_analytics_id", "attribution_location_analytics_id")
    site = locations.select(
        F.col("location_analytics_id").alias("attribution_location_analytics_id"),
        F.col("channel_analytics_id").alias("channel"),
    )
    return sales.join(line, "order_line_analytics_id", "left").join(site, "attribution_location_analytics_id", "left")


def basket(lines: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Order by product by channel: sales and units, beside the order's totals and agent-order count."""
    cells = lines.groupBy("order_analytics_id", "product_analytics_id", "channel").agg(
        F.sum("merchandise").alias("sales"), F.sum("quantity").alias("units")
    )
    orders = lines.groupBy("order_analytics_id").agg(
        F.sum("merchandise").alias("order_sales"), F.sum("quantity").alias("order_units")
    )
    result = cells.join(orders, "order_analytics_id")
    if agents is not None:
        result = result.join(agent_orders(agents, lines), "order_analytics_id", "left").withColumn(
            "agent_orders", zero_if_null("agent_orders")
        )
    return result


def agent_orders(agents: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct agent-attributed orders per order of ``lines``."""
    keys = lines.select("order_line_analytics_id", "order_analytics_id")
    return (
        agents.select("order_line_analytics_id", F.col("order_analytics_id").alias("_agent_order"))
        .join(keys, "order_line_analytics_id")
        .groupBy("order_analytics_id")
        .agg(F.countDistinct("_agent_order").alias("agent_orders"))
    )


def all_keys(keys: Sequence[str], *dfs: DataFrame) -> DataFrame:
    """Distinct union of the keys of several results."""
    union = dfs[0].select(*keys)
    for df in dfs[1:]:
        union = union.unionByName(df.select(*keys))
    return union.distinct()


def merge_wide(keys: Sequence[str], *dfs: DataFrame) -> DataFrame:
    """Several results with one row per key as one wide row per key; a key twice in an input is an error.

    A union and one group-by: keys present in any input are kept, null keys
    match each other, and the shuffle happens once instead of once per input.
    """
    measures = {c: i for i, df in enumerate(dfs) for c in df.columns if c not in keys}
    union = dfs[0].withColumn("_input", F.lit(0))
    for i, df in enumerate(dfs[1:], 1):
        union = union.unionByName(df.withColumn("_input", F.lit(i)), allowMissingColumns=True)
    twice = lambda i: F.count_if(F.col("_input") == i) > 1
    refuse = F.raise_error(F.lit("an input of a wide merge has a key twice"))
    return union.groupBy(*keys).agg(*[F.when(twice(i), refuse).otherwise(F.max(m)).alias(m) for m, i in measures.items()])
