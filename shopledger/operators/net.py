"""Net sales: deliveries minus returns, with cost adjustments and plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, money, zero_if_null
from ..functions.joins import spread_null_left_join

# Web warehouse, web location, channels whose returns go to the web
# location, and the departments all net-sales reports are limited to.
WAREHOUSE = 904
WEB_LOCATION = 2
WEB_CHANNELS = (
    "amazon_pickup", "amazon_delivery", "slt_bopis", "walmart_go_local",
    "web", "customer_service", "amazon_marketplace", "culinary_orders",
)
DEPARTMENTS = (
    500004, 500005, 250003, 3, 500006, 250004, 500007, 250005, 500008, 500010, 6, 250007, 500012, 8,
)


def remap_return_location(
    location: str | Column, channel: str | Column, warehouse: int = WAREHOUSE, target: int = WEB_LOCATION,
    channels: Sequence[str] | None = WEB_CHANNELS,
) -> Column:
    """Where a return counts: warehouse returns of web channels go to the web location.

    With ``channels=None`` every channel but the store's own ('pos') is remapped.
    A null channel never is.
    """
    listed = col(channel).isin(*channels) if channels is not None else col(channel) != "pos"
    return F.when((col(location) == warehouse) & listed, target).otherwise(col(location)).cast("bigint")


def channel_lookup(
    headers: DataFrame, lines: DataFrame, wanted: DataFrame, source: str = "oroms"
) -> DataFrame:
    """Largest channel per online order and product; unique on both.

    Only the orders in ``wanted`` are looked at, so the returns of a week do
    not make all lines ever sold go through a shuffle.
    """
    online = headers.where(F.col("source") == source).select("order_analytics_id")
    return (
        lines.where(F.col("source") == source)
        .join(wanted, "order_analytics_id", "left_semi")
        .groupBy("order_analytics_id", "product_analytics_id")
        .agg(F.max("sales_channel").alias("original_channel"))
        .join(online, "order_analytics_id", "left_semi")
    )


def original_orders(returns: DataFrame) -> DataFrame:
    """The orders that returns name as their original ones, each once; what ``channel_lookup`` wants."""
    return (
        returns.where(F.col("original_order_analytics_id").isNotNull())
        .select(F.col("original_order_analytics_id").alias("order_analytics_id"))
        .distinct()
    )


def original_channel(
    returns: DataFrame, headers: DataFrame, lines: DataFrame, source: str = "oroms",
    originals: DataFrame | None = None, lookup: DataFrame | None = None, spread_by: Sequence[str] = ("order_line_analytics_id",),
) -> DataFrame:
    """Add the channel of the original online order to each return, null when there is none.

    Most returns name no original order; those rows are spread over all tasks, by ``spread_by``.
    ``originals`` may give a cheaper read of the original order ids than
    ``returns`` itself, and ``lookup`` a ``channel_lookup`` that was made before.
    """
    if lookup is None:
        lookup = channel_lookup(headers, lines, original_orders(returns if originals is None else originals), source)
    lookup = lookup.withColumnRenamed("order_analytics_id", "original_order_analytics_id")
    return spread_null_left_join(
        returns, lookup, ["original_order_analytics_id", "product_analytics_id"],
        spread_by=spread_by,
    )


def attributed_returns(
    returns: DataFrame, lines: DataFrame, headers: DataFrame,
    channels: Sequence[str] | None = WEB_CHANNELS, warehouse: int = WAREHOUSE, target: int = WEB_LOCATION,
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Returns with the location and channel they count for, in one pass over both order systems.

    Online lines keep their channel and may move to the web location; store
    lines keep their location and take the channel of the original online order,
    from ``lookup`` where a ``channel_lookup`` was made before.
    """
    line = lines.select(
        "order_line_analytics_id",
        F.col("order_analytics_id").alias("line_order_analytics_id"),
        F.col("source").alias("line_source"),
        F.col("sales_channel").alias("line_channel"),
        "unit_last_cost",
    ).where(F.col("line_source").isin("oroms", "xcenter"))
    in_store = F.col("line_source") == "xcenter"
    place = F.when(in_store, F.col("location_analytics_id")).otherwise(
        remap_return_location("location_analytics_id", "line_channel", warehouse, target, channels)
    )
    kept = [c for c in returns.columns if c not in ("location_analytics_id", "original_order_analytics_id")]
    # Only what the later joins need goes through them; the line id, a long text, as its hash.
    found = returns.join(line, "order_line_analytics_id").select(
        *kept, "line_order_analytics_id", place.cast("bigint").alias("attribution_location_analytics_id"),
        F.when(~in_store, F.col("line_channel")).alias("line_channel"),
        F.when(in_store, F.col("original_order_analytics_id")).alias("original_order_analytics_id"),
        F.xxhash64("order_line_analytics_id").alias("_spread"), "unit_last_cost",
    )
    # An inner join to distinct ids: a semi-join would be moved below the join before it, and shuffle all lines once more.
    known = headers.select(F.col("order_analytics_id").alias("line_order_analytics_id")).distinct()
    joined = found.join(known, "line_order_analytics_id")
    return original_channel(joined, headers, lines, originals=returns, lookup=lookup, spread_by=["_spread"]).select(
        *kept, "attribution_location_analytics_id",
        F.coalesce("line_channel", "original_channel", F.lit("pos")).alias("sales_channel"),
        "unit_last_cost",
    )


def attributed_sales(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """Deliveries with the location and channel of their order line; 'pos' when unknown."""
    line = lines.select(
        "order_line_analytics_id", "attribution_location_analytics_id", "sales_channel", "unit_last_cost"
    )
    return sales.join(line, "order_line_analytics_id", "left").withColumn(
        "sales_channel", F.coalesce("sales_channel", F.lit("pos"))
    )


def margins(df: DataFrame) -> DataFrame:
    """Landed margin (dollars less fair value) and vendor margin (dollars less units at last cost)."""
    vendor_cost = money(F.col("quantity") * F.col("unit_last_cost"))
    return (
        df.withColumn("landed_cost", zero_if_null("fair_market_value"))
        .withColumn("landed_margin", F.col("merchandise") - zero_if_null("fair_market_value"))
        .withColumn("vendor_cost", vendor_cost)
        .withColumn("vendor_margin", F.col("merchandise") - vendor_cost)
    )


def net_of(
    sales: DataFrame, returns: DataFrame, keys: Sequence[str], measures: Mapping[str, str | Column]
) -> DataFrame:
    """Sales, returns and net per key as one signed union and one group-by.

    Rows present on either side are kept and a missing side is zero. Null keys
    group together. Columns: ``sales_<m>``, ``return_<m>``, ``net_<m>``.
    """
    sold = sales.select(*keys, *[col(e).alias(f"_s_{m}") for m, e in measures.items()])
    returned = returns.select(*keys, *[col(e).alias(f"_r_{m}") for m, e in measures.items()])
    both = sold.unionByName(returned, allowMissingColumns=True)
    totals = []
    for m in measures:
        sold_sum, returned_sum = zero_if_null(F.sum(f"_s_{m}")), zero_if_null(F.sum(f"_r_{m}"))
        totals += [
            sold_sum.alias(f"sales_{m}"), returned_sum.alias(f"return_{m}"), (sold_sum - returned_sum).alias(f"net_{m}"),
        ]
    return both.groupBy(*keys).agg(*totals)


def net_with_cost_adjustment(
    sales: DataFrame, returns: DataFrame, adjustments: DataFrame, keys: Sequence[str],
    measures: Mapping[str, str | Column], dollars: str, adjustment: str = "cosa",
) -> DataFrame:
    """Net sales with the cost-allocation table; adjustment-only keys are kept.

    ``adjusted_margin`` is net ``dollars`` minus the adjustment and
    ``movements`` the number of sales and return rows behind a key.
    """
    signed = [
        sales.select(*keys, *[col(e).alias(m) for m, e in measures.items()]),
        returns.select(*keys, *[(-col(e)).alias(m) for m, e in measures.items()]),
        adjustments.where(F.col(adjustment) != 0).select(*keys, F.col(adjustment).alias("_adjustment")),
    ]
    both = signed[0].unionByName(signed[1]).unionByName(signed[2], allowMissingColumns=True)
    net = {m: zero_if_null(F.sum(m)) for m in measures}
    cost = zero_if_null(F.sum("_adjustment"))
    return both.groupBy(*keys).agg(
        *[value.alias(f"net_{m}") for m, value in net.items()],
        cost.alias("cost_adjustment"),
        (net[dollars] - cost).alias("adjusted_margin"),
        F.count(dollars).alias("movements"),
    )


def net_with_forecast(
    sales: DataFrame, returns: DataFrame, plan: DataFrame, keys: Sequence[str], plan_measures: Sequence[str]
) -> DataFrame:
    """Actual net dollars, units and orders beside the plan; plan-only keys are kept.

    Orders are distinct sales orders plus distinct return orders.
    """
    actual = []
    for df, sign in ((sales, 1), (returns, -1)):
        actual.append(
            df.groupBy(*keys).agg(
                (F.sum("merchandise") * sign).alias("net_dollars"),
                (F.sum("quantity") * sign).alias("net_units"),
                F.countDistinct("order_analytics_id").alias("orders"),
            )
        )
    both = actual[0].unionByName(actual[1]).unionByName(plan.select(*keys, *plan_measures), allowMissingColumns=True)
    return both.groupBy(*keys).agg(
        *[zero_if_null(F.sum(m)).alias(m) for m in ("net_dollars", "net_units", "orders", *plan_measures)]
    )
