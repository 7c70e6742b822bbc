"""Stock on hand, backorders, purchase orders, store maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, first_match, ratio, total_order, zero_if_null
from ..functions.ordered import ordered_scan
from .keys import snapshot_at_max
from .pricing import days_since
from .shaping import pivot_when
from .time import days_between, on_days
from .windows import group_stat

NO_DATE = date(2099, 12, 31)


def open_units(quantity: str | Column = "quantity_open") -> Column:
    """Open units, never negative; null stays null."""
    return F.when(col(quantity) < 0, F.lit(0)).otherwise(col(quantity))


def open_backorders(lines: DataFrame, as_of: date, first_day: date | None = None) -> DataFrame:
    """Earliest date, units, dollars and age in days of open backorders per product."""
    waiting = lines.where(
        (F.col("is_backorder") == 1) & (F.col("status") == "open") & F.col("product_analytics_id").isNotNull()
    )
    if first_day:
        waiting = waiting.where(F.col("date_ordered") >= F.lit(first_day))
    return (
        waiting.groupBy("product_analytics_id")
        .agg(
            F.min(F.to_date("date_ordered")).alias("earliest_backorder_date"),
            F.sum("merchandise").alias("open_backorder_dollars"),
            F.sum("quantity").alias("open_backorder_units"),
        )
        .withColumn("earliest_backorder_age_days", days_since("earliest_backorder_date", as_of))
    )


def on_hand(history: DataFrame, calendar: DataFrame, day: date, sites: Sequence[int]) -> DataFrame:
    """Units at each site on one day as columns ``on_hand_<site>``."""
    stock = history.where(F.col("location_analytics_id").isin(*sites) & on_days(days_between(calendar, day, day)))
    return pivot_when(
        stock,
        ["product_analytics_id"],
        {f"on_hand_{site}": (F.col("location_analytics_id") == site, "quantity_on_hand") for site in sites},
        empty=0,
    )


def next_arrivals(
    po: DataFrame, n: int = 3, scope: str = "any", site: int | None = None
) -> DataFrame:
    """First ``n`` open arrivals per product with their order and label.

    ``scope='any'`` numbers arrivals over all sites; ``'site'`` only those at
    ``site``. Tasks keep at most ``n`` rows per product before the shuffle.
    """
    waiting = po.where(
        (F.col("quantity_open") > 0) & F.col("product_analytics_id").isNotNull() & (F.col("is_closed") == 0)
    )
    if scope == "site":
        waiting = waiting.where(F.col("location_analytics_id") == site)
    window = Window.partitionBy("product_analytics_id").orderBy(
        *total_order(["current_arrival_date_analytics_id", "purchase_order_analytics_id", "po_line_number"])
    )
    position = F.col("arrival_order")
    label = first_match(
        [(position == 1, F.lit("Next PO")), (position == 2, F.lit("2nd Next PO")), (position == 3, F.lit("3rd Next PO"))],
        F.concat(position.cast("string"), F.lit("th Next PO")),
    )
    return (
        waiting.withColumn("arrival_order", F.row_number().over(window).cast("bigint"))
        .where(position <= n)
        .withColumn("arrival_label", label)
    )


def next_arrival_at(arrivals: DataFrame, site: int) -> DataFrame:
    """The first arrival of each product if it is at ``site``."""
    first = arrivals.where((F.col("arrival_order") == 1) & (F.col("location_analytics_id") == site))
    return first.select(
        "product_analytics_id",
        F.col("quantity_open").alias("next_po_units"),
        F.col("current_arrival_date").alias("next_po_eta"),
        F.col("purchase_order_analytics_id").alias("next_po_number"),
    )


def open_order_units(po: DataFrame, site: int) -> DataFrame:
    """Units on open orders for one site per product."""
    return (
        po.where(
            (F.col("is_closed") == 0)
            & (F.col("location_analytics_id") == site)
            & F.col("product_analytics_id").isNotNull()
        )
        .groupBy("product_analytics_id")
        .agg(F.sum(open_units()).alias("open_on_order_units"))
    )


def coverage(df: DataFrame, main_stock: str, all_stock: Sequence[str]) -> DataFrame:
    """Oversold units, coverage of backorders by stock and open orders, backorders to total stock."""
    backorder = zero_if_null("open_backorder_units")
    stock = zero_if_null(all_stock[0])
    for name in all_stock[1:]:
        stock = stock + zero_if_null(name)
    return (
        df.withColumn("oversold_units", F.greatest(backorder - zero_if_null("next_po_units"), F.lit(0)))
        .withColumn(
            "coverage_ratio", ratio(zero_if_null(main_stock) + zero_if_null("open_on_order_units"), backorder)
        )
        .withColumn("backorder_to_stock_ratio", ratio(backorder, stock))
    )


def po_lines(po: DataFrame, as_of: date) -> DataFrame:
    """Open purchase-order lines with defaults, extended costs and stale days."""
    quantity = open_units()
    return po.where(F.col("is_closed") == 0).select(
        "purchase_order_analytics_id", "po_line_number", "location_analytics_id", "product_analytics_id",
        "vendor_analytics_id", "sku",
        F.col("written_date").alias("po_written_date"),
        F.col("current_ship_date").alias("po_ship_date"),
        F.col("current_arrival_date").alias("po_arrival_date"),
        "current_arrival_date_analytics_id", "quantity_ordered", "quantity_received",
        F.coalesce("next_cost_effective_date", F.lit(NO_DATE)).alias("next_cost_effective_date"),
        F.coalesce("cancel_date", F.lit(NO_DATE)).alias("cancel_date"),
        F.coalesce("vendor_po_name", F.lit("not populated")).alias("vendor_po_name"),
        quantity.alias("quantity_open"),
        (quantity * F.col("landed_cost")).cast("decimal(28,4)").alias("open_landed_cost"),
        (quantity * F.col("vendor_cost")).cast("decimal(28,4)").alias("open_vendor_cost"),
        days_since("current_arrival_date", as_of).alias("stale_days"),
    )


# What identifies a purchase-order line across openings and receipts.
PO_LINE_KEYS = (
    "vendor_po_name", "purchase_order_analytics_id", "po_line_number", "next_cost_effective_date",
    "cancel_date", "location_analytics_id",
)


def open_vs_received(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """Open cost and units, ordered and received units per purchase-order line.

    A union of both sides and one group-by: received-only lines are kept, with
    null open measures.
    """
    opened = lines.select(
        *PO_LINE_KEYS,
        F.col("open_landed_cost"), F.col("open_vendor_cost"),
        F.col("quantity_open").alias("open_units"), F.col("quantity_ordered").alias("ordered_units"),
    )
    receipt = receipts.select(
        "location_analytics_id", "po_line_number", "purchase_order_analytics_id",
        F.col("received_date_analytics_id").alias("current_arrival_date_analytics_id"),
        F.col("recieved_quantity").alias("received_units"),
    )
    keys = ["location_analytics_id", "po_line_number", "purchase_order_analytics_id", "current_arrival_date_analytics_id"]
    known = lines.select(*dict.fromkeys([*keys, *PO_LINE_KEYS])).distinct()
    received = receipt.join(known, keys).select(*PO_LINE_KEYS, "received_units")
    measures = ["open_landed_cost", "open_vendor_cost", "open_units", "ordered_units", "received_units"]
    return (
        opened.unionByName(received, allowMissingColumns=True)
        .groupBy(*PO_LINE_KEYS)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def inventory_position(
    history: DataFrame, calendar: DataFrame, keys: Sequence[str], as_of: date, prior: date
) -> DataFrame:
    """Value now, in transit, a week ago and last year per key.

    Last year is the stock of the day that ``as_of`` points back to.
    """
    now, before = days_between(calendar, as_of, as_of), days_between(calendar, prior, prior)
    last_year = days_between(calendar, as_of, as_of, "last_year_date_analytics_id")
    return pivot_when(
        history.where(on_days(now) | on_days(before) | on_days(last_year)),
        keys,
        {
            "current_available": (on_days(now), "available_fair_market_value"),
            "current_in_transit": (on_days(now), "in_transit_fair_market_value"),
            "prior_available": (on_days(before), "available_fair_market_value"),
            "last_year_available": (on_days(last_year), "available_fair_market_value"),
        },
    )


def selling_stores(sales: DataFrame, day: str = "date_analytics_id", store: str = "attribution_location_analytics_id") -> DataFrame:
    """Per store and day, 1 when the day's sales are positive, else 0."""
    return sales.groupBy(day, store).agg(F.sum("merchandise").alias("sales")).select(
        day, store, F.when(F.col("sales") > 0, 1).otherwise(0).cast("bigint").alias("is_selling")
    )


def active_stores(
    sales: DataFrame, locations: DataFrame, days: Sequence[int], name: str = "store_count",
    store: str = "attribution_location_analytics_id",
) -> DataFrame:
    """Stores with positive sales per channel, on the channel's last day within ``days``."""
    site = locations.select(F.col("location_analytics_id").alias(store), F.col("channel_analytics_id").alias("channel"))
    per_day = (
        selling_stores(sales.where(on_days(days)), store=store)
        .join(site, store)
        .groupBy("channel", "date_analytics_id")
        .agg(F.sum("is_selling").alias(name))
    )
    return snapshot_at_max(per_day, ["channel"], "date_analytics_id")


def changes(df: DataFrame, now: str, then: str, name: str) -> DataFrame:
    """Difference and percent change; the percent is null when the base is null or zero."""
    difference = F.col(now) - F.col(then)
    return df.withColumn(f"{name}_change", difference).withColumn(f"{name}_change_pct", ratio(difference, then))


def stale_days(lines: DataFrame) -> DataFrame:
    """Mean stale days per product and recency position within the vendor, beside each line.

    Means are aggregated and joined back; positions come from a distributed
    scan, so one vendor may hold any part of the lines.
    """
    placed = ordered_scan(
        lines, [("po_written_date", "desc")], ["purchase_order_analytics_id", "po_line_number"], ["vendor_analytics_id"]
    ).drop("rank", "dense_rank", "group_rows").withColumnRenamed("row_number", "vendor_recency")
    return group_stat(placed, "stale_days", ["product_analytics_id"], "avg", "avg_stale_days", source=lines)


def region_map(
    locations: DataFrame, regions: Mapping[str, tuple[Sequence[str], str, int]],
    districts: Mapping[str, tuple[str, int]], warehouse: tuple[str, int, str, int], other: tuple[str, int, str, int],
    flag_stores: Sequence[int] = (),
) -> DataFrame:
    """Region, district, their sort order and the flag-store mark per location.

    ``regions`` maps a region to its district codes, manager and order;
    ``districts`` maps a code to a name and order. Warehouses and unknown
    districts get the ``warehouse`` and ``other`` rows (region, order, district,
    order).
    """
    code = F.col("district_code")
    is_warehouse = F.col("channel_code") == "warehouse"
    in_region = [(code.isin(*codes), name, manager, order) for name, (codes, manager, order) in regions.items()]
    in_district = [(code == c, name, order) for c, (name, order) in districts.items()]
    return locations.select(
        "location_analytics_id",
        F.col("name").alias("store_name"),
        first_match([(c, F.lit(n)) for c, n, _, _ in in_region] + [(is_warehouse, F.lit(warehouse[0]))], F.lit(other[0])).alias("region"),
        first_match([(c, F.lit(m)) for c, _, m, _ in in_region] + [(is_warehouse, F.lit(warehouse[0]))], F.lit(other[0])).alias("region_manager"),
        first_match([(c, F.lit(o)) for c, _, _, o in in_region] + [(is_warehouse, F.lit(warehouse[1]))], F.lit(other[1])).cast("bigint").alias("region_order"),
        F.coalesce(code, F.lit("No Code")).alias("district_code"),
        first_match([(c, F.lit(n)) for c, n, _ in in_district] + [(is_warehouse, F.lit(warehouse[2]))], F.lit(other[2])).alias("district_name"),
        first_match([(c, F.lit(o)) for c, _, o in in_district] + [(is_warehouse, F.lit(warehouse[3]))], F.lit(other[3])).cast("bigint").alias("district_order"),
        F.when(F.col("location_analytics_id").isin(*flag_stores), "Y").otherwise("N").alias("is_flag_store")
        if flag_stores
        else F.lit("N").alias("is_flag_store"),
    )
