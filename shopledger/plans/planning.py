"""Planning reports: market basket, backorders, purchase orders, dashboard, sales and inventory."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ratio, zero_if_null
from ..functions.ordered import cut_lineage, ordered_scan
from ..operators import inventory, net, pricing, shaping, time, windows
from ..sources.catalog import RetailTables


def departments_named(t: RetailTables) -> DataFrame:
    return pricing.department_dim(t["merchandising_taxonomies"]).select(
        "level_3_analytics_id", F.col("department_name").alias("level_3_name"), F.col("department_code").alias("taxonomy_code")
    )


def market_basket(t: RetailTables, first: date, last: date) -> DataFrame:
    """Orders of a date range by product and every channel, with product totals, shares and ranks.

    An order placed in the range brings all its lines; only products sold in
    the range get the full list of channels.
    """
    in_range = time.on_days(time.days_between(t["calendar"], first, last))
    orders = t["written_sales"].where(in_range).select("order_analytics_id").distinct()
    written = (
        t["written_sales"].join(orders, "order_analytics_id", "left_semi")
        .withColumn("_in_range", F.coalesce(in_range, F.lit(False)))
    )
    cells = shaping.basket_lines(written, t["sales_line"], t["locations"])
    channels = t["channels"].select(F.col("channel_analytics_id").alias("channel"), "channel_code")
    # Written once, then read for the channel totals and for the rows.
    grid = cut_lineage(
        shaping.dense_grid(
            cells, ["order_analytics_id", "product_analytics_id"], "channel", channels, ["merchandise", "quantity"], only="_in_range"
        ).join(channels, "channel")
    )
    totals = windows.with_group_values(grid, ["product_analytics_id", "channel"], {"_channel_total": F.sum("merchandise")})
    ranked = ordered_scan(
        totals, [("_channel_total", "desc")], ["channel_code", "order_analytics_id"], ["product_analytics_id"], {"sku": "merchandise"}
    )
    agents = shaping.agent_orders(
        t["store_agents"], t["sales_line"].join(orders, "order_analytics_id", "left_semi")
    )
    shared = (
        ranked.join(t["product_to_merchandising_taxonomy"].select("product_analytics_id", "level_3_analytics_id"), "product_analytics_id")
        .join(departments_named(t), "level_3_analytics_id")
        .join(t["products"].select("product_analytics_id", "product_name"), "product_analytics_id")
        .join(t["sales_header"].select("order_analytics_id", "order_number"), "order_analytics_id", "left")
        .join(agents, "order_analytics_id", "left")
        .withColumn("agent_orders", zero_if_null("agent_orders"))
        .withColumn("channel_sales_share_for_sku", ratio("merchandise", "total_sku"))
    )
    return shared.select(
        "channel", "channel_code", F.col("order_analytics_id").alias("original_order_analytics_id"),
        F.col("order_number").alias("original_order_number"), "level_3_analytics_id", "level_3_name", "taxonomy_code",
        "product_analytics_id", "product_name", F.col("merchandise").alias("written_gross_sales"),
        F.col("quantity").alias("written_gross_units"), F.col("agent_orders").alias("primary_product_identifier"),
        F.col("in_grid").alias("order_presence_flag"), F.col("total_sku").alias("total_sales_per_sku"), "channel_sales_share_for_sku",
        F.col("row_number").alias("sku_channel_rank_within_sku"),
    )


def open_backorders(
    t: RetailTables, as_of: date, first_order_day: date, first_reported_day: date, main_site: int = 904,
    sites: Sequence[int] = (904, 903, 2), scope: str = "any",
) -> DataFrame:
    """Backorders, stock, open orders and prices per product, with department share and rank."""
    arrivals = inventory.next_arrival_at(inventory.next_arrivals(t["po_details"], 1, scope, main_site), main_site)
    vendors = t["vendors"].select("vendor_analytics_id", "vendor_name")
    departments = t["product_to_merchandising_taxonomy"].select("product_analytics_id", "level_3_analytics_id")
    # One narrow row per product: it is ranked first, so the wide rows never move for it.
    # A department may hold most products: position and total come from one distributed scan.
    backorders = cut_lineage(
        t["products"].select("product_analytics_id")
        .join(departments, "product_analytics_id")
        .join(departments_named(t).select("level_3_analytics_id"), "level_3_analytics_id", "left_semi")
        .join(inventory.open_backorders(t["sales_line"], as_of, first_order_day), "product_analytics_id", "left")
    )
    ranked = ordered_scan(
        backorders.select(
            "product_analytics_id", "level_3_analytics_id",
            zero_if_null("open_backorder_dollars").alias("_dollars"), zero_if_null("open_backorder_units").alias("_units"),
        ),
        [("_dollars", "desc"), ("_units", "desc")], ["product_analytics_id"], ["level_3_analytics_id"], {"units": "_units"},
    ).select(
        "product_analytics_id", F.col("row_number").alias("bo_rank_in_dept"), F.col("total_units").alias("total_bo_units_in_dept"),
        ratio("_units", "total_units").alias("bo_unit_share_in_dept"),
    )
    reported = backorders.where(
        F.col("earliest_backorder_date").isNull() | (F.col("earliest_backorder_date") >= F.lit(first_reported_day))
    )
    wide = (
        t["products"].select("product_analytics_id", "product_name", "vendor_analytics_id")
        .join(vendors, "vendor_analytics_id", "left")
        .withColumn("vendor_analytics_id", zero_if_null("vendor_analytics_id"))
        .withColumn("vendor_name", F.coalesce("vendor_name", F.lit("Blank")))
        .join(reported, "product_analytics_id")
        .join(departments_named(t), "level_3_analytics_id")
        .join(inventory.on_hand(t["product_history"], t["calendar"], as_of, sites), "product_analytics_id", "left")
        .join(inventory.open_order_units(t["po_details"], main_site), "product_analytics_id", "left")
        .join(arrivals, "product_analytics_id", "left")
        .join(pricing.price_info(t["products"], t["product_price_history"], as_of), "product_analytics_id", "left")
        .join(ranked, "product_analytics_id")
    )
    return inventory.coverage(wide, f"on_hand_{main_site}", [f"on_hand_{site}" for site in sites]).withColumnRenamed(
        "current_retail_price", "file_retail_price"
    ).drop("earliest_backorder_age_days")


def open_purchase_orders(t: RetailTables, as_of: date, departments: Sequence[int] = net.DEPARTMENTS) -> DataFrame:
    """Open purchase-order lines with costs, receipts and dimensions, vendor totals and recency."""
    products = t["product_to_merchandising_taxonomy"].where(F.col("level_3_analytics_id").isin(*departments)).select(
        "product_analytics_id"
    )
    lines = inventory.po_lines(t["po_details"].join(products, "product_analytics_id", "left_semi"), as_of)
    received = inventory.open_vs_received(lines, t["po_receipts"])
    attributes = t["slt_product_attributes"].select(
        "product_analytics_id", "next_vendor_cost", "market", "status", "ticket_type", "port"
    )
    collections = pricing.collection_dim(
        t["products"], t["product_to_merchandising_taxonomy"], pricing.department_dim(t["merchandising_taxonomies"]),
        t["slt_product_attributes"], t["collections"],
    ).drop("department_code")
    prices = pricing.price_info(t["products"], t["product_price_history"], as_of).select(
        "product_analytics_id", F.col("current_retail_price").alias("file_retail_price")
    )
    vendors = t["vendors"].select(
        zero_if_null("vendor_analytics_id").alias("vendor_analytics_id"), "vendor_name", "vendor_style_num",
        F.when(F.col("is_foreign_vendor") == 1, "For").when(F.col("is_foreign_vendor") == 0, "Dom").otherwise("").alias("vendor_origin"),
    )
    about = t["products"].select(
        "product_analytics_id", "product_name", "season", "holiday", "country_of_origin", "minimum_order_quantity",
        "first_receipt_date", "last_receipt_date", F.col("original_retail_price").alias("retail_price"),
    )
    sites = t["locations"].select("location_analytics_id", F.col("name").alias("location_name"))
    base = lines.select(
        *inventory.PO_LINE_KEYS, "product_analytics_id", zero_if_null("vendor_analytics_id").alias("vendor_analytics_id"),
        "po_ship_date", "po_arrival_date", "current_arrival_date_analytics_id", "po_written_date", "stale_days",
    )
    fact = (
        base.join(received, list(inventory.PO_LINE_KEYS))
        .join(vendors, "vendor_analytics_id")
        .join(sites, "location_analytics_id")
        .join(about, "product_analytics_id")
        .join(prices, "product_analytics_id")
        .join(attributes, "product_analytics_id")
        .join(collections, "product_analytics_id")
        .join(departments_named(t), "level_3_analytics_id")
    )
    # The wide rows are written once; positions, product means and department
    # totals are computed on narrow reads of that copy and joined to it.
    fact = cut_lineage(fact)
    # A line may lie at several locations or dates: only the whole key tells rows apart.
    line_key = [
        "purchase_order_analytics_id", "po_line_number", "vendor_po_name", "location_analytics_id",
        "next_cost_effective_date", "cancel_date",
    ]
    placed = ordered_scan(
        fact.select(*line_key, "vendor_analytics_id", "po_written_date", "open_units"), [("po_written_date", "desc")],
        line_key, ["vendor_analytics_id"], {"open_units": "open_units"},
    ).select(
        *line_key, F.col("row_number").alias("vendor_po_recency_rank"), F.col("total_open_units").alias("total_open_units_by_vendor")
    )
    placed_fact = fact.join(placed, line_key)
    with_mean = windows.group_stat(
        placed_fact, "stale_days", ["product_analytics_id"], "avg", "avg_stale_days_per_product", source=fact
    )
    return windows.share_of(
        with_mean, "open_vendor_cost", ["level_3_analytics_id"], "pct_open_cost_within_dept", "_department", source=fact
    ).drop("_department", "stale_days")


def planning_dashboard(
    t: RetailTables, as_of: date, prior: date, week_start: date, week_end: date,
    channels: Sequence[str] = ("1", "2", "5"), departments: Sequence[int] = net.DEPARTMENTS, web_location: int = 2,
) -> DataFrame:
    """Stock value and selling stores per channel: now, a week ago, last year, with changes and shares."""
    calendar = t["calendar"]
    sites = t["locations"].where(F.col("channel_analytics_id").isin(*channels)).select(
        "location_analytics_id", "channel_analytics_id"
    )
    products = t["product_to_merchandising_taxonomy"].where(F.col("level_3_analytics_id").isin(*departments)).select(
        "product_analytics_id"
    )
    stock = (
        t["product_history"].join(products, "product_analytics_id", "left_semi")
        .join(sites, "location_analytics_id")
        .withColumn("channel", F.col("channel_analytics_id"))
    )
    position = inventory.inventory_position(stock, calendar, ["channel"], as_of, prior)

    in_week = F.col("gregorian_date").between(F.lit(week_start), F.lit(week_end))
    weeks = calendar.where(in_week).select("fiscal_week_id").distinct()
    this_year = time.day_ids(calendar.join(weeks, "fiscal_week_id", "left_semi"))
    last_year = time.days_between(calendar, week_start, week_end, "last_year_date_analytics_id")
    line = t["sales_line"].where(F.col("attribution_location_analytics_id") != web_location).select(
        "order_line_analytics_id", "attribution_location_analytics_id"
    )

    def stores(days: Sequence[int], name: str) -> DataFrame:
        sales = t["delivered_sales"].where(time.on_days(days)).join(line, "order_line_analytics_id")
        return inventory.active_stores(sales, sites, days, name).drop("date_analytics_id")

    # One row per channel from here on.
    merged = shaping.merge_wide(
        ["channel"], position, stores(this_year, "current_store_count"), stores(last_year, "ly_store_count")
    )
    merged = windows.share_of(
        merged, "current_available", (), "curr_avail_share_of_total", "total_curr_avail_all_channels", bounded=True
    )
    merged = inventory.changes(merged, "current_available", "last_year_available", "yoy_available")
    merged = inventory.changes(merged, "current_available", "prior_available", "wow_available")
    merged = merged.withColumn("current_inv_per_store", ratio("current_available", "current_store_count"))
    return windows.ranks(merged, "current_available", ["channel"], (), bounded=True).drop("rank", "dense_rank").withColumnRenamed(
        "row_number", "channel_rank_by_current_inv"
    )


def sales_and_inventory(
    t: RetailTables, as_of: date, cutoff: date, departments: Sequence[int] = net.DEPARTMENTS
) -> DataFrame:
    """Net sales and margins by vendor, comparable flag, product family and channel, to date and last year.

    Facts are limited to the days of both years first; all periods are summed
    in one pass and keys seen in any of them are kept.
    """
    periods = time.period_days(t["calendar"], as_of, cutoff=cutoff)
    sales = net.attributed_sales(time.within(t["delivered_sales"], periods), t["sales_line"])
    returns = net.attributed_returns(time.within(t["delivered_returns"], periods), t["sales_line"], t["sales_header"])
    adjustments = time.within(t["cosa"], periods).withColumnRenamed(
        "location_analytics_id", "attribution_location_analytics_id"
    )
    netted = net.net_with_cost_adjustment(
        sales.where(F.col("product_analytics_id").isNotNull()), returns, adjustments,
        ["date_analytics_id", "product_analytics_id", "attribution_location_analytics_id"],
        {"dollars": "merchandise", "landed_gm": F.col("merchandise") - F.col("fair_market_value"), "units": "quantity"},
        "dollars",
    )
    sites = t["locations"].select(
        F.col("location_analytics_id").alias("attribution_location_analytics_id"),
        F.col("channel_analytics_id").alias("channel"),
        F.when(F.col("has_comparable_sales") == 1, "Y").otherwise("N").alias("has_comp"),
    )
    products = (
        t["product_to_merchandising_taxonomy"].where(F.col("level_3_analytics_id").isin(*departments))
        .select("product_analytics_id", "level_5_analytics_id")
        .join(
            t["products"].select("product_analytics_id", zero_if_null("vendor_analytics_id").alias("vendor_analytics_id")),
            "product_analytics_id",
        )
    )
    wide = time.to_date_buckets(
        netted.join(sites, "attribution_location_analytics_id").join(products, "product_analytics_id"),
        periods, ["vendor_analytics_id", "has_comp", "level_5_analytics_id", "channel"],
        {
            "net_dollars": "net_dollars", "net_landed_gm": "net_landed_gm", "net_cosa_gm": "adjusted_margin",
            "net_units": "net_units",
        },
    )
    # The ranking reads its input several times; it is far smaller than the facts.
    ranked = ordered_scan(
        cut_lineage(wide), [("net_dollars_year", "desc")], ["vendor_analytics_id", "has_comp"], ["level_5_analytics_id", "channel"],
        {"dollars": "net_dollars_year"},
    )
    return (
        ranked.withColumn("gm_pct_ytd", ratio("net_landed_gm_year", "net_dollars_year"))
        .withColumn("vendor_share_ytd_in_dept", ratio("net_dollars_year", "total_dollars"))
        .withColumnRenamed("row_number", "vendor_rank_ytd_in_dept")
        .drop("rank", "dense_rank", "group_rows", "running_dollars", "total_dollars")
    )
