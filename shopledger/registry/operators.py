"""One query per operator, each over the whole of the tables it reads."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import money, ratio, zero_if_null
from ..operators import classes, customers, finance, inventory, keys, kpis, lifecycle, net, pricing, shaping, time, windows
from ..plans.parameters import (
    demand_class_rules, DISTRICTS, FLAG_STORES, FULL_PRICES, OTHER_REGION, PLAN_COLUMNS, REGIONS, SPEND_EDGES, SPEND_LABELS,
    WAREHOUSE_REGION,
)
from ..sources.catalog import RetailTables
from .base import query

AS_OF = date(2000, 6, 15)


def moves(t: RetailTables, returned: bool) -> DataFrame:
    """Line facts of one direction, with 'pos' where the channel is unknown."""
    facts = t["line_facts"].where(F.col("is_return_line") == int(returned))
    return facts.withColumn("sales_channel", F.coalesce("sales_channel", F.lit("pos")))


STORE_DAY = ["date_analytics_id", "attribution_location_analytics_id", "sales_channel"]


# Net sales


@query("return_remap")
def _(t):
    returned = t["line_facts"].where(F.col("is_return_line") == 1)
    return returned.groupBy(
        net.remap_return_location("location_analytics_id", "sales_channel").alias("counted_location"),
        net.remap_return_location("location_analytics_id", "sales_channel", channels=None).alias("counted_any_channel"),
    ).agg(F.count(F.lit(1)).alias("returns"), F.sum("merchandise").alias("return_dollars"))


@query("original_channel")
def _(t):
    found = net.original_channel(t["delivered_returns"], t["sales_header"], t["sales_line"])
    return found.groupBy("original_channel").agg(
        F.count(F.lit(1)).alias("returns"), F.sum("merchandise").alias("return_dollars")
    )


@query("net_sales")
def _(t):
    measures = {
        "dollars": "merchandise",
        "units": "quantity",
        "cost": "fair_market_value",
        "margin": F.col("merchandise") - F.col("fair_market_value"),
    }
    return net.net_of(moves(t, False), moves(t, True), STORE_DAY, measures)


@query("net_sales_cost_adjusted")
def _(t):
    grain = ["date_analytics_id", "product_analytics_id", "location_analytics_id"]
    sales, returns = (moves(t, side) for side in (False, True))
    return net.net_with_cost_adjustment(
        sales, returns, t["cosa"], grain, {"dollars": "merchandise", "units": "quantity"}, "dollars"
    ).drop("movements")


@query("net_vs_forecast")
def _(t):
    plan = t["forecast_and_budget_by_channel"].withColumnRenamed("location_analytics_id", STORE_DAY[1])
    return net.net_with_forecast(
        moves(t, False), moves(t, True), plan, STORE_DAY, ["forecast_sales", "budget_sales", "forecast_units"]
    )


@query("margins")
def _(t):
    return (
        net.margins(moves(t, False))
        .join(t["product_to_merchandising_taxonomy"], "product_analytics_id")
        .groupBy("level_3_analytics_id")
        .agg(*[F.sum(c).alias(c) for c in ("landed_cost", "landed_margin", "vendor_cost", "vendor_margin")])
    )


# Time


@query("anchor_period")
def _(t):
    anchor = time.anchor_period(t["calendar"], AS_OF)
    week = t["calendar"].select("date_analytics_id", "fiscal_week_id").join(
        anchor.drop("date_analytics_id"), "fiscal_week_id"
    )
    return (
        moves(t, False)
        .join(week, "date_analytics_id")
        .groupBy("fiscal_week_id", "fiscal_month_id", "fiscal_quarter_id", "fiscal_year", "week_in_year", "sales_channel")
        .agg(F.sum("merchandise").alias("sales"))
    )


@query("ty_vs_ly")
def _(t):
    sales = moves(t, False)
    this_year = sales.groupBy("date_analytics_id", "sales_channel").agg(F.sum("merchandise").alias("sales"))
    last_year = time.align_last_year(this_year, t["calendar"]).withColumnRenamed("sales", "sales_ly")
    return shaping.merge_wide(["date_analytics_id", "sales_channel"], this_year, last_year)


@query("to_date_buckets")
def _(t):
    periods = time.period_days(t["calendar"], AS_OF, cutoff=AS_OF)
    return time.to_date_buckets(
        moves(t, False), periods, ["vendor_analytics_id", "sales_channel"], {"sales": "merchandise", "units": "quantity"}
    )


@query("fiscal_weeks")
def _(t):
    weeks = time.fiscal_weeks(t["calendar"])
    days = t["calendar"].select("date_analytics_id", "fiscal_week_id")
    per_week = moves(t, False).join(days, "date_analytics_id").groupBy("fiscal_week_id").agg(F.sum("merchandise").alias("sales"))
    return per_week.join(weeks, "fiscal_week_id")


@query("rolling_weeks")
def _(t):
    weeks = time.rolling_weeks(t["calendar"], AS_OF, 52)
    days = t["calendar"].select("date_analytics_id", "fiscal_week_id").join(weeks, "fiscal_week_id", "left_semi")
    return moves(t, False).join(days, "date_analytics_id").groupBy("fiscal_week_id").agg(F.sum("merchandise").alias("sales"))


@query("reporting_date")
def _(t):
    quarters = time.reporting_date(t["calendar"], t["fiscal_weeks"])
    days = t["calendar"].select(F.col("date_analytics_id").alias("day"), "fiscal_quarter_id")
    return (
        moves(t, False)
        .withColumnRenamed("date_analytics_id", "day")
        .join(days, "day")
        .groupBy("fiscal_quarter_id")
        .agg(F.sum("merchandise").alias("sales"))
        .join(quarters, "fiscal_quarter_id")
    )


@query("yesterday_orders")
def _(t):
    return time.on_day(t["sales_header"], "date_ordered", AS_OF).select(
        "order_analytics_id", "order_number", "source", "date_ordered"
    )


@query("hourly_demand")
def _(t):
    return time.hourly(t["events"], "ts", money("value"), ["event_type"])


@query("day_range")
def _(t):
    ranged = time.between_days(t["sales_header"], "date_ordered", date(2000, 1, 1), date(2000, 3, 31))
    return ranged.groupBy(F.to_date("date_ordered").alias("order_date")).agg(F.count(F.lit(1)).alias("orders"))


# Shares, ranks, curves


def orders(t: RetailTables) -> DataFrame:
    return t["order_header"].select(
        "target_key", "order_number", "order_date", "order_year", "net_amount", "channel_code_desc"
    )


@query("share_of_total")
def _(t):
    in_channel = windows.share_of(orders(t), "net_amount", ["channel_code_desc"], "channel_share", "channel_total")
    return windows.share_of(in_channel, "net_amount", share="overall_share", total="overall_total", source=orders(t)).select(
        "order_number", "channel_code_desc", "net_amount", "channel_total", "channel_share", "overall_total", "overall_share"
    )


@query("pareto")
def _(t):
    per_customer = orders(t).groupBy("target_key").agg(F.sum("net_amount").alias("sales"))
    return windows.pareto(per_customer, "sales", ["target_key"])


@query("rank_family")
def _(t):
    whole = orders(t).withColumn("hundreds", F.floor(F.col("net_amount") / 100).cast("bigint"))
    return windows.ranks(whole, "hundreds", ["order_number"], ["channel_code_desc"]).select(
        "order_number", "channel_code_desc", "hundreds", "row_number", "rank", "dense_rank"
    )


@query("running_total")
def _(t):
    return windows.running_total(orders(t), "net_amount", ["channel_code_desc"], ["order_date", "order_number"]).select(
        "order_number", "channel_code_desc", "net_amount", "running"
    )


@query("rank_by_total")
def _(t):
    cells = moves(t, False).groupBy("product_analytics_id", "sales_channel", "attribution_location_analytics_id").agg(
        F.sum("merchandise").alias("sales")
    )
    return windows.rank_by_group_total(
        cells, ["product_analytics_id"], ["sales_channel"], "sales",
        ["sales_channel", "attribution_location_analytics_id"],
    )


@query("top_n")
def _(t):
    per_channel = windows.top_n(orders(t), "net_amount", 5, ["order_number"], ["channel_code_desc"])
    overall = windows.top_n(orders(t), "net_amount", 20, ["order_number"])
    columns = ["order_number", "channel_code_desc", "net_amount"]
    return per_channel.select(*columns, F.lit("channel").alias("scope")).unionByName(
        overall.select(*columns, F.lit("overall").alias("scope"))
    )


@query("group_average")
def _(t):
    return windows.group_stat(orders(t), "net_amount", ["channel_code_desc"], "avg", "channel_mean").select(
        "order_number", "channel_code_desc", "net_amount", "channel_mean"
    )


# One row per key


@query("latest_per_key")
def _(t):
    marketplace = t["sales_header"].where(F.col("alt_order_number_2").isNotNull())
    return keys.latest_per_key(
        marketplace.select("alt_order_number_2", "date_ordered", "order_analytics_id", "order_number"),
        ["alt_order_number_2"], ["date_ordered"], ["order_analytics_id"],
    )


@query("latest_with_ties")
def _(t):
    columns = ["product_analytics_id", "current_arrival_date", "po_line_number", "quantity_open"]
    return keys.latest_with_ties(t["po_details"].select(*columns), ["product_analytics_id"], "current_arrival_date")


@query("snapshot_at_max")
def _(t):
    return keys.snapshot_at_max(t["product_history"], ["location_analytics_id"], "date_analytics_id")


@query("collapse_lines")
def _(t):
    lines = t["sales_line"].withColumn("unit_price_mean", F.col("unit_price"))
    return keys.collapse(
        lines, ["order_analytics_id", "product_analytics_id"], ["quantity", "merchandise"], ["date_ordered"],
        ["order_line_type"], ["unit_price_mean"],
    )


@query("last_value")
def _(t):
    return keys.last_value_of(orders(t), ["target_key"], "order_date", "net_amount", "last_amount")


# Customers


def known_orders(t: RetailTables) -> DataFrame:
    return t["order_header"].where((F.col("target_key") != -1) & (F.col("net_amount") > 0))


@query("customer_year")
def _(t):
    return customers.customer_period(known_orders(t), "target_key", "order_year", "order_number", "net_amount")


@query("frequency_bucket")
def _(t):
    yearly = customers.customer_period(known_orders(t), "target_key", "order_year", "order_number", "net_amount")
    return yearly.groupBy("order_year", customers.cap_bucket("frequency", 2).alias("frequency_bucket")).agg(
        F.count(F.lit(1)).alias("customers")
    )


@query("spend_band")
def _(t):
    yearly = customers.customer_period(known_orders(t), "target_key", "order_year", "order_number", "net_amount")
    return yearly.groupBy("order_year", customers.band("sales", SPEND_EDGES, SPEND_LABELS).alias("band")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("sales").alias("sales")
    )


@query("cohort_size")
def _(t):
    return customers.first_period_cohort(known_orders(t), "target_key", "order_year")


@query("price_mix")
def _(t):
    lines = t["order_line"].where(F.col("net_amount") > 0).join(
        known_orders(t).select("order_number", "target_key", "order_year"), "order_number"
    )
    return customers.price_mix(lines, ["target_key", "order_year"], "price", "net_amount", FULL_PRICES)


@query("tenure_in_year")
def _(t):
    firsts = customers.first_period(known_orders(t), "target_key", "order_year")
    return (
        known_orders(t)
        .join(firsts, "target_key")
        .groupBy("order_year", customers.tenure_in_year("order_year", "first_period").alias("tenure"))
        .agg(F.countDistinct("target_key").alias("customers"), F.sum("net_amount").alias("sales"))
    )


@query("mix_segment")
def _(t):
    parts = known_orders(t).groupBy("target_key").agg(
        F.sum(zero_if_null("cooking_school_amount")).alias("class_sales"),
        F.sum(F.col("net_amount") - zero_if_null("cooking_school_amount")).alias("merch_sales"),
    )
    label = customers.mix_segment("class_sales", "merch_sales", ["Culinary+Merch", "CulinaryOnly", "NonCulinary", "Other"])
    return parts.withColumn("segment", label)


@query("cohort_orders")
def _(t):
    return customers.cohort_orders(known_orders(t), "target_key", "sub_categories_purchased", "%999%").select(
        "target_key", "order_number", "net_amount"
    )


@query("proximity")
def _(t):
    near = customers.proximity(t["target"], t["store_master"])
    return near.select("target_key", "store_proximity", "culinary_proximity")


@query("customer_tenure")
def _(t):
    firsts = known_orders(t).groupBy("target_key").agg(F.min("order_date").alias("first_order"))
    return (
        t["target"]
        .join(firsts, "target_key", "left")
        .select(
            "target_key",
            customers.tenure_since_order("original_entered_date", "first_order").alias("tenure_since_order"),
            customers.tenure_by_year("original_entered_date", 2000).alias("tenure_by_year"),
        )
    )


@query("category_mix")
def _(t):
    lines = (
        known_orders(t).select("order_number", "target_key")
        .join(t["order_line"].select("order_number", F.col("item_number").alias("sku"), "net_amount"), "order_number")
        .join(t["product"], "sku")
    )
    return customers.category_mix(lines, "target_key", "category_name", "net_amount", "COOKING SCHOOL")


@query("recency_segment")
def _(t):
    return customers.recency_segment(known_orders(t), "target_key", "order_date")


@query("multi_year_qualified")
def _(t):
    yearly = customers.customer_period(known_orders(t), "target_key", "order_year", "order_number", "net_amount")
    year, sales, count = F.col("order_year"), F.col("sales"), F.col("frequency")
    return customers.qualify_all_periods(
        yearly,
        "target_key",
        {
            "1997": (year == 1997) & (count <= 50),
            "1998": (year == 1998) & (sales >= 200) & (count <= 50),
            "1999": (year == 1999) & (sales >= 400) & (count <= 50),
        },
    )


@query("contactable")
def _(t):
    excluded = known_orders(t).where(F.col("channel_code_desc") == "5-LOW").select("target_key").distinct()
    return customers.contactable(t["target"], ["%internal%", "%INTERNAL%"], excluded).select("target_key", "email")


# Lifecycle


def activity(t: RetailTables) -> DataFrame:
    """Who ordered when and through which channel, from order headers."""
    days = t["calendar"].select(
        F.col("date_analytics_id").alias("date_ordered_analytics_id"), "fiscal_year", "month_analytics_id",
        "quarter_analytics_id",
    )
    return (
        lifecycle.enrich_email(t["sales_header"])
        .where(F.col("email").isNotNull())
        .join(days, "date_ordered_analytics_id")
        .withColumn("sales_channel_type", lifecycle.channel_type())
    )


@query("lifecycle_year")
def _(t):
    return lifecycle.lifecycle_by_year(activity(t))


@query("lifecycle_rolling")
def _(t):
    return lifecycle.lifecycle_rolling(activity(t), ["email", "sales_channel_type"], "month_analytics_id", 12)


@query("segment_totals")
def _(t):
    lines = t["written_sales"].select("order_analytics_id", "merchandise", "quantity").join(
        t["sales_header"].select("order_analytics_id", "email", "source"), "order_analytics_id"
    )
    return lifecycle.segment_totals(lines, ["source"])


@query("channel_type")
def _(t):
    return t["sales_header"].groupBy("source", "order_type", lifecycle.channel_type().alias("channel_type")).agg(
        F.count(F.lit(1)).alias("orders")
    )


@query("anonymous_orders")
def _(t):
    return lifecycle.anonymous_orders(t["sales_header"], t["non_customer_emails"]).select("order_analytics_id", "email")


@query("enrich_email")
def _(t):
    return lifecycle.enrich_email(t["sales_header"]).select("order_analytics_id", "source", "order_type", "email")


@query("exclude_orders")
def _(t):
    kept = lifecycle.exclude_orders(t["sales_line"], t["sales_line"])
    return kept.groupBy("order_analytics_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("merchandise").alias("sales"))


@query("surrogate_id")
def _(t):
    return lifecycle.surrogate_id(t["sales_header"], "email", "email_id")


@query("new_customers")
def _(t):
    weeks = time.rolling_weeks(t["calendar"], date(1996, 6, 15), 52)
    return lifecycle.new_in_window(t["sales_header"], t["calendar"], weeks, "email", "date_ordered_analytics_id")


@query("reactivated")
def _(t):
    return lifecycle.reactivated(activity(t), "email", "fiscal_year")


@query("retained")
def _(t):
    months = t["sales_header"].where(F.col("email").isNotNull()).select(
        "email", F.year("date_ordered").alias("order_year"), F.month("date_ordered").alias("order_month")
    )
    return lifecycle.retained(months, "email", "order_year", "order_month")


@query("allowed_sales")
def _(t):
    return lifecycle.allowed_sales(t["sales_line"]).groupBy("source", "sales_channel", "order_line_type").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("merchandise").alias("sales")
    )


@query("product_category")
def _(t):
    return (
        t["delivered_sales"]
        .join(t["product_to_merchandising_taxonomy"], "product_analytics_id")
        .groupBy(lifecycle.product_category().alias("product_category"))
        .agg(F.sum("merchandise").alias("sales"), F.sum("quantity").alias("units"))
    )


# Shaping


@query("grouping_sets")
def _(t):
    facts = t["line_facts"].select("attribution_location_analytics_id", "sales_channel", "merchandise", "order_analytics_id")
    return shaping.with_total(
        facts, ["attribution_location_analytics_id", "sales_channel"], "sales_channel", "All",
        [F.sum("merchandise").alias("sales"), F.countDistinct("order_analytics_id").alias("orders")],
    )


@query("conditional_pivot")
def _(t):
    channel = F.col("sales_channel")
    return shaping.pivot_when(
        moves(t, False), ["product_analytics_id"],
        {name: (channel == name, "merchandise") for name in ("web", "slt_bopis", "pos")}, empty=0,
    )


@query("dense_grid")
def _(t):
    cells = shaping.basket_lines(t["written_sales"], t["sales_line"], t["locations"])
    return shaping.dense_grid(
        cells, ["product_analytics_id", "date_analytics_id"], "channel",
        t["channels"].select(F.col("channel_analytics_id").alias("channel")), ["merchandise", "quantity"],
    )


@query("market_basket")
def _(t):
    cells = shaping.basket_lines(t["written_sales"], t["sales_line"], t["locations"])
    return shaping.basket(cells, t["store_agents"])


@query("all_keys")
def _(t):
    grain = ["location_analytics_id", "product_analytics_id"]
    return shaping.all_keys(grain, t["delivered_returns"], t["product_history"], t["cosa"])


@query("merge_wide")
def _(t):
    key = ["product_analytics_id"]
    sold = moves(t, False).groupBy(*key).agg(F.sum("merchandise").alias("sales"))
    returned = moves(t, True).groupBy(*key).agg(F.sum("merchandise").alias("returns"))
    adjusted = t["cosa"].groupBy(*key).agg(F.sum("cosa").alias("cost_adjustment"))
    return shaping.merge_wide(key, sold, returned, adjusted)


# KPI sheets


def demand_lines(t: RetailTables) -> DataFrame:
    """Written lines with what the demand classes ask about."""
    written = t["written_sales"].select(
        "order_line_analytics_id", "order_analytics_id", "product_analytics_id", "date_analytics_id", "merchandise"
    )
    flagged = kpis.split_by_existence(written, t["drop_ship_po"], ["order_analytics_id", "product_analytics_id"])
    taxonomy = t["product_to_merchandising_taxonomy"].select(
        "product_analytics_id", "level_3_analytics_id", "level_5_analytics_id"
    )
    return flagged.join(t["sales_line"].select("order_line_analytics_id", "sales_channel"), "order_line_analytics_id").join(
        taxonomy, "product_analytics_id", "left"
    )


@query("day_two_day")
def _(t):
    return kpis.day_and_two_day(
        moves(t, False), ["attribution_location_analytics_id"], {"sales": "merchandise", "units": "quantity"},
        time.in_dates("dt", AS_OF, AS_OF), time.in_dates("dt", AS_OF - timedelta(days=1), AS_OF),
    )


@query("demand_classes")
def _(t):
    return kpis.demand_classes(demand_lines(t), demand_class_rules())


@query("demand_vs_plan")
def _(t):
    demand = kpis.demand_classes(demand_lines(t), demand_class_rules())
    return kpis.demand_vs_plan(t["calendar"], t["direct_forecast_sales_budget"], demand, PLAN_COLUMNS)


@query("discount_net")
def _(t):
    return kpis.discount_net(
        moves(t, False), moves(t, True), t["pos_discounts"], "COOKING",
        ["date_analytics_id", "attribution_location_analytics_id"],
    )


@query("store_kpis")
def _(t):
    sales = t["line_facts"].withColumn("location_analytics_id", F.col("attribution_location_analytics_id"))
    return kpis.store_kpis(
        {
            "sales": (sales, {"sales": "merchandise"}),
            "traffic": (t["shoppertrak_traffic"], {"traffic": "traffic_out_count"}),
            "captures": (t["store_kpi"], {"address": "hasaddress", "email": "hasemail"}),
            "forecast": (t["forecast_and_budget"], {"class_forecast": "culinary_discount_forecast"}),
        },
        t["calendar"],
        AS_OF,
    )


@query("dropship_split")
def _(t):
    flagged = kpis.split_by_existence(
        t["written_sales"], t["drop_ship_po"], ["order_analytics_id", "product_analytics_id"]
    )
    return flagged.groupBy("date_analytics_id", "is_dropship").agg(F.sum("merchandise").alias("sales"))


# Prices and products


@query("current_price")
def _(t):
    return pricing.current_price(t["products"], t["product_price_history"]).select(
        "product_analytics_id", "retail_price", "current_retail_price"
    )


@query("price_ending")
def _(t):
    return t["product_price_history"].groupBy(
        pricing.price_ending_type("price", "id").alias("type_id"),
        pricing.price_ending_type("price").alias("type_code"),
        pricing.price_ending_type("price", "description").alias("type_description"),
    ).agg(F.count(F.lit(1)).alias("prices"))


@query("receipt_age")
def _(t):
    return t["products"].select(
        "product_analytics_id",
        pricing.days_since("last_receipt_date", AS_OF).alias("age_days"),
        pricing.age_bucket("last_receipt_date", AS_OF, "id").alias("bucket_id"),
        pricing.age_bucket("last_receipt_date", AS_OF).alias("bucket"),
    )


@query("price_type_sales")
def _(t):
    typed = pricing.price_type_on_day(t["delivered_sales"], t["product_price_history"])
    return typed.groupBy("price_type", pricing.price_type_order("price_type").alias("type_order")).agg(
        F.sum("merchandise").alias("sales"), F.count(F.lit(1)).alias("lines")
    )


@query("department_dim")
def _(t):
    departments = pricing.department_dim(t["merchandising_taxonomies"])
    return (
        t["delivered_sales"]
        .join(t["product_to_merchandising_taxonomy"].select("product_analytics_id", "level_3_analytics_id"), "product_analytics_id")
        .join(departments, "level_3_analytics_id")
        .groupBy("level_3_analytics_id", "department_name", "department_code", "merch_group")
        .agg(F.sum("merchandise").alias("sales"))
    )


@query("collection_dim")
def _(t):
    return pricing.collection_dim(
        t["products"], t["product_to_merchandising_taxonomy"], pricing.department_dim(t["merchandising_taxonomies"]),
        t["slt_product_attributes"], t["collections"],
    )


# Inventory and purchase orders


@query("open_backorders")
def _(t):
    return inventory.open_backorders(t["sales_line"], AS_OF, date(1996, 1, 1))


@query("on_hand")
def _(t):
    return inventory.on_hand(t["product_history"], t["calendar"], AS_OF, [904, 903, 2])


@query("next_arrivals")
def _(t):
    return inventory.next_arrivals(t["po_details"]).select(
        "product_analytics_id", "location_analytics_id", "arrival_order", "arrival_label", "current_arrival_date",
        "purchase_order_analytics_id", "quantity_open",
    )


@query("coverage")
def _(t):
    history = t["product_history"].groupBy("product_analytics_id").agg(
        F.sum(F.when(F.col("location_analytics_id") == 904, F.col("quantity_on_hand"))).alias("stock_904"),
        F.sum(F.when(F.col("location_analytics_id") == 903, F.col("quantity_on_hand"))).alias("stock_903"),
    )
    wide = (
        inventory.open_backorders(t["sales_line"], AS_OF)
        .join(history, "product_analytics_id", "left")
        .join(inventory.open_order_units(t["po_details"], 904), "product_analytics_id", "left")
        .join(inventory.next_arrival_at(inventory.next_arrivals(t["po_details"]), 904), "product_analytics_id", "left")
    )
    return inventory.coverage(wide, "stock_904", ["stock_904", "stock_903"]).select(
        "product_analytics_id", "open_backorder_units", "oversold_units", "coverage_ratio", "backorder_to_stock_ratio"
    )


@query("open_vs_received")
def _(t):
    return inventory.open_vs_received(inventory.po_lines(t["po_details"], AS_OF), t["po_receipts"])


@query("stale_days")
def _(t):
    lines = inventory.po_lines(t["po_details"], AS_OF).select(
        "purchase_order_analytics_id", "po_line_number", "vendor_analytics_id", "product_analytics_id",
        "po_written_date", "stale_days",
    )
    return inventory.stale_days(lines)


@query("inventory_position")
def _(t):
    return inventory.inventory_position(
        t["product_history"], t["calendar"], ["location_analytics_id"], AS_OF, date(2000, 6, 8)
    )


@query("active_stores")
def _(t):
    sales = t["line_facts"].where(F.col("is_return_line") == 0)
    week = time.days_between(t["calendar"], date(2000, 6, 4), date(2000, 6, 10))
    return inventory.active_stores(sales, t["locations"], week)


@query("changes")
def _(t):
    position = inventory.inventory_position(
        t["product_history"], t["calendar"], ["product_analytics_id"], AS_OF, date(2000, 6, 8)
    )
    compared = inventory.changes(position, "current_available", "last_year_available", "yoy")
    return inventory.changes(compared, "current_available", "prior_available", "wow")


@query("region_map")
def _(t):
    mapped = inventory.region_map(t["locations"], REGIONS, DISTRICTS, WAREHOUSE_REGION, OTHER_REGION, FLAG_STORES)
    sales = t["line_facts"].groupBy(F.col("attribution_location_analytics_id").alias("location_analytics_id")).agg(
        F.sum("merchandise").alias("sales")
    )
    return mapped.join(sales, "location_analytics_id", "left").drop("region_manager")


# Classes


def session_prices(t: RetailTables) -> DataFrame:
    """Web price per order number and sku."""
    return (
        t["sales_header"]
        .select("order_number", F.col("ecom_order_number").alias("sfcc_order_number"))
        .join(t["sfcc_order_item"].select("sfcc_order_number", "sku", "unit_price"), "sfcc_order_number")
        .drop("sfcc_order_number")
    )


@query("fill_rate")
def _(t):
    sessions = t["culinary_products"].select("sku", "location_code", "start_date", "maximum_seats", "price")
    return classes.fill_rate(sessions, t["sales_line"], session_prices(t))


@query("resolve_name")
def _(t):
    return t["sfcc_order"].join(t["sfcc_billing_address"], "sfcc_order_number", "left").select(
        "sfcc_order_number", classes.resolve_name("customer_name", "first_name", "last_name", "Guest Chef").alias("customer_name")
    )


@query("cancelled_lines")
def _(t):
    lines = t["sales_line"].select(
        "order_line_analytics_id", "sku", "attribution_location_analytics_id", "quantity", "quantity_returned",
        "quantity_canceled", "sub_total",
    )
    return classes.cancelled_lines(
        lines, ["sku"], ["attribution_location_analytics_id"], ["order_line_analytics_id"]
    )


# Finance


@query("tender_chain")
def _(t):
    return finance.tender_chain(
        t["trn_trans"], t["trl_rtrans"], t["ttr_send_check_tndr_lineitm"], t["ttr_tndr_lineitm"],
        t["trl_rtrans_lineitm"], date(1999, 1, 1), date(2000, 12, 31),
    ).select("rtl_loc_id", "trans_seq", "create_date", "cust_party_id", "payable_to_apartment", "tndr_id", "amount")


@query("preferred_contact")
def _(t):
    return finance.preferred_contact(t["crm_party_telephone"])


@query("payment_lines")
def _(t):
    return finance.payment_lines(
        t["sfcc_order"], t["sales_header"], t["sales_line"], t["sfcc_order_item"], t["sfcc_payment_instrument"],
        t["culinary_products"], "Amex", "Culinary", date(1998, 1, 1), date(1999, 12, 31),
    ).select("sfcc_order_number", "order_line_analytics_id", "sku", "last_4", "product_name", "class_type", "quantity", "sub_total")


@query("discount_attribution")
def _(t):
    facts = moves(t, False)
    return finance.discount_attribution(facts, t["pos_discounts"], ["date_analytics_id", "product_analytics_id"])
