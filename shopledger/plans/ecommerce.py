"""E-commerce reports: marketplace orders, redemptions, hourly demand, price types."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ratio
from ..operators import keys, net, pricing, time, windows
from ..sources.catalog import RetailTables

STORE_ORDER_PATTERN = "%ginating Store: 90%"


def percent(part: str, whole: str):
    """Share in percent with two decimals; null when the whole is zero."""
    return F.round(F.lit(100) * F.col(part).cast("decimal(28,4)") / F.nullif(F.col(whole).cast("decimal(28,4)"), F.lit(0)), 2)


def marketplace_orders_of_yesterday(t: RetailTables, as_of: date, skip: str = STORE_ORDER_PATTERN) -> DataFrame:
    """Newest order per marketplace reference among yesterday's orders."""
    recent = time.on_day(t["sales_header"], "date_ordered", as_of).where(
        F.col("alt_order_number_2").isNotNull() & ~F.col("alt_order_number_2").like(skip)
    )
    newest = keys.latest_per_key(
        recent.select("alt_order_number_2", "date_ordered", "order_number", "ecom_order_number"),
        ["alt_order_number_2"], ["date_ordered"], ["order_number"],
    )
    return newest.select(
        F.col("order_number").alias("oroms_order_number"),
        F.col("ecom_order_number").alias("ca_order_number"),
        F.col("alt_order_number_2").alias("amz_order_number"),
        F.to_date("date_ordered").alias("order_date"),
    )


def discount_redemptions_of_yesterday(t: RetailTables, as_of: date) -> DataFrame:
    """Redemptions and discount value per promotion, with its share and rank in the campaign."""
    orders = time.on_day(t["sfcc_order"], "order_date", as_of).select("sfcc_order_number")
    names = ["discount_type", "campaign_name", "promotion_name", "discount_name"]
    promotions = (
        t["sfcc_discount"]
        .join(orders, "sfcc_order_number")
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("total_redemptions"), F.sum("total").alias("total_discount"))
    )
    # A campaign is a short list of promotions.
    campaign = ["campaign_name"]
    totals = windows.with_group_values(promotions, campaign, {"campaign_total_discount": F.sum("total_discount")}, bounded=True)
    ranked = windows.ranks(totals, "total_discount", names, campaign, bounded=True)
    share = F.when(F.col("campaign_total_discount") == 0, F.lit(0)).otherwise(percent("total_discount", "campaign_total_discount"))
    return ranked.select(
        *names, "total_redemptions", "total_discount", "campaign_total_discount",
        share.alias("pct_of_campaign_discount"), F.col("rank").alias("promotion_rank_in_campaign"),
    )


def hourly_ecommerce_demand(
    t: RetailTables, first: date, last: date, skip_type: str = "Culinary", kinds: Sequence[str] = ("ecommerce", "bopis")
) -> DataFrame:
    """Demand by date and hour with its part of the day and running total."""
    lines = time.between_days(t["sales_line"], "date_ordered", first, last).where(
        (F.col("is_canceled") == "FALSE") & (F.col("is_return") == "FALSE") & F.col("order_line_type").isin(*kinds)
    ).select("order_number", "sku", "date_ordered", "merchandise")
    headers = t["sales_header"].where(F.col("source") == "oroms").select(
        "order_number", F.col("ecom_order_number").alias("sfcc_order_number")
    )
    items = t["sfcc_order_item"].where(F.col("product_type") != skip_type).select("sfcc_order_number", "sku")
    orders = t["sfcc_order"].select("sfcc_order_number")
    demand = time.hourly(
        lines.join(headers, "order_number").join(items, ["sfcc_order_number", "sku"]).join(
            orders, "sfcc_order_number", "left_semi"
        ),
        "date_ordered", "merchandise",
    )
    # A day has at most 24 rows.
    daily = windows.with_group_values(demand, ["order_date"], {"daily_demand": F.sum("demand")}, bounded=True)
    return (
        windows.running_total(daily, "demand", ["order_date"], ["order_hour"], bounded=True)
        .withColumn("pct_of_daily_demand", percent("demand", "daily_demand"))
        .withColumnRenamed("running", "cumulative_demand")
    )


def sales_by_price_type(
    t: RetailTables, fiscal_week: int, channels: Sequence[str] = ("1", "2"), departments: Sequence[int] = net.DEPARTMENTS
) -> DataFrame:
    """Net sales and margin of a fiscal week by price type, department and channel, with shares.

    The week is resolved to days first, so both facts are limited at the scan.
    """
    in_week = time.on_days(time.day_ids(t["calendar"].where(F.col("fiscal_week_id") == fiscal_week)))
    sales = net.attributed_sales(t["delivered_sales"].where(in_week), t["sales_line"])
    returns = net.attributed_returns(t["delivered_returns"].where(in_week), t["sales_line"], t["sales_header"])
    history = t["product_price_history"].where(in_week)
    grain = ["date_analytics_id", "product_analytics_id", "attribution_location_analytics_id"]
    margin = F.col("merchandise") - F.coalesce("fair_market_value", F.lit(0))
    # Netting per day, product and store first evens out popular products before prices are joined.
    netted = pricing.price_type_on_day(net.net_of(sales, returns, grain, {"dollars": "merchandise", "margin": margin}), history)
    sites = t["locations"].where(F.col("channel_analytics_id").isin(*channels)).select(
        F.col("location_analytics_id").alias("attribution_location_analytics_id"),
        F.col("channel_analytics_id").alias("channel"),
    )
    products = t["product_to_merchandising_taxonomy"].where(F.col("level_3_analytics_id").isin(*departments)).select(
        "product_analytics_id", "level_3_analytics_id"
    )
    summary = (
        netted.join(sites, "attribution_location_analytics_id")
        .join(products, "product_analytics_id")
        .join(pricing.department_dim(t["merchandising_taxonomies"]), "level_3_analytics_id")
        .groupBy("price_type", "merch_group", "level_3_analytics_id", "channel")
        .agg(
            F.max("department_name").alias("level_3_name"),
            F.max("department_code").alias("taxonomy_code"),
            F.sum("net_dollars").alias("net_sales"),
            F.sum("net_margin").alias("net_margin"),
        )
    )
    # Price types by departments by channels: a short summary.
    shared = windows.with_group_values(summary, [], {"total_net_sales": F.sum("net_sales")}, bounded=True)
    shared = windows.share_of(shared, "net_sales", ["merch_group"], "pct_of_merch_group_net_sales", "_group", bounded=True)
    shared = windows.share_of(shared, "net_sales", ["level_3_analytics_id"], "pct_of_dept_net_sales", "_department", bounded=True)
    return (
        shared.drop("_group", "_department")
        .withColumn("price_type_order", pricing.price_type_order("price_type"))
        .withColumn("margin_pct", ratio("net_margin", "net_sales"))
    )
