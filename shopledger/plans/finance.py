"""Finance reports: card refunds, daily KPI sheets, mailed cheques."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ratio, zero_if_null
from ..functions.ordered import cut_lineage, ordered_scan
from ..operators import finance, kpis, net, shaping, time, windows
from ..sources.catalog import RetailTables
from .ecommerce import percent
from .parameters import PLAN_COLUMNS, demand_class_rules


def card_refunds_for_classes(
    t: RetailTables, first: date, last: date, card: str = "Amex", product_type: str = "Culinary"
) -> DataFrame:
    """Class lines paid by one card type, with order and card totals and rank in the order."""
    lines = finance.payment_lines(
        t["sfcc_order"], t["sales_header"], t["sales_line"], t["sfcc_order_item"], t["sfcc_payment_instrument"],
        t["culinary_products"], card, product_type, first, last,
    ).withColumnRenamed("sub_total", "line_revenue")
    ranked = ordered_scan(
        lines, [("line_revenue", "desc")], ["order_line_analytics_id"], ["sfcc_order_number"], {"order": "line_revenue"}
    )
    ranked = windows.with_group_values(ranked, ["last_4"], {"card_last4_total_revenue": F.sum("line_revenue")}, source=lines)
    total = F.col("total_order")
    return ranked.withColumn(
        "pct_of_order_revenue", F.when(total == 0, F.lit(0)).otherwise(percent("line_revenue", "total_order"))
    ).select(
        "sfcc_order_number", F.col("order_number").alias("oms_order_number"), F.col("order_date").alias("date_ordered"),
        F.col("order_source").alias("source"), "customer_name", "card_type", F.col("last_4").alias("last_4_digits_cc"),
        "line_id", "sku", "product_name", "product_type", "class_type", "start_date", "end_date", "is_return",
        "is_canceled", "is_class_cancelled", "quantity", "unit_price", F.col("line_revenue").alias("sub_total"),
        total.alias("order_total_revenue"), "card_last4_total_revenue", F.col("rank").alias("line_rank_in_order"),
        "pct_of_order_revenue",
    )


def demand_lines(t: RetailTables, written: DataFrame) -> DataFrame:
    """Written lines with channel, drop-ship flag and taxonomy, as the demand classes need them."""
    flagged = kpis.split_by_existence(
        written.select(
            "order_line_analytics_id", "order_analytics_id", "product_analytics_id", "date_analytics_id", "merchandise"
        ),
        t["drop_ship_po"], ["order_analytics_id", "product_analytics_id"],
    )
    taxonomy = t["product_to_merchandising_taxonomy"].select(
        "product_analytics_id", "level_3_analytics_id", "level_5_analytics_id"
    )
    lines = t["sales_line"].select("order_line_analytics_id", "sales_channel")
    return flagged.join(lines, "order_line_analytics_id").join(taxonomy, "product_analytics_id", "left")


def direct_daily_kpis(
    t: RetailTables, as_of: date, class_id: int = 212, plan_columns: Mapping = PLAN_COLUMNS
) -> DataFrame:
    """Today and two-day demand of one class for this year and last; plan and share for this year.

    Only the four days of both years are read from the written sales.
    """
    calendar = t["calendar"]
    this_year = calendar.where(F.col("gregorian_date").between(F.lit(as_of - timedelta(days=1)), F.lit(as_of)))
    days = this_year.select("date_analytics_id", "gregorian_date", F.lit("this year").alias("period")).unionByName(
        this_year.select(
            F.col("last_year_date_analytics_id").alias("date_analytics_id"), "gregorian_date", F.lit("last year").alias("period")
        )
    )
    wanted = time.on_days(time.day_ids(days))
    written = t["written_sales"].where(wanted)
    demand = kpis.demand_classes(demand_lines(t, written), demand_class_rules())
    sheet = kpis.demand_vs_plan(
        calendar.where(wanted), t["direct_forecast_sales_budget"].where(wanted), demand, plan_columns,
    ).drop("gregorian_date").join(days, "date_analytics_id")
    today, chosen = F.col("gregorian_date") == F.lit(as_of), F.col("class_id") == class_id
    planned = chosen & (F.col("period") == "this year")
    wide = shaping.pivot_when(
        sheet, ["period"],
        {
            "demand_day": (today & chosen, "dollars"),
            "forecast_day": (today & planned, "forecast_demand"),
            "budget_day": (today & planned, "budgeted_demand"),
            "demand_2day": (chosen, "dollars"),
            "forecast_2day": (planned, "forecast_demand"),
            "budget_2day": (planned, "budgeted_demand"),
            "_all": (F.col("period") == "this year", "dollars"),
        },
    )
    return wide.withColumn("class_share_of_window", ratio("demand_day", "_all")).drop("_all")


def mailed_refund_cheques(t: RetailTables, first: date, last: date) -> DataFrame:
    """Mailed refund cheques with payee and the party's preferred phone number."""
    chain = finance.tender_chain(
        t["trn_trans"], t["trl_rtrans"], t["ttr_send_check_tndr_lineitm"], t["ttr_tndr_lineitm"],
        t["trl_rtrans_lineitm"], first, last,
    )
    phones = finance.preferred_contact(t["crm_party_telephone"]).withColumnRenamed("party_id", "cust_party_id")
    return chain.join(phones, "cust_party_id", "left").select(
        F.col("rtl_loc_id").alias("store_id"), F.col("create_date").alias("transaction_timestamp"), "amount",
        F.col("tndr_id").alias("tender_code"), F.col("trans_seq").alias("transaction_id"),
        F.col("wkstn_id").alias("register_id"), F.col("cust_party_id").alias("customer_id"),
        F.col("payable_to_name").alias("name"), F.col("payable_to_address").alias("address"),
        F.col("payable_to_apartment").alias("apartment"), F.col("payable_to_city").alias("city"),
        F.col("payable_to_state").alias("state"), F.col("payable_to_postal_code").alias("zip_code"),
        F.col("payable_to_country").alias("country"), F.col("telephone_number").alias("phone"),
    )


def store_daily_kpis(
    t: RetailTables, as_of: date, departments: Sequence[int] = net.DEPARTMENTS, discount_prefix: str = "COOKING"
) -> DataFrame:
    """Sales, class discounts, traffic, captures and forecasts per store, today and two days.

    All facts are limited to the two days by id first; stores of any fact are kept.
    """
    either_day = time.on_days(time.days_between(t["calendar"], as_of - timedelta(days=1), as_of))
    store = "location_analytics_id"
    products = t["product_to_merchandising_taxonomy"].where(F.col("level_3_analytics_id").isin(*departments)).select(
        "product_analytics_id"
    )

    def two_days(df: DataFrame) -> DataFrame:
        return df.where(either_day)

    def in_departments(df: DataFrame) -> DataFrame:
        return df.join(products, "product_analytics_id", "left_semi")

    line = t["sales_line"].select(
        "order_line_analytics_id", "sales_channel", F.col("attribution_location_analytics_id").alias("line_location"), F.lit(True).alias("has_line")
    )
    # Both sides of the two days meet the lines, the largest table, once.
    columns = ["order_line_analytics_id", "order_analytics_id", "product_analytics_id", "date_analytics_id", "merchandise", "quantity"]
    sold = two_days(t["delivered_sales"]).select(*columns, F.lit(None).cast("bigint").alias(store), F.lit(False).alias("returned"))
    back = two_days(t["delivered_returns"]).select(*columns, store, F.lit(True).alias("returned"))
    moves = cut_lineage(sold.unionByName(back).join(line, "order_line_analytics_id", "left"))
    counted = in_departments(moves.where("has_line"))
    sales = counted.where("not returned").withColumn(store, F.col("line_location"))
    known_sites = t["locations"].select(F.col(store).alias("line_location"))
    returns = (
        counted.where("returned")
        .join(known_sites, "line_location", "left_semi")
        .withColumn(store, net.remap_return_location(store, "sales_channel", channels=None))
    )
    plan = two_days(t["forecast_and_budget_by_channel"])
    signed = (
        sales.select("date_analytics_id", store, F.col("merchandise").alias("net"))
        .unionByName(returns.select("date_analytics_id", store, (-F.col("merchandise")).alias("net")))
        .unionByName(plan.select("date_analytics_id", store, F.col("forecast_sales").alias("forecast")), allowMissingColumns=True)
    )
    netted = signed.groupBy("date_analytics_id", store).agg(
        zero_if_null(F.sum("net")).alias("net"), zero_if_null(F.sum("forecast")).alias("forecast")
    )
    discounted = kpis.discount_net(
        moves.where("not returned"), moves.where("returned"), t["pos_discounts"], discount_prefix, ["date_analytics_id", "line_location"],
    ).withColumnRenamed("line_location", store)
    sheet = kpis.store_kpis(
        {
            "sales": (netted, {"sales_net": "net", "sales_forecast": "forecast"}),
            "classes": (discounted, {"class_net": "net_dollars"}),
            "traffic": (t["shoppertrak_traffic"], {"traffic": "traffic_out_count"}),
            "captures": (t["store_kpi"], {"address": "hasaddress", "email": "hasemail"}),
            "class_forecast": (t["forecast_and_budget"], {"class_forecast": "culinary_discount_forecast"}),
        },
        t["calendar"], as_of,
    )
    return sheet.join(t["locations"].select(store, "date_opened", "manager"), store)
