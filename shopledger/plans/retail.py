"""Retail reports: cancelled classes, fill rate, returns, discount codes, store margin."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import moment, ratio, zero_if_null
from ..functions.ordered import copies_deleted_after, cut_lineage, in_part, new_copy, ordered_scan, shuffles_deleted_after_each
from ..operators import classes, inventory, keys, net, pricing, time, windows
from ..sources.catalog import RetailTables
from .parameters import DISTRICTS, FLAG_STORES, OTHER_REGION, REGIONS, WAREHOUSE_REGION


def cancelled_classes(t: RetailTables, first_start: datetime, placeholder: str) -> DataFrame:
    """Orders of cancelled class sessions with refunds, names, seat prices and class totals.

    Returns, cancellations and names are reduced to one row per line or order
    before they are joined, so sums count every line once.
    """
    sessions = t["culinary_products"].where(
        (F.col("is_class_cancelled") == "TRUE") & (F.col("start_date") >= moment(first_start))
    ).select("sku", "location_code", "is_class_cancelled", F.col("start_date").alias("class_start_date"))
    line_key = ["order_number", "order_line_analytics_id"]
    # A few sessions are cancelled: the lines sold for them decide what is read of every other table.
    sold = cut_lineage(t["sales_line"].join(sessions.select("sku").distinct(), "sku", "left_semi"))
    chosen, orders = sold.select(*line_key), sold.select("order_number")
    returned = t["written_returns"].join(chosen, line_key, "left_semi").groupBy(*line_key).agg(
        F.max("reason_code").alias("return_reason_code"), F.max("reason").alias("return_reason"), F.max("dt").alias("return_date")
    )
    cancelled = t["canceled_sales"].join(chosen, line_key, "left_semi").groupBy(*line_key).agg(F.max("dt").alias("cancellation_date"))
    headers = t["sales_header"].join(orders, "order_number", "left_semi").select(
        "order_number", "email", F.col("ecom_order_number").alias("sfcc_order_number")
    )
    web = headers.select("sfcc_order_number")
    names = t["sfcc_order"].join(web, "sfcc_order_number", "left_semi").select("sfcc_order_number", "customer_name").join(
        t["sfcc_billing_address"].select("sfcc_order_number", "first_name", "last_name"), "sfcc_order_number", "left"
    )
    lines = (
        sold
        .join(sessions, "sku")
        .join(t["products"].select("sku", "short_description"), "sku", "left")
        .join(returned, line_key, "left")
        .join(cancelled, line_key, "left")
        .join(headers, "order_number", "left")
        .join(names, "sfcc_order_number", "left")
        .withColumn("customer_name", classes.resolve_name("customer_name", "first_name", "last_name", placeholder))
    )
    grain = [
        "order_number", "date_ordered", "email", "customer_name", "location_code", "sku", "short_description",
        "is_class_cancelled", "class_start_date",
    ]
    merged = keys.collapse(
        lines, grain,
        sums=["quantity", "quantity_shipped", "sub_total", "quantity_returned", "quantity_canceled"],
        maxes=[
            "is_return", "return_reason_code", "return_reason", "return_date", "is_canceled", "cancellation_reason_code",
            "cancellation_reason", "cancellation_date",
        ],
    )
    return classes.cancelled_lines(
        cut_lineage(merged), ["location_code", "class_start_date", "sku"], ["location_code", "class_start_date"],
        ["order_number", "sku", "date_ordered"],
    )


def class_fill_rate(t: RetailTables, first_start: datetime, last_start: datetime, skip_sku: str = "CSA%") -> DataFrame:
    """Seats sold, fill rate and revenue per class session, with district mean, total and rank."""
    sessions = (
        t["culinary_products"]
        .where(~F.col("sku").like(skip_sku) & F.col("start_date").between(moment(first_start), moment(last_start)))
        .select("sku", "location_code", "start_date", "maximum_seats", "price", "instructor_name", "is_class_cancelled")
        .join(t["locations"].select("location_code", F.col("name").alias("store_name"), "district_code"), "location_code", "left")
        .join(t["products"].select("sku", F.col("short_description").alias("class_name")), "sku", "left")
    )
    prices = (
        t["sales_header"].select("order_number", F.col("ecom_order_number").alias("sfcc_order_number"))
        .join(
            t["sfcc_order_item"].join(sessions.select("sku").distinct(), "sku", "left_semi").select(
                "sfcc_order_number", "sku", "unit_price"
            ),
            "sfcc_order_number",
        )
        .drop("sfcc_order_number")
    )
    filled = classes.fill_rate(sessions, t["sales_line"], prices)
    ranked = ordered_scan(
        cut_lineage(filled), [("fill_rate", "desc")], ["sku", "start_date", "location_code"], ["district_code"],
        {"revenue": "actual_revenue", "fill": "fill_rate"},
    )
    return ranked.select(
        "store_name", F.col("location_code").alias("store"), "district_code",
        F.to_date("start_date").alias("date_start"), F.date_format("start_date", "HH:mm:ss").alias("time_start"),
        F.col("sku").alias("class_sku"), "class_name", F.col("instructor_name").alias("chef_name"),
        F.col("maximum_seats").alias("max_seats"), F.col("paid_seats").alias("paid_in_full"), "available_seats",
        "fill_rate", "cost", F.col("potential_revenue").alias("potential"), F.col("actual_revenue").alias("actual"),
        "is_class_cancelled", F.col("total_revenue").alias("district_total_revenue"),
        ratio("total_fill", "group_rows").alias("district_avg_fill_rate"),
        F.col("rank").alias("fill_rate_rank_in_district"),
    )


def delivered_moves(t: RetailTables, days: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Deliveries and returns with the location and channel they count for; ``days`` limits both at the scan."""
    sold, returned = t["delivered_sales"], t["delivered_returns"]
    if days is not None:
        sold, returned = sold.where(days), returned.where(days)
    return net.attributed_sales(sold, t["sales_line"]), net.attributed_returns(returned, t["sales_line"], t["sales_header"])


#: Parts of the order lines that deliveries and returns are joined to one after the other, and parts of the days that are
#: netted one after the other. The disk that shuffles take at a time is divided by them; all rows go through.
LINE_PARTS, DAY_PARTS = 2, 8
MOVE_COLUMNS = [
    "date_analytics_id", "product_analytics_id", "attribution_location_analytics_id", "sales_channel",
    "quantity", "merchandise", "fair_market_value",
]
NET_KEYS = ["date_analytics_id", "department_id", "vendor_analytics_id", "attribution_location_analytics_id", "sales_channel"]
NET_SUMS = [f"{side}_{m}" for m in ("units", "dollars", "cost", "margin") for side in ("sales", "return")]


def written_moves(t: RetailTables, days: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``delivered_net`` needs of ``delivered_moves``, as tables in the shared folder.

    Lines are joined by parts of their ids, and each part's shuffle files are gone before the next one's are written.
    """
    sold, returned = t["delivered_sales"], t["delivered_returns"]
    if days is not None:
        sold, returned = sold.where(days), returned.where(days)
    headers, lines = t["sales_header"], t["sales_line"]

    def written(moves: DataFrame) -> DataFrame:
        return cut_lineage(moves.select(*MOVE_COLUMNS), "zstd")

    lookup = cut_lineage(net.channel_lookup(headers, lines, net.original_orders(returned)))
    some = [in_part("order_line_analytics_id", i, LINE_PARTS) for i in range(LINE_PARTS)]
    returns = [written(net.attributed_returns(returned.where(p), lines.where(p), headers, lookup=lookup)) for p in some]
    sales = [written(net.attributed_sales(sold.where(p), lines.where(p))) for p in some]
    return reduce(DataFrame.unionByName, sales), reduce(DataFrame.unionByName, returns)


def product_places(t: RetailTables) -> DataFrame:
    """Department and vendor of each product; products that only one of the two tables has are kept."""
    return t["product_to_merchandising_taxonomy"].select(
        "product_analytics_id", F.col("level_3_analytics_id").alias("department_id")
    ).join(t["products"].select("product_analytics_id", "vendor_analytics_id"), "product_analytics_id", "full_outer")


def delivered_net(sales: DataFrame, returns: DataFrame, products: DataFrame) -> DataFrame:
    """Deliveries and returns with department and vendor, netted per day, product, location and channel."""
    cost = zero_if_null("fair_market_value")
    # Netting per product first evens out popular products before the product dimensions are joined.
    per_product = net.net_of(
        sales, returns, ["date_analytics_id", "product_analytics_id", "attribution_location_analytics_id", "sales_channel"],
        {"units": "quantity", "dollars": "merchandise", "cost": cost, "margin": F.col("merchandise") - cost},
    )
    return per_product.join(products, "product_analytics_id", "left")


def _store_sums(netted: DataFrame) -> DataFrame:
    return netted.groupBy(*NET_KEYS).agg(*[F.sum(m).alias(m) for m in NET_SUMS])


def dated_net(sums: DataFrame, calendar: DataFrame) -> DataFrame:
    """The net of both sides and the date; the net of sums is the sum of nets, as no measure of ``net_of`` is null."""
    columns = []
    for m in ("units", "dollars", "cost", "margin"):
        sold, returned = F.col(f"sales_{m}"), F.col(f"return_{m}")
        columns += [sold, returned, (sold - returned).alias(f"net_{m}")]
    return sums.select(*NET_KEYS, *columns).join(calendar.select("date_analytics_id", "gregorian_date"), "date_analytics_id", "left")


def returns_by_store(t: RetailTables, days: Column | None = None) -> DataFrame:
    """Sales, returns and net by day, department, vendor, store and channel; ``days`` limits the facts at the scan."""
    return dated_net(_store_sums(delivered_net(*delivered_moves(t, days), product_places(t))), t["calendar"])


def store_sums_in_parts(t: RetailTables, write: Callable[[DataFrame, Column, int], None], days: Column | None = None, parts: int = DAY_PARTS) -> None:
    """Give ``write`` the sums that ``returns_by_store`` is made of, some days at a time.

    ``write`` also gets what these days are and the number of the part; it must write what it makes of them. Tables and
    shuffle files that a part needs are deleted before the next part, or at the end.
    """
    with copies_deleted_after(t.spark), shuffles_deleted_after_each(t.spark):
        sales, returns = written_moves(t, days)
        products = cut_lineage(product_places(t))
        for i in range(parts):
            some = in_part("date_analytics_id", i, parts)
            write(_store_sums(delivered_net(sales.where(some), returns.where(some), products)), some, i)


def written_returns_by_store(t: RetailTables) -> DataFrame:
    """``returns_by_store`` over facts of any size: its sums are written in parts to the shared folder and read from there."""
    path, kinds = new_copy(t.spark), []

    def write(sums: DataFrame, _: Column, part: int) -> None:
        kinds.append(sums.schema)
        sums.write.mode("append").option("compression", "zstd").parquet(path)

    store_sums_in_parts(t, write)
    return dated_net(t.spark.read.schema(kinds[0]).parquet(path), t["calendar"])


def returns_by_store_to_date(t: RetailTables, as_of: date) -> DataFrame:
    """Returns and net sales per store, week to year to date, this year and last."""
    periods = time.period_days(t["calendar"], as_of, cutoff=as_of)
    days = time.on_days(sorted({i for ids in periods.values() for i in ids}))
    sales, returns = delivered_moves(t, days)
    netted = net.net_of(
        sales, returns, ["date_analytics_id", "attribution_location_analytics_id"], {"dollars": "merchandise"}
    )
    return time.to_date_buckets(
        netted, periods, ["attribution_location_analytics_id"], {"returns": "return_dollars", "net": "net_dollars"}
    )


def sales_by_discount_code(
    t: RetailTables, as_of: date, cutoff: date, attribution: str = "once", channel: str = "1",
    departments: Sequence[int] = net.DEPARTMENTS,
) -> DataFrame:
    """Net sales by product and discount code, year to date for this year and last.

    ``attribution='once'`` counts a line under its first code only, ``'full'``
    under every one of its codes.
    """
    periods = time.period_days(t["calendar"], as_of, ["year"], cutoff=cutoff)
    sites = t["locations"].where(F.col("channel_analytics_id") == channel).select(
        F.col("location_analytics_id").alias("attribution_location_analytics_id")
    )
    products = t["product_to_merchandising_taxonomy"].where(F.col("level_3_analytics_id").isin(*departments)).select(
        "product_analytics_id", "level_3_analytics_id"
    )

    def relevant(df: DataFrame) -> DataFrame:
        return time.within(df, periods).join(products, "product_analytics_id", "left_semi")

    columns = ["date_analytics_id", "product_analytics_id", "order_line_analytics_id", "attribution_location_analytics_id"]
    sales = net.attributed_sales(relevant(t["delivered_sales"]), t["sales_line"])
    returns = net.attributed_returns(relevant(t["delivered_returns"]), t["sales_line"], t["sales_header"])
    moves = (
        sales.select(*columns, F.col("merchandise").alias("dollars"))
        .unionByName(returns.select(*columns, (-F.col("merchandise")).alias("dollars")))
        .join(sites, "attribution_location_analytics_id", "left_semi")
    )
    codes = t["pos_discounts"].select("order_line_analytics_id", "discount_code", "subdiscount_code")
    if attribution == "once":
        # The first code of a line, found with partial minima rather than a window.
        first = F.min(F.struct("discount_code", "subdiscount_code")).alias("code")
        codes = codes.groupBy("order_line_analytics_id").agg(first).select("order_line_analytics_id", "code.*")
    else:
        codes = codes.distinct()
    coded = moves.join(codes, "order_line_analytics_id", "left").select(
        "date_analytics_id", "product_analytics_id", "dollars",
        F.coalesce("discount_code", F.lit("No Discount")).alias("discount_code"),
        F.coalesce("subdiscount_code", F.lit("No Sub-Code")).alias("subdiscount_code"),
    )
    years = time.to_date_buckets(
        coded, periods, ["product_analytics_id", "discount_code", "subdiscount_code"], {"net_dollars": "dollars"}
    ).withColumnsRenamed({"net_dollars_year": "net_dollars_ty", "net_dollars_year_ly": "net_dollars_ly"})
    # Written once, then read for the department totals and for the rows.
    named = cut_lineage(
        years.join(products, "product_analytics_id")
        .join(t["products"].select("product_analytics_id", "product_name"), "product_analytics_id")
        .join(
            pricing.department_dim(t["merchandising_taxonomies"]).select(
                "level_3_analytics_id", F.col("department_name").alias("level_3_name"), F.col("department_code").alias("taxonomy_code")
            ),
            "level_3_analytics_id",
        )
    )
    return windows.share_of(
        named, "net_dollars_ty", ["level_3_analytics_id"], "discount_share_in_dept_ty", "_department"
    ).drop("_department")


def store_margin(
    t: RetailTables, as_of: date, first: date, last: date, channel: str = "1",
    departments: Sequence[int] = net.DEPARTMENTS, regions: Mapping = REGIONS, districts: Mapping = DISTRICTS,
    flag_stores: Sequence[int] = FLAG_STORES,
) -> DataFrame:
    """Store net sales and margins of a week by region, with region totals and rank.

    Net sales count the given departments and channel; the cost-adjusted margin
    counts everything, and stores of either are kept.
    """
    anchor = time.anchor_period(t["calendar"], as_of).select("fiscal_year")
    week = time.on_days(
        time.day_ids(
            t["calendar"].where(F.col("gregorian_date").between(F.lit(first), F.lit(last))).join(anchor, "fiscal_year", "left_semi")
        )
    )
    sales = net.attributed_sales(t["delivered_sales"].where(week), t["sales_line"])
    returns = net.attributed_returns(t["delivered_returns"].where(week), t["sales_line"], t["sales_header"])
    adjustments = t["cosa"].where(week).withColumnRenamed(
        "location_analytics_id", "attribution_location_analytics_id"
    )
    margin = F.col("merchandise") - zero_if_null("fair_market_value")
    per_product = net.net_with_cost_adjustment(
        sales, returns, adjustments, ["product_analytics_id", "attribution_location_analytics_id"],
        {"dollars": "merchandise", "margin": margin}, "dollars",
    ).withColumnRenamed("attribution_location_analytics_id", "location_analytics_id")
    department = t["product_to_merchandising_taxonomy"].where(F.col("level_3_analytics_id").isin(*departments)).select(
        "product_analytics_id", F.lit(True).alias("_counted")
    )
    sites = t["locations"].select("location_analytics_id", (F.col("channel_analytics_id") == channel).alias("_in_channel"))
    counted = F.col("_counted") & F.col("_in_channel") & (F.col("movements") > 0)
    stores = (
        per_product.join(department, "product_analytics_id", "left")
        .join(sites, "location_analytics_id", "left")
        .groupBy("location_analytics_id")
        .agg(
            F.sum(F.when(counted, F.col("net_dollars"))).alias("net_dollars"),
            F.sum("adjusted_margin").alias("adjusted_margin"),
            F.sum(F.when(counted, F.col("net_margin"))).alias("net_margin"),
        )
    )
    mapped = inventory.region_map(t["locations"], regions, districts, WAREHOUSE_REGION, OTHER_REGION, flag_stores)
    # One row per store: a region is a short list.
    rows = stores.join(mapped, "location_analytics_id")
    rows = windows.with_group_values(
        rows, ["region"], {"region_net_dollars": F.sum("net_dollars"), "region_net_margin": F.sum("net_margin")}, bounded=True
    )
    return windows.ranks(rows, "net_margin", ["location_analytics_id"], ["region"], bounded=True).drop(
        "row_number", "dense_rank"
    ).withColumnRenamed("rank", "store_rank_by_margin")
