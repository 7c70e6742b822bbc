"""Customer reports: cohorts, frequency, lifecycle, class buyers, top customers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import matches_any, ratio, sum_when, zero_if_null
from ..functions.ordered import cut_lineage
from ..operators import customers, lifecycle, shaping, time, windows
from ..sources.catalog import RetailTables
from .parameters import FREQUENCY_CAP, FULL_PRICES, SPEND_EDGES, SPEND_LABELS

UNKNOWN = customers.UNKNOWN_CUSTOMER
CLASS_CATEGORY = "COOKING SCHOOL"
GIFT_GROUP = "GIFT CERTIFICATES"


def valid_orders(headers: DataFrame) -> DataFrame:
    """Purchases of known customers with a positive amount."""
    return headers.where(
        (F.col("target_key") != UNKNOWN) & (F.col("purchase_order") == "Y") & (F.col("net_amount") > 0)
    )


def with_year_curve(df: DataFrame, by: Sequence[str], measure: str, key: Sequence[str]) -> DataFrame:
    """Group total, share, rank and cumulative share of a small summary."""
    shared = windows.share_of(df, measure, by, "sales_share", "sales_total", bounded=True)
    ranked = windows.ranks(shared, measure, key, by, bounded=True).drop("row_number", "dense_rank")
    curve = windows.pareto(ranked, measure, key, by, bounded=True).drop("running", "total")
    return curve.withColumnsRenamed({"rank": "sales_rank", "cumulative_share": "cum_sales_share"})


def class_orders(headers: DataFrame) -> DataFrame:
    """Valid, uncancelled orders with at least one class seat, and their calendar year."""
    return (
        valid_orders(headers)
        .where((F.col("cooking_school_quantity") > 0) & (F.col("cancel_quantity") == 0))
        .withColumn("order_year", F.year("order_date").cast("bigint"))
    )


def cooking_class_cohorts(
    t: RetailTables, cap: int = FREQUENCY_CAP, full_prices: Sequence[float] = FULL_PRICES
) -> DataFrame:
    """Class customers by year, frequency, price mix and tenure, with shares and curve."""
    orders = class_orders(t["order_header"])
    lines = t["order_line"].where(F.col("net_amount") > 0).select("order_number", F.col("net_amount").alias("amount"), "price")
    mix = customers.price_mix(
        orders.select("order_number", "target_key", "order_year").join(lines, "order_number"),
        ["target_key", "order_year"], "price", "amount", full_prices,
    )
    # One row per customer and year: the window over a customer's years is small.
    yearly = orders.groupBy("target_key", "order_year").agg(
        F.countDistinct("order_number").alias("frequency"),
        F.sum("cooking_school_quantity").alias("cs_quantity"),
        F.sum("cooking_school_amount").alias("cs_sales"),
    ).withColumn("first_year", F.min("order_year").over(Window.partitionBy("target_key")))
    buckets = (
        yearly.join(mix, ["target_key", "order_year"], "left")
        .groupBy(
            "order_year",
            customers.cap_bucket("frequency", cap).alias("frequency_bucket"),
            "price_mix_type",
            customers.tenure_in_year("order_year", "first_year").alias("tenure_in_year"),
        )
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("cs_quantity").alias("total_cs_quantity"),
            F.sum("cs_sales").alias("total_cs_sales"),
            F.sum(zero_if_null("fullprice_sales")).alias("total_fullprice_sales"),
            F.sum(zero_if_null("sale_sales")).alias("total_sale_sales"),
        )
    )
    counted = windows.share_of(
        buckets, "customer_count", ["order_year"], "customer_share_in_year", "year_total_customers", bounded=True
    )
    curve = with_year_curve(
        counted, ["order_year"], "total_cs_sales", ["frequency_bucket", "price_mix_type", "tenure_in_year"]
    )
    return curve.withColumnsRenamed(
        {
            "sales_share": "sales_share_in_year", "sales_total": "year_total_cs_sales",
            "sales_rank": "sales_rank_in_year", "cum_sales_share": "cum_sales_share_in_year",
        }
    )


def cooking_class_first_years(t: RetailTables) -> DataFrame:
    """Class customers by the year of their first class."""
    return customers.first_period_cohort(class_orders(t["order_header"]), "target_key", "order_year").select(
        F.col("first_period").alias("first_year"), "cohort_customers", F.col("cohort_share").alias("cohort_customer_share")
    )


def customer_frequency_and_spend(
    t: RetailTables, cap: int = FREQUENCY_CAP, edges: Sequence[float] = SPEND_EDGES, labels: Sequence[str] = SPEND_LABELS
) -> DataFrame:
    """Customers by year, order frequency and spend band, with shares and curve."""
    orders = t["order_header"].where((F.col("target_key") != UNKNOWN) & (F.col("net_amount") > 0))
    yearly = customers.customer_period(orders, "target_key", "order_year", "order_number", "net_amount")
    # The mean of means is taken over exact decimals, so it does not depend on row order.
    mean = F.col("avg_order_value").cast("decimal(28,10)")
    grouped = yearly.groupBy(
        "order_year",
        customers.cap_bucket("frequency", cap).alias("frequency_bucket"),
        customers.band("sales", edges, labels).alias("sales_bucket"),
    ).agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("sales").alias("total_sales"),
        ratio(F.sum("sales"), F.count(F.lit(1))).alias("avg_sales_per_customer"),
        ratio(F.sum(mean), F.count(F.lit(1))).alias("avg_order_value_mean"),
    )
    counted = windows.share_of(
        grouped, "customer_count", ["order_year"], "customer_share", "year_customer_total", bounded=True
    )
    return with_year_curve(
        counted, ["order_year"], "total_sales", ["frequency_bucket", "sales_bucket"]
    ).withColumnRenamed("sales_total", "year_sales_total")


def sale_lines(
    t: RetailTables, sales: DataFrame, headers: DataFrame, periods: Sequence[str], skip_gift_cards: bool,
    patterns: Mapping[str, Sequence[str]] = lifecycle.MARKETPLACE_PATTERNS,
) -> DataFrame:
    """Sales with e-mail, channel type, product and period; marketplace orders left out.

    Each join is to a key that is unique on the other side, so no row repeats.
    """
    lines = t["sales_line"].select("order_line_analytics_id", F.col("order_analytics_id").alias("line_order"))
    excluded = lifecycle.marketplace_orders(t["sales_line"], patterns).withColumnRenamed("order_analytics_id", "line_order")
    taxonomy = t["product_to_merchandising_taxonomy"].select(
        "product_analytics_id", "level_3_name", "level_4_name", "level_5_name"
    )
    if skip_gift_cards:
        taxonomy = taxonomy.where(~F.col("level_4_name").like(GIFT_GROUP))
    days = t["calendar"].select(F.col("date_analytics_id").alias("date_ordered_analytics_id"), *periods)
    header = headers.select("order_analytics_id", "email", "source", "order_type")
    return (
        sales.select(
            "order_analytics_id", "order_line_analytics_id", "product_analytics_id", "date_ordered_analytics_id",
            "merchandise", "quantity",
        )
        .join(days, "date_ordered_analytics_id")
        .join(taxonomy, "product_analytics_id")
        .join(lines, "order_line_analytics_id")
        .join(excluded, "line_order", "left_anti")
        .join(header, "order_analytics_id")
    )


def lifecycle_totals(
    lines: DataFrame, period: str, n: int, labels: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Customers, orders, value and units per period, ``by`` and lifecycle segment in one pass.

    Lines are first summed per customer and period; an order has one customer,
    so order counts add up and no second read of the lines is needed to label
    them. An order without an e-mail is a customer of its own.
    """
    *active, anonymous = labels
    who = F.coalesce(F.col("email"), F.col("order_analytics_id").cast("string"))
    known = F.lit(True)
    for name in by:
        known = known & F.col(name).isNotNull()
    customer = [*by, "is_anonymous", "who"]
    summed = (
        lines.withColumn("is_anonymous", F.col("email").isNull())
        .where(F.col("is_anonymous") | known)
        .withColumn("who", who)
        .groupBy(*customer, period)
        .agg(
            F.countDistinct("order_analytics_id").alias("orders"),
            F.sum("merchandise").alias("value"),
            F.sum("quantity").alias("units"),
        )
    )
    previous = F.lag(period).over(Window.partitionBy(*customer).orderBy(period))
    label = (
        F.when(F.col("is_anonymous"), anonymous)
        .when(F.col("_previous").isNull(), active[0])
        .when(F.col(period) - F.col("_previous") <= n, active[1])
        .otherwise(active[2])
    )
    return (
        summed.withColumn("_previous", previous)
        .withColumn("customer_type", label)
        .groupBy(period, *by, "customer_type")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("orders").alias("order_count"),
            F.sum("value").alias("total_order_value"),
            F.sum("units").alias("total_units"),
        )
    )


def customer_segmentation_fiscal_year(t: RetailTables) -> DataFrame:
    """Lifecycle segments by fiscal year."""
    lines = sale_lines(t, t["written_sales"], t["sales_header"], ["fiscal_year"], skip_gift_cards=True)
    labels = ("New customer", "Retained customer", "Reactivated customer", "Anonymous customer")
    return lifecycle_totals(lines, "fiscal_year", 1, labels)


def customer_segmentation_channel_month(t: RetailTables) -> DataFrame:
    """Lifecycle segments by fiscal month and Direct or Retail, looking back twelve months."""
    headers = lifecycle.enrich_email(t["sales_header"])
    lines = sale_lines(t, t["written_sales"], headers, ["month_analytics_id"], skip_gift_cards=True)
    totals = lifecycle_totals(
        lines.withColumn("sales_channel_type", lifecycle.channel_type()),
        "month_analytics_id", 12, ("New", "Retained", "Reactivated", "Anonymous"), ["sales_channel_type"],
    )
    months = t["calendar"].select("month_analytics_id", "fiscal_month_id").distinct()
    return totals.join(months, "month_analytics_id").drop("month_analytics_id")


def customer_segmentation_channel_product_quarter(t: RetailTables, years: tuple[int, int] = (2019, 2026)) -> DataFrame:
    """Order value by quarter, channel, segment, customer, order and product category.

    The detail is written once to the shared folder and read for both the
    activity of customers and the labelled rows.
    """
    headers = lifecycle.with_anonymous_flag(lifecycle.enrich_email(t["sales_header"]), t["non_customer_emails"])
    named = headers.withColumn("email", F.when(~F.col("is_anonymous"), F.col("email")))
    lines = sale_lines(t, t["delivered_sales"], named, ["fiscal_quarter_id", "quarter_analytics_id"], skip_gift_cards=False)
    keys = ["fiscal_quarter_id", "quarter_analytics_id", "sales_channel_type", "email", "order_analytics_id", "product_category_flag"]
    detail = cut_lineage(
        lines.withColumn("sales_channel_type", lifecycle.channel_type())
        .withColumn("product_category_flag", lifecycle.product_category())
        .groupBy(*keys)
        .agg(F.sum("merchandise").alias("total_order_value_by_quarter"), F.sum("quantity").alias("total_units_by_quarter"))
    )
    known = detail.where(F.col("email").isNotNull() & F.col("sales_channel_type").isNotNull())
    customer = ["email", "sales_channel_type"]
    classes = lifecycle.lifecycle_rolling(known, customer, "quarter_analytics_id", 4)
    ids = lifecycle.surrogate_id(t["sales_header"], "email", "email_id")
    labelled = known.join(classes, [*customer, "quarter_analytics_id"]).join(ids, "email", "left")
    nameless = detail.where(F.col("email").isNull()).withColumn("customer_type", F.lit("Anonymous"))
    reporting = time.reporting_date(t["calendar"], t["fiscal_weeks"], 2, years).select("fiscal_quarter_id", "date_analytics_id")
    return (
        labelled.unionByName(nameless, allowMissingColumns=True)
        .join(reporting, "fiscal_quarter_id")
        .select(
            "fiscal_quarter_id", "date_analytics_id", "sales_channel_type", "customer_type",
            F.coalesce(F.col("email_id").cast("string"), F.col("order_analytics_id").cast("string")).alias("customer_identifier"),
            "order_analytics_id", "product_category_flag", "total_order_value_by_quarter", "total_units_by_quarter",
        )
    )


def merch_vs_culinary_customers(t: RetailTables, year: int) -> DataFrame:
    """Customers of a year by what they bought, with an all-customers row.

    Totals, shares and the curve leave the all-customers row out.
    """
    amount = zero_if_null("cooking_school_amount")
    orders = valid_orders(t["order_header"]).where(F.col("order_year") == year).join(
        t["target"].select("target_key"), "target_key", "left_semi"
    )
    per_customer = orders.groupBy("target_key").agg(
        F.countDistinct("order_number").alias("orders"),
        F.sum("net_amount").alias("sales"),
        F.sum(amount).alias("cs_sales"),
        F.sum(F.col("net_amount") - amount).alias("merch_sales"),
    )
    segment = customers.mix_segment("cs_sales", "merch_sales", ["Culinary+Merch", "CulinaryOnly", "NonCulinary", "Other"])
    rows = shaping.with_total(
        per_customer.withColumn("customer_segment", segment), ["customer_segment"], "customer_segment", "AllCustomers",
        [
            F.count(F.lit(1)).alias("customer_count"), F.sum("orders").alias("total_orders"),
            F.sum("sales").alias("total_sales"), F.sum("cs_sales").alias("total_cs_sales"),
            F.sum("merch_sales").alias("total_merch_sales"),
        ],
    )
    for name in ("customer_count", "total_sales"):
        rows = rows.withColumn(f"_{name}", F.when(~F.col("is_total"), F.col(name)))
    everything = Window.partitionBy()
    # A handful of segments: plain windows over the whole summary.
    order = Window.orderBy(F.col("_total_sales").desc_nulls_last())
    rows = rows.select(
        "*",
        F.sum("_customer_count").over(everything).alias("grand_customer_count"),
        F.sum("_total_sales").over(everything).alias("grand_total_sales"),
        F.rank().over(order).alias("sales_rank"),
        F.sum(zero_if_null("_total_sales")).over(
            Window.orderBy(F.col("_total_sales").desc_nulls_last(), "customer_segment").rowsBetween(
                Window.unboundedPreceding, Window.currentRow
            )
        ).alias("_running"),
    )
    return rows.select(
        "customer_segment", "customer_count", "total_orders", "total_sales", "total_cs_sales", "total_merch_sales",
        "grand_customer_count", "grand_total_sales",
        ratio("customer_count", "grand_customer_count").alias("customer_share"),
        ratio("total_sales", "grand_total_sales").alias("sales_share"),
        "sales_rank",
        ratio("_running", "grand_total_sales").alias("cum_sales_share"),
    )


def new_customers_rolling(t: RetailTables, as_of: date, weeks: int = 52) -> DataFrame:
    """Number of customers whose first own-channel order lies in the last full weeks."""
    products = t["product_to_merchandising_taxonomy"].where(~F.col("level_4_name").like(GIFT_GROUP))
    sold = t["written_sales"].join(products, "product_analytics_id", "left_semi")
    own = lifecycle.exclude_orders(
        t["sales_header"].where(F.col("email").isNotNull()), t["sales_line"], {"sales_channel": ("%amazon%",)}
    )
    orders = own.join(sold, "order_analytics_id", "left_semi")
    window = time.rolling_weeks(t["calendar"], as_of, weeks)
    return lifecycle.new_in_window(orders, t["calendar"], window, "email", "date_ordered_analytics_id")


def online_class_buyers(
    t: RetailTables, pattern: str = "%999%", limit_miles: float = 25, category: str = CLASS_CATEGORY
) -> DataFrame:
    """One wide row per buyer of online classes, ranked by online-class sales."""
    orders = valid_orders(t["order_header"]).where(F.col("cancel_quantity") == 0).select(
        "target_key", "order_number", "order_date", "net_amount", "net_quantity", "cooking_school_quantity",
        "cooking_school_amount", "sub_categories_purchased",
        (F.col("net_amount") - zero_if_null("cooking_school_amount")).alias("hg_amount"),
    )
    online = F.col("sub_categories_purchased").like(pattern)
    measures = {
        "sales": "net_amount", "units": "net_quantity", "class_units": "cooking_school_quantity",
        "class_sales": "cooking_school_amount", "hg_amount": "hg_amount",
    }
    # Online and overall measures of a customer come from one pass over the orders.
    metrics = orders.groupBy("target_key").agg(
        F.countDistinct(F.when(online, F.col("order_number"))).alias("occ_orders"),
        *[sum_when(online, c).alias(f"occ_{name}") for name, c in measures.items()],
        F.min(F.when(online, F.col("order_date"))).alias("first_occ_order_date"),
        F.max(F.when(online, F.col("order_date"))).alias("last_occ_order_date"),
        F.countDistinct("order_number").alias("total_orders"),
        *[F.sum(c).alias(f"total_{name}") for name, c in measures.items()],
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    ).where(F.col("occ_orders") > 0)
    cohort = customers.cohort_orders(orders, "target_key", "sub_categories_purchased", pattern).select(
        "target_key", "order_number", "order_date"
    )
    lines = (
        cohort.join(t["order_line"].select("order_number", F.col("item_number").alias("sku"), "net_amount"), "order_number")
        .join(t["product"].select("sku", "category_name"), "sku")
    )
    mix = customers.category_mix(lines, "target_key", "category_name", "net_amount", category).withColumnsRenamed(
        {"chosen_sales": "cs_category_sales", "other_sales": "non_cs_category_sales"}
    )
    recency = customers.recency_segment(cohort, "target_key", "order_date").select("target_key", "buying_segment")
    about = customers.proximity(t["target"], t["store_master"], limit_miles).select(
        "target_key", "email", "store_proximity", "culinary_proximity", "original_entered_date"
    )
    profile = (
        metrics.join(mix, "target_key", "left").join(recency, "target_key", "left").join(about, "target_key", "left")
    )
    tenure = F.when(
        F.col("store_proximity").isNotNull(),
        customers.tenure_since_order("original_entered_date", "first_occ_order_date"),
    )
    ranked = windows.ranked_curve(
        profile.withColumn("customer_tenure", tenure).drop("original_entered_date"), "occ_sales", ["target_key"]
    )
    return ranked.withColumnsRenamed(
        {
            "row_number": "occ_sales_rownum", "rank": "occ_sales_rank", "dense_rank": "occ_sales_dense_rank",
            "share": "occ_sales_share", "cumulative_share": "occ_cum_sales_share",
        }
    )


def allowed_activity(t: RetailTables) -> DataFrame:
    """E-mail and calendar year and month of delivered own sales."""
    lines = lifecycle.allowed_sales(t["sales_line"]).select("order_analytics_id", "order_line_analytics_id")
    orders = t["delivered_sales"].select("order_analytics_id", "order_line_analytics_id").join(
        lines, ["order_analytics_id", "order_line_analytics_id"], "left_semi"
    )
    return t["sales_header"].where(F.col("email").isNotNull()).join(orders, "order_analytics_id", "left_semi").select(
        "email", F.year("date_ordered").alias("order_year"), F.month("date_ordered").alias("order_month")
    )


def reactivated_customers_yearly(t: RetailTables) -> DataFrame:
    """Customers back after at least one year without an order, by year."""
    return lifecycle.reactivated(allowed_activity(t), "email", "order_year").withColumnRenamed("order_year", "year")


def retained_customers_monthly(t: RetailTables) -> DataFrame:
    """Customers of a month who also ordered the year before."""
    return lifecycle.retained(allowed_activity(t), "email", "order_year", "order_month").withColumnsRenamed(
        {"order_year": "year", "order_month": "month"}
    )


def top_classes(t: RetailTables, year: int, category: str = CLASS_CATEGORY, top: int = 10) -> DataFrame:
    """Classes by sales for new, existing and all customers of a year.

    Grand totals leave the all-customers rows out.
    """
    orders = valid_orders(t["order_header"]).where(
        (F.col("order_year") == year) & (F.col("cooking_school_amount") > 0)
    ).select("order_number", "target_key")
    lines = t["order_line"].where(F.col("net_amount") > 0).select(
        "order_number", F.col("item_number").alias("sku"), "net_amount", "net_quantity"
    )
    tenure = t["target"].select("target_key", customers.tenure_by_year("original_entered_date", year).alias("customer_tenure"))
    facts = (
        lines.join(t["product"].where(F.col("category_name") == category).select("sku", "class_name"), "sku")
        .join(orders, "order_number")
        .join(tenure, "target_key")
    )
    rows = shaping.with_total(
        facts, ["class_name", "customer_tenure"], "customer_tenure", "All",
        [
            F.sum("net_amount").alias("sales"), F.sum("net_quantity").alias("quantity"),
            F.countDistinct("target_key").alias("distinct_customers"),
            F.countDistinct("order_number").alias("distinct_orders"),
        ],
    )
    # Classes are a catalogue, so a tenure group is a short list.
    rows = windows.with_group_values(
        rows, [],
        {
            "sales_all_groups": sum_when(~F.col("is_total"), "sales"),
            "qty_all_groups": sum_when(~F.col("is_total"), "quantity"),
        },
        bounded=True,
    )
    by = ["customer_tenure"]
    rows = windows.share_of(rows, "quantity", by, "qty_share_within_tenure", "qty_by_tenure", bounded=True)
    rows = with_year_curve(rows, by, "sales", ["class_name"])
    return rows.select(
        "customer_tenure", "class_name", "sales", "quantity", "distinct_customers", "distinct_orders",
        F.col("sales_total").alias("sales_by_tenure"), "qty_by_tenure", "sales_all_groups", "qty_all_groups",
        zero_if_null("sales_share").alias("sales_share_within_tenure"),
        zero_if_null("qty_share_within_tenure").alias("qty_share_within_tenure"),
        F.col("sales_rank").alias("sales_rank_within_tenure"),
        F.col("cum_sales_share").alias("cum_sales_share_within_tenure"),
        windows.top_flag("sales_rank", top).alias("top_flag"),
    )


def yearly_rules(thresholds: Mapping[int, float | None], max_orders: int = 50) -> dict[str, Column]:
    """One rule per year: sales at or above the threshold, if any, and not more than ``max_orders``."""
    rules = {}
    for year, threshold in thresholds.items():
        rule = (F.col("order_year") == year) & (F.col("frequency") <= max_orders)
        rules[str(year)] = rule if threshold is None else rule & (F.col("sales") >= threshold)
    return rules


def top_customers(
    t: RetailTables, thresholds: Mapping[int, float | None], internal_patterns: Sequence[str], excluded: DataFrame,
    n: int = 5000,
) -> DataFrame:
    """The ``n`` best contactable customers who met the rule of every year, with ranks and curve.

    Orders are summed once per customer and year; lifetime totals add those up,
    so the order table is read a single time.
    """
    orders = valid_orders(t["order_header"])
    yearly = customers.customer_period(orders, "target_key", "order_year", "order_number", "net_amount")
    rules = yearly_rules(thresholds)
    flags = yearly.groupBy("target_key").agg(
        F.sum("frequency").alias("total_orders"),
        F.sum("sales").alias("total_sales"),
        *[F.bool_or(rule).alias(f"ok_{name}") for name, rule in rules.items()],
    )
    passed = F.lit(True)
    for name in rules:
        passed = passed & F.col(f"ok_{name}")
    eligible = flags.where(passed).select("target_key", "total_orders", "total_sales")
    people = customers.contactable(t["target"], internal_patterns, excluded).select(
        "target_key", "first_name", "last_name", "email"
    )
    candidates = eligible.join(people, "target_key")
    # Ranks and the curve of the first n need only these rows and one total over all.
    total = eligible.join(people.select("target_key"), "target_key").agg(F.sum("total_sales")).scalar()
    best = windows.top_n(candidates, "total_sales", n, ["target_key"]).withColumn("_total", total)
    ranked = windows.pareto(windows.ranks(best, "total_sales", ["target_key"], bounded=True), "total_sales", ["target_key"], bounded=True)
    return ranked.withColumn("sales_share", ratio("total_sales", "_total")).withColumn(
        "cum_sales_share", ratio("running", "_total")
    ).drop("row_number", "running", "total", "cumulative_share", "_total").withColumnsRenamed(
        {"rank": "sales_rank", "dense_rank": "sales_dense_rank"}
    )
