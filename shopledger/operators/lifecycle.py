"""Customer lifecycle: new, retained, reactivated, anonymous."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, first_match, matches_any
from ..functions.ordered import ordered_scan

# Patterns that mark a marketplace line.
MARKETPLACE_PATTERNS = {
    "sales_channel": ("%amazon%", "%amzbopis%"),
    "order_line_type": ("%amazon%",),
}

# Combinations of source, channel and line type that count as own sales;
# a null channel stands for any.
ALLOWED_SALES = (
    ("xcenter", None, "in_store_sale"),
    ("oroms", "web", "ecommerce"),
    ("oroms", "culinary_orders", "ecommerce"),
    ("oroms", "slt_bopis", "bopis"),
    ("oroms", "walmart_go_local", "bopis"),
    ("oroms", "customer_service", "phone"),
    ("oroms", "culinary_orders", "phone"),
)


def with_previous_period(activity: DataFrame, customer: Sequence[str], period: str) -> DataFrame:
    """Distinct activity with the customer's previous active period, null for the first.

    After ``distinct`` a customer has at most one row per period, so the window
    is small for every customer.
    """
    distinct = activity.select(*customer, period).distinct()
    window = Window.partitionBy(*customer).orderBy(period)
    return distinct.withColumn("previous_period", F.lag(period).over(window))


def lifecycle_rolling(
    activity: DataFrame, customer: Sequence[str], period: str, n: int,
    labels: Sequence[str] = ("New", "Retained", "Reactivated"),
) -> DataFrame:
    """New, retained (active within the last ``n`` periods) or reactivated, per customer and period.

    ``period`` must be a dense id, so that subtracting counts periods.
    """
    new, retained, reactivated = labels
    label = first_match(
        [
            (F.col("previous_period").isNull(), F.lit(new)),
            (F.col(period) - F.col("previous_period") <= n, F.lit(retained)),
        ],
        F.lit(reactivated),
    )
    return with_previous_period(activity, customer, period).withColumn("customer_type", label).drop("previous_period")


def lifecycle_by_year(activity: DataFrame, customer: str = "email", year: str = "fiscal_year") -> DataFrame:
    """New, retained (active the year before) or reactivated (active earlier only) by year."""
    return lifecycle_rolling(
        activity, [customer], year, 1, ("New customer", "Retained customer", "Reactivated customer")
    )


def segment_totals(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Customers, orders, value and units per segment; an order without an e-mail is a customer of its own."""
    who = F.coalesce(F.col("email"), F.col("order_analytics_id").cast("string"))
    return lines.groupBy(*keys).agg(
        F.countDistinct(who).alias("customer_count"),
        F.countDistinct("order_analytics_id").alias("order_count"),
        F.sum("merchandise").alias("total_order_value"),
        F.sum("quantity").alias("total_units"),
    )


def channel_type(source: str | Column = "source", order_type: str | Column = "order_type") -> Column:
    """Direct or Retail."""
    kind = col(order_type)
    return first_match(
        [
            ((col(source) == "oroms") | kind.like("%bopis%") | (kind == "ship_from_store"), F.lit("Direct")),
            (col(source) == "xcenter", F.lit("Retail")),
        ],
        F.lit(None),
    )


def anonymous_orders(orders: DataFrame, blocklist: DataFrame | None = None, email: str = "email") -> DataFrame:
    """Rows without an e-mail or with one that is known not to be a customer's."""
    return with_anonymous_flag(orders, blocklist, email).where("is_anonymous").drop("is_anonymous")


def with_anonymous_flag(orders: DataFrame, blocklist: DataFrame | None = None, email: str = "email") -> DataFrame:
    """Flag for the same rule, so that one pass serves named and anonymous rows."""
    if blocklist is None:
        return orders.withColumn("is_anonymous", F.col(email).isNull())
    blocked = blocklist.select(F.col("email").alias(email)).where(F.col(email).isNotNull()).distinct()
    return orders.join(blocked.withColumn("_blocked", F.lit(True)), email, "left").select(
        *orders.columns, (F.col(email).isNull() | F.col("_blocked").isNotNull()).alias("is_anonymous")
    )


def enrich_email(headers: DataFrame) -> DataFrame:
    """Give a store pick-up order the e-mail of its online order.

    Only pick-up orders go through the join, against one row per online order
    number; all other orders pass by untouched.
    """
    pickup = F.coalesce(
        (F.col("source") == "xcenter") & (F.col("order_type") == "bopis") & F.col("alt_order_number_1").isNotNull(),
        F.lit(False),
    )
    online = (
        headers.where((F.col("source") == "oroms") & F.col("order_type").like("%bopis%"))
        .groupBy(F.col("order_number").alias("alt_order_number_1"))
        .agg(F.max("email").alias("_online_email"))
    )
    picked_up = (
        headers.where(pickup)
        .join(online, "alt_order_number_1", "left")
        .withColumn("email", F.coalesce("email", "_online_email"))
        .select(*headers.columns)
    )
    return headers.where(~pickup).unionByName(picked_up)


def marketplace_orders(
    lines: DataFrame, patterns: Mapping[str, Sequence[str]] = MARKETPLACE_PATTERNS
) -> DataFrame:
    """Ids of orders with at least one marketplace line."""
    hit = F.lit(False)
    for name, values in patterns.items():
        hit = hit | matches_any(name, values)
    return lines.where(hit & F.col("order_analytics_id").isNotNull()).select("order_analytics_id").distinct()


def exclude_orders(
    df: DataFrame, lines: DataFrame, patterns: Mapping[str, Sequence[str]] = MARKETPLACE_PATTERNS
) -> DataFrame:
    """Drop every row of an order that has any marketplace line."""
    return df.join(marketplace_orders(lines, patterns), "order_analytics_id", "left_anti")


def surrogate_id(df: DataFrame, value: str, name: str = "surrogate_id") -> DataFrame:
    """Dense number per distinct non-null value, in value order."""
    distinct = df.where(F.col(value).isNotNull()).select(value).distinct()
    return ordered_scan(distinct, [value], [value]).select(value, F.col("row_number").alias(name))


def first_orders(orders: DataFrame, customer: str, day: str) -> DataFrame:
    """First order day per customer."""
    return orders.where(F.col(customer).isNotNull()).groupBy(customer).agg(F.min(day).alias("first_order_day"))


def new_in_window(orders: DataFrame, calendar: DataFrame, weeks: DataFrame, customer: str, day: str) -> DataFrame:
    """Number of customers whose first order lies in one of the given fiscal weeks."""
    days = calendar.join(weeks, "fiscal_week_id", "left_semi").select(F.col("date_analytics_id").alias("first_order_day"))
    return (
        first_orders(orders, customer, day)
        .join(days, "first_order_day", "left_semi")
        .agg(F.count(F.lit(1)).alias("new_customers"))
    )


def reactivated(activity: DataFrame, customer: str, period: str) -> DataFrame:
    """Customers per period who were absent the period before but active earlier."""
    gap = F.col(period) - F.col("previous_period") > 1
    return (
        with_previous_period(activity, [customer], period)
        .where(gap)
        .groupBy(period)
        .agg(F.count(F.lit(1)).alias("reactivated_customers"))
    )


def retained(activity: DataFrame, customer: str, year: str, month: str) -> DataFrame:
    """Customers per month who were active in any month of the year before."""
    months = activity.select(customer, year, month).distinct()
    next_year = months.select(customer, (F.col(year) + 1).alias(year)).distinct()
    return (
        months.join(next_year, [customer, year], "left_semi")
        .groupBy(year, month)
        .agg(F.count(F.lit(1)).alias("retained_customers"))
    )


def allowed_sales(lines: DataFrame, allowed: Sequence[tuple[str, str | None, str]] = ALLOWED_SALES) -> DataFrame:
    """Lines whose source, channel and type are on the allow-list.

    The list is short and fixed, so it is a filter that reaches the scan.
    """
    keep = F.lit(False)
    for source, channel, kind in allowed:
        rule = (F.col("source") == source) & (F.col("order_line_type") == kind)
        keep = keep | (rule if channel is None else rule & (F.col("sales_channel") == channel))
    return lines.where(keep)


def product_category(level_5_name: str | Column = "level_5_name", level_3_name: str | Column = "level_3_name") -> Column:
    """Warranty, gift card, class or hard good; the first match wins."""
    return first_match(
        [
            (col(level_5_name) == "WARRANTY", F.lit("Warranty")),
            (col(level_3_name) == "GIFT CERTIFICATES", F.lit("GiftCard")),
            (col(level_3_name) == "COOKING SCHOOL", F.lit("CulinaryClass")),
        ],
        F.lit("HardGood"),
    )
