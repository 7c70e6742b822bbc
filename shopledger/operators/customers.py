"""Customer value and profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, first_match, matches_any, ratio, sum_when, zero_if_null
from .windows import share_of

UNKNOWN_CUSTOMER = -1


def customer_period(orders: DataFrame, customer: str, period: str, order: str, amount: str) -> DataFrame:
    """Distinct orders, sales and mean order value per customer and period."""
    return orders.groupBy(customer, period).agg(
        F.countDistinct(order).alias("frequency"),
        F.sum(amount).alias("sales"),
        ratio(F.sum(amount), F.count(amount)).alias("avg_order_value"),
    )


def cap_bucket(n: str | Column, cap: int) -> Column:
    """1 to ``cap``, and ``cap + 1`` for everything above."""
    return F.least(col(n), F.lit(cap + 1)).cast("bigint")


def band(x: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Labelled bands with inclusive upper edges; the last label is open-ended."""
    return first_match([(col(x) <= edge, F.lit(label)) for edge, label in zip(edges, labels)], F.lit(labels[-1]))


def first_period(orders: DataFrame, customer: str, period: str) -> DataFrame:
    """First active period per customer."""
    return orders.groupBy(customer).agg(F.min(period).alias("first_period"))


def first_period_cohort(orders: DataFrame, customer: str, period: str) -> DataFrame:
    """Cohort size by first active period, and its share of all customers."""
    sizes = first_period(orders, customer, period).groupBy("first_period").agg(F.count(F.lit(1)).alias("cohort_customers"))
    return share_of(sizes, "cohort_customers", share="cohort_share", total="all_customers", bounded=True)


def price_band(price: str | Column, full_prices: Sequence[float]) -> Column:
    """FullPrice when the price is on the list, else Sale."""
    return F.when(col(price).isin(*full_prices), "FullPrice").otherwise("Sale")


def price_mix(
    lines: DataFrame, keys: Sequence[str], price: str, amount: str, full_prices: Sequence[float]
) -> DataFrame:
    """Full-price and sale dollars with an only/mixed label."""
    full = price_band(price, full_prices) == "FullPrice"
    sums = lines.groupBy(*keys).agg(
        zero_if_null(sum_when(full, amount)).alias("fullprice_sales"),
        zero_if_null(sum_when(~full, amount)).alias("sale_sales"),
    )
    full_sales, sale_sales = F.col("fullprice_sales"), F.col("sale_sales")
    return sums.withColumn(
        "price_mix_type",
        first_match(
            [
                ((full_sales > 0) & (sale_sales == 0), F.lit("FullPriceOnly")),
                ((full_sales == 0) & (sale_sales > 0), F.lit("SaleOnly")),
                ((full_sales > 0) & (sale_sales > 0), F.lit("Mixed")),
            ],
            F.lit("Unknown"),
        ),
    )


def tenure_in_year(year: str | Column, first_year: str | Column) -> Column:
    """Whether a year is the customer's first, a later or an earlier one."""
    return first_match(
        [(col(year) == col(first_year), F.lit("FirstYear")), (col(year) > col(first_year), F.lit("PostFirstYear"))],
        F.lit("PreFirstYear"),
    )


def mix_segment(part_a: str | Column, part_b: str | Column, labels: Sequence[str]) -> Column:
    """Label for both parts bought, only A, no A, anything else."""
    both, only_a, no_a, other = labels
    a, b = col(part_a), col(part_b)
    return first_match(
        [((a > 0) & (b > 0), F.lit(both)), ((a > 0) & (b == 0), F.lit(only_a)), (a == 0, F.lit(no_a))], F.lit(other)
    )


def matching_orders(orders: DataFrame, codes: str, pattern: str) -> DataFrame:
    """Orders whose code list is LIKE the pattern."""
    return orders.where(F.col(codes).like(pattern))


def cohort_orders(orders: DataFrame, customer: str, codes: str, pattern: str) -> DataFrame:
    """Every order of the customers with at least one order matching the pattern."""
    cohort = matching_orders(orders, codes, pattern).select(customer).distinct()
    return orders.join(cohort, customer, "left_semi")


def proximity(customers: DataFrame, stores: DataFrame, limit_miles: float = 25) -> DataFrame:
    """Near or not near a store, and whether the closest store teaches classes."""
    return customers.join(stores, F.col("closest_store_id") == F.col("store_id")).select(
        *customers.columns,
        F.when(F.col("miles_to_closest_store") < limit_miles, "NEAR STORE").otherwise("NOT NEAR STORE").alias(
            "store_proximity"
        ),
        F.when(F.col("culinary") == "Y", "CULINARY").otherwise("NO CULINARY").alias("culinary_proximity"),
    )


def tenure_since_order(entered: str | Column, first_order: str | Column) -> Column:
    """New when the customer was entered on the day of the first order."""
    return F.when(col(entered).cast("date") == col(first_order).cast("date"), "New").otherwise("Existing")


def tenure_by_year(entered: str | Column, year: int) -> Column:
    """New when the customer was entered in the given year."""
    return F.when(F.year(col(entered)) == year, "New").otherwise("Existing")


def category_mix(lines: DataFrame, customer: str, category: str, amount: str, chosen: str) -> DataFrame:
    """Distinct categories, and sales inside and outside the chosen one."""
    return lines.groupBy(customer).agg(
        F.countDistinct(category).alias("distinct_categories"),
        F.sum(amount).alias("category_sales"),
        zero_if_null(sum_when(F.col(category) == chosen, amount)).alias("chosen_sales"),
        zero_if_null(sum_when(F.col(category) != chosen, amount)).alias("other_sales"),
    )


def recency_segment(orders: DataFrame, customer: str, ordered: str) -> DataFrame:
    """Gap in days between the last order and the one before, and its segment.

    Orders are first counted per customer and day, so the window sees at most
    one row per day however many orders a customer has. Two orders on the last
    day make a gap of zero; it and a single order get the text '(null)'.
    """
    days = orders.groupBy(customer, F.to_date(ordered).alias("_day")).agg(F.count(F.lit(1)).alias("_orders"))
    newest = Window.partitionBy(customer).orderBy(F.col("_day").desc_nulls_last())
    two = days.withColumn("_position", F.row_number().over(newest)).where(F.col("_position") <= 2)
    per_customer = two.groupBy(customer).agg(
        F.max(F.when(F.col("_position") == 1, F.col("_day"))).alias("last_order_date"),
        F.max(F.when(F.col("_position") == 1, F.col("_orders"))).alias("_on_last_day"),
        F.max(F.when(F.col("_position") == 2, F.col("_day"))).alias("_day_before"),
    )
    previous = F.when(F.col("_on_last_day") > 1, F.col("last_order_date")).otherwise(F.col("_day_before"))
    gap = F.col("days_since_prev")
    return (
        per_customer.withColumn("prev_order_date", previous)
        .withColumn("days_since_prev", F.datediff("last_order_date", "prev_order_date").cast("bigint"))
        .withColumn(
            "buying_segment",
            first_match(
                [
                    (gap.between(1, 365), F.lit("ACTIVE")),
                    (gap.between(366, 730), F.lit("LAPSED")),
                    (gap > 730, F.lit("DEEP LAPSED")),
                ],
                F.lit("(null)"),
            ),
        )
        .drop("_on_last_day", "_day_before")
    )


def qualify_all_periods(periods: DataFrame, customer: str, rules: Mapping[str, Column]) -> DataFrame:
    """Customers for whom each rule holds in at least one of their periods."""
    flags = periods.groupBy(customer).agg(*[F.bool_or(F.coalesce(rule, F.lit(False))).alias(f"ok_{name}") for name, rule in rules.items()])
    passed = F.lit(True)
    for name in rules:
        passed = passed & F.col(f"ok_{name}")
    return flags.where(passed).select(customer)


def contactable(
    customers: DataFrame, internal_patterns: Sequence[str], excluded: DataFrame, key: str = "target_key"
) -> DataFrame:
    """Customers with a valid e-mail who did not opt out, are not internal and not excluded."""
    usable = customers.where(
        F.col("email").isNotNull()
        & ~matches_any("email", internal_patterns)
        & (F.col("email_valid_syntax") == 1)
        & (F.col("do_not_email") != "Y")
    )
    return usable.join(excluded.select(key).where(F.col(key).isNotNull()), key, "left_anti")
