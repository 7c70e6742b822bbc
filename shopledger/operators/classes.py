"""Bookable class sessions: seats, names, cancelled lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, ratio, zero_if_null
from ..functions.ordered import ordered_scan
from .windows import with_group_values


def fill_rate(sessions: DataFrame, lines: DataFrame, item_prices: DataFrame) -> DataFrame:
    """Paid seats, seats left, fill rate, actual and potential revenue per session.

    ``sessions`` has one row per sku, start and location. Lines count unless
    returned or cancelled; only those of the sessions' skus are read on, and they
    are summed per sku first, so a popular class is one row when it meets its sessions. ``item_prices`` has one row per order
    number and sku.
    """
    wanted = sessions.select("sku").distinct()
    usable = lines.join(wanted, "sku", "left_semi").where(
        (F.coalesce("is_return", F.lit("")) != "TRUE") & (F.coalesce("is_canceled", F.lit("")) != "TRUE")
    ).select("sku", "order_number", "quantity", "sub_total")
    priced = usable.join(item_prices, ["order_number", "sku"], "left")
    per_sku = priced.groupBy("sku").agg(
        F.sum(zero_if_null("quantity")).alias("_paid"),
        F.sum(zero_if_null("sub_total")).alias("_actual"),
        ratio(F.sum("unit_price"), F.count("unit_price")).alias("_mean_price"),
    )
    seats, paid = F.col("maximum_seats"), F.col("paid_seats")
    return (
        sessions.join(per_sku, "sku", "left")
        .withColumn("paid_seats", zero_if_null("_paid"))
        .withColumn("actual_revenue", zero_if_null("_actual"))
        .withColumn("cost", F.coalesce(F.col("_mean_price"), F.col("price").cast("double")))
        .withColumn("available_seats", seats - paid)
        .withColumn("fill_rate", F.when(seats == 0, F.lit(0)).otherwise((paid / F.nullif(seats, F.lit(0))).cast("decimal(10,4)")))
        .withColumn(
            "potential_revenue",
            F.col("actual_revenue").cast("double") + F.col("available_seats").cast("double") * F.col("cost"),
        )
        .drop("_paid", "_actual", "_mean_price")
    )


def resolve_name(
    name: str | Column, first: str | Column, last: str | Column, placeholder: str
) -> Column:
    """Replace the placeholder customer name by trimmed first and last name."""
    full = F.trim(F.concat(F.coalesce(col(first), F.lit("")), F.lit(" "), F.coalesce(col(last), F.lit(""))))
    return F.when(col(name) == placeholder, full).otherwise(col(name))


def cancelled_lines(lines: DataFrame, class_keys: Sequence[str], rank_keys: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Seat price, net quantity and extended price per line, with class totals and rank.

    A class may sell any number of seats: totals are aggregated and joined back,
    ranks come from a distributed scan.
    """
    net = F.col("quantity") - F.col("quantity_returned") - F.col("quantity_canceled")
    seat_price = F.when(F.col("quantity") == 0, F.lit(0.0)).otherwise(ratio("sub_total", "quantity"))
    priced = (
        lines.withColumn("seat_price", seat_price)
        .withColumn("net_quantity", net)
        .withColumn("extended_price", net.cast("double") * seat_price)
    )
    ranked = ordered_scan(priced, [("sub_total", "desc")], key, rank_keys).drop("row_number", "dense_rank", "group_rows")
    return with_group_values(
        ranked.withColumnRenamed("rank", "rank_in_class"), class_keys,
        {"class_revenue": F.sum("sub_total"), "class_net_quantity": F.sum("net_quantity")}, source=priced,
    )
