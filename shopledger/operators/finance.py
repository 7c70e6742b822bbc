"""Tender chains, contacts, card payments, discount attribution."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import total_order, zero_if_null
from .keys import latest_per_key
from .time import between_days

# Key of a till transaction, the system user, and the cheque tender.
TRANSACTION_KEYS = ("organization_id", "rtl_loc_id", "business_date", "wkstn_id", "trans_seq")
SYSTEM_USER = "DATALOADER"
CHEQUE_TENDER = "HOME_OFFICE_CHECK"


def by_people(df: DataFrame, user: str = "create_user_id") -> DataFrame:
    """Rows not written by the system user; rows without a user drop out too."""
    return df.where(F.col(user) != SYSTEM_USER)


def tender_chain(
    transactions: DataFrame, retail: DataFrame, cheques: DataFrame, tenders: DataFrame, items: DataFrame,
    first: date, last: date, tender: str = CHEQUE_TENDER,
) -> DataFrame:
    """Mailed-cheque tender lines of completed transactions in a date range.

    All five tables share the transaction key, so after the first shuffle the
    joins reuse one partitioning.
    """
    key = list(TRANSACTION_KEYS)
    base = between_days(by_people(transactions), "create_date", first, last).where(
        (F.col("trans_statcode") == "COMPLETE") & (F.col("post_void_flag") == 0)
    )
    payee = [
        "payable_to_name", "payable_to_address",
        F.coalesce("payable_to_address2", "payable_to_apt").alias("payable_to_apartment"),
        "payable_to_city", "payable_to_state", "payable_to_postal_code", "payable_to_country",
    ]
    lines = by_people(tenders).where(F.col("tndr_id") == tender).select(*key, "rtrans_lineitm_seq", "amt", "tndr_id")
    valid = by_people(items).where(F.col("void_flag") == 0).select(*key, "rtrans_lineitm_seq")
    return (
        base.select(*key, "create_date")
        .join(by_people(retail).select(*key, "cust_party_id"), key)
        .join(by_people(cheques).select(*key, *payee), key)
        .join(lines, key)
        .join(valid, [*key, "rtrans_lineitm_seq"])
        .withColumn("amount", F.abs("amt"))
        .drop("amt")
    )


def preferred_contact(phones: DataFrame) -> DataFrame:
    """Best phone number per party: flagged first, then newest, then the largest number."""
    known = phones.where(F.col("telephone_number").isNotNull())
    return latest_per_key(
        known.select("party_id", "contact_flag", "create_date", "telephone_number"),
        ["party_id"], ["contact_flag", "create_date"], ["telephone_number"],
    ).select("party_id", "telephone_number")


def payment_lines(
    orders: DataFrame, headers: DataFrame, lines: DataFrame, items: DataFrame, payments: DataFrame,
    sessions: DataFrame, card: str, product_type: str, first: date, last: date,
) -> DataFrame:
    """Order lines paid by one card type for one product type, ordered in a date range.

    Every side is reduced to the grain it is joined at, so lines do not repeat.
    """
    web = between_days(orders, "order_date", first, last).select("sfcc_order_number", "order_date", "customer_name")
    cards = payments.where(F.col("card_type") == card).select("sfcc_order_number", "card_type", "last_4").distinct()
    header = headers.select(
        F.col("ecom_order_number").alias("sfcc_order_number"), "order_number", F.col("source").alias("order_source")
    )
    item = (
        items.where(F.col("product_type") == product_type)
        .groupBy("sfcc_order_number", "sku")
        .agg(F.min("product_name").alias("product_name"), F.min("product_type").alias("product_type"))
    )
    line = lines.select(
        "order_number", "order_line_analytics_id", "line_id", "sku", "is_return", "is_canceled", "quantity",
        "unit_price", "sub_total",
    )
    session = sessions.select("sku", "class_type", "start_date", "end_date", "is_class_cancelled")
    return (
        web.join(cards, "sfcc_order_number")
        .join(header, "sfcc_order_number")
        .join(line, "order_number")
        .join(item, ["sfcc_order_number", "sku"])
        .join(session, "sku", "left")
    )


def discount_attribution(
    facts: DataFrame, discounts: DataFrame, keys: Sequence[str], line: str = "order_line_analytics_id"
) -> DataFrame:
    """Facts per line and discount code, with a 1/0 factor that is 1 once per line.

    Multiplying units and dollars by the factor counts a line once, while the
    discount amounts of all its codes add up.
    """
    codes = discounts.groupBy(line, "discount_code", "subdiscount_code").agg(F.sum("discount_amount").alias("discount_dollars"))
    per_code = (
        facts.join(codes, line, "left")
        .groupBy(
            *keys, line,
            F.coalesce("discount_code", F.lit("No Discount")).alias("discount_code"),
            F.coalesce("subdiscount_code", F.lit("No Sub-Code")).alias("subdiscount_code"),
        )
        .agg(
            F.sum("merchandise").alias("dollars"),
            F.sum("quantity").alias("units"),
            F.sum(F.col("merchandise") - zero_if_null("fair_market_value")).alias("margin"),
            F.sum(zero_if_null("fair_market_value")).alias("cost"),
            zero_if_null(F.sum("discount_dollars")).alias("discount_dollars"),
        )
    )
    # A line has as many rows as it has codes, so the window is small.
    first = Window.partitionBy(*keys, line).orderBy(*total_order(["discount_code", "subdiscount_code"]))
    return per_code.withColumn("unique_factor", F.when(F.row_number().over(first) == 1, 1).otherwise(0).cast("bigint"))
