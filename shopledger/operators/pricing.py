"""Prices, price types, receipt age, departments, collections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, first_match
from .keys import latest_per_key

# Price types in report order, then departments by merchandise group.
PRICE_TYPE_ORDER = ("regular_price", "promotional_sale", "markdown_sale", "marked_out_of_stock", "other")
MERCH_GROUPS = {
    "Entertaining": (500007, 500010, 250007, 500012, 8),
    "Kitchen": (500005, 250003, 3, 500006, 250004, 250005, 6, 500008, 4, 500004),
}

# Price types told by the last cents, and 13-week receipt-age buckets.
PRICE_ENDINGS = {
    "id": {"6": 3, "9": 2, "01": 4, "none": 5, "regular": 1},
    "code": {"6": "POS", "9": "MKD", "01": "MOS", "none": "NP", "regular": "REG"},
    "description": {"6": "POS", "9": "Markdown", "01": "MOS", "none": "No Price", "regular": "Regular"},
}
RECEIPT_AGES = (
    (91, 5, "Aged Last 13 Weeks"),
    (182, 4, "Aged 14 - 26 Weeks"),
    (273, 3, "Aged 27 - 39 Weeks"),
    (364, 2, "Aged 40 - 52 Weeks"),
)
OLDEST_RECEIPT = (1, "Aged Greater than 52 Weeks")


def current_price(products: DataFrame, history: DataFrame) -> DataFrame:
    """Products with ``current_retail_price``: the newest known price, else the list price."""
    newest = latest_per_key(
        history.select("product_analytics_id", "snapshot_date", "price"),
        ["product_analytics_id"], ["snapshot_date"], ["price"],
    ).select("product_analytics_id", F.col("price").alias("_newest_price"))
    return products.join(newest, "product_analytics_id", "left").select(
        *products.columns, F.coalesce("_newest_price", "retail_price").alias("current_retail_price")
    )


def price_ending_type(price: str | Column, part: str = "code") -> Column:
    """Price type by the last cents: ``part`` is 'id', 'code' or 'description'."""
    value = col(price).cast("decimal(18,2)")
    cents = F.floor(value * 100)
    label = {k: F.lit(v) for k, v in PRICE_ENDINGS[part].items()}
    return first_match(
        [
            (value.isNull(), label["none"]),
            (cents % 10 == 6, label["6"]),
            (cents % 10 == 9, label["9"]),
            (cents % 100 == 1, label["01"]),
        ],
        label["regular"],
    )


def days_since(day: str | Column, as_of: date) -> Column:
    return F.datediff(F.lit(as_of), col(day)).cast("bigint")


def age_bucket(day: str | Column, as_of: date, part: str = "label") -> Column:
    """13-week bucket of the days since ``day``; an unknown day falls in the oldest bucket."""
    index = 2 if part == "label" else 1
    oldest = OLDEST_RECEIPT[1] if part == "label" else OLDEST_RECEIPT[0]
    return first_match([(days_since(day, as_of) <= row[0], F.lit(row[index])) for row in RECEIPT_AGES], F.lit(oldest))


def price_info(products: DataFrame, history: DataFrame, as_of: date) -> DataFrame:
    """Current price, its type and the age of the last receipt, per product."""
    priced = current_price(products, history)
    return priced.select(
        "product_analytics_id",
        "current_retail_price",
        "last_receipt_date",
        days_since("last_receipt_date", as_of).alias("last_receipt_age"),
        price_ending_type("current_retail_price", "id").cast("bigint").alias("current_price_type_id"),
        price_ending_type("current_retail_price", "code").alias("current_price_type_code"),
        price_ending_type("current_retail_price", "description").alias("current_price_type_description"),
        age_bucket("last_receipt_date", as_of, "id").cast("bigint").alias("receipt_age_bucket_id"),
        age_bucket("last_receipt_date", as_of).alias("receipt_age_bucket"),
    )


def price_type_on_day(fact: DataFrame, history: DataFrame) -> DataFrame:
    """Add the price type of the product on the fact's day, 'other' when unknown.

    The history has one row per product and day.
    """
    types = history.select("product_analytics_id", "date_analytics_id", "price_type")
    return fact.join(types, ["product_analytics_id", "date_analytics_id"], "left").withColumn(
        "price_type", F.coalesce("price_type", F.lit("other"))
    )


def price_type_order(price_type: str | Column) -> Column:
    """Position of a price type in the report; unknown types come last."""
    return first_match(
        [(col(price_type) == name, F.lit(i).cast("bigint")) for i, name in enumerate(PRICE_TYPE_ORDER, start=1)],
        F.lit(len(PRICE_TYPE_ORDER) + 1).cast("bigint"),
    )


def department_dim(taxonomy: DataFrame, groups: Mapping[str, Sequence[int]] = MERCH_GROUPS) -> DataFrame:
    """Level-3 taxonomy rows with a numeric code and a merchandise group."""
    department = F.col("taxonomy_analytics_id")
    group = first_match([(department.isin(*ids), F.lit(name)) for name, ids in groups.items()], F.lit("Other"))
    return taxonomy.where(F.col("level") == 3).select(
        department.alias("level_3_analytics_id"),
        F.col("parent_taxonomy_analytics_id").alias("division_id"),
        F.col("name").alias("department_name"),
        F.col("taxonomy_code").cast("bigint").alias("department_code"),
        group.alias("merch_group"),
    )


def collection_dim(
    products: DataFrame, taxonomy: DataFrame, departments: DataFrame, attributes: DataFrame, collections: DataFrame
) -> DataFrame:
    """Collection code and largest collection name per product and department."""
    named = (
        products.select("product_analytics_id")
        .join(taxonomy.select("product_analytics_id", "level_3_analytics_id"), "product_analytics_id")
        .join(departments.select("level_3_analytics_id", "department_code"), "level_3_analytics_id")
        .join(attributes.select("product_analytics_id", "collection"), "product_analytics_id")
    )
    names = collections.groupBy("collection", F.col("department").cast("bigint").alias("department_code")).agg(
        F.max("collection_name").alias("collection_name")
    )
    return (
        named.join(names, ["collection", "department_code"], "left")
        .groupBy("product_analytics_id", "collection", "department_code", "level_3_analytics_id")
        .agg(F.max("collection_name").alias("collection_name"))
    )
