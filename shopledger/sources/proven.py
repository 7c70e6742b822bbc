"""Retail tables whose dimensions prove their keys while they are read.

A dimension that has a key twice would multiply the facts joined to it, and no total would show why. Here such a row
fails the query, or the write, that reads it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from .catalog import RetailTables

#: The keys that every join in the reports takes as unique.
UNIQUE: Mapping[str, Sequence[str]] = {
    "calendar": ["date_analytics_id"],
    "locations": ["location_analytics_id"],
    "products": ["product_analytics_id"],
    "product_to_merchandising_taxonomy": ["product_analytics_id"],
    "sales_line": ["order_line_analytics_id"],
    "sales_header": ["order_analytics_id"],
    "vendors": ["vendor_analytics_id"],
    "channels": ["channel_analytics_id"],
    "target": ["target_key"],
    "store_master": ["store_id"],
    "product": ["sku"],
    "product_price_history": ["product_analytics_id", "date_analytics_id"],
}


def prove_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """``df`` as it is; reading it fails if a key without nulls occurs twice.

    The check is a filter, so it is made whatever columns are used.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    number = "_times"
    while number in df.columns:
        number = "_" + number
    counted = df.withColumn(number, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    refused = F.raise_error(F.concat(F.lit(f"{name} has a key more than once: "), shown)).cast("boolean")
    return counted.where(F.when(known & (F.col(number) > 1), refused).otherwise(F.lit(True))).drop(number)


def proven(t: RetailTables, unique: Mapping[str, Sequence[str]] = UNIQUE) -> RetailTables:
    """The same tables, those in ``unique`` with proof of their keys; for any report."""
    return RetailTables(t.spark, lambda name: prove_unique(t[name], unique[name], name) if name in unique else t[name])
