"""What the lifecycle of customers needs of their past, as a small table that is added to.

Per customer: the first active period, the last, and the last one before that. States of any parts of the activity merge
into the state of the whole, in any order and with repeats, so a day's activity is added without reading the past again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import first_match


def state_of(activity: DataFrame, customer: Sequence[str], period: str) -> DataFrame:
    """``customer, first_period, last_period, previous_period`` (null for customers of one period)."""
    # Distinct first: a task keeps a customer's period once, however often the customer bought.
    seen = activity.where(F.col(period).isNotNull()).select(*customer, F.col(period).alias("_period")).distinct()
    periods = F.sort_array(F.collect_list("_period"), asc=False)
    return seen.groupBy(*customer).agg(periods.alias("_p")).select(
        *customer, F.element_at("_p", -1).alias("first_period"), F.get("_p", F.lit(0)).alias("last_period"),
        F.get("_p", F.lit(1)).alias("previous_period"),
    )


def merged_state(one: DataFrame, other: DataFrame, customer: Sequence[str]) -> DataFrame:
    """The state of both activities together."""
    kept = F.explode(F.array("first_period", "previous_period", "last_period")).alias("_at")
    return state_of(one.unionByName(other).select(*customer, kept), customer, "_at")


def lifecycle_of_state(
    state: DataFrame, customer: Sequence[str], period: int, n: int, labels: Sequence[str] = ("New", "Retained", "Reactivated"),
) -> DataFrame:
    """The customers active in ``period``, the last that the state has seen, as ``lifecycle_rolling`` labels them."""
    new, retained, reactivated = labels
    label = first_match(
        [(F.col("previous_period").isNull(), F.lit(new)), (F.col("last_period") - F.col("previous_period") <= n, F.lit(retained))],
        F.lit(reactivated),
    )
    return state.where(F.col("last_period") == period).select(*customer, F.col("last_period").alias("period"), label.alias("customer_type"))
