"""The daily reports that re-read yesterday, as incremental queries over a stream.

The same sums as the batch operators, kept by Structured Streaming state and
closed by a watermark. The caller chooses source, sink and checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col


def hourly_demand_stream(
    events: DataFrame, ts: str, measure: str | Column, keys: Sequence[str] = (), lateness: str = "1 hour"
) -> DataFrame:
    """Demand by date and hour of a stream; rows later than ``lateness`` are dropped.

    State holds one row per open hour and key.
    """
    hour = F.window("_event_time", "1 hour")
    timed = events.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", lateness)
    return (
        timed.groupBy(*keys, hour.alias("_hour"))
        .agg(F.sum(col(measure)).alias("demand"))
        .select(
            *keys, F.to_date("_hour.start").alias("order_date"), F.hour("_hour.start").cast("bigint").alias("order_hour"), "demand"
        )
    )


def daily_totals_stream(
    events: DataFrame, ts: str, measure: str | Column, keys: Sequence[str], lateness: str = "1 day"
) -> DataFrame:
    """Redemptions and value per day and key of a stream, as the daily redemption report counts them."""
    day = F.window("_event_time", "1 day")
    timed = events.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", lateness)
    return (
        timed.groupBy(*keys, day.alias("_day"))
        .agg(F.count(F.lit(1)).alias("total_redemptions"), F.sum(col(measure)).alias("total_discount"))
        .select(*keys, F.to_date("_day.start").alias("order_date"), "total_redemptions", "total_discount")
    )
