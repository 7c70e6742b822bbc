"""Fiscal calendar: one row per day with period ids and a last-year pointer."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F


def fiscal_calendar(
    spark: SparkSession, start: date, first_year: int, weeks_per_year: Sequence[int]
) -> DataFrame:
    """Calendar of consecutive fiscal years of 52 or 53 weeks starting at ``start``.

    Quarters have 13 weeks split 4-5-4; a 53rd week joins the last month. The
    last-year pointer goes back 364 days, so weekdays line up. The row count is
    seven times the number of weeks, known to the planner from ``range``.
    """
    first_week = [sum(weeks_per_year[:i]) for i in range(len(weeks_per_year))]
    week = F.floor(F.col("id") / 7)
    year_index = F.lit(0)
    week_start = F.lit(0)
    for index, offset in enumerate(first_week[1:], start=1):
        year_index = F.when(week >= offset, index).otherwise(year_index)
        week_start = F.when(week >= offset, offset).otherwise(week_start)
    days = spark.range(7 * sum(weeks_per_year)).select(
        "id",
        week.alias("week"),
        year_index.cast("bigint").alias("year_index"),
        (week - week_start + 1).alias("week_of_year"),
    )
    quarter = F.least(F.floor((F.col("week_of_year") - 1) / 13) + 1, F.lit(4))
    days = days.withColumn("quarter", quarter)
    in_quarter = F.col("week_of_year") - 13 * (F.col("quarter") - 1)
    month = F.when(in_quarter <= 4, 1).when(in_quarter <= 9, 2).otherwise(3) + 3 * (F.col("quarter") - 1)
    year = first_year + F.col("year_index")
    day = F.date_add(F.lit(start), F.col("id").cast("int"))
    day_id = F.unix_date(day).cast("bigint")
    return days.select(
        day_id.alias("date_analytics_id"),
        day.alias("gregorian_date"),
        day_id.alias("fiscal_date_id"),
        year.alias("fiscal_year"),
        (year * 100 + F.col("quarter")).alias("fiscal_quarter_id"),
        (F.col("year_index") * 4 + F.col("quarter")).alias("quarter_analytics_id"),
        (year * 100 + month).alias("fiscal_month_id"),
        (F.col("year_index") * 12 + month).alias("month_analytics_id"),
        (year * 100 + F.col("week_of_year")).alias("fiscal_week_id"),
        F.col("week").alias("week_analytics_id"),
        (year * 10 + F.floor((F.col("quarter") + 1) / 2)).alias("fiscal_season_id"),
        (day_id - 364).alias("last_year_date_analytics_id"),
        in_quarter.alias("week_in_quarter"),
    )
