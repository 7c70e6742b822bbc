"""Daily KPI sheets: today and two-day columns, demand classes, plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, zero_if_null
from .net import net_of
from .shaping import merge_wide, pivot_when
from .time import days_between, on_days


def day_and_two_day(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, str | Column], today: Column, both: Column
) -> DataFrame:
    """Each measure on the day and on the day and the one before: ``<m>_day``, ``<m>_2day``.

    ``today`` and ``both`` are conditions on the raw day column, so other days
    are dropped at the scan; a column without a row is null.
    """
    columns = {}
    for name, measure in measures.items():
        columns[f"{name}_day"] = (today, measure)
        columns[f"{name}_2day"] = (F.lit(True), measure)
    return pivot_when(df.where(both), keys, columns)


def split_by_existence(lines: DataFrame, orders: DataFrame, keys: Sequence[str], flag: str = "is_dropship") -> DataFrame:
    """Flag lines that have a matching purchase order; both halves come from one pass."""
    known = orders.select(*keys).distinct().withColumn("_found", F.lit(True))
    return lines.join(known, list(keys), "left").select(*lines.columns, F.col("_found").isNotNull().alias(flag))


def demand_classes(
    lines: DataFrame, rules: Mapping[int, Column], measure: str = "merchandise", day: str = "date_analytics_id"
) -> DataFrame:
    """Demand per day and class; a line counts in every class whose rule it meets.

    All classes are conditional sums of one scan, then turned into rows.
    """
    sums = [F.sum(F.when(F.coalesce(rule, F.lit(False)), F.col(measure))).alias(str(c)) for c, rule in rules.items()]
    wide = lines.groupBy(day).agg(*sums)
    long = wide.unpivot([day], [str(c) for c in rules], "class_id", "dollars").where(F.col("dollars").isNotNull())
    return long.withColumn("class_id", F.col("class_id").cast("bigint"))


def demand_vs_plan(
    calendar: DataFrame, plan: DataFrame, demand: DataFrame, classes: Mapping[int, tuple[str | None, str | None]],
    days: tuple[date, date] | None = None, day: str = "date_analytics_id",
) -> DataFrame:
    """Every day with every class: forecast, budget and actual demand, zero where missing.

    ``classes`` maps a class id to its forecast and budget columns in the wide plan.
    """
    dense = calendar.where(F.col("gregorian_date").between(*map(F.lit, days))) if days else calendar
    per_class = dense.join(plan, day, "left").select(
        day,
        "gregorian_date",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).cast("bigint").alias("class_id"),
                        *[
                            (F.col(name) if name else F.lit(0)).cast("decimal(18,4)").alias(alias)
                            for name, alias in zip(names, ("forecast_demand", "budgeted_demand"))
                        ],
                    )
                    for c, names in classes.items()
                ]
            )
        ).alias("c"),
    ).select(day, "gregorian_date", "c.*")
    return per_class.join(demand, [day, "class_id"], "left").select(
        day,
        "gregorian_date",
        "class_id",
        *[zero_if_null(m).alias(m) for m in ("forecast_demand", "budgeted_demand", "dollars")],
    )


def discount_net(
    sales: DataFrame, returns: DataFrame, discounts: DataFrame, prefix: str, keys: Sequence[str]
) -> DataFrame:
    """Net sales of lines carrying a discount code that starts with ``prefix``.

    A line counts once per matching code; orders are distinct sales orders plus
    distinct return orders.
    """
    codes = discounts.where(F.col("discount_code").startswith(prefix)).select("order_line_analytics_id")
    sides = []
    for df in (sales, returns):
        sides.append(
            df.join(codes, "order_line_analytics_id")
            .groupBy(*keys)
            .agg(
                F.sum("merchandise").alias("dollars"),
                F.sum("quantity").alias("units"),
                F.countDistinct("order_analytics_id").alias("orders"),
            )
        )
    net = net_of(sides[0], sides[1], keys, {"dollars": "dollars", "units": "units", "orders": "orders"})
    return net.select(
        *keys,
        F.col("net_dollars"),
        F.col("net_units"),
        (F.col("sales_orders") + F.col("return_orders")).alias("orders"),
    )


def store_kpis(
    facts: Mapping[str, tuple[DataFrame, Mapping[str, str]]], calendar: DataFrame, as_of: date,
    key: str = "location_analytics_id",
) -> DataFrame:
    """Today and two-day columns of several store-day facts side by side; every store of any fact is kept.

    Each fact is limited to the two days by id at its scan.
    """
    both = days_between(calendar, as_of - timedelta(days=1), as_of)
    today = days_between(calendar, as_of, as_of)
    sheets = [
        day_and_two_day(df, [key], measures, on_days(today), on_days(both)) for df, measures in facts.values()
    ]
    return merge_wide([key], *sheets)
