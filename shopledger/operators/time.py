"""Fiscal periods, last-year alignment, day filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col

DAY = "date_analytics_id"
#: Up to so many runs of consecutive days are written as ranges, more as a set; both are exact.
MOST_RANGES = 32

# Calendar column that identifies each period.
PERIOD_COLUMN = {
    "week": "fiscal_week_id",
    "month": "fiscal_month_id",
    "quarter": "fiscal_quarter_id",
    "year": "fiscal_year",
}


def anchor_period(calendar: DataFrame, as_of: date, lag_days: int = 7) -> DataFrame:
    """Fiscal ids of the day ``lag_days`` before ``as_of``; one row."""
    return calendar.where(F.col("gregorian_date") == F.lit(as_of - timedelta(days=lag_days))).select(
        DAY,
        *PERIOD_COLUMN.values(),
        "fiscal_season_id",
        (F.col("fiscal_week_id") % 100).alias("week_in_year"),
    )


def align_last_year(fact: DataFrame, calendar: DataFrame, day: str = DAY) -> DataFrame:
    """Re-date a fact to this year: each day moves to the day that points back at it.

    Days without such a pointer drop out, as they have no counterpart.
    """
    moved = calendar.select(
        F.col("last_year_date_analytics_id").alias(day), F.col(DAY).alias("_this_year_day")
    )
    others = [c for c in fact.columns if c != day]
    return fact.join(moved, day).select(F.col("_this_year_day").alias(day), *others)


def day_ids(days: DataFrame, column: str = DAY) -> list[int]:
    """Day ids of a calendar selection, brought to the driver so that they can filter scans.

    A calendar has one row per day whatever the size of the facts; the number of days is not limited.
    """
    rows = days.select(column).where(F.col(column).isNotNull()).distinct().collect()
    return sorted(row[0] for row in rows)


def runs(ids: Sequence[int]) -> list[tuple[int, int]]:
    """First and last id of every run of consecutive ids."""
    found: list[tuple[int, int]] = []
    for i in sorted(set(ids)):
        if found and found[-1][1] == i - 1:
            found[-1] = (found[-1][0], i)
        else:
            found.append((i, i))
    return found


def on_days(ids: Sequence[int], day: str = DAY) -> Column:
    """Whether a row lies on one of the days, as ranges of consecutive ids that reach the scan."""
    ranges = runs(ids)
    if not ranges:
        return F.lit(False)
    whole = F.col(day).between(ranges[0][0], ranges[-1][1])
    if len(ranges) > MOST_RANGES:
        return whole & F.col(day).isin(*ids)
    return whole & reduce(or_, [F.col(day).between(*r) for r in ranges]) if len(ranges) > 1 else whole


def days_between(calendar: DataFrame, first: date, last: date, column: str = DAY) -> list[int]:
    """Ids of the days from ``first`` to ``last``; ``column`` may name the last-year pointer."""
    return day_ids(calendar.where(F.col("gregorian_date").between(F.lit(first), F.lit(last))), column)


def period_days(
    calendar: DataFrame, as_of: date, periods: Sequence[str] = ("week", "month", "quarter", "year"),
    lag_days: int = 7, cutoff: date | None = None,
) -> dict[str, list[int]]:
    """Day ids of each period to date, and under ``<period>_ly`` the days they point back to."""
    anchor = anchor_period(calendar, as_of, lag_days)
    # Every period lies inside its fiscal year, so an equality on the year finds all days.
    days = calendar.join(
        anchor.select("fiscal_year", *[F.col(PERIOD_COLUMN[p]).alias(f"_at_{p}") for p in periods if p != "year"]),
        "fiscal_year",
    ).where(F.col("gregorian_date") <= F.lit(cutoff) if cutoff else F.lit(True))
    flags = [F.lit(True) if p == "year" else F.col(PERIOD_COLUMN[p]) == F.col(f"_at_{p}") for p in periods]
    rows = days.select(DAY, "last_year_date_analytics_id", *flags).distinct().collect()
    result = {}
    for index, p in enumerate(periods, start=2):
        result[p] = sorted({row[0] for row in rows if row[index]})
        result[f"{p}_ly"] = sorted({row[1] for row in rows if row[index] and row[1] is not None})
    return result


def within(fact: DataFrame, periods: Mapping[str, Sequence[int]], day: str = DAY) -> DataFrame:
    """Rows of a fact on any of the periods' days."""
    return fact.where(on_days(sorted({i for ids in periods.values() for i in ids}), day))


def to_date_buckets(
    fact: DataFrame, periods: Mapping[str, Sequence[int]], keys: Sequence[str],
    measures: Mapping[str, str | Column], day: str = DAY,
) -> DataFrame:
    """Week-, month-, quarter- and year-to-date sums for this year and last.

    ``periods`` comes from :func:`period_days`. The fact is scanned and shuffled
    once whatever the number of periods, and not joined to the calendar at all.
    Keys seen only last year are kept. Columns: ``<measure>_<period>`` and
    ``<measure>_<period>_ly``; null where no row of the period exists.
    """
    flagged = within(fact, periods, day)
    for p, ids in periods.items():
        flagged = flagged.withColumn(f"_in_{p}", on_days(ids, day))
    return flagged.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col(f"_in_{p}"), col(measure))).alias(f"{name}_{p}")
            for name, measure in measures.items()
            for p in periods
        ]
    )


def to_date_every_day(
    fact: DataFrame, calendar: DataFrame, keys: Sequence[str], measures: Mapping[str, str | Column],
    first: date, last: date, periods: Sequence[str] = ("week", "month", "quarter", "year"), day: str = DAY,
) -> DataFrame:
    """``to_date_buckets`` of every day from ``first`` to ``last``, from one pass over the fact.

    Sums per key and day are added up along the days of a key, and a period to date is the sum so far less the sum
    before the period began. What a day points back to a year before is added up along the same days. One row per day
    and key that has a row in the fiscal year to date or in the days it points back to: ``gregorian_date``, ``keys``,
    ``<measure>_<period>`` and ``<measure>_<period>_ly``. A key has as many rows as days, so no window is large.
    """
    shown = F.col("gregorian_date").between(F.lit(first), F.lit(last))
    years = calendar.where(shown).select("fiscal_year").distinct()
    days = calendar.join(years, "fiscal_year", "left_semi").where(F.col("gregorian_date") <= F.lit(last))
    days = days.select(DAY, "last_year_date_analytics_id", "gregorian_date", *[PERIOD_COLUMN[p] for p in periods])
    rows = days.select(DAY, "last_year_date_analytics_id", "gregorian_date").collect()  # calendar rows
    ids = sorted({r[0] for r in rows} | {r[1] for r in rows if r[1] is not None})
    names = list(measures)
    limited = fact.where(on_days(ids, day))
    daily = limited.groupBy(*keys, F.col(day).alias("_day")).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(col(m)).alias(f"_s_{n}") for n, m in measures.items()], *[F.count(col(m)).alias(f"_c_{n}") for n, m in measures.items()],
    )
    # Each day's sums count on their own day, and on the days that point back to it.
    points = days.select(F.col(DAY).alias("_day"), "gregorian_date", F.lit("").alias("_side")).unionByName(
        days.where("last_year_date_analytics_id is not null").select(F.col("last_year_date_analytics_id").alias("_day"), "gregorian_date", F.lit("_ly").alias("_side"))
    )
    moved = daily.join(points, "_day")
    sides = ("", "_ly")
    sums = [f"_{kind}_{n}" for kind in "sc" for n in names]
    placed = moved.select(
        *keys, "gregorian_date", "_rows", *[F.when(F.col("_side") == s, F.col(c)).alias(f"{c}{s}") for c in sums for s in sides]
    )
    all_days = F.sequence(F.lit(min(r[2] for r in rows)), F.lit(max(r[2] for r in rows))) if rows else F.array().cast("array<date>")
    grid = placed.select(*keys).distinct().select(*keys, F.explode(all_days).alias("gregorian_date"))
    dense = placed.unionByName(grid, allowMissingColumns=True).groupBy(*keys, "gregorian_date").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["_rows", *[f"{c}{s}" for c in sums for s in sides]]]
    ).join(days.drop(DAY, "last_year_date_analytics_id"), "gregorian_date")
    along = Window.partitionBy(*keys).orderBy("gregorian_date")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ["_rows", *[f"{c}{s}" for c in sums for s in sides]]
    summed = dense.select(
        "*", *[F.sum(c).over(so_far).alias(f"{c}_all") for c in totals],
        *[(F.lag(PERIOD_COLUMN[p]).over(along).eqNullSafe(F.col(PERIOD_COLUMN[p]))).alias(f"_same_{p}") for p in dict.fromkeys([*periods, "year"]) if p in periods],
    )

    def to_date(column: str, period: str) -> Column:
        begun = F.when(~F.col(f"_same_{period}"), F.col(f"{column}_all") - F.col(column))
        return F.col(f"{column}_all") - F.last(begun, ignorenulls=True).over(so_far)

    out = [
        F.when(to_date(f"_c_{n}{s}", p) > 0, to_date(f"_s_{n}{s}", p)).alias(f"{n}_{p}{s}") for n in names for p in periods for s in sides
    ]
    present = to_date("_rows", "year") > 0 if "year" in periods else F.col("_rows_all") > 0
    return summed.select("gregorian_date", *keys, *out, present.alias("_present")).where(F.col("_present") & shown).drop("_present")


def fiscal_weeks(calendar: DataFrame) -> DataFrame:
    """First and last day of every fiscal week."""
    return calendar.groupBy(
        "fiscal_year", "fiscal_quarter_id", "quarter_analytics_id", "fiscal_month_id",
        "month_analytics_id", "fiscal_week_id", "week_analytics_id",
    ).agg(
        F.min("fiscal_date_id").alias("start_fiscal_date_id"),
        F.min(DAY).alias("start_date_analytics_id"),
        F.max("fiscal_date_id").alias("end_fiscal_date_id"),
        F.max(DAY).alias("end_date_analytics_id"),
    )


def rolling_weeks(calendar: DataFrame, as_of: date, n: int = 52) -> DataFrame:
    """The ``n`` full fiscal weeks before the week of ``as_of``."""
    current = calendar.where(F.col("gregorian_date") == F.lit(as_of)).select("fiscal_week_id").scalar()
    return (
        calendar.where(F.col("fiscal_week_id") < current)
        .select("fiscal_week_id")
        .distinct()
        .orderBy(F.col("fiscal_week_id").desc())
        .limit(n)
    )


def reporting_date(
    calendar: DataFrame, weeks: DataFrame, week_in_quarter: int = 2, years: tuple[int, int] | None = None
) -> DataFrame:
    """Last day of the given week of each fiscal quarter."""
    chosen = weeks.where(F.col("week_in_quarter") == week_in_quarter)
    if years:
        chosen = chosen.where(F.col("fiscal_year").between(*years))
    return (
        chosen.select("fiscal_year", "fiscal_quarter_id", "quarter_analytics_id", "fiscal_week_id")
        .join(calendar.select("fiscal_week_id", DAY, "gregorian_date"), "fiscal_week_id")
        .groupBy("fiscal_year", "fiscal_quarter_id", "quarter_analytics_id")
        .agg(F.max(DAY).alias(DAY), F.max("gregorian_date").alias("gregorian_date"))
    )


def between_days(df: DataFrame, ts: str, first: date, last: date) -> DataFrame:
    """Rows from the start of ``first`` to the end of ``last``.

    A half-open range on the raw column, so the filter reaches the scan.
    """
    return df.where(in_dates(ts, first, last))


def in_dates(ts: str, first: date, last: date) -> Column:
    """The same range as a condition."""
    return (F.col(ts) >= F.lit(first)) & (F.col(ts) < F.lit(last + timedelta(days=1)))


def on_day(df: DataFrame, ts: str, as_of: date, offset: int = -1) -> DataFrame:
    """Rows of one day, by default the day before ``as_of``."""
    day = as_of + timedelta(days=offset)
    return between_days(df, ts, day, day)


def hourly(df: DataFrame, ts: str, measure: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Sum by date and hour."""
    return df.groupBy(
        *keys, F.to_date(ts).alias("order_date"), F.hour(ts).cast("bigint").alias("order_hour")
    ).agg(F.sum(col(measure)).alias("demand"))
