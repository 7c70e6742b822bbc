"""Net sales and time operators on hand-made rows."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from found import rows
from shopledger.operators import net, time
from shopledger.sources.calendar import fiscal_calendar
from shopledger.sources.driver_views import from_driver

KEYS = ["day", "store"]


def test_remap_return_location(make):
    df = make(
        "location int, channel string",
        (904, "web"), (904, "phone"), (904, None), (904, "pos"), (7, "web"),
    )
    got = df.select(
        "channel", "location",
        net.remap_return_location("location", "channel").alias("listed"),
        net.remap_return_location("location", "channel", channels=None).alias("any"),
    )
    assert rows(got) == [
        (None, 904, 904, 904), ("phone", 904, 904, 2), ("pos", 904, 904, 904), ("web", 7, 7, 7), ("web", 904, 2, 2),
    ]


def test_original_channel(make):
    returns = make(
        "order_line_analytics_id string, original_order_analytics_id bigint, product_analytics_id bigint",
        ("a", 1, 10), ("b", 1, 11), ("c", 9, 10), ("d", None, 10), ("e", 2, 10),
    )
    headers = make("order_analytics_id bigint, source string", (1, "oroms"), (2, "xcenter"))
    lines = make(
        "order_analytics_id bigint, product_analytics_id bigint, source string, sales_channel string",
        (1, 10, "oroms", "phone"), (1, 10, "oroms", "web"), (1, 10, "xcenter", "zzz"), (2, 10, "oroms", "web"),
    )
    got = net.original_channel(returns, headers, lines)
    assert rows(got, "order_line_analytics_id", "original_channel") == [
        ("a", "web"), ("b", None), ("c", None), ("d", None), ("e", None),
    ]


def test_net_of_keeps_both_sides_and_null_keys(make):
    sales = make("day int, store string, amount double", (1, "a", 10.0), (1, "a", 5.0), (1, None, 3.0))
    returns = make(
        "day int, store string, amount double", (1, "a", 4.0), (1, "a", 1.0), (2, "b", 7.0), (1, None, 1.0)
    )
    got = net.net_of(sales, returns, KEYS, {"d": "amount"})
    assert rows(got, "day", "store", "sales_d", "return_d", "net_d") == [
        (1, None, 3.0, 1.0, 2.0), (1, "a", 15.0, 5.0, 10.0), (2, "b", 0.0, 7.0, -7.0),
    ]


def test_net_with_cost_adjustment_keeps_adjustment_only_rows(make):
    sales = make("day int, store string, amount double", (1, "a", 10.0))
    returns = make("day int, store string, amount double", (2, "a", 4.0))
    adjustments = make("day int, store string, cosa double", (1, "a", 2.0), (3, "a", 1.5), (4, "a", 0.0))
    got = net.net_with_cost_adjustment(sales, returns, adjustments, KEYS, {"dollars": "amount"}, "dollars")
    assert rows(got, "day", "net_dollars", "cost_adjustment", "adjusted_margin", "movements") == [
        (1, 10.0, 2.0, 8.0, 1), (2, -4.0, 0.0, -4.0, 1), (3, 0.0, 1.5, -1.5, 0),
    ]


def test_net_with_forecast_keeps_plan_only_rows_and_adds_orders(make):
    schema = "day int, store string, order_analytics_id int, merchandise double, quantity double"
    sales = make(schema, (1, "a", 1, 10.0, 1.0), (1, "a", 1, 5.0, 1.0), (1, "a", 2, 1.0, 1.0))
    returns = make(schema, (1, "a", 9, 4.0, 1.0))
    plan = make("day int, store string, forecast double", (1, "a", 20.0), (5, "a", 30.0))
    got = net.net_with_forecast(sales, returns, plan, KEYS, ["forecast"])
    assert rows(got, "day", "net_dollars", "net_units", "orders", "forecast") == [
        (1, 12.0, 2.0, 3, 20.0), (5, 0.0, 0.0, 0, 30.0),
    ]


def test_margins(make):
    df = make(
        "merchandise decimal(18,4), fair_market_value decimal(18,4), quantity decimal(18,4), unit_last_cost decimal(18,4)",
        (Decimal(100), Decimal(60), Decimal(2), Decimal(20)), (Decimal(50), None, Decimal(1), Decimal(10)),
    )
    assert rows(net.margins(df), "landed_margin", "vendor_margin") == [(40.0, 60.0), (50.0, 40.0)]


def test_attributed_returns(make):
    returns = make(
        "order_line_analytics_id string, location_analytics_id int, product_analytics_id bigint, "
        "original_order_analytics_id bigint, merchandise double",
        ("on", 904, 10, 1, 1.0), ("st", 904, 10, 1, 2.0), ("st2", 5, 11, None, 3.0), ("lost", 5, 11, None, 4.0),
    )
    lines = make(
        "order_line_analytics_id string, order_analytics_id bigint, product_analytics_id bigint, source string, "
        "sales_channel string, unit_last_cost double",
        ("on", 1, 10, "oroms", "web", 1.0), ("st", 3, 10, "xcenter", None, 1.0), ("st2", 4, 11, "xcenter", None, 1.0),
        ("lost", 99, 11, "xcenter", None, 1.0),
    )
    headers = make("order_analytics_id bigint, source string", (1, "oroms"), (3, "xcenter"), (4, "xcenter"))
    got = net.attributed_returns(returns, lines, headers)
    assert rows(got, "order_line_analytics_id", "attribution_location_analytics_id", "sales_channel") == [
        ("on", 2, "web"), ("st", 904, "web"), ("st2", 5, "pos"),
    ]


@pytest.fixture(scope="module")
def calendar(spark):
    """52, 53 and 52 weeks from Sunday 2022-01-02."""
    return fiscal_calendar(spark, date(2022, 1, 2), 2022, [52, 53, 52]).cache()


def test_calendar_with_53_weeks(calendar):
    per_year = calendar.groupBy("fiscal_year").agg(F.count(F.lit(1)), F.max("fiscal_week_id"), F.max("fiscal_month_id"))
    assert rows(per_year) == [(2022, 364, 202252, 202212), (2023, 371, 202353, 202312), (2024, 364, 202452, 202412)]
    assert calendar.agg(F.countDistinct("week_analytics_id")).first()[0] == 157
    assert calendar.agg(F.countDistinct("gregorian_date")).first()[0] == calendar.count()


def test_generated_calendar_equals_the_driver_view(spark):
    view = from_driver(spark, "/root/testdata/sf0.001")["calendar"]
    generated = fiscal_calendar(spark, date(1994, 1, 2), 1994, [52] * 10)
    assert generated.select(*view.columns).exceptAll(view).count() == 0


@pytest.mark.parametrize(
    "as_of, week, month, quarter",
    [
        (date(2022, 1, 9), 202201, 202201, 202201),
        (date(2022, 2, 5), 202204, 202201, 202201),
        (date(2022, 2, 6), 202205, 202202, 202201),
        (date(2022, 4, 3), 202213, 202203, 202201),
        (date(2022, 4, 10), 202214, 202204, 202202),
        (date(2024, 1, 13), 202353, 202312, 202304),
        (date(2024, 1, 14), 202401, 202401, 202401),
    ],
)
def test_anchor_period_on_edges(calendar, as_of, week, month, quarter):
    anchor = time.anchor_period(calendar, as_of)
    row = anchor.first()
    assert (row.fiscal_week_id, row.week_in_year) == (week, week % 100)
    assert row.fiscal_quarter_id == quarter and row.fiscal_month_id == month


def test_align_last_year(make, calendar):
    day = lambda d: (d - date(1970, 1, 1)).days
    fact = make("date_analytics_id bigint, v int", (day(date(2022, 1, 2)), 1), (day(date(2024, 12, 1)), 2))
    assert rows(time.align_last_year(fact, calendar)) == [(day(date(2023, 1, 1)), 1)]


def test_to_date_buckets(make, calendar):
    day = lambda *d: (date(*d) - date(1970, 1, 1)).days
    fact = make(
        "date_analytics_id bigint, k string, v int",
        (day(2023, 2, 22), "a", 1),      # the anchor week
        (day(2023, 2, 1), "a", 10),      # the month, not the week
        (day(2023, 1, 5), "a", 100),     # the quarter, not the month
        (day(2022, 2, 23), "a", 1000),    # the same week last year
        (day(2022, 1, 6), "b", 5),       # last year only
        (day(2022, 12, 20), "a", 7),     # outside of both
    )
    periods = time.period_days(calendar, date(2023, 3, 1), cutoff=date(2023, 3, 1))
    got = time.to_date_buckets(fact, periods, ["k"], {"v": "v"})
    assert rows(got, "k", "v_week", "v_month", "v_quarter", "v_year", "v_week_ly", "v_month_ly", "v_year_ly") == [
        ("a", 1, 11, 111, 111, 1000, 1000, 1000), ("b", None, None, None, None, None, None, 5),
    ]


def test_any_number_of_days(spark):
    days = spark.range(60_000).select(F.col("id").alias("date_analytics_id"))
    every, odd = time.day_ids(days), time.day_ids(days.where("date_analytics_id % 2 = 1"))
    assert len(every) == 60_000 and len(odd) == 30_000
    assert time.runs(every) == [(0, 59_999)] and time.runs([5, 1, 2, 9, 5]) == [(1, 2), (5, 5), (9, 9)]
    assert days.where(time.on_days(every[1000:])).count() == 59_000
    assert days.where(time.on_days(odd)).count() == 30_000


def test_repeated_calendar_days_count_once(calendar):
    periods = time.period_days(calendar.union(calendar), date(2023, 3, 1))
    assert periods == time.period_days(calendar, date(2023, 3, 1))


def test_on_days(make):
    df = make("date_analytics_id bigint", (1,), (2,), (3,), (5,), (None,))
    assert rows(df.where(time.on_days([1, 2, 3]))) == [(1,), (2,), (3,)]
    assert rows(df.where(time.on_days([1, 5]))) == [(1,), (5,)]
    assert rows(df.where(time.on_days([]))) == []


def test_weeks_and_reporting_date(calendar):
    week = time.fiscal_weeks(calendar).where(F.col("fiscal_week_id") == 202353).first()
    assert week.end_date_analytics_id - week.start_date_analytics_id == 6
    assert rows(time.rolling_weeks(calendar, date(2022, 1, 20), 52)) == [(202201,), (202202,)]
    assert [r[0] for r in time.rolling_weeks(calendar, date(2024, 1, 20), 3).collect()] == [202401, 202353, 202352]
    weeks = calendar.select("fiscal_year", "fiscal_quarter_id", "quarter_analytics_id", "fiscal_week_id", "week_in_quarter").distinct()
    got = time.reporting_date(calendar, weeks, 2, (2022, 2022))
    assert rows(got, "fiscal_quarter_id", "gregorian_date")[0] == (202201, date(2022, 1, 15))


def test_day_filters_include_the_whole_last_day(make):
    df = make(
        "ts timestamp_ntz",
        *[(datetime.fromisoformat(text),) for text in (
            "2022-05-01T23:59:59.999999", "2022-05-02T00:00:00", "2022-05-02T23:59:59.999999", "2022-05-03T00:00:00",
        )],
    )
    assert time.on_day(df, "ts", date(2022, 5, 3)).count() == 2
    assert time.between_days(df, "ts", date(2022, 5, 1), date(2022, 5, 2)).count() == 3


def test_hourly(make):
    df = make("ts timestamp_ntz, v int", (datetime(2022, 5, 1, 9, 59), 1), (datetime(2022, 5, 1, 9), 2), (datetime(2022, 5, 1, 10), 4))
    assert rows(time.hourly(df, "ts", "v"), "order_hour", "demand") == [(9, 3), (10, 4)]
