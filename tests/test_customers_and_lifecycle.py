"""Customer and lifecycle operators on hand-made rows."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from found import rows
from shopledger.operators import customers, lifecycle
from shopledger.plans.parameters import FULL_PRICES, SPEND_EDGES, SPEND_LABELS


def test_customer_period_and_first_period(make):
    df = make("c int, y int, o int, a double", (1, 2020, 1, 10.0), (1, 2020, 1, 20.0), (1, 2021, 2, 5.0), (2, 2021, 3, 1.0))
    assert rows(customers.customer_period(df, "c", "y", "o", "a")) == [
        (1, 2020, 1, 30.0, 15.0), (1, 2021, 1, 5.0, 5.0), (2, 2021, 1, 1.0, 1.0),
    ]
    assert rows(customers.first_period_cohort(df, "c", "y"), "first_period", "cohort_customers", "cohort_share") == [
        (2020, 1, 0.5), (2021, 1, 0.5),
    ]


def test_buckets_and_bands(make):
    df = make("n int, x double", (5, 1000.0), (6, 1000.01), (1, 10000.0), (99, 10000.01))
    got = df.select(customers.cap_bucket("n", 5).alias("b"), customers.band("x", SPEND_EDGES, SPEND_LABELS).alias("l"))
    assert rows(got) == [(1, "7501-10000"), (5, "0-1000"), (6, "10000+"), (6, "1001-2500")]


def test_price_mix(make):
    df = make(
        "c int, price double, a double", (1, 49.0, 5.0), (2, 50.0, 5.0), (3, 49.0, 5.0), (3, 50.0, 5.0),
        (4, 49.0, -5.0), (4, 50.0, 5.0), (5, 49.0, 5.0), (5, 49.0, -5.0),
    )
    assert rows(customers.price_mix(df, ["c"], "price", "a", FULL_PRICES), "c", "price_mix_type") == [
        (1, "FullPriceOnly"), (2, "SaleOnly"), (3, "Mixed"), (4, "Unknown"), (5, "Unknown"),
    ]


def test_tenure_and_segments(make):
    df = make("y int, f int, a double, b double", (2020, 2020, 1.0, 1.0), (2021, 2020, 1.0, 0.0), (2019, 2020, 0.0, 1.0), (2020, 2020, 1.0, -1.0))
    got = df.select(
        customers.tenure_in_year("y", "f").alias("t"), customers.mix_segment("a", "b", ["both", "onlyA", "noA", "other"]).alias("s")
    )
    assert rows(got) == [("FirstYear", "both"), ("FirstYear", "other"), ("PostFirstYear", "onlyA"), ("PreFirstYear", "noA")]
    days = make("e date, o timestamp_ntz", (date(2022, 3, 1), datetime(2022, 3, 1, 8)), (date(2022, 3, 2), datetime(2022, 3, 1)), (None, None))
    got = days.select(customers.tenure_since_order("e", "o"), customers.tenure_by_year("e", 2022))
    assert rows(got) == [("Existing", "Existing"), ("Existing", "New"), ("New", "New")]


def test_cohort_orders_and_categories(make):
    orders = make("c int, o int, codes string", (1, 1, "|999|"), (1, 2, "|5|"), (2, 3, "|5|"), (3, 4, None))
    assert rows(customers.cohort_orders(orders, "c", "codes", "%999%"), "o") == [(1,), (2,)]
    lines = make("c int, k string, a double", (1, "X", 1.0), (1, "Y", 2.0), (1, None, 4.0))
    assert rows(customers.category_mix(lines, "c", "k", "a", "X")) == [(1, 2, 7.0, 1.0, 2.0)]


def test_proximity(make):
    people = make("target_key int, miles_to_closest_store double, closest_store_id string", (1, 24.9, "s"), (2, 25.0, "s"), (3, None, "t"), (4, 1.0, "gone"))
    stores = make("store_id string, culinary string", ("s", "Y"), ("t", None))
    assert rows(customers.proximity(people, stores), "target_key", "store_proximity", "culinary_proximity") == [
        (1, "NEAR STORE", "CULINARY"), (2, "NOT NEAR STORE", "CULINARY"), (3, "NOT NEAR STORE", "NO CULINARY"),
    ]


def test_recency_segment(make):
    start = datetime(2020, 1, 1)
    cases = {1: [], 2: [0], 3: [1], 4: [365], 5: [366], 6: [730], 7: [731], 8: [10, 10], 9: [400, 500]}
    data = [(c, start + timedelta(days=d)) for c, gaps in cases.items() for d in [0, *gaps]]
    got = customers.recency_segment(make("c int, d timestamp_ntz", *data), "c", "d")
    assert rows(got, "c", "days_since_prev", "buying_segment") == [
        (1, None, "(null)"), (2, 0, "(null)"), (3, 1, "ACTIVE"), (4, 365, "ACTIVE"), (5, 366, "LAPSED"),
        (6, 730, "LAPSED"), (7, 731, "DEEP LAPSED"), (8, 0, "(null)"), (9, 100, "ACTIVE"),
    ]


def test_qualify_all_periods(make):
    df = make(
        "c int, y int, s double, n int",
        (1, 2020, 400.0, 50), (1, 2021, 1.0, 1), (2, 2020, 399.99, 1), (2, 2021, 1.0, 1), (3, 2020, 500.0, 51),
        (3, 2021, 1.0, 1), (4, 2020, 500.0, 1),
    )
    rules = {"2020": (F.col("y") == 2020) & (F.col("s") >= 400) & (F.col("n") <= 50), "2021": F.col("y") == 2021}
    assert rows(customers.qualify_all_periods(df, "c", rules)) == [(1,)]


def test_contactable(make):
    df = make(
        "target_key bigint, email string, email_valid_syntax int, do_not_email string",
        (1, "a@x", 1, "N"), (2, None, 1, "N"), (3, "a@INTERNAL", 1, "N"), (4, "a@internal", 1, "N"), (5, "a@x", 0, "N"),
        (6, "a@x", 1, "Y"), (7, "a@x", 1, "N"), (8, "a@x", 1, None),
    )
    excluded = make("target_key bigint", (7,), (None,))
    assert rows(customers.contactable(df, ["%internal%", "%INTERNAL%"], excluded), "target_key") == [(1,)]


def test_lifecycle_rolling(make):
    df = make("c int, m int", *[(1, m) for m in (1, 2, 14, 27, 28)], (1, 2), (2, 5))
    got = lifecycle.lifecycle_rolling(df, ["c"], "m", 12)
    assert rows(got) == [
        (1, 1, "New"), (1, 2, "Retained"), (1, 14, "Retained"), (1, 27, "Reactivated"), (1, 28, "Retained"), (2, 5, "New"),
    ]
    by_channel = make("c int, ch string, m int", (1, "a", 1), (1, "b", 2))
    assert {r.customer_type for r in lifecycle.lifecycle_rolling(by_channel, ["c", "ch"], "m", 12).collect()} == {"New"}
    years = make("email string, fiscal_year int", ("x", 2019), ("x", 2020), ("x", 2022))
    assert [r[2] for r in rows(lifecycle.lifecycle_by_year(years))] == ["New customer", "Retained customer", "Reactivated customer"]


@pytest.mark.parametrize("n", [1, 4, 12])
def test_lifecycle_equals_its_definition(make, n):
    generator = random.Random(3)
    data = {(generator.randrange(40), generator.randrange(40)) for _ in range(300)}
    expected = []
    for c, m in data:
        before = [x for (d, x) in data if d == c and x < m]
        label = "New" if not before else "Retained" if max(before) >= m - n else "Reactivated"
        expected.append((c, m, label))
    assert rows(lifecycle.lifecycle_rolling(make("c int, m int", *data), ["c"], "m", n)) == sorted(expected)


def test_reactivated_and_retained(make):
    years = make("e string, y int", ("a", 2018), ("a", 2020), ("a", 2021), ("b", 2020), ("c", 2017), ("c", 2020))
    assert rows(lifecycle.reactivated(years, "e", "y")) == [(2020, 2)]
    months = make("e string, y int, m int", ("a", 2020, 12), ("a", 2021, 1), ("a", 2021, 2), ("b", 2021, 1), ("a", 2023, 1))
    assert rows(lifecycle.retained(months, "e", "y", "m")) == [(2021, 1, 1), (2021, 2, 1)]


def test_segment_totals_counts_nameless_orders_as_customers(make):
    df = make(
        "k string, email string, order_analytics_id bigint, merchandise double, quantity int",
        ("x", "a", 1, 1.0, 1), ("x", "a", 2, 1.0, 1), ("x", None, 3, 1.0, 1), ("x", None, 3, 1.0, 1), ("x", None, 4, 1.0, 1),
    )
    assert rows(lifecycle.segment_totals(df, ["k"])) == [("x", 3, 4, 5.0, 5)]


def test_channel_type_and_category(make):
    df = make("source string, order_type string", ("oroms", "x"), ("xcenter", "my_bopis"), ("xcenter", "ship_from_store"), ("xcenter", "sale"), ("other", "sale"))
    assert rows(df.select("order_type", lifecycle.channel_type())) == [
        ("my_bopis", "Direct"), ("sale", None), ("sale", "Retail"), ("ship_from_store", "Direct"), ("x", "Direct"),
    ]
    names = make("level_5_name string, level_3_name string", ("WARRANTY", "GIFT CERTIFICATES"), ("x", "GIFT CERTIFICATES"), ("x", "COOKING SCHOOL"), (None, None))
    assert rows(names.select(lifecycle.product_category())) == [("CulinaryClass",), ("GiftCard",), ("HardGood",), ("Warranty",)]


def test_anonymous_and_enriched_email(make):
    headers = make(
        "order_analytics_id bigint, order_number string, source string, order_type string, email string, alt_order_number_1 string",
        (1, "A", "oroms", "web_bopis", "a@x", None), (2, "A", "oroms", "web_bopis", None, None), (3, "S", "xcenter", "bopis", None, "A"),
        (4, "T", "xcenter", "bopis", "own@x", "A"), (5, "U", "xcenter", "sale", None, "A"), (6, "V", "xcenter", "bopis", None, None),
        (7, "W", None, None, "bad@x", None),
    )
    enriched = lifecycle.enrich_email(headers)
    assert rows(enriched, "order_analytics_id", "email") == [
        (1, "a@x"), (2, None), (3, "a@x"), (4, "own@x"), (5, None), (6, None), (7, "bad@x"),
    ]
    blocked = make("email string", ("bad@x",), ("bad@x",), (None,))
    assert rows(lifecycle.anonymous_orders(enriched, blocked), "order_analytics_id") == [(2,), (5,), (6,), (7,)]
    assert rows(lifecycle.anonymous_orders(enriched), "order_analytics_id") == [(2,), (5,), (6,)]


def test_exclude_orders(make):
    lines = make(
        "order_analytics_id bigint, sales_channel string, order_line_type string",
        (1, "web", "x"), (1, "amazon_y", "x"), (2, "web", "an amazon line"), (3, None, None), (None, "amazon", "x"), (4, "web", "x"),
    )
    assert rows(lifecycle.exclude_orders(lines, lines), "order_analytics_id") == [(None,), (3,), (4,)]
    none = lines.where("order_analytics_id = 4")
    assert lifecycle.exclude_orders(lines, none).count() == lines.count()


def test_surrogate_id_and_allow_list(make):
    df = make("e string", ("b",), ("a",), ("b",), (None,))
    assert rows(lifecycle.surrogate_id(df, "e")) == [("a", 1), ("b", 2)]
    lines = make(
        "source string, sales_channel string, order_line_type string",
        ("xcenter", None, "in_store_sale"), ("oroms", "web", "ecommerce"), ("oroms", "web", "phone"), ("oroms", None, "ecommerce"),
    )
    assert rows(lifecycle.allowed_sales(lines), "source") == [("oroms",), ("xcenter",)]


def test_new_in_window(make):
    orders = make("e string, d bigint", ("a", 1), ("a", 9), ("b", 8), ("b", 9), (None, 8), ("c", 99))
    calendar = make("date_analytics_id bigint, fiscal_week_id int", (1, 1), (8, 2), (9, 2))
    weeks = make("fiscal_week_id int", (2,))
    assert lifecycle.new_in_window(orders, calendar, weeks, "e", "d").first()[0] == 1
