"""Shares, ranks, curves and one-row-per-key operators on hand-made rows."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import Window, functions as F

from found import rows
from shopledger.functions.joins import spread_null_left_join
from shopledger.functions.ordered import ordered_scan
from shopledger.operators import keys, windows


@pytest.fixture(scope="module")
def ties(make):
    """Ties at the top, in the middle and across groups, null measures, a null group."""
    return make(
        "g string, v int, k int",
        ("a", 9, 1), ("a", 9, 2), ("a", 5, 3), ("a", 5, 4), ("a", 1, 5), ("a", None, 6),
        ("b", 9, 7), (None, 3, 8), (None, 3, 9),
    )


@pytest.mark.parametrize("bounded", [True, False])
def test_share_of(make, bounded):
    df = make("g string, v double", ("a", 1.0), ("a", 3.0), ("z", 2.0), ("z", -2.0), (None, 5.0), ("n", None))
    got = windows.share_of(df, "v", ["g"], bounded=bounded)
    assert rows(got, "g", "v", "share") == [
        (None, 5.0, 1.0), ("a", 1.0, 0.25), ("a", 3.0, 0.75), ("n", None, None), ("z", -2.0, None), ("z", 2.0, None),
    ]
    overall = windows.share_of(df, "v", bounded=bounded)
    assert {round(r.total, 6) for r in overall.collect()} == {9.0}


@pytest.mark.parametrize("bounded", [True, False])
def test_ranks(ties, bounded):
    got = windows.ranks(ties, "v", ["k"], ["g"], bounded=bounded)
    assert rows(got, "k", "row_number", "rank", "dense_rank") == [
        (1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 3, 2), (4, 4, 3, 2), (5, 5, 5, 3), (6, 6, 6, 4),
        (7, 1, 1, 1), (8, 1, 1, 1), (9, 2, 1, 1),
    ]


@pytest.mark.parametrize("bounded", [True, False])
def test_pareto_of_ties_goes_row_by_row(make, bounded):
    df = make("v int, k int", (5, 1), (5, 2), (10, 3))
    got = windows.pareto(df, "v", ["k"], bounded=bounded)
    assert rows(got, "k", "running", "cumulative_share") == [(1, 15, 0.75), (2, 20, 1.0), (3, 10, 0.5)]


def test_scans_of_one_row_and_of_none(make):
    one = make("v int, k int", (5, 1))
    assert rows(windows.ranks(one, "v", ["k"]), "row_number", "rank", "dense_rank") == [(1, 1, 1)]
    assert windows.pareto(one.where("v > 9"), "v", ["k"]).count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_scan_equals_plain_windows_whatever_the_partitions(spark, partitions):
    generator = random.Random(7)
    data = [
        (generator.choice(["hot", "hot", "hot", "b", None]), generator.choice([0, 0, 0, 0, 1, 2, 3, None]), i)
        for i in range(2000)
    ]
    df = spark.createDataFrame(data, "g string, v int, k int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for by in ([], ["g"]):
            peers = Window.partitionBy(*by).orderBy(F.col("v").desc_nulls_last())
            order = Window.partitionBy(*by).orderBy(F.col("v").desc_nulls_last(), "k")
            whole = Window.partitionBy(*by)
            value = F.coalesce("v", F.lit(0))
            expected = df.select(
                "g", "v", "k", F.row_number().over(order).alias("row_number"), F.rank().over(peers).alias("rank"),
                F.dense_rank().over(peers).alias("dense_rank"), F.count(F.lit(1)).over(whole).alias("group_rows"),
                F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("running_v"),
                F.sum(value).over(whole).alias("total_v"),
            )
            got = ordered_scan(df, [("v", "desc")], ["k"], by, {"v": "v"})
            assert rows(got) == rows(expected)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("bounded", [True, False])
def test_running_total(make, bounded):
    df = make("d int, h int, v int", (1, 2, 5), (1, 1, 3), (2, 1, 4))
    assert rows(windows.running_total(df, "v", ["d"], ["h"], bounded=bounded), "d", "h", "running") == [
        (1, 1, 3), (1, 2, 8), (2, 1, 4),
    ]


@pytest.mark.parametrize("bounded", [True, False])
def test_rank_by_group_total(make, bounded):
    df = make("p int, c string, v int, k int", (1, "x", 3, 1), (1, "x", 3, 2), (1, "y", 5, 3), (2, "y", 1, 4))
    got = windows.rank_by_group_total(df, ["p"], ["c"], "v", ["c", "k"], bounded=bounded)
    assert rows(got, "k", "sub_total", "row_number") == [(1, 6, 1), (2, 6, 2), (3, 5, 3), (4, 1, 1)]


def test_top_n(ties):
    assert rows(windows.top_n(ties, "v", 2, ["k"]), "k") == [(1,), (2,)]
    assert rows(windows.top_n(ties, "v", 1, ["k"], ["g"]), "g", "k") == [(None, 8), ("a", 1), ("b", 7)]
    assert windows.top_n(ties, "v", 100, ["k"]).count() == ties.count()
    assert rows(ties.select("k", windows.top_flag("k", 2)))[1:3] == [(2, "Top 2"), (3, "Other")]


@pytest.mark.parametrize("bounded", [True, False])
def test_group_stat(ties, bounded):
    got = windows.group_stat(ties, "v", ["g"], "avg", "mean", bounded=bounded)
    assert rows(got.select("g", "mean").distinct()) == [(None, 3.0), ("a", 5.8), ("b", 9.0)]


def test_latest_per_key(make):
    df = make(
        "k int, d date, n int", (1, date(2022, 1, 1), 1), (1, date(2022, 1, 2), 2), (1, date(2022, 1, 2), 3),
        (1, None, 4), (2, None, 5),
    )
    assert rows(keys.latest_per_key(df, ["k"], ["d"], ["n"])) == [(1, date(2022, 1, 2), 3), (2, None, 5)]
    assert rows(keys.latest_with_ties(df, ["k"], "d"), "n") == [(2,), (3,), (5,)]
    assert rows(keys.snapshot_at_max(df, ["k"], "d"), "n") == [(2,), (3,)]


def test_last_value_takes_the_largest_on_ties(make):
    df = make("k int, d int, v int", (1, 1, 9), (1, 2, 3), (1, 2, 4), (2, 5, 1))
    assert rows(keys.last_value_of(df, ["k"], "d", "v")) == [(1, 2, 4), (2, 5, 1)]


def test_collapse(make):
    df = make("k int, q int, t string, p double", (1, 2, "a", 1.0), (1, 3, "b", 2.0), (2, 1, "c", 4.0))
    assert rows(keys.collapse(df, ["k"], sums=["q"], maxes=["t"], avgs=["p"])) == [(1, 5, "b", 1.5), (2, 1, "c", 4.0)]


def test_null_keys_are_spread_and_never_match(make, spark):
    left = make("k int, i int", (1, 1), (2, 2), *[(None, i) for i in range(3, 400)])
    right = make("k int, v string", (1, "x"), (None, "never"))
    got = spread_null_left_join(left, right, ["k"], ["i"])
    assert got.count() == 399
    assert rows(got.where("v is not null"), "i", "v") == [(1, "x")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spread_null_left_join(left, right, ["k"], ["i"])._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and "_slot" in plan.split("hashpartitioning(k", 1)[1][:40]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
