"""Period joins, proven keys, customer state, owned copies."""

from __future__ import annotations

import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from found import rows
from shopledger.functions.ordered import copies_deleted_after, cut_lineage
from shopledger.functions.periods import join_periods
from shopledger.operators import customer_state, lifecycle
from shopledger.plans import finance, retail
from shopledger.registry import run
from shopledger.registry.operators import activity
from shopledger.sources.catalog import RetailTables
from shopledger.sources.driver_views import from_driver
from shopledger.sources.proven import UNIQUE, prove_unique, proven

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_periods_meet_as_a_plain_search_finds(spark, make, width):
    draw = random.Random(width)
    facts = [(i, draw.choice([None, draw.randrange(-30, 60)])) for i in range(80)]
    periods = [(f"p{i}", a, a + draw.randrange(-3, 40)) for i, a in enumerate(draw.randrange(-40, 60) for _ in range(25))] + [("open", 5, None), ("p0", None, 3)]
    found = join_periods(make("id int, day int", *facts), make("name string, start int, stop int", *periods), "day", "start", "stop", width)
    expected = [(i, d, n, a, b) for i, d in facts for n, a, b in periods if None not in (d, a, b) and a <= d <= b]
    assert rows(found, "id", "day", "name", "start", "stop") == sorted(expected)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unique_keys_change_nothing(spark):
    t = from_driver(spark, FOLDER)
    for report in (lambda x: finance.store_daily_kpis(x, date(2000, 6, 15)), lambda x: retail.store_margin(x, date(2000, 6, 15), date(2000, 6, 4), date(2000, 6, 10))):
        plain = report(t)
        assert rows(report(proven(t)), *plain.columns) == rows(plain)


@pytest.mark.parametrize("name", ["locations", "product_to_merchandising_taxonomy", "sales_line"])
def test_a_repeated_key_is_refused(spark, tmp_path, name):
    t = from_driver(spark, FOLDER)
    twice = RetailTables(spark, lambda n: t[n].unionByName(t[n].limit(1)) if n == name else t[n])
    report = lambda tables: retail.store_margin(tables, date(2000, 6, 15), date(2000, 6, 4), date(2000, 6, 10))
    report(twice).write.parquet(f"{tmp_path}/unproven")
    with pytest.raises(Exception, match=f"{name} has a key more than once: {UNIQUE[name][0]}="):
        report(proven(twice)).write.parquet(f"{tmp_path}/proven")


def test_null_keys_may_repeat(make):
    df = make("a int, b string, _times int", (1, "x", 1), (None, "y", 2), (None, "y", 3), (2, None, 4), (2, None, 5))
    assert prove_unique(df, ["a", "b"]).count() == 5 and prove_unique(df, ["a", "b"]).columns == df.columns
    with pytest.raises(Exception, match="table has a key more than once: a=2"):
        prove_unique(df, ["a"]).count()


def test_state_of_parts_is_the_state_of_the_whole(spark):
    keys, period = ["email", "sales_channel_type"], "month_analytics_id"
    active = activity(from_driver(spark, FOLDER)).select(*keys, period).persist()
    whole = rows(customer_state.state_of(active, keys, period))
    part = F.pmod(F.xxhash64(*keys, period), F.lit(3))
    parts = [customer_state.state_of(active.where(part == i), keys, period) for i in (2, 0, 1, 0)]
    merged = parts[0]
    for other in parts[1:]:
        merged = customer_state.merged_state(merged, other, keys)
    assert rows(merged) == whole
    full = lifecycle.lifecycle_rolling(active, keys, period, 12).withColumnRenamed(period, "period")
    for month in [r[0] for r in active.select(period).distinct().orderBy(F.desc(period)).limit(30).collect()][::10]:
        state = customer_state.state_of(active.where(F.col(period) <= month), keys, period)
        labels = customer_state.lifecycle_of_state(state, keys, month, 12)
        assert rows(labels) == rows(full.where(F.col("period") == month), *labels.columns)
    active.unpersist()


def test_copies_are_deleted_with_their_owner(spark):
    with copies_deleted_after(spark):
        copy = cut_lineage(spark.range(10))
        path = Path(copy.inputFiles()[0].removeprefix("file://")).parent
        assert copy.count() == 10 and path.exists()
    assert not path.exists()
    kept = cut_lineage(spark.range(3))
    assert kept.count() == 3


def test_store_kpis_join_the_lines_once(spark):
    """The order lines are written with the two days; what is left to scan are discount codes, captures and plans."""
    plan = run("store_daily_kpis", spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "l_orderkey" in line]
    assert len(scans) <= 4 and not any("l_quantity" in line for line in scans)
