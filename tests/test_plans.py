"""Plans that have to hold at any scale."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from found import left_behind, rows, shuffled
from shopledger.functions.ordered import ordered_scan, with_range
from shopledger.operators import inventory, time, windows
from shopledger.plans import planning, retail
from shopledger.registry import QUERIES, run
from shopledger.sources.catalog import RetailTables
from shopledger.sources.driver_views import from_driver

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_nested_loops_when_nothing_may_be_broadcast(name, spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(run(name, spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "BroadcastHashJoin" not in plan


def test_net_sales_is_one_shuffle(spark):
    plan = plan_of(run("net_sales", spark, FOLDER))
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


def test_to_date_buckets_read_the_fact_once_without_a_join(spark):
    plan = plan_of(run("to_date_buckets", spark, FOLDER))
    assert len(re.findall("FileScan parquet", plan)) == 1 and "Join" not in plan


def test_day_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet")
    plan = plan_of(time.on_day(df, "o_orderdate", date(2000, 6, 15)).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate,2000-06-14T00:00)" in plan and "LessThan(o_orderdate,2" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(run("price_ending", spark, FOLDER))
    assert "l_extendedprice" not in plan.split("ReadSchema")[1] and "l_orderkey" not in plan.split("ReadSchema")[1]


def test_top_n_limits_before_the_shuffle(spark):
    plan = plan_of(run("top_n", spark, FOLDER))
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def test_ranked_customers_are_not_gathered_in_one_task(spark):
    """Only the per-bucket summary, one row per partition, goes through a single task."""
    plan = plan_of(run("pareto", spark, FOLDER))
    for at in [m.start() for m in re.finditer("SinglePartition", plan)]:
        assert "_bucket" in plan[at : at + 600] and "HashAggregate" in plan[at : at + 600]


def test_ordered_scans_write_nothing_and_run_nothing_before_an_action(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scan", "planning only")
    try:
        scanned = ordered_scan(df, [("v", "desc")], ["k"], [], {"v": "v"})
        plan = plan_of(scanned)
        assert not tracker.getJobIdsForGroup("scan") and "InsertIntoHadoop" not in plan and "FileScan" not in plan
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert scanned.count() == 1000


def test_ranges_are_even_whatever_the_keys(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    sizes = [r["count"] for r in with_range(df, ["g", ("id", "desc")], 20).groupBy("_bucket").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 4 * 2000


def test_a_hot_group_is_many_join_keys(spark):
    """No task holds the group when its total is joined back without broadcasting or re-planning."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for key, value in zip(before, ("-1", "false", "64")):
        spark.conf.set(key, value)
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("rest").alias("g"), F.col("id").alias("v"))
        placed = windows.with_group_values(df, ["g"], {"total": F.sum("v")}).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in placed.groupBy("task").count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 5000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_join_keys_of_a_group_follow_its_measured_rows(spark):
    """Half of the rows spread over all tasks, groups of few rows are not copied, and the input is read twice, not more."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        small = (F.col("id") % 5000).cast("string")
        df = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, None).otherwise(small).alias("g"), F.col("id").alias("v"))
        totals = df.groupBy("g").agg(F.count(F.lit(1)).alias("_rows"), F.sum("v").alias("total"))
        hot = windows.hot_groups(totals, ["g"], ["total"]).first()["_hot"]
        assert list(hot["keys"]) == [128] and hot["totals"][0]["total"] == sum(range(0, 400_000, 2))
        joined = windows.with_group_values(df, ["g"], {"total": F.sum("v")})
        sizes = [r["count"] for r in joined.where("g is null").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and sum(sizes) == 200_000 and max(sizes) < 3 * 200_000 / 16
        plan = plan_of(joined)
        assert plan.count("Range (") == 2 and "ReusedExchange" in plan and "SinglePartition" not in plan
        wrong = joined.groupBy("g").agg(F.sum("v").alias("again"), F.min("total").alias("low"), F.max("total").alias("high"))
        assert wrong.where("again != low or again != high").count() == 0 and joined.count() == 400_000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def overlaid(spark, **frames):
    """The given tables with some of them replaced."""
    base = from_driver(spark, FOLDER)
    return RetailTables(spark, lambda name: frames[name] if name in frames else base[name])


def test_dates_of_returns_come_from_the_calendar(spark):
    """Also where day ids are not day numbers."""
    base = from_driver(spark, FOLDER)
    packed = {}
    for name in ("calendar", "delivered_sales", "delivered_returns"):
        days = [c for c in base[name].columns if c in ("date_analytics_id", "last_year_date_analytics_id")]
        packed[name] = base[name].withColumns({c: F.col(c) * 3 + 1_000_000 for c in days})
    plain = retail.returns_by_store(base).withColumn("date_analytics_id", F.col("date_analytics_id") * 3 + 1_000_000)
    moved = retail.returns_by_store(overlaid(spark, **packed))
    columns = plain.columns
    assert plain.select(columns).exceptAll(moved.select(columns)).count() == moved.select(columns).exceptAll(plain.select(columns)).count() == 0
    assert moved.where("gregorian_date is null").count() == 0


def test_returns_by_store_leave_little_on_disk(spark, tmp_path):
    """Each part's shuffle files are gone before the next part's are written."""
    before = shuffled(spark)
    run("returns_by_store", spark, "/root/testdata/sf0.01").write.parquet(f"{tmp_path}/out")
    assert left_behind(spark, before, 0) == 0


def test_returns_by_store_in_parts_have_all_rows(spark):
    """Also those without a day or a line, and lines, headers and products that come twice; parts share no group."""
    base = from_driver(spark, FOLDER)
    odd = {}
    for name in ("delivered_sales", "delivered_returns"):
        odd[name] = base[name].withColumns({
            "date_analytics_id": F.when(F.col("product_analytics_id") % 5 > 0, F.col("date_analytics_id")),
            "order_line_analytics_id": F.when(F.col("product_analytics_id") % 7 > 0, F.col("order_line_analytics_id")),
            "fair_market_value": F.when(F.col("product_analytics_id") % 3 > 0, F.col("fair_market_value")),
            "merchandise": F.when(F.col("product_analytics_id") % 11 > 0, F.col("merchandise")),
        })
    for name, few in (("sales_line", "line_id = 1"), ("sales_header", "order_analytics_id % 3 = 0"), ("products", "product_analytics_id % 4 = 0")):
        odd[name] = base[name].union(base[name].where(few)).where("order_analytics_id % 17 > 0" if name == "sales_header" else "true")
    t = overlaid(spark, **odd)
    plain = retail.returns_by_store(t)
    assert rows(retail.written_returns_by_store(t), *plain.columns) == rows(plain)
    assert plain.where("date_analytics_id is null").count() and plain.where("return_units > 0").count()
    parts = []
    retail.store_sums_in_parts(t, lambda sums, some, part: parts.append((sums.count(), sums.where(~some).count())))
    assert len(parts) == retail.DAY_PARTS and not any(out for _, out in parts) and sum(n for n, _ in parts) == plain.count()


def test_purchase_order_lines_at_two_locations_stay_apart(spark):
    base = from_driver(spark, FOLDER)
    first, second = (r.location_analytics_id for r in base["locations"].orderBy("location_analytics_id").limit(2).collect())
    details = base["po_details"].withColumn("location_analytics_id", F.lit(first).cast("bigint"))
    both = details.union(details.withColumn("location_analytics_id", F.lit(second).cast("bigint")))
    one, two = (planning.open_purchase_orders(overlaid(spark, po_details=d), date(2000, 6, 15)) for d in (details, both))
    grain = ["vendor_analytics_id", *inventory.PO_LINE_KEYS]
    assert two.count() == two.select(*grain).distinct().count() == 2 * one.count()
    assert two.select("vendor_analytics_id", "vendor_po_recency_rank").distinct().count() == two.count()
