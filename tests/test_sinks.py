"""Ordered files, the maintained view, the latest record of a stream, mergeable distinct counts."""

from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from found import left_behind, rows, shuffled
from shopledger.functions.distinct import counted, distinct_bitmaps, distinct_over, estimated, merged, sketches
from shopledger.operators import time
from shopledger.operators.keys import latest_per_key
from shopledger.plans import retail
from shopledger.plans.orders import report_orders
from shopledger.registry import QUERIES
from shopledger.sinks import maintained
from shopledger.sinks.ordered import in_order, rank_of, write_ordered
from shopledger.sinks.upsert import compact, current, upsert
from shopledger.sources.catalog import RetailTables, from_frames
from shopledger.sources.driver_views import from_driver
from shopledger.streaming.latest import latest_stream

FOLDER = "/root/testdata/sf0.001"


def files_of(path):
    found = Path(path).glob("part-*.parquet")
    return sorted(found, key=lambda f: int(re.match(r"part-(\d+)", f.name)[1]))


def test_files_hold_the_order(spark, tmp_path):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_shipdate")
    lines = lines.withColumn("l_shipdate", F.when(F.col("l_orderkey") % 7 > 0, F.col("l_shipdate")))
    order = [rank_of("l_returnflag", "R", "A"), ("l_shipdate", "desc"), "l_orderkey", ("l_extendedprice", "desc")]
    write_ordered(lines, f"{tmp_path}/out", order, files=9)
    found = [r for f in files_of(f"{tmp_path}/out") for r in pq.read_table(f).to_pylist()]
    flag = {"R": 0, "A": 1}
    key = lambda r: (
        flag.get(r["l_returnflag"], 2), r["l_shipdate"] is None, -(r["l_shipdate"] or datetime(1970, 1, 1)).toordinal(), r["l_orderkey"], -r["l_extendedprice"]
    )
    assert [key(r) for r in found] == sorted(key(r) for r in found) and len(found) == lines.count()
    assert len(files_of(f"{tmp_path}/out")) == 9 and found[0].keys() == set(lines.columns)
    back = in_order(spark, f"{tmp_path}/out").orderBy("position").collect()
    assert [r.position for r in back] == list(range(1, len(found) + 1))
    assert [r.l_extendedprice for r in back] == [r["l_extendedprice"] for r in found]


def test_a_value_of_most_rows_fills_several_files(spark, tmp_path):
    df = spark.range(20_000).select(F.lit("same").alias("k"), "id", F.lit(1).alias("_order_0"))
    write_ordered(df, f"{tmp_path}/out", ["k"], files=8)
    sizes = [pq.read_metadata(f).num_rows for f in files_of(f"{tmp_path}/out")]
    assert sum(sizes) == 20_000 and max(sizes) < 6_000


def test_order_without_rows_and_as_text(spark, tmp_path):
    df = spark.createDataFrame([], "a int, b string")
    write_ordered(df, f"{tmp_path}/none", ["a"])
    assert in_order(spark, f"{tmp_path}/none").count() == 0
    some = spark.createDataFrame([(2, "x"), (None, "z"), (1, "y")], "a int, b string")
    write_ordered(some, f"{tmp_path}/csv", [("a", "desc")], files=2, format="csv")
    text = "".join(f.read_text() for f in sorted(Path(f"{tmp_path}/csv").glob("part-*.csv")))
    assert text.split() == ["2,x", "1,y", ",z"]


def test_every_order_names_a_report(spark):
    assert set(report_orders()) <= set(QUERIES)


@pytest.fixture(scope="module")
def some_days(spark):
    """The retail tables with the facts of ten days, and the ids of those days."""
    t = from_driver(spark, FOLDER)
    days = [r[0] for r in t["delivered_sales"].groupBy(time.DAY).count().orderBy(F.desc("count"), time.DAY).limit(10).collect()]
    tables = {name: t[name].where(F.col(time.DAY).isin(days)) for name in ("delivered_sales", "delivered_returns")}
    return RetailTables(spark, lambda name: tables.get(name, None) or t[name]), sorted(days), t


def test_renewed_days_give_the_full_view(spark, some_days, tmp_path):
    tables, days, whole = some_days
    path = f"{tmp_path}/view"
    maintained.refresh(tables, path, days[:7])
    full = rows(retail.returns_by_store(tables))
    columns = retail.returns_by_store(tables).columns
    assert rows(maintained.view(spark, path), *columns) != full
    assert maintained.maintain(tables, path) == days[7:]
    assert rows(maintained.view(spark, path), *columns) == full
    assert maintained.maintain(tables, path) == []
    maintained.refresh(tables, path, days[2:4])
    maintained.refresh(tables, path, [])
    assert rows(maintained.view(spark, path), *columns) == full

    # A day loses its facts and another gets them twice.
    twice = whole["delivered_sales"].where(F.col(time.DAY) == days[1])
    changed = from_frames(spark, {
        **{n: whole[n] for n in ("sales_line", "sales_header", "calendar", "products", "product_to_merchandising_taxonomy", "locations")},
        "delivered_sales": tables["delivered_sales"].where(F.col(time.DAY) != days[0]).union(twice),
        "delivered_returns": tables["delivered_returns"].where(F.col(time.DAY) != days[0]),
    })
    assert maintained.maintain(changed, path) == days[:2]
    assert rows(maintained.view(spark, path), *columns) == rows(retail.returns_by_store(changed))
    maintained.refresh(tables, path)
    assert rows(maintained.view(spark, path), *columns) == full and maintained.changed_days(tables, path) == []


def test_a_renewal_reads_only_its_days(spark, some_days):
    _, days, whole = some_days
    plan = retail.returns_by_store(whole, time.on_days(days[:1]))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "l_orderkey" in line]
    assert scans and maintained.fingerprints(whole, days[:1]).select(time.DAY).distinct().count() == 1


def test_a_renewal_leaves_little_on_disk(spark, tmp_path):
    """Only the days' fingerprints stay in shuffle files; no line does."""
    before = shuffled(spark)
    t = from_driver(spark, "/root/testdata/sf0.01")
    days = time.day_ids(t["calendar"].where(F.col("gregorian_date") < F.lit(date(2000, 6, 1))))
    maintained.refresh(t, f"{tmp_path}/view", days)
    assert left_behind(spark, before, 500_000) <= 500_000
    before = shuffled(spark)
    maintained.refresh(t, f"{tmp_path}/view")
    assert left_behind(spark, before, 500_000) <= 500_000


EVENTS = "id bigint, ts timestamp_ntz, number string, version bigint, amount decimal(10,2)"


def arrivals(seed):
    draw = random.Random(seed)
    start = datetime(2024, 5, 1)
    found = [
        (draw.choice([1, 2, 3, 4, None]), start + timedelta(minutes=draw.randrange(600), microseconds=draw.randrange(3)), draw.choice("abc") + "é", i, None)
        for i in range(60)
    ]
    found += [(5, None, None, 100, None), (5, None, "x", 101, None), (6, None, "y", 102, None), (6, start, None, 103, None)]
    draw.shuffle(found)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_of_a_stream_in_any_order(spark, tmp_path, seed):
    """Batches in any order, some twice, compacted in between, give what the batch operator gives."""
    data, schema = arrivals(seed), EVENTS
    for i in range(0, len(data), 16):
        spark.createDataFrame(data[i : i + 16], schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={i}")
    keys, order, ties = ["id"], ["ts"], ["number", "version"]
    write, seen = upsert(f"{tmp_path}/out", keys, order, ties), []

    def twice(batch, number):
        kept = batch.persist()
        write(kept, number)
        write(kept, number)
        seen.append(number)
        if number == 1:
            compact(spark, f"{tmp_path}/out", schema, keys, order, ties)
            write(kept, number)
        kept.unpersist()

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in/*")
        started = latest_stream(stream, keys, "ts", ties, lateness="2 days").writeStream.outputMode("update").foreachBatch(twice)
        query = started.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(240)
        query.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    table = lambda: sorted(map(tuple, current(spark, f"{tmp_path}/out", schema, keys, order, ties).collect()), key=str)
    batch = latest_per_key(spark.createDataFrame(data, schema), keys, order, ties)
    expected = sorted(map(tuple, batch.collect()), key=str)
    assert table() == expected and len(seen) > 2
    compact(spark, f"{tmp_path}/out", schema, keys, order, ties)
    assert table() == expected


def test_table_before_the_first_batch(spark, tmp_path):
    assert current(spark, f"{tmp_path}/out", EVENTS, ["id"], ["ts"], ["version"]).count() == 0
    compact(spark, f"{tmp_path}/out", EVENTS, ["id"], ["ts"], ["version"])


def test_distinct_counts_on_three_grains(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 5).alias("store"), (F.col("id") % 365).alias("day"), F.when(F.col("id") % 11 > 0, 1 + F.col("id") * 7919 % 70_001).alias("customer")
    )
    grains = {"both": ["store", "day"], "store": ["store"], "all": []}
    got = rows(distinct_over(distinct_bitmaps(df, ["store", "day"], "customer"), grains, "n"), "grain", "store", "day", "n")
    expected = []
    for grain, by in grains.items():
        for r in df.where("customer is not null").groupBy(*by).agg(F.countDistinct("customer").alias("n")).collect():
            expected.append((grain, r.store if "store" in by else None, r.day if "day" in by else None, r.n))
    assert got == sorted(expected, key=lambda row: [(v is not None, v) for v in row])
    plan = counted(merged(distinct_bitmaps(df, ["store", "day"], "customer"), ["store"]), ["store"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_sketches_of_days_unite(spark):
    df = spark.range(300_000).select((F.col("id") % 30).alias("day"), (F.col("id") * 31 % 90_000).alias("customer"))
    daily = sketches(df, ["day"], "customer")
    for by in ([], ["day"]):
        exact = {r[0] if by else None: r.n for r in df.groupBy(*by).agg(F.countDistinct("customer").alias("n")).collect()}
        for r in estimated(daily, by).collect():
            assert abs(r.distinct - exact[r[0] if by else None]) < 0.03 * exact[r[0] if by else None]


def test_to_date_of_each_day(spark):
    t = from_driver(spark, FOLDER)
    facts = t["line_facts"].where("is_return_line = 0")
    measures = {"sales": "merchandise"}
    every = time.to_date_every_day(facts, t["calendar"], ["sales_channel"], measures, date(1999, 5, 12), date(2000, 6, 14)).persist()
    for day in (date(1999, 5, 12), date(2000, 1, 29), date(2000, 2, 1), date(2000, 6, 14)):
        periods = time.period_days(t["calendar"], day, lag_days=0, cutoff=day)
        one = time.to_date_buckets(facts, periods, ["sales_channel"], measures)
        assert rows(every.where(F.col("gregorian_date") == F.lit(day)), *one.columns) == rows(one)
    assert every.select("gregorian_date").distinct().count() == 400
    every.unpersist()
