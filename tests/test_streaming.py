"""Incremental queries give what the batch operators give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from found import rows
from shopledger.functions.columns import money
from shopledger.operators import time
from shopledger.streaming.incremental import daily_totals_stream, hourly_demand_stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drained(spark, transform):
    """Run a streaming query over all of the events and return its result."""
    name = f"stream_{uuid.uuid4().hex}"
    schema = spark.read.parquet(EVENTS).schema
    stream = spark.readStream.schema(schema).parquet(EVENTS.replace("events.", "event[s]."))
    query = transform(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return spark.table(name)


def test_hourly_demand(spark):
    batch = time.hourly(spark.read.parquet(EVENTS), "ts", money("value"), ["event_type"])
    got = drained(spark, lambda s: hourly_demand_stream(s, "ts", money("value"), ["event_type"]))
    assert rows(got, *batch.columns) == rows(batch)


def test_daily_totals(spark):
    batch = spark.read.parquet(EVENTS).groupBy("event_type", F.to_date("ts").alias("order_date")).agg(
        F.count(F.lit(1)).alias("total_redemptions"), F.sum(money("value")).alias("total_discount")
    )
    got = drained(spark, lambda s: daily_totals_stream(s, "ts", money("value"), ["event_type"]))
    assert rows(got, *batch.columns) == rows(batch)
