"""Retail tables from parquet folders and DataFrames, and the types they get."""

from __future__ import annotations

import pytest

from found import rows
from shopledger.operators import customers, net
from shopledger.plans import crm
from shopledger.registry.base import presentable
from shopledger.sources.bucketed import write_bucketed
from shopledger.sources.catalog import from_catalog, from_frames, from_parquet
from shopledger.sources.driver_views import VIEW_SQL, from_driver
from shopledger.sources.schema import RETAIL_TABLES, column_type, conform

FOLDER = "/root/testdata/sf0.001"


def test_every_retail_table_has_a_view():
    assert len(RETAIL_TABLES) == 48 and set(RETAIL_TABLES) <= set(VIEW_SQL)


def test_views_have_the_types_of_the_warehouse(spark):
    tables = from_driver(spark, FOLDER)
    unlike = {
        (name, column, kind, column_type(column))
        for name in RETAIL_TABLES
        for column, kind in tables[name].dtypes
        if kind != column_type(column)
    }
    assert unlike == set()


def test_reports_run_on_parquet_tables(spark, tmp_path):
    tables = from_driver(spark, FOLDER)
    for name in ("order_header", "order_line"):
        tables[name].write.parquet(str(tmp_path / name))
    stored = from_parquet(spark, str(tmp_path))
    assert rows(presentable(crm.cooking_class_cohorts(stored))) == rows(presentable(crm.cooking_class_cohorts(tables)))
    given = from_frames(spark, {"order_header": stored["order_header"]})
    assert crm.customer_frequency_and_spend(given).count() == crm.customer_frequency_and_spend(tables).count()


def test_types_are_cast_at_load(spark, tmp_path):
    spark.sql("SELECT '5' AS target_key, '0' AS cancel_quantity, '2022-01-02' AS order_date, 'x' AS purchase_order").write.parquet(
        str(tmp_path / "order_header")
    )
    loaded = from_parquet(spark, str(tmp_path))["order_header"]
    assert loaded.dtypes == [
        ("target_key", "bigint"), ("cancel_quantity", "decimal(18,4)"), ("order_date", "timestamp_ntz"), ("purchase_order", "string"),
    ]
    assert loaded.where(customers.tenure_by_year("order_date", 2022) == "New").count() == 1


def test_boolean_flags_become_words(spark):
    found = conform(spark.createDataFrame([(True, 1), (False, 2), (None, 3)], "is_canceled boolean, line_id int"))
    assert [r.is_canceled for r in found.orderBy("line_id").collect()] == ["TRUE", "FALSE", None]
    with pytest.raises(TypeError, match="tags"):
        conform(spark.createDataFrame([(["x"],)], "tags array<string>"))


def test_bucketed_lines_are_joined_without_a_shuffle(spark, tmp_path):
    t = from_driver(spark, "/root/testdata/sf0.001")
    spark.sql("CREATE DATABASE IF NOT EXISTS in_buckets")
    names = ["sales_line", "delivered_sales", "delivered_returns"]
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        write_bucketed(t, "in_buckets", 4, str(tmp_path), names)
        stored = from_catalog(spark, "in_buckets")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for side in ("delivered_sales", "delivered_returns"):
            facts = lambda x: x[side].select("order_line_analytics_id", "merchandise")  # noqa: E731, B023
            found, plain = net.attributed_sales(facts(stored), stored["sales_line"]), net.attributed_sales(facts(t), t["sales_line"])
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
            assert rows(found) == rows(plain)
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
        spark.sql("DROP DATABASE in_buckets CASCADE")
