"""Every registered query against its SQL text on the smallest tables."""

from __future__ import annotations

import pytest

from oracle import connect, differences
from shopledger.registry import QUERIES, oracle_queries, run

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def oracle():
    return oracle_queries()


def test_every_query_has_a_text(oracle):
    assert set(oracle) == set(QUERIES)


# Summaries with a bounded number of rows, which may pass through one task.
SMALL_SUMMARIES = {
    "share_of_total", "pareto", "cohort_size", "surrogate_id", "new_customers", "dense_grid", "cooking_class_first_years",
    "customer_segmentation_channel_product_quarter", "merch_vs_culinary_customers", "new_customers_r52_weeks",
    "online_cooking_class_buyers", "customers_by_grain", "top_classes_customer_type", "top_customers", "sales_by_price_type", "planning_dashboard",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, connection, oracle):
    df = run(name, spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert name in SMALL_SUMMARIES or "SinglePartition" not in plan
    problems, _ = differences(df, connection, oracle[name])
    assert problems == []
