"""Reports that are written and read back, counts that are merged, sums to date of every day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.distinct import distinct_bitmaps, distinct_over
from ..functions.ordered import cut_lineage, new_copy
from ..functions.periods import join_periods
from ..operators import customer_state, lifecycle, time
from ..plans import crm, planning
from ..plans.orders import write_report
from ..sinks import maintained
from ..sinks.ordered import in_order
from ..sources.catalog import RetailTables
from .base import query
from .operators import activity


def read_in_order(t: RetailTables, name: str, report, *columns: str):
    path = new_copy(t.spark)
    write_report(name, report, path)
    return in_order(t.spark, path).select(*columns, "position")


@query("customer_frequency_in_order")
def _(t):
    return read_in_order(
        t, "customer_frequency_and_spend", crm.customer_frequency_and_spend(t), "order_year", "frequency_bucket", "sales_bucket", "total_sales"
    )


@query("merch_vs_culinary_in_order")
def _(t):
    return read_in_order(t, "merch_vs_culinary_customers", crm.merch_vs_culinary_customers(t, 2000), "customer_segment", "total_sales")


@query("open_backorders_in_order")
def _(t):
    report = planning.open_backorders(t, date(2000, 6, 15), date(1996, 1, 1), date(1996, 2, 1))
    return read_in_order(t, "open_backorders_report", report, "level_3_analytics_id", "product_analytics_id", "bo_rank_in_dept")


@query("returns_by_store_maintained")
def _(t):
    """The view made up to a day, and then renewed for the days that it lacks."""
    path = new_copy(t.spark)
    known = t["calendar"].where(F.col("gregorian_date") < F.lit(date(2000, 6, 1)))
    maintained.refresh(t, path, time.day_ids(known))
    maintained.maintain(t, path)
    return maintained.view(t.spark, path)


@query("customers_by_grain")
def _(t):
    orders = t["sales_header"].select("email", "source", F.year("date_ordered").cast("bigint").alias("order_year"))
    numbered = orders.join(lifecycle.surrogate_id(orders, "email", "customer"), "email")
    bitmaps = cut_lineage(distinct_bitmaps(numbered, ["source", "order_year"], "customer"))
    grains = {"source and year": ["source", "order_year"], "source": ["source"], "year": ["order_year"], "all": []}
    return distinct_over(bitmaps, grains, "customers")


@query("to_date_every_day")
def _(t):
    facts = t["line_facts"].where("is_return_line = 0").withColumn("sales_channel", F.coalesce("sales_channel", F.lit("pos")))
    return time.to_date_every_day(
        facts, t["calendar"], ["sales_channel"], {"sales": "merchandise", "units": "quantity"}, date(1999, 5, 12), date(2000, 6, 14)
    )


@query("sales_by_overlapping_periods")
def _(t):
    """Fiscal weeks, months, quarters and years at once."""
    calendar = t["calendar"]
    kinds = {"week": "fiscal_week_id", "month": "fiscal_month_id", "quarter": "fiscal_quarter_id", "year": "fiscal_year"}
    spans = [
        calendar.groupBy(F.col(c).cast("string").alias("id")).agg(F.min(time.DAY).alias("first"), F.max(time.DAY).alias("last")).withColumn("kind", F.lit(k))
        for k, c in kinds.items()
    ]
    periods = spans[0].unionByName(spans[1]).unionByName(spans[2]).unionByName(spans[3])
    daily = t["line_facts"].where("is_return_line = 0").groupBy(time.DAY).agg(F.sum("merchandise").alias("sales"), F.count(F.lit(1)).alias("lines"))
    return join_periods(daily, periods, time.DAY, "first", "last").groupBy("kind", "id").agg(F.sum("sales").alias("sales"), F.sum("lines").alias("lines"))


@query("lifecycle_by_state")
def _(t):
    """The last month's customers from the state before it and that month's activity."""
    keys, period = ["email", "sales_channel_type"], "month_analytics_id"
    active = activity(t)
    last = active.agg(F.max(period)).first()[0]
    before = cut_lineage(customer_state.state_of(active.where(F.col(period) < last), keys, period))
    state = customer_state.merged_state(before, customer_state.state_of(active.where(F.col(period) == last), keys, period), keys)
    return customer_state.lifecycle_of_state(state, keys, last, 12)
