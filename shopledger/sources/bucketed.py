"""Order-line tables stored in buckets of their line id, so that joining them moves no row.

Most reports join sales, returns or discounts to the order lines by ``order_line_analytics_id``. Tables that are bucketed
and sorted by it, with the same number of buckets, are joined bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from .catalog import RetailTables

LINE = "order_line_analytics_id"
#: The tables that meet on the line id.
LINE_TABLES = ("sales_line", "delivered_sales", "delivered_returns", "written_sales", "written_returns", "pos_discounts")


def write_bucketed(
    t: RetailTables, schema: str, buckets: int, path: str | None = None, tables: Sequence[str] = LINE_TABLES, key: str = LINE
) -> None:
    """Store ``tables`` as catalog tables of ``schema``; ``from_catalog`` reads them.

    ``buckets`` should leave a bucket of the largest table some hundred MB, and be the same for all tables that meet.
    Each bucket is one file: rows are dealt by the key first. ``path`` puts the files elsewhere than the warehouse.
    """
    for name in tables:
        dealt = t[name].repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet")
        (dealt.option("path", f"{path}/{name}") if path else dealt).saveAsTable(f"{schema}.{name}")
