"""The order in which each report is shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..sinks.ordered import Order, rank_of, write_ordered


def report_orders() -> dict[str, Sequence[Order]]:
    """Sort columns by report; columns may be expressions, which need a session."""
    return {
        "cooking_class_cohorts": ["order_year", "frequency_bucket", "price_mix_type", "tenure_in_year"],
        "cooking_class_first_years": ["first_year"],
        "customer_frequency_and_spend": ["order_year", "frequency_bucket", "sales_bucket"],
        "customer_segmentation_fiscal_year": ["fiscal_year", "customer_type"],
        "customer_segmentation_channel_month": ["fiscal_month_id", "sales_channel_type", "customer_type"],
        "merch_vs_culinary_customers": [rank_of("customer_segment", "AllCustomers", "Culinary+Merch", "CulinaryOnly", "NonCulinary")],
        "online_cooking_class_buyers": [("occ_sales", "desc")],
        "reactivated_customers_yearly": ["year"],
        "retained_customers_monthly": ["year", "month"],
        "top_classes_customer_type": [rank_of("customer_tenure", "All", "New", "Existing"), "sales_rank_within_tenure"],
        "top_customers": [("total_sales", "desc")],
        "marketplace_orders": [("order_date", "desc"), "amz_order_number"],
        "discount_redemptions": ["discount_type", "campaign_name", "promotion_rank_in_campaign", "promotion_name", "discount_name"],
        "hourly_ecommerce_demand": ["order_date", "order_hour"],
        "sales_by_price_type": ["price_type_order", "merch_group", "level_3_analytics_id", "channel", "price_type"],
        "card_refunds_for_classes": ["date_ordered", "sfcc_order_number", "line_rank_in_order"],
        "mailed_refund_cheques": ["store_id", "transaction_timestamp"],
        "store_daily_kpis": ["manager", "location_analytics_id"],
        "market_basket_report": ["channel_code", "level_3_analytics_id", "product_analytics_id", "sku_channel_rank_within_sku"],
        "open_backorders_report": ["level_3_analytics_id", "bo_rank_in_dept", "product_analytics_id"],
        "open_purchase_orders": ["vendor_name", ("po_written_date", "desc"), "product_name"],
        "planning_dashboard": ["channel_rank_by_current_inv"],
        "sales_and_inventory": ["level_5_analytics_id", "channel", "vendor_rank_ytd_in_dept"],
        "cancelled_cooking_classes": ["class_start_date", "location_code", "order_number", "sku"],
        "class_fill_rate": ["date_start", "store"],
        "sales_by_discount_code": ["level_3_analytics_id", "taxonomy_code", "product_analytics_id", "discount_code", "subdiscount_code"],
        "store_margin": ["region_order", "district_order", "store_name"],
    }


def write_report(name: str, report: DataFrame, path: str, **options) -> None:
    """Write a report in its order; see ``write_ordered``."""
    write_ordered(report, path, report_orders()[name], **options)
