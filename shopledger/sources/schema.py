"""Names and column types of the retail warehouse tables the reports read.

The warehouse declares no DDL, so a column's type follows from its name. The
rules below are checked in order; the first match wins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

# The tables a warehouse has to provide.
RETAIL_TABLES = (
    "calendar", "canceled_sales", "channels", "collections", "cosa",
    "crm_party_telephone", "culinary_products", "delivered_returns",
    "delivered_sales", "direct_forecast_sales_budget", "drop_ship_po",
    "fiscal_weeks", "forecast_and_budget", "forecast_and_budget_by_channel",
    "locations", "merchandising_taxonomies", "non_customer_emails",
    "order_header", "order_line", "po_details", "po_receipts", "pos_discounts",
    "product", "product_history", "product_price_history",
    "product_to_merchandising_taxonomy", "products", "sales_header",
    "sales_line", "sfcc_billing_address", "sfcc_discount", "sfcc_order",
    "sfcc_order_item", "sfcc_payment_instrument", "shoppertrak_traffic",
    "slt_product_attributes", "store_agents", "store_kpi", "store_master",
    "target", "trl_rtrans", "trl_rtrans_lineitm", "trn_trans",
    "ttr_send_check_tndr_lineitm", "ttr_tndr_lineitm", "vendors",
    "written_returns", "written_sales",
)

_TYPE_RULES = (
    (r"^(channel_analytics_id|order_line_analytics_id)$", "string"),
    (r"_analytics_id$|^target_key$|^fiscal_|^(level|party_id|cust_party_id|country_of_origin|payable_to_country)$", "bigint"),
    (r"^(rtl_loc_id|wkstn_id|trans_seq|rtrans_lineitm_seq|line_id|order_year)$", "bigint"),
    (r"^(maximum_seats|traffic_out_count|hasaddress|hasemail|week_in_quarter)$", "bigint"),
    (r"^(is_backorder|is_closed|is_foreign_vendor|void_flag|post_void_flag|contact_flag|email_valid_syntax)$", "int"),
    (r"^(dt|date_ordered|order_date|start_date|end_date|create_date)$", "timestamp_ntz"),
    (r"_date$|^date_opened$", "date"),
    (r"^(merchandise|fair_market_value|cosa|amt|price|total|sub_total|landed_cost|vendor_cost)$", "decimal(18,4)"),
    (r"(quantity|_price|_amount|_cost|_demand|_sales|_units|_orders|_traffic|_forecast|_fair_market_value)$",
     "decimal(18,4)"),
    (r"^quantity_|^has_comparable_sales$", "decimal(18,4)"),
    (r"^miles_to_closest_store$", "double"),
)


def column_type(name: str) -> str:
    """Spark type of a warehouse column, text when no rule applies."""
    for pattern, spark_type in _TYPE_RULES:
        if re.search(pattern, name):
            return spark_type
    return "string"


def conform(df: DataFrame) -> DataFrame:
    """Cast every column once, at load, to the type its name asks for.

    Flags that a warehouse keeps as booleans become the words TRUE and FALSE, which the reports compare with. A
    nested column has no counterpart and is refused.
    """
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"column {field.name} has the nested type {field.dataType.simpleString()}")
        wanted = column_type(field.name)
        column = F.col(f"`{field.name}`").cast(wanted)
        if isinstance(field.dataType, T.BooleanType) and wanted == "string":
            column = F.upper(column)
        columns.append(column.alias(field.name))
    return df.select(columns)
