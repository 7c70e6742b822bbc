"""The reports, each over the whole of the tables it reads, with dates inside the given data."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..plans import crm, ecommerce, finance, planning, retail
from .base import query

AS_OF = date(2000, 6, 15)

# Customer reports

query("cooking_class_cohorts")(crm.cooking_class_cohorts)
query("cooking_class_first_years")(crm.cooking_class_first_years)
query("customer_frequency_and_spend")(crm.customer_frequency_and_spend)
query("customer_segmentation_fiscal_year")(crm.customer_segmentation_fiscal_year)
query("customer_segmentation_channel_month")(crm.customer_segmentation_channel_month)
query("customer_segmentation_channel_product_quarter")(
    lambda t: crm.customer_segmentation_channel_product_quarter(t, (1994, 2003))
)
query("merch_vs_culinary_customers")(lambda t: crm.merch_vs_culinary_customers(t, 2000))
query("new_customers_r52_weeks")(lambda t: crm.new_customers_rolling(t, date(1996, 6, 15)))
query("online_cooking_class_buyers")(crm.online_class_buyers)
query("reactivated_customers_yearly")(crm.reactivated_customers_yearly)
query("retained_customers_monthly")(crm.retained_customers_monthly)
query("top_classes_customer_type")(lambda t: crm.top_classes(t, 1999))


@query("top_customers")
def _(t):
    excluded = t["order_header"].where(F.col("order_number").like("%77")).select("target_key").distinct()
    return crm.top_customers(t, {1999: 400, 1998: 300, 1997: 200, 1996: None}, ["%INTERNAL%", "%internal%"], excluded)


# E-commerce reports

query("marketplace_orders")(lambda t: ecommerce.marketplace_orders_of_yesterday(t, date(1998, 6, 18)))
query("discount_redemptions")(lambda t: ecommerce.discount_redemptions_of_yesterday(t, AS_OF))
query("hourly_ecommerce_demand")(
    lambda t: ecommerce.hourly_ecommerce_demand(t, date(1999, 10, 2), date(2000, 10, 14))
)
query("sales_by_price_type")(lambda t: ecommerce.sales_by_price_type(t, 200013))

# Finance reports

query("card_refunds_for_classes")(lambda t: finance.card_refunds_for_classes(t, date(1998, 4, 1), date(1999, 6, 30)))
query("direct_daily_kpis")(lambda t: finance.direct_daily_kpis(t, AS_OF))
query("mailed_refund_cheques")(lambda t: finance.mailed_refund_cheques(t, date(1999, 1, 1), date(2000, 12, 31)))
query("store_daily_kpis")(lambda t: finance.store_daily_kpis(t, AS_OF))

# Planning reports

query("market_basket_report")(lambda t: planning.market_basket(t, date(2000, 5, 1), date(2000, 5, 31)))
query("open_backorders_report")(
    lambda t: planning.open_backorders(t, AS_OF, date(1996, 1, 1), date(1996, 2, 1))
)
query("open_purchase_orders")(lambda t: planning.open_purchase_orders(t, AS_OF))
query("planning_dashboard")(
    lambda t: planning.planning_dashboard(t, AS_OF, date(2000, 6, 8), date(2000, 6, 4), date(2000, 6, 10))
)
query("sales_and_inventory")(lambda t: planning.sales_and_inventory(t, AS_OF, date(2000, 6, 14)))

# Retail reports

query("cancelled_cooking_classes")(lambda t: retail.cancelled_classes(t, datetime(2000, 1, 29), "Guest Chef"))
query("class_fill_rate")(
    lambda t: retail.class_fill_rate(t, datetime(2000, 1, 1), datetime(2000, 12, 31, 23, 59, 59))
)
query("returns_by_store")(retail.written_returns_by_store)
query("returns_by_store_to_date")(lambda t: retail.returns_by_store_to_date(t, AS_OF))
query("sales_by_discount_code")(lambda t: retail.sales_by_discount_code(t, AS_OF, date(2000, 6, 14)))
query("sales_by_discount_code_full")(
    lambda t: retail.sales_by_discount_code(t, AS_OF, date(2000, 6, 14), attribution="full")
)
query("store_margin")(lambda t: retail.store_margin(t, AS_OF, date(2000, 6, 4), date(2000, 6, 10)))
