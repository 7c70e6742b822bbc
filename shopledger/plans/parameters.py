"""Business values the reports take as arguments, with the defaults in use.

Names of people and customer keys are not kept here; they are arguments.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Order-frequency cap and spend bands with inclusive upper edges.
FREQUENCY_CAP = 5
SPEND_EDGES = (1000, 2500, 5000, 7500, 10000)
SPEND_LABELS = ("0-1000", "1001-2500", "2501-5000", "5001-7500", "7501-10000", "10000+")

# List prices of a class seat.
FULL_PRICES = (49, 59, 69, 79, 195, 200, 210, 250, 295)

# Region to district codes, manager and order; district to name and order.
REGIONS = {
    "West Coast": (("NW", "WC"), "West Coast", 1),
    "Mid-West": (("TX", "CHI"), "Mid-West", 2),
    "Florida": (("FL", "WDC"), "Florida", 3),
    "East Coast": (("OV", "EC"), "East Coast", 4),
    "ecommerce": (("DC",), "ecommerce", 5),
}
DISTRICTS = {
    "NW": ("West Coast North", 1),
    "WC": ("West Coast South", 2),
    "CHI": ("Greater Chicago", 3),
    "TX": ("Texas", 4),
    "FL": ("Florida", 5),
    "EC": ("East Coast", 6),
    "OV": ("Ohio Valley", 7),
    "WDC": ("District of Columbia", 8),
    "DC": ("ecommerce", 9),
}
WAREHOUSE_REGION = ("DC", 6, "DC", 10)
OTHER_REGION = ("zOther", 7, "Other", 11)
FLAG_STORES = (14, 18, 42, 76, 113, 122, 125, 138, 144, 154, 157, 159, 160, 161, 162, 171, 172, 174, 175)

# Forecast and budget columns of each demand class in the daily plan.
PLAN_COLUMNS: Mapping[int, tuple[str | None, str | None]] = {
    212: ("dc_sfs_forecasted_demand", "dc_sfs_budgeted_demand"),
    250275: ("drop_ship_forecasted_demand", "drop_ship_budgeted_demand"),
    337: ("amazon_marketplace_forecasted_demand", "amazon_marketplace_budgeted_demand"),
    353: ("slt_bopis_forecasted_demand", "slt_bopis_budgeted_demand"),
    250220: ("walmart_go_local_forecasted_demand", "walmart_go_local_budgeted_demand"),
    500198: ("gift_card_forecasted_demand", "gift_card_budgeted_demand"),
    216: ("warranty_forecasted_demand", "warranty_budgeted_demand"),
    461000001: (None, None),
    500086: ("culinary_forecasted_demand", "culinary_budgeted_demand"),
}


def demand_class_rules() -> dict[int, Column]:
    """When a written line belongs to a demand class; classes may overlap."""
    channel, level_5 = F.col("sales_channel"), F.col("level_5_analytics_id")
    own_stock = ~F.col("is_dropship") & (F.col("level_3_analytics_id") != 4)
    return {
        212: own_stock & channel.isin("web", "customer_service", "slt_sfs"),
        250275: F.col("is_dropship") & channel.isin("web", "customer_service"),
        337: channel == "amazon_marketplace",
        353: channel == "slt_bopis",
        250220: channel == "walmart_go_local",
        500198: level_5 == 500198,
        216: level_5 == 216,
        461000001: level_5 == 461000001,
        500086: channel == "culinary_orders",
    }
