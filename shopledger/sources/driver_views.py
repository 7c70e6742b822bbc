"""Retail tables as views of the driver's tables.

The given tables hold orders and lines but no retail warehouse, so each retail
table is a plain projection (sometimes one group-by) of them. The text is
portable SQL: the same view runs in Spark and, for the oracle, in DuckDB.
``{name}`` refers to another view or a given table; ``DAYNO(d)`` is the number
of days since 1970-01-01. Views read only the columns asked for, and no id
depends on the physical order of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .catalog import RetailTables

# Schemas of the given tables; stating them saves reading footers first.
GIVEN_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_VIEWS = """
-- lines: one row per order line, the base of all line-level tables
SELECT
  concat(l_orderkey * 8 + l_linenumber, '-', l_partkey, '-',
         l_suppkey * 10000 + DAYNO(CAST(l_shipdate AS DATE))) AS order_line_analytics_id,
  l_orderkey AS order_analytics_id,
  CAST(l_orderkey AS STRING) AS order_number,
  CAST(l_linenumber AS BIGINT) AS line_id,
  l_partkey AS product_analytics_id,
  CASE WHEN l_partkey % 40 = 39 THEN concat('CSA', l_partkey) ELSE CAST(l_partkey AS STRING) END AS sku,
  l_suppkey AS vendor_analytics_id,
  l_shipdate AS dt,
  CAST(DAYNO(CAST(l_shipdate AS DATE)) AS BIGINT) AS date_analytics_id,
  CASE l_orderkey % 8
    WHEN 0 THEN 'web' WHEN 1 THEN 'customer_service' WHEN 2 THEN 'slt_bopis'
    WHEN 3 THEN 'amazon_marketplace' WHEN 4 THEN 'culinary_orders'
    WHEN 5 THEN 'walmart_go_local' WHEN 6 THEN 'slt_sfs' END AS sales_channel,
  CASE WHEN l_orderkey % 8 = 7 THEN 'xcenter' ELSE 'oroms' END AS source,
  CASE WHEN l_orderkey % 8 = 7 THEN 'in_store_sale'
       WHEN l_partkey % 20 = 0 THEN 'amazon'
       WHEN l_orderkey % 8 IN (2, 5) THEN 'bopis'
       WHEN l_orderkey % 8 = 1 THEN 'phone' ELSE 'ecommerce' END AS order_line_type,
  l_orderkey % 25 AS attribution_location_analytics_id,
  CASE WHEN l_partkey % 4 = 0 THEN 904 ELSE l_orderkey % 25 END AS location_analytics_id,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS merchandise,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.5 AS DECIMAL(18,4)) AS fair_market_value,
  CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.01 AS DECIMAL(18,4)) AS unit_last_cost,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discount_amount,
  l_returnflag, l_linestatus
FROM {lineitem}

-- sales_line
SELECT order_line_analytics_id, order_analytics_id, order_number, line_id, product_analytics_id, sku,
  sales_channel, source, order_line_type, attribution_location_analytics_id, location_analytics_id,
  dt + (product_analytics_id % 24) * INTERVAL '1' HOUR AS date_ordered,
  merchandise, quantity, unit_last_cost, merchandise AS sub_total,
  CAST(10 + product_analytics_id % 90 AS DECIMAL(18,4)) AS unit_price,
  CASE WHEN product_analytics_id % 11 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'FALSE' END AS is_return,
  CASE WHEN product_analytics_id % 17 = 0 THEN 'TRUE' ELSE 'FALSE' END AS is_canceled,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_backorder,
  CASE WHEN l_returnflag = 'A' THEN 'closed' ELSE 'open' END AS status,
  quantity AS quantity_shipped,
  CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS quantity_returned,
  CAST(CASE WHEN product_analytics_id % 17 = 0 THEN 2 ELSE 0 END AS DECIMAL(18,4)) AS quantity_canceled,
  CASE WHEN product_analytics_id % 17 = 0 THEN 'C1' END AS cancellation_reason_code,
  CASE WHEN product_analytics_id % 17 = 0 THEN 'customer request' END AS cancellation_reason
FROM {lines}

-- written_sales
SELECT order_analytics_id, order_number, order_line_analytics_id, product_analytics_id, dt, date_analytics_id,
  date_analytics_id AS date_ordered_analytics_id, merchandise, quantity, fair_market_value
FROM {lines}

-- delivered_sales
SELECT order_analytics_id, order_line_analytics_id, product_analytics_id, dt, date_analytics_id,
  date_analytics_id AS date_ordered_analytics_id, merchandise, quantity, fair_market_value
FROM {lines} WHERE l_returnflag <> 'R'

-- delivered_returns
SELECT order_analytics_id, order_line_analytics_id, product_analytics_id, dt, date_analytics_id,
  location_analytics_id, merchandise, quantity, fair_market_value,
  CASE WHEN order_analytics_id % 8 = 7 AND order_analytics_id % 5 <> 0
       THEN order_analytics_id - order_analytics_id % 7 END AS original_order_analytics_id,
  CASE WHEN line_id = 1 THEN 'R1' ELSE 'R2' END AS reason_code,
  CASE WHEN line_id = 1 THEN 'damaged' ELSE 'unwanted' END AS reason
FROM {lines} WHERE l_returnflag = 'R'

-- line_facts: lines with the sign of the movement and the last cost, for operator-level queries
SELECT order_analytics_id, order_line_analytics_id, product_analytics_id, sku, vendor_analytics_id,
  attribution_location_analytics_id, location_analytics_id, sales_channel, source, order_line_type, dt,
  date_analytics_id, merchandise, quantity, fair_market_value, unit_last_cost, discount_amount,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_return_line
FROM {lines}

-- written_returns
SELECT order_number, order_line_analytics_id, dt,
  CASE WHEN line_id = 1 THEN 'R1' ELSE 'R2' END AS reason_code,
  CASE WHEN line_id = 1 THEN 'damaged' ELSE 'unwanted' END AS reason
FROM {lines} WHERE l_returnflag = 'R'

-- canceled_sales
SELECT order_number, order_line_analytics_id, dt
FROM {lines} WHERE product_analytics_id % 17 = 0

-- pos_discounts: no, one or two codes per line
SELECT order_line_analytics_id,
  CASE product_analytics_id % 3 WHEN 0 THEN 'COOKING10' WHEN 1 THEN 'PROMO' ELSE 'VIP' END AS discount_code,
  concat('S', line_id) AS subdiscount_code,
  discount_amount
FROM {lines} WHERE discount_amount > 0
UNION ALL
SELECT order_line_analytics_id, 'EXTRA' AS discount_code, 'S0' AS subdiscount_code,
  CAST(1.5 AS DECIMAL(18,4)) AS discount_amount
FROM {lines} WHERE product_analytics_id % 6 = 0

-- store_agents
SELECT order_analytics_id, order_line_analytics_id FROM {lines} WHERE product_analytics_id % 5 = 0

-- drop_ship_po
SELECT order_analytics_id, product_analytics_id, concat('PO', order_line_analytics_id) AS po_number
FROM {lines} WHERE vendor_analytics_id % 4 = 0

-- product_price_history: one price per product and day sold
SELECT product_analytics_id, sku, date_analytics_id, CAST(dt AS DATE) AS snapshot_date,
  CASE (product_analytics_id + date_analytics_id) % 5
    WHEN 0 THEN 'regular_price' WHEN 1 THEN 'promotional_sale' WHEN 2 THEN 'markdown_sale'
    WHEN 3 THEN 'marked_out_of_stock' END AS price_type,
  CAST(CAST(2000 + (product_analytics_id * 37 + date_analytics_id * 7) % 5000 AS DECIMAL(18,2)) * 0.01
       AS DECIMAL(18,4)) AS price
FROM {lines} WHERE product_analytics_id % 3 <> 0
GROUP BY product_analytics_id, sku, date_analytics_id, CAST(dt AS DATE)

-- product_history: stock per product, site and day
SELECT product_analytics_id,
  CASE product_analytics_id % 4 WHEN 0 THEN 904 WHEN 1 THEN 903 ELSE attribution_location_analytics_id END
    AS location_analytics_id,
  date_analytics_id,
  CAST(sum(quantity) AS DECIMAL(18,4)) AS quantity_on_hand,
  CAST(sum(merchandise) AS DECIMAL(18,4)) AS available_fair_market_value,
  CAST(sum(fair_market_value) AS DECIMAL(18,4)) AS in_transit_fair_market_value
FROM {lines}
GROUP BY product_analytics_id,
  CASE product_analytics_id % 4 WHEN 0 THEN 904 WHEN 1 THEN 903 ELSE attribution_location_analytics_id END,
  date_analytics_id

-- cosa: cost adjustments; the shifted days give adjustment-only rows
SELECT attribution_location_analytics_id AS location_analytics_id, product_analytics_id,
  date_analytics_id + line_id % 2 AS date_analytics_id,
  CAST(sum(merchandise) * 0.02 AS DECIMAL(18,4)) AS cosa
FROM {lines} WHERE product_analytics_id % 6 = 0
GROUP BY attribution_location_analytics_id, product_analytics_id, date_analytics_id + line_id % 2

-- forecast_and_budget_by_channel
SELECT attribution_location_analytics_id AS location_analytics_id, date_analytics_id + 1 AS date_analytics_id,
  coalesce(sales_channel, 'pos') AS sales_channel,
  CAST(sum(merchandise) * 0.9 AS DECIMAL(18,4)) AS forecast_sales,
  CAST(sum(merchandise) * 1.1 AS DECIMAL(18,4)) AS budget_sales,
  CAST(sum(quantity) AS DECIMAL(18,4)) AS forecast_units,
  CAST(sum(quantity) + 1 AS DECIMAL(18,4)) AS budget_units,
  CAST(count(*) AS DECIMAL(18,4)) AS forecast_orders,
  CAST(count(*) + 1 AS DECIMAL(18,4)) AS budget_orders
FROM {lines} GROUP BY attribution_location_analytics_id, date_analytics_id + 1, coalesce(sales_channel, 'pos')

-- forecast_and_budget
SELECT attribution_location_analytics_id AS location_analytics_id, date_analytics_id,
  CAST(sum(merchandise) * 0.1 AS DECIMAL(18,4)) AS culinary_discount_forecast
FROM {lines} WHERE product_analytics_id % 5 = 0
GROUP BY attribution_location_analytics_id, date_analytics_id

-- direct_forecast_sales_budget: one wide row per day
SELECT date_analytics_id,
  CAST(sum(merchandise) * 0.40 AS DECIMAL(18,4)) AS dc_sfs_forecasted_demand,
  CAST(sum(merchandise) * 0.41 AS DECIMAL(18,4)) AS dc_sfs_budgeted_demand,
  CAST(sum(merchandise) * 0.20 AS DECIMAL(18,4)) AS drop_ship_forecasted_demand,
  CAST(sum(merchandise) * 0.21 AS DECIMAL(18,4)) AS drop_ship_budgeted_demand,
  CAST(sum(merchandise) * 0.10 AS DECIMAL(18,4)) AS amazon_marketplace_forecasted_demand,
  CAST(sum(merchandise) * 0.11 AS DECIMAL(18,4)) AS amazon_marketplace_budgeted_demand,
  CAST(sum(merchandise) * 0.12 AS DECIMAL(18,4)) AS slt_bopis_forecasted_demand,
  CAST(sum(merchandise) * 0.13 AS DECIMAL(18,4)) AS slt_bopis_budgeted_demand,
  CAST(sum(merchandise) * 0.14 AS DECIMAL(18,4)) AS walmart_go_local_forecasted_demand,
  CAST(sum(merchandise) * 0.15 AS DECIMAL(18,4)) AS walmart_go_local_budgeted_demand,
  CAST(sum(merchandise) * 0.04 AS DECIMAL(18,4)) AS gift_card_forecasted_demand,
  CAST(sum(merchandise) * 0.05 AS DECIMAL(18,4)) AS gift_card_budgeted_demand,
  CAST(sum(merchandise) * 0.02 AS DECIMAL(18,4)) AS warranty_forecasted_demand,
  CAST(sum(merchandise) * 0.03 AS DECIMAL(18,4)) AS warranty_budgeted_demand,
  CAST(sum(merchandise) * 0.06 AS DECIMAL(18,4)) AS culinary_forecasted_demand,
  CAST(sum(merchandise) * 0.07 AS DECIMAL(18,4)) AS culinary_budgeted_demand
FROM {lines} WHERE product_analytics_id % 2 = 0 GROUP BY date_analytics_id

-- shoppertrak_traffic
SELECT o_orderkey % 25 AS location_analytics_id, CAST(DAYNO(CAST(o_orderdate AS DATE)) AS BIGINT) AS date_analytics_id,
  count(*) * 3 AS traffic_out_count
FROM {orders} GROUP BY o_orderkey % 25, CAST(DAYNO(CAST(o_orderdate AS DATE)) AS BIGINT)

-- store_kpi
SELECT o_orderkey % 25 AS location_analytics_id, CAST(DAYNO(CAST(o_orderdate AS DATE)) AS BIGINT) AS date_analytics_id,
  CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS hasaddress,
  CAST(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS hasemail
FROM {orders}

-- po_details
SELECT order_analytics_id AS purchase_order_analytics_id, order_line_analytics_id AS po_line_number,
  location_analytics_id, product_analytics_id,
  CASE WHEN line_id = 7 THEN NULL ELSE vendor_analytics_id END AS vendor_analytics_id, sku,
  CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS is_closed,
  CAST(CAST(dt AS DATE) - INTERVAL '60' DAY AS DATE) AS written_date,
  CAST(CAST(dt AS DATE) - INTERVAL '20' DAY AS DATE) AS current_ship_date,
  CAST(dt AS DATE) AS current_arrival_date, date_analytics_id AS current_arrival_date_analytics_id,
  quantity AS quantity_ordered, CAST(5 AS DECIMAL(18,4)) AS quantity_received,
  CAST(quantity - 5 AS DECIMAL(18,4)) AS quantity_open,
  CASE WHEN line_id = 1 THEN CAST(dt AS DATE) END AS next_cost_effective_date,
  CASE WHEN line_id = 2 THEN CAST(dt AS DATE) END AS cancel_date,
  CASE WHEN line_id <> 3 THEN concat('VPO', order_analytics_id) END AS vendor_po_name,
  CAST(1 + product_analytics_id % 50 AS DECIMAL(18,4)) AS landed_cost,
  CAST(1 + product_analytics_id % 40 AS DECIMAL(18,4)) AS vendor_cost
FROM {lines}

-- po_receipts
SELECT order_analytics_id AS purchase_order_analytics_id, order_line_analytics_id AS po_line_number,
  location_analytics_id, product_analytics_id, date_analytics_id AS received_date_analytics_id,
  CAST(5 AS DECIMAL(18,4)) AS recieved_quantity
FROM {lines} WHERE line_id % 2 = 0

-- sales_header
SELECT o_orderkey AS order_analytics_id, CAST(o_orderkey AS STRING) AS order_number,
  CASE WHEN o_orderkey % 8 = 7 THEN 'xcenter' ELSE 'oroms' END AS source,
  CASE WHEN o_orderkey % 8 = 7 AND o_orderkey % 3 = 0 THEN 'bopis'
       WHEN o_orderkey % 8 = 7 THEN 'in_store_sale'
       WHEN o_orderkey % 8 = 2 THEN 'web_bopis' ELSE 'ecommerce' END AS order_type,
  CASE WHEN o_custkey % 10 = 0 OR (o_orderkey % 8 = 7 AND o_orderkey % 3 = 0) THEN NULL
       ELSE concat('c', o_custkey, '@mail.test') END AS email,
  CASE WHEN o_orderkey % 8 = 7 THEN CAST(o_orderkey - 5 AS STRING) END AS alt_order_number_1,
  CASE WHEN o_orderkey % 8 = 3 THEN concat('MP', o_orderkey - o_orderkey % 16)
       WHEN o_orderkey % 16 = 4 THEN concat('Originating Store: 90', o_orderkey % 10) END AS alt_order_number_2,
  concat('E', o_orderkey) AS ecom_order_number,
  o_orderdate + (o_custkey % 24) * INTERVAL '1' HOUR AS date_ordered,
  CAST(DAYNO(CAST(o_orderdate AS DATE)) AS BIGINT) AS date_ordered_analytics_id
FROM {orders}

-- order_header
SELECT CASE WHEN o_custkey % 50 = 0 THEN -1 ELSE o_custkey END AS target_key,
  CAST(o_orderkey AS STRING) AS order_number,
  o_orderdate AS order_date, CAST(year(o_orderdate) AS BIGINT) AS order_year,
  CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.01 AS DECIMAL(18,4)) AS net_amount,
  CAST(1 + o_orderkey % 7 AS DECIMAL(18,4)) AS net_quantity,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_orderkey % 4 ELSE 0 END AS DECIMAL(18,4)) AS cooking_school_quantity,
  CAST(CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) * 0.01
            WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) * 0.005
            WHEN o_orderkey % 5 = 0 THEN NULL ELSE 0 END AS DECIMAL(18,4)) AS cooking_school_amount,
  CASE WHEN o_orderkey % 20 = 0 THEN 'N' ELSE 'Y' END AS purchase_order,
  CAST(CASE WHEN o_orderkey % 25 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS cancel_quantity,
  o_orderpriority AS channel_code_desc,
  concat('|', 990 + o_orderkey % 20, '|') AS sub_categories_purchased
FROM {orders}

-- order_line
SELECT CAST(l_orderkey AS STRING) AS order_number, 
  CASE WHEN l_partkey % 40 = 39 THEN concat('CSA', l_partkey) ELSE CAST(l_partkey AS STRING) END AS item_number,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CASE WHEN l_returnflag = 'R' THEN -0.01 ELSE 0.01 END
       AS DECIMAL(18,4)) AS net_amount,
  CAST(l_quantity AS DECIMAL(18,4)) AS net_quantity,
  CAST(CASE WHEN l_suppkey % 2 = 0 THEN 49 + 10 * (l_partkey % 4) ELSE 45 END AS DECIMAL(18,4)) AS price
FROM {lineitem}

-- target
SELECT c_custkey AS target_key,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN concat('c', c_custkey, '@INTERNAL.test')
       ELSE concat('c', c_custkey, '@mail.test') END AS email,
  concat('F', c_custkey) AS first_name, c_name AS last_name,
  DATE '1995-01-01' + CAST(c_custkey % 2200 AS INT) AS original_entered_date,
  CAST(c_custkey % 60 AS DOUBLE) AS miles_to_closest_store,
  CAST(c_nationkey AS STRING) AS closest_store_id,
  CASE WHEN c_custkey % 19 = 0 THEN 0 ELSE 1 END AS email_valid_syntax,
  CASE WHEN c_custkey % 23 = 0 THEN 'Y' ELSE 'N' END AS do_not_email
FROM {customer}

-- store_master
SELECT CAST(n_nationkey AS STRING) AS store_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Y' ELSE 'N' END AS culinary
FROM {nation}

-- non_customer_emails
SELECT concat('c', c_custkey, '@mail.test') AS email FROM {customer} WHERE c_custkey % 100 = 3

-- part_names: departments and product families of each part
SELECT p_partkey,
  CASE WHEN p_partkey % 40 = 39 THEN concat('CSA', p_partkey) ELSE CAST(p_partkey AS STRING) END AS sku,
  CASE p_type WHEN 'STANDARD' THEN 500004 WHEN 'LARGE' THEN 500007 WHEN 'ECONOMY' THEN 3
    WHEN 'SMALL' THEN 4 WHEN 'MEDIUM' THEN 8 ELSE 99 END AS level_3_analytics_id,
  CASE p_type WHEN 'STANDARD' THEN 'COOKWARE' WHEN 'LARGE' THEN 'TABLETOP' WHEN 'ECONOMY' THEN 'CUTLERY'
    WHEN 'SMALL' THEN 'COOKING SCHOOL' WHEN 'MEDIUM' THEN 'FOOD' ELSE 'GIFT CERTIFICATES' END AS level_3_name,
  CASE WHEN p_brand = 'Brand#1' THEN 'GIFT CERTIFICATES' ELSE concat('GROUP ', p_size) END AS level_4_name,
  CASE WHEN p_brand = 'Brand#2' THEN 'WARRANTY' ELSE p_brand END AS level_5_name,
  CASE p_brand WHEN 'Brand#1' THEN 500198 WHEN 'Brand#2' THEN 216 WHEN 'Brand#3' THEN 461000001
    ELSE CAST(substr(p_brand, 7) AS BIGINT) END AS level_5_analytics_id
FROM {part}

-- products
SELECT p_partkey AS product_analytics_id,
  CASE WHEN p_partkey % 40 = 39 THEN concat('CSA', p_partkey) ELSE CAST(p_partkey AS STRING) END AS sku,
  p_name AS product_name, concat('class of ', p_name) AS short_description,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) + CAST(p_partkey % 10 AS DECIMAL(12,2)) * 0.01 AS DECIMAL(18,4)) AS retail_price,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) + 5 AS DECIMAL(18,4)) AS original_retail_price,
  CASE WHEN p_partkey % 50 <> 0 THEN DATE '2000-06-15' - CAST(p_partkey % 500 AS INT) END AS last_receipt_date,
  DATE '1999-01-01' - CAST(p_partkey % 500 AS INT) AS first_receipt_date,
  CASE WHEN p_size <> 50 THEN CAST(p_size AS BIGINT) END AS vendor_analytics_id,
  concat('season ', p_size % 4) AS season, concat('holiday ', p_size % 3) AS holiday,
  CAST(p_size % 25 AS BIGINT) AS country_of_origin, CAST(p_size AS DECIMAL(18,4)) AS minimum_order_quantity
FROM {part}

-- product
SELECT sku, level_3_name AS category_name, level_5_name AS class_name FROM {part_names}

-- product_to_merchandising_taxonomy
SELECT p_partkey AS product_analytics_id, CAST(level_3_analytics_id AS BIGINT) AS level_3_analytics_id, level_3_name,
  level_4_name, level_5_name, CAST(level_5_analytics_id AS BIGINT) AS level_5_analytics_id
FROM {part_names}

-- merchandising_taxonomies
SELECT DISTINCT CAST(level_3_analytics_id AS BIGINT) AS taxonomy_analytics_id,
  CAST(1 AS BIGINT) AS parent_taxonomy_analytics_id, level_3_name AS name,
  CAST(level_3_analytics_id % 1000 AS STRING) AS taxonomy_code, CAST(3 AS BIGINT) AS level
FROM {part_names}
UNION ALL
SELECT DISTINCT CAST(level_5_analytics_id AS BIGINT), CAST(level_3_analytics_id AS BIGINT), level_5_name,
  CAST(level_5_analytics_id % 1000 AS STRING), CAST(5 AS BIGINT)
FROM {part_names}

-- slt_product_attributes
SELECT p_partkey AS product_analytics_id, concat('COL', p_size % 7) AS collection,
  CAST(1 + p_size AS DECIMAL(18,4)) AS next_vendor_cost, concat('market ', p_size % 2) AS market,
  CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'held' END AS status,
  concat('T', p_size % 3) AS ticket_type, concat('port ', p_size % 5) AS port
FROM {part}

-- collections
SELECT DISTINCT concat('COL', p_size % 7) AS collection, CAST(CASE WHEN p_size % 2 = 0 THEN 4 ELSE 8 END AS STRING) AS department,
  concat('Collection ', p_size % 7) AS collection_name
FROM {part} WHERE p_size % 7 < 5

-- culinary_products: bookable sessions
SELECT CASE WHEN p_partkey % 40 = 39 THEN concat('CSA', p_partkey) ELSE CAST(p_partkey AS STRING) END AS sku,
  CAST(p_partkey % 25 AS STRING) AS location_code, concat('Chef ', p_size) AS instructor_name,
  CAST(CASE WHEN p_partkey % 30 = 0 THEN 0 ELSE 20 * p_size END AS BIGINT) AS maximum_seats,
  CASE WHEN p_partkey % 5 = 0 THEN 'TRUE' ELSE 'FALSE' END AS is_class_cancelled,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS price,
  concat('type ', p_size % 4) AS class_type,
  CAST('2000-01-01 10:00:00' AS TIMESTAMP_NTZ) + (p_partkey % 400) * INTERVAL '1' DAY AS start_date,
  CAST('2000-01-01 12:00:00' AS TIMESTAMP_NTZ) + (p_partkey % 400) * INTERVAL '1' DAY AS end_date
FROM {part} WHERE p_type IN ('SMALL', 'MEDIUM', 'LARGE')

-- vendors
SELECT s_suppkey AS vendor_analytics_id, s_name AS vendor_name,
  CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 3 = 1 THEN 0 END AS is_foreign_vendor,
  concat('style ', s_suppkey) AS vendor_style_num
FROM {supplier}

-- locations: stores by nation, plus two warehouses
SELECT CAST(n_nationkey AS BIGINT) AS location_analytics_id, CAST(n_nationkey AS STRING) AS location_code, n_name AS name,
  CASE WHEN n_nationkey = 2 THEN '2' ELSE '1' END AS channel_analytics_id,
  CASE WHEN n_nationkey = 2 THEN 'web' ELSE 'store' END AS channel_code,
  CASE n_nationkey % 10 WHEN 0 THEN 'NW' WHEN 1 THEN 'WC' WHEN 2 THEN 'DC' WHEN 3 THEN 'TX' WHEN 4 THEN 'CHI'
    WHEN 5 THEN 'FL' WHEN 6 THEN 'WDC' WHEN 7 THEN 'OV' WHEN 8 THEN 'EC' END AS district_code,
  concat('manager ', n_regionkey) AS manager,
  DATE '1990-01-01' + CAST(n_nationkey * 30 AS INT) AS date_opened,
  CAST(CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END AS DECIMAL(18,4)) AS has_comparable_sales
FROM {nation}
UNION ALL
SELECT CAST(903 + r_regionkey AS BIGINT), CAST(903 + r_regionkey AS STRING), concat('WAREHOUSE ', r_name), '5', 'warehouse',
  NULL, 'manager of warehouses', DATE '1990-01-01', CAST(0 AS DECIMAL(18,4))
FROM {region} WHERE r_regionkey < 2

-- channels
SELECT DISTINCT CASE WHEN n_nationkey = 2 THEN '2' ELSE '1' END AS channel_analytics_id,
  CASE WHEN n_nationkey = 2 THEN 'web' ELSE 'store' END AS channel_code
FROM {nation}
UNION ALL
SELECT '5', 'warehouse' FROM {region} WHERE r_regionkey = 0

-- sfcc_order
SELECT concat('E', o_orderkey) AS sfcc_order_number, o_orderdate AS order_date,
  CASE WHEN o_custkey % 7 = 0 THEN 'Guest Chef' ELSE concat('Customer ', o_custkey) END AS customer_name
FROM {orders} WHERE o_orderkey % 8 <> 7

-- sfcc_billing_address
SELECT concat('E', o_orderkey) AS sfcc_order_number,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('F', o_custkey) END AS first_name,
  concat('L', o_custkey) AS last_name
FROM {orders} WHERE o_orderkey % 8 <> 7

-- sfcc_order_item: one row per order and sku
SELECT concat('E', order_analytics_id) AS sfcc_order_number, sku,
  CASE WHEN product_analytics_id % 3 = 0 THEN 'Culinary' ELSE 'Retail' END AS product_type,
  concat('item ', product_analytics_id) AS product_name,
  CAST(10 + product_analytics_id % 90 AS DECIMAL(18,4)) AS unit_price
FROM {lines} WHERE order_analytics_id % 8 <> 7
GROUP BY order_analytics_id, sku, product_analytics_id

-- sfcc_payment_instrument
SELECT concat('E', o_orderkey) AS sfcc_order_number,
  CASE o_orderkey % 3 WHEN 0 THEN 'Amex' WHEN 1 THEN 'Visa' ELSE 'Master' END AS card_type,
  CAST(1000 + o_custkey % 9000 AS STRING) AS last_4
FROM {orders}

-- sfcc_discount
SELECT concat('E', o_orderkey) AS sfcc_order_number, concat('type ', o_orderkey % 2) AS discount_type,
  concat('campaign ', o_custkey % 3) AS campaign_name, concat('promotion ', o_custkey % 5) AS promotion_name,
  concat('discount ', o_orderkey % 4) AS discount_name,
  CAST(CASE WHEN o_custkey % 3 = 2 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(12,2)) * 0.01 END AS DECIMAL(18,4)) AS total
FROM {orders}

-- trn_trans
SELECT 'ORG' AS organization_id, o_orderkey % 25 AS rtl_loc_id, CAST(o_orderdate AS DATE) AS business_date,
  o_orderkey % 4 AS wkstn_id, o_orderkey AS trans_seq,
  o_orderdate + (o_custkey % 24) * INTERVAL '1' HOUR AS create_date,
  CASE WHEN o_orderstatus = 'P' THEN 'SUSPEND' ELSE 'COMPLETE' END AS trans_statcode,
  CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS post_void_flag,
  CASE WHEN o_orderkey % 13 = 0 THEN 'DATALOADER' WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'clerk' END AS create_user_id
FROM {orders}

-- trl_rtrans
SELECT 'ORG' AS organization_id, o_orderkey % 25 AS rtl_loc_id, CAST(o_orderdate AS DATE) AS business_date,
  o_orderkey % 4 AS wkstn_id, o_orderkey AS trans_seq, o_custkey AS cust_party_id, 'clerk' AS create_user_id
FROM {orders}

-- ttr_send_check_tndr_lineitm
SELECT 'ORG' AS organization_id, o_orderkey % 25 AS rtl_loc_id, CAST(o_orderdate AS DATE) AS business_date,
  o_orderkey % 4 AS wkstn_id, o_orderkey AS trans_seq, concat('Payee ', o_custkey) AS payable_to_name,
  concat(o_custkey, ' Main St') AS payable_to_address,
  CASE WHEN o_custkey % 2 = 0 THEN concat('Floor ', o_custkey % 5) END AS payable_to_address2,
  concat('Apt ', o_custkey % 9) AS payable_to_apt, concat('City ', o_custkey % 100) AS payable_to_city,
  concat('S', o_custkey % 50) AS payable_to_state, CAST(10000 + o_custkey % 1000 AS STRING) AS payable_to_postal_code,
  o_custkey % 25 AS payable_to_country, 'clerk' AS create_user_id
FROM {orders} WHERE o_orderkey % 2 = 0

-- ttr_tndr_lineitm
SELECT 'ORG' AS organization_id, o_orderkey % 25 AS rtl_loc_id, CAST(o_orderdate AS DATE) AS business_date,
  o_orderkey % 4 AS wkstn_id, o_orderkey AS trans_seq, o_orderkey % 3 AS rtrans_lineitm_seq,
  CAST(0 - CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS amt,
  CASE WHEN o_orderkey % 5 = 0 THEN 'CASH' ELSE 'HOME_OFFICE_CHECK' END AS tndr_id, 'clerk' AS create_user_id
FROM {orders}

-- trl_rtrans_lineitm
SELECT 'ORG' AS organization_id, o_orderkey % 25 AS rtl_loc_id, CAST(o_orderdate AS DATE) AS business_date,
  o_orderkey % 4 AS wkstn_id, o_orderkey AS trans_seq, o_orderkey % 3 AS rtrans_lineitm_seq,
  CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS void_flag, 'clerk' AS create_user_id
FROM {orders}

-- crm_party_telephone: two numbers per party, some without a number
SELECT c_custkey AS party_id, concat('555-', c_custkey) AS telephone_number, CAST(c_custkey % 2 AS INT) AS contact_flag,
  CAST('2000-01-01 00:00:00' AS TIMESTAMP_NTZ) + (c_custkey % 30) * INTERVAL '1' DAY AS create_date
FROM {customer}
UNION ALL
SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN concat('777-', c_custkey) END, CAST(1 AS INT),
  CAST('2000-01-15 00:00:00' AS TIMESTAMP_NTZ)
FROM {customer}

-- calendar: ten fiscal years of 52 weeks from Sunday 1994-01-02
SELECT date_analytics_id, gregorian_date, date_analytics_id AS fiscal_date_id, fiscal_year,
  fiscal_year * 100 + quarter AS fiscal_quarter_id, (fiscal_year - 1994) * 4 + quarter AS quarter_analytics_id,
  fiscal_year * 100 + month AS fiscal_month_id, (fiscal_year - 1994) * 12 + month AS month_analytics_id,
  fiscal_year * 100 + week AS fiscal_week_id, week_analytics_id,
  fiscal_year * 10 + CASE WHEN quarter <= 2 THEN 1 ELSE 2 END AS fiscal_season_id,
  date_analytics_id - 364 AS last_year_date_analytics_id, week - 13 * (quarter - 1) AS week_in_quarter
FROM (
  SELECT *, 3 * (quarter - 1) + CASE WHEN week - 13 * (quarter - 1) <= 4 THEN 1
                                     WHEN week - 13 * (quarter - 1) <= 9 THEN 2 ELSE 3 END AS month
  FROM (
    SELECT *, CAST(floor((week - 1) / 13) AS BIGINT) + 1 AS quarter
    FROM (
      SELECT id + 8767 AS date_analytics_id, DATE '1994-01-02' + CAST(id AS INT) AS gregorian_date,
        1994 + CAST(floor(id / 364) AS BIGINT) AS fiscal_year,
        CAST(floor((id % 364) / 7) AS BIGINT) + 1 AS week, CAST(floor(id / 7) AS BIGINT) AS week_analytics_id
      FROM range(0, 3640) AS r(id)) AS days) AS quarters) AS months

-- fiscal_weeks
SELECT DISTINCT fiscal_year, fiscal_quarter_id, quarter_analytics_id, fiscal_week_id, week_in_quarter
FROM {calendar}
"""


def _parse(text: str) -> dict[str, str]:
    views = {}
    for block in re.split(r"^-- ", text, flags=re.M)[1:]:
        title, sql = block.split("\n", 1)
        views[title.split(":")[0].strip()] = sql.strip()
    return views


VIEW_SQL = _parse(_VIEWS)


def references(sql: str) -> list[str]:
    """Names in braces, in order of first use."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def from_driver(spark: SparkSession, folder: str) -> RetailTables:
    """Retail tables derived from the driver's parquet files in ``folder``."""

    def load(name: str) -> DataFrame:
        if name in GIVEN_TABLES:
            return spark.read.schema(GIVEN_TABLES[name]).parquet(f"{folder}/{name}.parquet")
        sql = VIEW_SQL[name].replace("DAYNO(", "unix_date(")
        return spark.sql(sql, **{ref: tables[ref] for ref in references(sql)})

    tables = RetailTables(spark, load)
    return tables


def duckdb_view(name: str) -> str:
    """The same view for DuckDB, reading tables of the same names."""
    sql = VIEW_SQL[name].replace("DAYNO(", "datediff('day', DATE '1970-01-01', ")
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("TIMESTAMP_NTZ", "TIMESTAMP")
