-- view: original_channels
-- channel of the online order a product was first bought in
SELECT order_analytics_id, product_analytics_id, max(sales_channel) AS channel FROM sales_line
WHERE source = 'oroms' AND order_analytics_id IN (SELECT order_analytics_id FROM sales_header WHERE source = 'oroms')
GROUP BY ALL

-- view: moves
-- deliveries as +1 and returns as -1, each with the place and channel it counts for
SELECT 1 AS sign, d.date_analytics_id AS day, d.product_analytics_id AS product, order_line_analytics_id AS line,
  l.attribution_location_analytics_id AS place, coalesce(l.sales_channel, 'pos') AS channel, d.quantity, d.merchandise AS dollars, d.fair_market_value AS cost
FROM delivered_sales d LEFT JOIN sales_line l USING (order_line_analytics_id)
UNION ALL
SELECT -1, r.date_analytics_id, r.product_analytics_id, order_line_analytics_id,
  if(l.source = 'oroms' AND r.location_analytics_id = 904 AND l.sales_channel IN (FROM web_channels), 2, r.location_analytics_id),
  coalesce(if(l.source = 'oroms', l.sales_channel, o.channel), 'pos'), r.quantity, r.merchandise, r.fair_market_value
FROM delivered_returns r JOIN sales_line l USING (order_line_analytics_id)
LEFT JOIN original_channels o ON o.order_analytics_id = r.original_order_analytics_id AND o.product_analytics_id = r.product_analytics_id
WHERE l.source IN ('oroms', 'xcenter') AND l.order_analytics_id IN (SELECT order_analytics_id FROM sales_header)

-- view: web_channels
SELECT unnest(['amazon_pickup', 'amazon_delivery', 'slt_bopis', 'walmart_go_local', 'web', 'customer_service', 'amazon_marketplace', 'culinary_orders']) AS channel

-- view: planned_departments
SELECT unnest([500004, 500010, 6, 250007, 500012, 500005, 8, 250003, 3, 500006, 250004, 500007, 250005, 500008]) AS level_3_analytics_id

-- view: anchor_buckets
-- every day of the anchor's year with the periods to date it is in; the caller limits gregorian_date
WITH days AS (
  SELECT c.*, list_filter([if(c.fiscal_week_id = a.fiscal_week_id, 'week', NULL), if(c.fiscal_month_id = a.fiscal_month_id, 'month', NULL),
    if(c.fiscal_quarter_id = a.fiscal_quarter_id, 'quarter', NULL), 'year'], lambda p: p IS NOT NULL) AS periods
  FROM calendar c JOIN calendar a USING (fiscal_year) WHERE a.gregorian_date = DATE '2000-06-08')
SELECT DISTINCT gregorian_date, day, p || suffix AS bucket FROM (
  SELECT gregorian_date, date_analytics_id AS day, '' AS suffix, unnest(periods) AS p FROM days
  UNION ALL SELECT gregorian_date, last_year_date_analytics_id, '_ly', unnest(periods) FROM days)

-- key: hourly_ecommerce_demand
WITH web AS (
  SELECT h.order_number, i.sku, count(*) AS times FROM sfcc_order_item i JOIN sales_header h ON h.ecom_order_number = i.sfcc_order_number
  WHERE h.source = 'oroms' AND i.product_type <> 'Culinary' AND EXISTS (FROM sfcc_order o WHERE o.sfcc_order_number = i.sfcc_order_number)
  GROUP BY ALL),
hours AS (
  SELECT date_trunc('hour', date_ordered) AS moment, sum(merchandise * times) AS m FROM sales_line JOIN web USING (order_number, sku)
  WHERE order_line_type IN ('ecommerce', 'bopis') AND 'FALSE' = ALL (SELECT unnest([is_canceled, is_return]))
    AND date_ordered >= TIMESTAMP '1999-10-02' AND date_ordered < TIMESTAMP '2000-10-15'
  GROUP BY ALL),
days AS (SELECT moment::DATE AS day, sum(m) AS m FROM hours GROUP BY ALL)
SELECT day AS order_date, hour(moment)::BIGINT AS order_hour, hours.m::DOUBLE AS demand, days.m::DOUBLE AS daily_demand,
  (SELECT sum(e.m) FROM hours e WHERE e.moment::DATE = day AND e.moment <= hours.moment)::DOUBLE AS cumulative_demand,
  round(100.0 * hours.m / nullif(days.m, 0), 2) AS pct_of_daily_demand
FROM hours JOIN days ON days.day = hours.moment::DATE

-- key: sales_by_price_type
WITH week AS (SELECT date_analytics_id AS day FROM calendar WHERE fiscal_week_id = 200013),
groups AS (
  SELECT level_3_analytics_id, CASE WHEN level_3_analytics_id IN (500007, 500010, 250007, 500012, 8) THEN 'Entertaining' ELSE 'Kitchen' END AS merch_group
  FROM planned_departments),
cells AS (
  SELECT coalesce(max_by(h.price_type, h.price_type), 'other') AS price_type, m.day, m.product, m.place, any_value(m.net) AS net, any_value(m.margin) AS margin
  FROM (SELECT day, product, place, sum(sign * dollars) AS net, sum(sign * (dollars - coalesce(cost, 0))) AS margin FROM moves SEMI JOIN week USING (day) GROUP BY ALL) m
  LEFT JOIN product_price_history h ON h.product_analytics_id = m.product AND h.date_analytics_id = m.day
  GROUP BY m.day, m.product, m.place),
totals AS (
  SELECT price_type, merch_group, level_3_analytics_id, l.channel_analytics_id AS channel, sum(net) AS net, sum(margin) AS margin
  FROM cells JOIN locations l ON l.location_analytics_id = place AND l.channel_analytics_id IN ('1', '2')
  JOIN product_to_merchandising_taxonomy ON product_analytics_id = product JOIN groups USING (level_3_analytics_id)
  GROUP BY ALL),
names AS (SELECT taxonomy_analytics_id AS level_3_analytics_id, name, CAST(taxonomy_code AS BIGINT) AS code FROM merchandising_taxonomies WHERE level = 3)
SELECT price_type, merch_group, level_3_analytics_id, channel, n.name AS level_3_name, n.code AS taxonomy_code, net::DOUBLE AS net_sales, margin::DOUBLE AS net_margin,
  (SELECT sum(net) FROM totals)::DOUBLE AS total_net_sales,
  net::DOUBLE / nullif((SELECT sum(g.net) FROM totals g WHERE g.merch_group = t.merch_group)::DOUBLE, 0) AS pct_of_merch_group_net_sales,
  net::DOUBLE / nullif((SELECT sum(d.net) FROM totals d WHERE d.level_3_analytics_id = t.level_3_analytics_id)::DOUBLE, 0) AS pct_of_dept_net_sales,
  coalesce(nullif(list_position(['regular_price', 'promotional_sale', 'markdown_sale', 'marked_out_of_stock', 'other'], price_type), 0), 6)::BIGINT AS price_type_order,
  margin::DOUBLE / nullif(net::DOUBLE, 0) AS margin_pct
FROM totals t JOIN names n USING (level_3_analytics_id)

-- key: card_refunds_for_classes
WITH cards AS (SELECT DISTINCT sfcc_order_number, card_type, last_4 FROM sfcc_payment_instrument WHERE card_type = 'Amex'),
bought AS (
  SELECT sfcc_order_number, sku, min(product_name) AS product_name, min(product_type) AS product_type FROM sfcc_order_item
  WHERE product_type = 'Culinary' AND sfcc_order_number IN (SELECT sfcc_order_number FROM cards) GROUP BY ALL),
paid AS (
  SELECT c.*, o.order_date, o.customer_name, h.order_number, h.source, b.* EXCLUDE (sfcc_order_number)
  FROM bought b JOIN cards c USING (sfcc_order_number) JOIN sfcc_order o USING (sfcc_order_number) JOIN sales_header h ON h.ecom_order_number = sfcc_order_number
  WHERE o.order_date::DATE BETWEEN DATE '1998-04-01' AND DATE '1999-06-30'),
seats AS (
  SELECT p.*, l.* EXCLUDE (order_number, sku, source) FROM paid p JOIN sales_line l USING (order_number, sku)),
per_order AS (SELECT sfcc_order_number, sum(sub_total) AS total FROM seats GROUP BY ALL),
per_card AS (SELECT last_4, sum(sub_total) AS total FROM seats GROUP BY ALL)
SELECT sfcc_order_number, order_number AS oms_order_number, order_date AS date_ordered, source, customer_name, card_type, l.last_4 AS last_4_digits_cc, line_id, sku, product_name,
  product_type, s.class_type, s.start_date, s.end_date, is_return, is_canceled, s.is_class_cancelled, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price,
  sub_total::DOUBLE AS sub_total, o.total::DOUBLE AS order_total_revenue, c.total::DOUBLE AS card_last4_total_revenue,
  1 + (SELECT count(*) FROM seats g WHERE g.sfcc_order_number = l.sfcc_order_number AND (g.sub_total > l.sub_total OR l.sub_total IS NULL AND g.sub_total IS NOT NULL)) AS line_rank_in_order,
  if(o.total = 0, 0, round(100.0 * sub_total / o.total, 2)) AS pct_of_order_revenue
FROM seats l JOIN per_order o USING (sfcc_order_number) JOIN per_card c ON c.last_4 IS NOT DISTINCT FROM l.last_4 LEFT JOIN culinary_products s USING (sku)

-- key: mailed_refund_cheques
WITH people AS (
  SELECT organization_id || '/' || rtl_loc_id || '/' || business_date || '/' || wkstn_id || '/' || trans_seq AS id, * FROM trn_trans
  WHERE create_user_id <> 'DATALOADER' AND trans_statcode = 'COMPLETE' AND post_void_flag = 0 AND year(create_date) IN (1999, 2000)),
good AS (
  SELECT organization_id || '/' || rtl_loc_id || '/' || business_date || '/' || wkstn_id || '/' || trans_seq AS id, rtrans_lineitm_seq AS item
  FROM trl_rtrans_lineitm WHERE void_flag = 0 AND create_user_id <> 'DATALOADER'),
tendered AS (
  SELECT organization_id || '/' || rtl_loc_id || '/' || business_date || '/' || wkstn_id || '/' || trans_seq AS id, amt, tndr_id
  FROM ttr_tndr_lineitm t SEMI JOIN good g
    ON g.id = organization_id || '/' || rtl_loc_id || '/' || business_date || '/' || wkstn_id || '/' || trans_seq AND g.item = t.rtrans_lineitm_seq
  WHERE tndr_id = 'HOME_OFFICE_CHECK' AND create_user_id <> 'DATALOADER'),
payees AS (
  SELECT organization_id || '/' || rtl_loc_id || '/' || business_date || '/' || wkstn_id || '/' || trans_seq AS id, COLUMNS('^payable_to_(.*)$') AS '\1'
  FROM ttr_send_check_tndr_lineitm WHERE create_user_id <> 'DATALOADER'),
parties AS (
  SELECT organization_id || '/' || rtl_loc_id || '/' || business_date || '/' || wkstn_id || '/' || trans_seq AS id, cust_party_id AS party
  FROM trl_rtrans WHERE create_user_id <> 'DATALOADER'),
phones AS (
  SELECT party_id AS party, max({'f': contact_flag, 'd': create_date, 'n': telephone_number}).n AS phone
  FROM crm_party_telephone WHERE telephone_number IS NOT NULL AND party_id IN (SELECT party FROM parties) GROUP BY ALL)
SELECT rtl_loc_id AS store_id, create_date AS transaction_timestamp, abs(amt)::DOUBLE AS amount, tndr_id AS tender_code, trans_seq AS transaction_id, wkstn_id AS register_id,
  party AS customer_id, payees.name, payees.address, coalesce(payees.address2, payees.apt) AS apartment, payees.city, payees.state, payees.postal_code AS zip_code,
  payees.country, phone
FROM tendered JOIN payees USING (id) JOIN parties USING (id) JOIN people USING (id) LEFT JOIN phones USING (party)

-- key: open_purchase_orders
WITH kept AS (
  SELECT coalesce(vendor_po_name, 'not populated') AS vendor_po_name, purchase_order_analytics_id, po_line_number,
    coalesce(next_cost_effective_date, DATE '2099-12-31') AS next_cost_effective_date, coalesce(cancel_date, DATE '2099-12-31') AS cancel_date, location_analytics_id,
    d.* EXCLUDE (vendor_po_name, purchase_order_analytics_id, po_line_number, next_cost_effective_date, cancel_date, location_analytics_id),
    greatest(quantity_open, 0) AS open_units, level_3_analytics_id
  FROM po_details d JOIN product_to_merchandising_taxonomy USING (product_analytics_id) JOIN planned_departments USING (level_3_analytics_id) WHERE is_closed = 0),
arrived AS (
  SELECT location_analytics_id, po_line_number, purchase_order_analytics_id, received_date_analytics_id AS current_arrival_date_analytics_id, sum(recieved_quantity) AS received_units
  FROM po_receipts GROUP BY ALL),
positions AS (
  SELECT vendor_po_name, purchase_order_analytics_id, po_line_number, next_cost_effective_date, cancel_date, location_analytics_id,
    sum(open_units * landed_cost) AS open_landed_cost, sum(open_units * vendor_cost) AS open_vendor_cost, sum(open_units) AS open_units, sum(quantity_ordered) AS ordered_units,
    sum(received_units) AS received_units
  FROM kept LEFT JOIN arrived USING (location_analytics_id, po_line_number, purchase_order_analytics_id, current_arrival_date_analytics_id) GROUP BY ALL),
prices AS (SELECT product_analytics_id, max({'d': coalesce(snapshot_date, DATE '0001-01-01'), 'p': price}).p AS price FROM product_price_history GROUP BY ALL),
wide AS (
  SELECT k.level_3_analytics_id, l.location_analytics_id, k.product_analytics_id, coalesce(k.vendor_analytics_id, 0) AS vendor_analytics_id,
    l.vendor_po_name, l.purchase_order_analytics_id, l.po_line_number, l.next_cost_effective_date, l.cancel_date, k.current_ship_date AS po_ship_date,
    k.current_arrival_date AS po_arrival_date, k.current_arrival_date_analytics_id, k.written_date AS po_written_date, v.vendor_name, v.vendor_style_num,
    coalesce(['Dom', 'For'][v.is_foreign_vendor + 1], '') AS vendor_origin, s.name AS location_name, p.product_name, p.season, p.holiday, p.country_of_origin,
    p.minimum_order_quantity::DOUBLE AS minimum_order_quantity, p.first_receipt_date, p.last_receipt_date, p.original_retail_price::DOUBLE AS retail_price,
    coalesce(prices.price, p.retail_price)::DOUBLE AS file_retail_price, a.next_vendor_cost::DOUBLE AS next_vendor_cost, a.market, a.status, a.ticket_type, a.port, a.collection,
    (SELECT max(c.collection_name) FROM collections c WHERE c.collection = a.collection AND CAST(c.department AS BIGINT) = CAST(t.taxonomy_code AS BIGINT)) AS collection_name,
    t.name AS level_3_name, CAST(t.taxonomy_code AS BIGINT) AS taxonomy_code, l.open_landed_cost, l.open_vendor_cost, l.open_units, l.ordered_units, l.received_units,
    DATE '2000-06-15' - k.current_arrival_date AS stale
  FROM positions l JOIN kept k USING (vendor_po_name, purchase_order_analytics_id, po_line_number, next_cost_effective_date, cancel_date, location_analytics_id)
  JOIN merchandising_taxonomies t ON t.taxonomy_analytics_id = k.level_3_analytics_id AND t.level = 3 JOIN products p USING (product_analytics_id)
  JOIN slt_product_attributes a USING (product_analytics_id) LEFT JOIN prices USING (product_analytics_id)
  JOIN (SELECT DISTINCT ON (id) coalesce(vendor_analytics_id, 0) AS id, * FROM vendors) v ON v.id = coalesce(k.vendor_analytics_id, 0)
  JOIN locations s ON s.location_analytics_id = l.location_analytics_id),
per_product AS (SELECT product_analytics_id, sum(stale)::DOUBLE / count(stale) AS days FROM wide GROUP BY ALL),
per_department AS (SELECT level_3_analytics_id, sum(open_vendor_cost)::DOUBLE AS cost FROM wide GROUP BY ALL),
per_vendor AS (SELECT vendor_analytics_id, sum(open_units)::DOUBLE AS units FROM wide GROUP BY ALL)
SELECT w.* EXCLUDE (stale) REPLACE (open_landed_cost::DOUBLE AS open_landed_cost, open_vendor_cost::DOUBLE AS open_vendor_cost, open_units::DOUBLE AS open_units,
    ordered_units::DOUBLE AS ordered_units, received_units::DOUBLE AS received_units),
  per_product.days AS avg_stale_days_per_product, open_vendor_cost::DOUBLE / nullif(cost, 0) AS pct_open_cost_within_dept, units AS total_open_units_by_vendor,
  row_number() OVER (PARTITION BY vendor_analytics_id ORDER BY po_written_date DESC NULLS LAST, purchase_order_analytics_id, po_line_number, vendor_po_name, location_analytics_id,
    next_cost_effective_date, cancel_date) AS vendor_po_recency_rank
FROM wide w JOIN per_product USING (product_analytics_id) JOIN per_department USING (level_3_analytics_id) JOIN per_vendor USING (vendor_analytics_id)

-- key: sales_and_inventory
WITH values AS (
  SELECT day, product, place, sign * dollars AS dollars, sign * (dollars - cost) AS landed, sign * dollars AS adjusted, sign * quantity AS units
  FROM moves WHERE product IS NOT NULL OR sign < 0
  UNION ALL SELECT date_analytics_id, product_analytics_id, location_analytics_id, 0, 0, -cosa, 0 FROM cosa WHERE cosa <> 0),
placed AS (
  SELECT coalesce(p.vendor_analytics_id, 0) AS vendor_analytics_id, if(s.has_comparable_sales = 1, 'Y', 'N') AS has_comp, t.level_5_analytics_id, s.channel_analytics_id AS channel,
    b.bucket, v.* EXCLUDE (day, product, place)
  FROM values v JOIN locations s ON s.location_analytics_id = v.place JOIN products p ON p.product_analytics_id = v.product
  JOIN product_to_merchandising_taxonomy t ON t.product_analytics_id = v.product SEMI JOIN planned_departments d ON d.level_3_analytics_id = t.level_3_analytics_id
  JOIN anchor_buckets b ON b.day = v.day AND b.gregorian_date <= DATE '2000-06-14'),
turned AS (
  FROM (PIVOT placed ON bucket IN ('week', 'week_ly', 'month', 'month_ly', 'quarter', 'quarter_ly', 'year', 'year_ly')
    USING sum(dollars) AS net_dollars, sum(landed) AS net_landed_gm, sum(adjusted) AS net_cosa_gm, sum(units) AS net_units
    GROUP BY vendor_analytics_id, has_comp, level_5_analytics_id, channel)
  SELECT vendor_analytics_id, has_comp, level_5_analytics_id, channel, COLUMNS('^(week|month|quarter|year)(_ly)?_(net_.*)$') AS '\3_\1\2'),
families AS (SELECT level_5_analytics_id, channel, sum(net_dollars_year)::DOUBLE AS family FROM turned GROUP BY ALL)
SELECT vendor_analytics_id, has_comp, level_5_analytics_id, channel, COLUMNS('^net_')::DOUBLE, net_landed_gm_year::DOUBLE / nullif(net_dollars_year::DOUBLE, 0) AS gm_pct_ytd,
  net_dollars_year::DOUBLE / nullif(family, 0) AS vendor_share_ytd_in_dept,
  row_number() OVER (PARTITION BY level_5_analytics_id, channel ORDER BY net_dollars_year DESC NULLS LAST, vendor_analytics_id, has_comp) AS vendor_rank_ytd_in_dept
FROM turned JOIN families USING (level_5_analytics_id, channel)

-- key: cancelled_cooking_classes
WITH sessions AS (SELECT sku, location_code, start_date AS class_start_date, is_class_cancelled FROM culinary_products WHERE is_class_cancelled = 'TRUE' AND start_date >= TIMESTAMP '2000-01-29'),
seats AS (FROM sales_line SEMI JOIN sessions USING (sku)),
back AS (
  SELECT order_number, order_line_analytics_id, max(reason_code) AS return_reason_code, max(reason) AS return_reason, max(dt) AS return_date, NULL AS cancellation_date
  FROM written_returns SEMI JOIN seats USING (order_number, order_line_analytics_id) GROUP BY ALL
  UNION ALL BY NAME
  SELECT order_number, order_line_analytics_id, max(dt) AS cancellation_date FROM canceled_sales SEMI JOIN seats USING (order_number, order_line_analytics_id) GROUP BY ALL),
undone AS (
  SELECT order_number, order_line_analytics_id, max(return_reason_code) AS return_reason_code, max(return_reason) AS return_reason, max(return_date) AS return_date,
    max(cancellation_date) AS cancellation_date FROM back GROUP BY ALL),
buyers AS (
  SELECT h.order_number, h.email, if(o.customer_name = 'Guest Chef', trim(concat(a.first_name, ' ', a.last_name)), o.customer_name) AS customer_name
  FROM sales_header h SEMI JOIN seats USING (order_number) LEFT JOIN sfcc_order o ON o.sfcc_order_number = h.ecom_order_number
  LEFT JOIN sfcc_billing_address a ON a.sfcc_order_number = o.sfcc_order_number),
grouped AS (
  SELECT order_number, date_ordered, email, customer_name, location_code, sku, p.short_description, is_class_cancelled, class_start_date, sum(quantity) AS n, sum(quantity_shipped) AS shipped,
    sum(sub_total) AS paid, sum(quantity_returned) AS returned, sum(quantity_canceled) AS canceled, max(is_return) AS is_return, max(return_reason_code) AS return_reason_code,
    max(return_reason) AS return_reason, max(return_date) AS return_date, max(is_canceled) AS is_canceled, max(cancellation_reason_code) AS cancellation_reason_code,
    max(cancellation_reason) AS cancellation_reason, max(cancellation_date) AS cancellation_date
  FROM seats JOIN sessions USING (sku) LEFT JOIN undone USING (order_number, order_line_analytics_id) LEFT JOIN buyers USING (order_number)
  LEFT JOIN (SELECT sku, short_description FROM products) p USING (sku) GROUP BY ALL),
classes AS (SELECT location_code, class_start_date, sku, sum(paid)::DOUBLE AS class_revenue, sum(n - returned - canceled)::DOUBLE AS class_net_quantity FROM grouped GROUP BY ALL)
SELECT g.* EXCLUDE (n, shipped, paid, returned, canceled), n::DOUBLE AS quantity, shipped::DOUBLE AS quantity_shipped, paid::DOUBLE AS sub_total, returned::DOUBLE AS quantity_returned,
  canceled::DOUBLE AS quantity_canceled, if(n = 0, 0, paid::DOUBLE / n::DOUBLE) AS seat_price, (n - returned - canceled)::DOUBLE AS net_quantity,
  (n - returned - canceled)::DOUBLE * if(n = 0, 0, paid::DOUBLE / n::DOUBLE) AS extended_price, class_revenue, class_net_quantity,
  1 + (SELECT count(*) FROM grouped b WHERE b.location_code IS NOT DISTINCT FROM g.location_code AND b.class_start_date = g.class_start_date AND b.paid > g.paid) AS rank_in_class
FROM grouped g JOIN classes c ON c.location_code IS NOT DISTINCT FROM g.location_code AND c.class_start_date = g.class_start_date AND c.sku = g.sku

-- key: returns_by_store
WITH about AS (
  SELECT product_analytics_id AS product, max(level_3_analytics_id) AS department_id, max(vendor_analytics_id) AS vendor_analytics_id
  FROM product_to_merchandising_taxonomy FULL JOIN products USING (product_analytics_id) GROUP BY ALL),
netted AS (
  SELECT day AS date_analytics_id, department_id, vendor_analytics_id, place AS attribution_location_analytics_id, channel AS sales_channel, sign,
    sum(quantity) AS units, sum(dollars) AS dollars, sum(coalesce(cost, 0)) AS cost, sum(dollars - coalesce(cost, 0)) AS margin
  FROM moves LEFT JOIN about USING (product) GROUP BY ALL),
both_sides AS (
  PIVOT netted ON sign IN (1, -1) USING coalesce(sum(units), 0) AS units, coalesce(sum(dollars), 0) AS dollars, coalesce(sum(cost), 0) AS cost, coalesce(sum(margin), 0) AS margin
  GROUP BY date_analytics_id, department_id, vendor_analytics_id, attribution_location_analytics_id, sales_channel)
SELECT date_analytics_id, gregorian_date, department_id, vendor_analytics_id, attribution_location_analytics_id, sales_channel,
  COLUMNS('^1_(.*)$')::DOUBLE AS 'sales_\1', COLUMNS('^-1_(.*)$')::DOUBLE AS 'return_\1', ("1_units" - "-1_units")::DOUBLE AS net_units,
  ("1_dollars" - "-1_dollars")::DOUBLE AS net_dollars, ("1_cost" - "-1_cost")::DOUBLE AS net_cost, ("1_margin" - "-1_margin")::DOUBLE AS net_margin
FROM both_sides LEFT JOIN (SELECT date_analytics_id, gregorian_date FROM calendar) USING (date_analytics_id)

-- key: returns_by_store_to_date
WITH placed AS (
  SELECT place AS attribution_location_analytics_id, bucket, if(sign < 0, dollars, 0) AS returned, sign * dollars AS netted
  FROM moves JOIN (SELECT DISTINCT day, bucket FROM anchor_buckets WHERE gregorian_date <= DATE '2000-06-15') USING (day))
FROM (PIVOT placed ON bucket IN ('week', 'week_ly', 'month', 'month_ly', 'quarter', 'quarter_ly', 'year', 'year_ly')
  USING sum(returned) AS returns, sum(netted) AS net GROUP BY attribution_location_analytics_id)
SELECT attribution_location_analytics_id, COLUMNS('^(week|month|quarter|year)(_ly)?_(net|returns)$')::DOUBLE AS '\3_\1\2'

-- view: years_at_stores
-- net dollars per line of stores, this year and last to date
SELECT line, product, bucket, sign * dollars AS dollars FROM moves
JOIN (SELECT DISTINCT day, bucket FROM anchor_buckets WHERE gregorian_date <= DATE '2000-06-14' AND bucket IN ('year', 'year_ly')) USING (day)
WHERE place IN (SELECT location_analytics_id FROM locations WHERE channel_analytics_id = '1')

-- view: coded_products
SELECT product_analytics_id, product_name, level_3_analytics_id, name AS level_3_name, CAST(taxonomy_code AS BIGINT) AS taxonomy_code
FROM product_to_merchandising_taxonomy JOIN planned_departments USING (level_3_analytics_id) JOIN (SELECT product_analytics_id, product_name FROM products) USING (product_analytics_id)
JOIN (SELECT taxonomy_analytics_id AS level_3_analytics_id, name, taxonomy_code FROM merchandising_taxonomies WHERE level = 3) USING (level_3_analytics_id)

-- key: sales_by_discount_code
WITH firsts AS (SELECT order_line_analytics_id AS line, min({'code': discount_code, 'sub': subdiscount_code}) AS first FROM pos_discounts GROUP BY ALL),
codes AS (SELECT line, first.code AS discount_code, first.sub AS subdiscount_code FROM firsts),
coded AS (
  SELECT product AS product_analytics_id, coalesce(discount_code, 'No Discount') AS discount_code, coalesce(subdiscount_code, 'No Sub-Code') AS subdiscount_code,
    sum(dollars) FILTER (bucket = 'year') AS ty, sum(dollars) FILTER (bucket = 'year_ly') AS ly
  FROM years_at_stores LEFT JOIN codes USING (line) GROUP BY ALL),
named AS (FROM coded JOIN coded_products USING (product_analytics_id))
SELECT named.* EXCLUDE (ty, ly), ty::DOUBLE AS net_dollars_ty, ly::DOUBLE AS net_dollars_ly, ty::DOUBLE / nullif(department, 0) AS discount_share_in_dept_ty
FROM named JOIN (SELECT level_3_analytics_id, sum(ty)::DOUBLE AS department FROM named GROUP BY ALL) USING (level_3_analytics_id)

-- key: sales_by_discount_code_full
WITH coded AS (
  SELECT product AS product_analytics_id, coalesce(discount_code, 'No Discount') AS discount_code, coalesce(subdiscount_code, 'No Sub-Code') AS subdiscount_code,
    sum(dollars) FILTER (bucket = 'year') AS ty, sum(dollars) FILTER (bucket = 'year_ly') AS ly
  FROM years_at_stores LEFT JOIN (SELECT DISTINCT order_line_analytics_id AS line, discount_code, subdiscount_code FROM pos_discounts) USING (line) GROUP BY ALL),
named AS (FROM coded JOIN coded_products USING (product_analytics_id))
SELECT named.* EXCLUDE (ty, ly), ty::DOUBLE AS net_dollars_ty, ly::DOUBLE AS net_dollars_ly, ty::DOUBLE / nullif(department, 0) AS discount_share_in_dept_ty
FROM named JOIN (SELECT level_3_analytics_id, sum(ty)::DOUBLE AS department FROM named GROUP BY ALL) USING (level_3_analytics_id)

-- key: store_margin
WITH week AS (
  SELECT date_analytics_id AS day FROM calendar SEMI JOIN (FROM calendar WHERE gregorian_date = DATE '2000-06-08') a USING (fiscal_year)
  WHERE gregorian_date BETWEEN DATE '2000-06-04' AND DATE '2000-06-10'),
counted AS (SELECT product_analytics_id AS product FROM product_to_merchandising_taxonomy SEMI JOIN planned_departments USING (level_3_analytics_id)),
flagged AS (
  SELECT m.*, product IN (FROM counted) AND place IN (SELECT location_analytics_id FROM locations WHERE channel_analytics_id = '1') AS inside FROM moves m SEMI JOIN week USING (day)),
parts AS (
  SELECT place, if(inside, sign * dollars, NULL) AS net, if(inside, sign * (dollars - coalesce(cost, 0)), NULL) AS margin, sign * dollars AS adjusted FROM flagged
  UNION ALL SELECT location_analytics_id, NULL, NULL, -cosa FROM cosa WHERE cosa <> 0 AND date_analytics_id IN (FROM week)),
stores AS (SELECT place, sum(net) AS net, sum(margin) AS margin, sum(adjusted) AS adjusted FROM parts GROUP BY ALL),
-- fixed values: regions and districts by code, in report order
districts(code, region, region_order, district, district_order) AS (
  VALUES ('NW', 'West Coast', 1, 'West Coast North', 1), ('WC', 'West Coast', 1, 'West Coast South', 2), ('CHI', 'Mid-West', 2, 'Greater Chicago', 3),
    ('TX', 'Mid-West', 2, 'Texas', 4), ('FL', 'Florida', 3, 'Florida', 5), ('EC', 'East Coast', 4, 'East Coast', 6), ('OV', 'East Coast', 4, 'Ohio Valley', 7),
    ('WDC', 'Florida', 3, 'District of Columbia', 8), ('DC', 'ecommerce', 5, 'ecommerce', 9)),
named AS (
  SELECT s.*, l.name AS store_name, coalesce(d.region, if(l.channel_code = 'warehouse', 'DC', 'zOther')) AS region,
    coalesce(d.region_order, if(l.channel_code = 'warehouse', 6, 7)) AS region_order, coalesce(l.district_code, 'No Code') AS district_code,
    coalesce(d.district, if(l.channel_code = 'warehouse', 'DC', 'Other')) AS district_name, coalesce(d.district_order, if(l.channel_code = 'warehouse', 10, 11)) AS district_order
  FROM stores s JOIN locations l ON l.location_analytics_id = s.place LEFT JOIN districts d ON d.code = l.district_code)
SELECT place AS location_analytics_id, n.net::DOUBLE AS net_dollars, adjusted::DOUBLE AS adjusted_margin, n.margin::DOUBLE AS net_margin, store_name, region, region AS region_manager,
  region_order::BIGINT AS region_order, district_code, district_name, district_order::BIGINT AS district_order,
  if(place IN (14, 18, 42, 76, 113, 122, 125, 138, 144, 154, 157, 159, 160, 161, 162, 171, 172, 174, 175), 'Y', 'N') AS is_flag_store,
  r.net::DOUBLE AS region_net_dollars, r.margin::DOUBLE AS region_net_margin, rank() OVER (PARTITION BY region ORDER BY n.margin DESC NULLS LAST) AS store_rank_by_margin
FROM named n JOIN (SELECT region, sum(net) AS net, sum(margin) AS margin FROM named GROUP BY ALL) r USING (region)
