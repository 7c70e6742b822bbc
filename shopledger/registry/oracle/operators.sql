-- key: return_remap
SELECT CAST(CASE WHEN location_analytics_id = 904 AND sales_channel IN ('amazon_pickup', 'amazon_delivery', 'slt_bopis',
      'walmart_go_local', 'web', 'customer_service', 'amazon_marketplace', 'culinary_orders') THEN 2
    ELSE location_analytics_id END AS BIGINT) AS counted_location,
  CAST(CASE WHEN location_analytics_id = 904 AND sales_channel NOT IN ('pos') THEN 2
    ELSE location_analytics_id END AS BIGINT) AS counted_any_channel,
  count(*) AS returns, sum(merchandise)::DOUBLE AS return_dollars
FROM line_facts WHERE is_return_line = 1 GROUP BY 1, 2

-- key: original_channel
WITH online AS (
  SELECT order_analytics_id, product_analytics_id, max(sales_channel) AS original_channel
  FROM sales_line WHERE source = 'oroms' GROUP BY 1, 2)
SELECT o.original_channel, count(*) AS returns, sum(r.merchandise)::DOUBLE AS return_dollars
FROM delivered_returns r
LEFT JOIN sales_header h ON r.original_order_analytics_id = h.order_analytics_id AND h.source = 'oroms'
LEFT JOIN online o ON o.order_analytics_id = h.order_analytics_id AND o.product_analytics_id = r.product_analytics_id
GROUP BY 1

-- key: net_sales
WITH s AS (
  SELECT date_analytics_id, attribution_location_analytics_id, coalesce(sales_channel, 'pos') AS sales_channel,
    sum(merchandise) AS dollars, sum(quantity) AS units, sum(fair_market_value) AS cost,
    sum(merchandise - fair_market_value) AS margin
  FROM line_facts WHERE is_return_line = 0 GROUP BY 1, 2, 3),
r AS (
  SELECT date_analytics_id, attribution_location_analytics_id, coalesce(sales_channel, 'pos') AS sales_channel,
    sum(merchandise) AS dollars, sum(quantity) AS units, sum(fair_market_value) AS cost,
    sum(merchandise - fair_market_value) AS margin
  FROM line_facts WHERE is_return_line = 1 GROUP BY 1, 2, 3)
SELECT coalesce(s.date_analytics_id, r.date_analytics_id) AS date_analytics_id,
  coalesce(s.attribution_location_analytics_id, r.attribution_location_analytics_id) AS attribution_location_analytics_id,
  coalesce(s.sales_channel, r.sales_channel) AS sales_channel,
  coalesce(s.dollars, 0)::DOUBLE AS sales_dollars, coalesce(r.dollars, 0)::DOUBLE AS return_dollars,
  (coalesce(s.dollars, 0) - coalesce(r.dollars, 0))::DOUBLE AS net_dollars,
  coalesce(s.units, 0)::DOUBLE AS sales_units, coalesce(r.units, 0)::DOUBLE AS return_units,
  (coalesce(s.units, 0) - coalesce(r.units, 0))::DOUBLE AS net_units,
  coalesce(s.cost, 0)::DOUBLE AS sales_cost, coalesce(r.cost, 0)::DOUBLE AS return_cost,
  (coalesce(s.cost, 0) - coalesce(r.cost, 0))::DOUBLE AS net_cost,
  coalesce(s.margin, 0)::DOUBLE AS sales_margin, coalesce(r.margin, 0)::DOUBLE AS return_margin,
  (coalesce(s.margin, 0) - coalesce(r.margin, 0))::DOUBLE AS net_margin
FROM s FULL JOIN r ON s.date_analytics_id = r.date_analytics_id
  AND s.attribution_location_analytics_id = r.attribution_location_analytics_id AND s.sales_channel = r.sales_channel

-- key: net_sales_cost_adjusted
WITH s AS (
  SELECT date_analytics_id, product_analytics_id, location_analytics_id, sum(merchandise) AS dollars, sum(quantity) AS units
  FROM line_facts WHERE is_return_line = 0 GROUP BY 1, 2, 3),
r AS (
  SELECT date_analytics_id, product_analytics_id, location_analytics_id, sum(merchandise) AS dollars, sum(quantity) AS units
  FROM line_facts WHERE is_return_line = 1 GROUP BY 1, 2, 3),
c AS (SELECT * FROM cosa WHERE cosa <> 0),
sr AS (
  SELECT coalesce(s.date_analytics_id, r.date_analytics_id) AS date_analytics_id,
    coalesce(s.product_analytics_id, r.product_analytics_id) AS product_analytics_id,
    coalesce(s.location_analytics_id, r.location_analytics_id) AS location_analytics_id,
    coalesce(s.dollars, 0) - coalesce(r.dollars, 0) AS dollars, coalesce(s.units, 0) - coalesce(r.units, 0) AS units
  FROM s FULL JOIN r ON s.date_analytics_id = r.date_analytics_id AND s.product_analytics_id = r.product_analytics_id
    AND s.location_analytics_id = r.location_analytics_id)
SELECT coalesce(sr.date_analytics_id, c.date_analytics_id) AS date_analytics_id,
  coalesce(sr.product_analytics_id, c.product_analytics_id) AS product_analytics_id,
  coalesce(sr.location_analytics_id, c.location_analytics_id) AS location_analytics_id,
  coalesce(sr.dollars, 0)::DOUBLE AS net_dollars, coalesce(sr.units, 0)::DOUBLE AS net_units,
  coalesce(c.cosa, 0)::DOUBLE AS cost_adjustment, (coalesce(sr.dollars, 0) - coalesce(c.cosa, 0))::DOUBLE AS adjusted_margin
FROM sr FULL JOIN c ON sr.date_analytics_id = c.date_analytics_id AND sr.product_analytics_id = c.product_analytics_id
  AND sr.location_analytics_id = c.location_analytics_id

-- key: net_vs_forecast
WITH f AS (
  SELECT date_analytics_id, location_analytics_id AS store, sales_channel, forecast_sales, budget_sales, forecast_units
  FROM forecast_and_budget_by_channel),
s AS (
  SELECT date_analytics_id, attribution_location_analytics_id AS store, coalesce(sales_channel, 'pos') AS sales_channel,
    sum(merchandise) AS dollars, sum(quantity) AS units, count(DISTINCT order_analytics_id) AS orders
  FROM line_facts WHERE is_return_line = 0 GROUP BY 1, 2, 3),
r AS (
  SELECT date_analytics_id, attribution_location_analytics_id AS store, coalesce(sales_channel, 'pos') AS sales_channel,
    sum(merchandise) AS dollars, sum(quantity) AS units, count(DISTINCT order_analytics_id) AS orders
  FROM line_facts WHERE is_return_line = 1 GROUP BY 1, 2, 3),
k AS (
  SELECT date_analytics_id, store, sales_channel FROM s
  UNION SELECT date_analytics_id, store, sales_channel FROM r
  UNION SELECT date_analytics_id, store, sales_channel FROM f)
SELECT k.date_analytics_id, k.store AS attribution_location_analytics_id, k.sales_channel,
  (coalesce(s.dollars, 0) - coalesce(r.dollars, 0))::DOUBLE AS net_dollars,
  (coalesce(s.units, 0) - coalesce(r.units, 0))::DOUBLE AS net_units,
  coalesce(s.orders, 0) + coalesce(r.orders, 0) AS orders,
  coalesce(f.forecast_sales, 0)::DOUBLE AS forecast_sales, coalesce(f.budget_sales, 0)::DOUBLE AS budget_sales,
  coalesce(f.forecast_units, 0)::DOUBLE AS forecast_units
FROM k
LEFT JOIN s ON k.date_analytics_id = s.date_analytics_id AND k.store = s.store AND k.sales_channel = s.sales_channel
LEFT JOIN r ON k.date_analytics_id = r.date_analytics_id AND k.store = r.store AND k.sales_channel = r.sales_channel
LEFT JOIN f ON k.date_analytics_id = f.date_analytics_id AND k.store = f.store AND k.sales_channel = f.sales_channel

-- key: margins
SELECT p.level_3_analytics_id, sum(coalesce(fair_market_value, 0))::DOUBLE AS landed_cost,
  sum(merchandise - coalesce(fair_market_value, 0))::DOUBLE AS landed_margin,
  sum(CAST(quantity * unit_last_cost AS DECIMAL(18,4)))::DOUBLE AS vendor_cost,
  sum(merchandise - CAST(quantity * unit_last_cost AS DECIMAL(18,4)))::DOUBLE AS vendor_margin
FROM line_facts l JOIN product_to_merchandising_taxonomy p USING (product_analytics_id)
WHERE is_return_line = 0 GROUP BY 1

-- key: anchor_period
WITH a AS (SELECT * FROM calendar WHERE gregorian_date = DATE '2000-06-08')
SELECT a.fiscal_week_id, a.fiscal_month_id, a.fiscal_quarter_id, a.fiscal_year, a.fiscal_week_id % 100 AS week_in_year,
  coalesce(l.sales_channel, 'pos') AS sales_channel, sum(l.merchandise)::DOUBLE AS sales
FROM line_facts l JOIN calendar c ON c.date_analytics_id = l.date_analytics_id JOIN a ON a.fiscal_week_id = c.fiscal_week_id
WHERE l.is_return_line = 0 GROUP BY ALL

-- key: ty_vs_ly
WITH d AS (
  SELECT date_analytics_id, coalesce(sales_channel, 'pos') AS sales_channel, sum(merchandise) AS sales
  FROM line_facts WHERE is_return_line = 0 GROUP BY 1, 2),
ly AS (
  SELECT c.date_analytics_id, d.sales_channel, d.sales FROM d JOIN calendar c ON d.date_analytics_id = c.last_year_date_analytics_id)
SELECT coalesce(d.date_analytics_id, ly.date_analytics_id) AS date_analytics_id,
  coalesce(d.sales_channel, ly.sales_channel) AS sales_channel, d.sales::DOUBLE AS sales, ly.sales::DOUBLE AS sales_ly
FROM d FULL JOIN ly ON d.date_analytics_id = ly.date_analytics_id AND d.sales_channel = ly.sales_channel

-- key: to_date_buckets
WITH a AS (SELECT * FROM calendar WHERE gregorian_date = DATE '2000-06-08'),
f AS (SELECT *, coalesce(sales_channel, 'pos') AS channel FROM line_facts WHERE is_return_line = 0),
ty AS (
  SELECT f.vendor_analytics_id, f.channel, c.fiscal_week_id, c.fiscal_month_id, c.fiscal_quarter_id, c.fiscal_year, f.merchandise, f.quantity
  FROM f JOIN calendar c ON f.date_analytics_id = c.date_analytics_id WHERE c.gregorian_date <= DATE '2000-06-15'),
ly AS (
  SELECT f.vendor_analytics_id, f.channel, c.fiscal_week_id, c.fiscal_month_id, c.fiscal_quarter_id, c.fiscal_year, f.merchandise, f.quantity
  FROM f JOIN calendar c ON f.date_analytics_id = c.last_year_date_analytics_id WHERE c.gregorian_date <= DATE '2000-06-15'),
k AS (
  SELECT vendor_analytics_id, channel FROM ty JOIN a ON ty.fiscal_year = a.fiscal_year
  UNION SELECT vendor_analytics_id, channel FROM ly JOIN a ON ly.fiscal_year = a.fiscal_year),
w AS (SELECT vendor_analytics_id, channel, sum(merchandise) m, sum(quantity) q FROM ty JOIN a ON ty.fiscal_week_id = a.fiscal_week_id GROUP BY 1, 2),
mo AS (SELECT vendor_analytics_id, channel, sum(merchandise) m, sum(quantity) q FROM ty JOIN a ON ty.fiscal_month_id = a.fiscal_month_id GROUP BY 1, 2),
qu AS (SELECT vendor_analytics_id, channel, sum(merchandise) m, sum(quantity) q FROM ty JOIN a ON ty.fiscal_quarter_id = a.fiscal_quarter_id GROUP BY 1, 2),
y AS (SELECT vendor_analytics_id, channel, sum(merchandise) m, sum(quantity) q FROM ty JOIN a ON ty.fiscal_year = a.fiscal_year GROUP BY 1, 2),
wl AS (SELECT vendor_analytics_id, channel, sum(merchandise) m, sum(quantity) q FROM ly JOIN a ON ly.fiscal_week_id = a.fiscal_week_id GROUP BY 1, 2),
mol AS (SELECT vendor_analytics_id, channel, sum(merchandise) m, sum(quantity) q FROM ly JOIN a ON ly.fiscal_month_id = a.fiscal_month_id GROUP BY 1, 2),
qul AS (SELECT vendor_analytics_id, channel, sum(merchandise) m, sum(quantity) q FROM ly JOIN a ON ly.fiscal_quarter_id = a.fiscal_quarter_id GROUP BY 1, 2),
yl AS (SELECT vendor_analytics_id, channel, sum(merchandise) m, sum(quantity) q FROM ly JOIN a ON ly.fiscal_year = a.fiscal_year GROUP BY 1, 2)
SELECT k.vendor_analytics_id, k.channel AS sales_channel,
  w.m::DOUBLE AS sales_week, wl.m::DOUBLE AS sales_week_ly, mo.m::DOUBLE AS sales_month, mol.m::DOUBLE AS sales_month_ly,
  qu.m::DOUBLE AS sales_quarter, qul.m::DOUBLE AS sales_quarter_ly, y.m::DOUBLE AS sales_year, yl.m::DOUBLE AS sales_year_ly,
  w.q::DOUBLE AS units_week, wl.q::DOUBLE AS units_week_ly, mo.q::DOUBLE AS units_month, mol.q::DOUBLE AS units_month_ly,
  qu.q::DOUBLE AS units_quarter, qul.q::DOUBLE AS units_quarter_ly, y.q::DOUBLE AS units_year, yl.q::DOUBLE AS units_year_ly
FROM k LEFT JOIN w USING (vendor_analytics_id, channel) LEFT JOIN mo USING (vendor_analytics_id, channel)
  LEFT JOIN qu USING (vendor_analytics_id, channel) LEFT JOIN y USING (vendor_analytics_id, channel)
  LEFT JOIN wl USING (vendor_analytics_id, channel) LEFT JOIN mol USING (vendor_analytics_id, channel)
  LEFT JOIN qul USING (vendor_analytics_id, channel) LEFT JOIN yl USING (vendor_analytics_id, channel)

-- key: fiscal_weeks
WITH wk AS (
  SELECT fiscal_year, fiscal_quarter_id, quarter_analytics_id, fiscal_month_id, month_analytics_id, fiscal_week_id, week_analytics_id,
    min(fiscal_date_id) AS start_fiscal_date_id, min(date_analytics_id) AS start_date_analytics_id,
    max(fiscal_date_id) AS end_fiscal_date_id, max(date_analytics_id) AS end_date_analytics_id
  FROM calendar GROUP BY ALL)
SELECT wk.*, s.sales FROM wk JOIN (
  SELECT c.fiscal_week_id, sum(l.merchandise)::DOUBLE AS sales FROM line_facts l JOIN calendar c USING (date_analytics_id)
  WHERE l.is_return_line = 0 GROUP BY 1) s USING (fiscal_week_id)

-- key: rolling_weeks
WITH w AS (
  SELECT DISTINCT fiscal_week_id FROM calendar
  WHERE fiscal_week_id < (SELECT fiscal_week_id FROM calendar WHERE gregorian_date = DATE '2000-06-15')
  ORDER BY 1 DESC LIMIT 52)
SELECT c.fiscal_week_id, sum(l.merchandise)::DOUBLE AS sales FROM line_facts l JOIN calendar c USING (date_analytics_id)
WHERE l.is_return_line = 0 AND c.fiscal_week_id IN (SELECT fiscal_week_id FROM w) GROUP BY 1

-- key: reporting_date
WITH rd AS (
  SELECT fw.fiscal_year, fw.fiscal_quarter_id, fw.quarter_analytics_id, max(c.date_analytics_id) AS date_analytics_id,
    max(c.gregorian_date) AS gregorian_date
  FROM fiscal_weeks fw JOIN calendar c ON fw.fiscal_week_id = c.fiscal_week_id WHERE fw.week_in_quarter = 2 GROUP BY 1, 2, 3)
SELECT rd.*, s.sales FROM rd JOIN (
  SELECT c.fiscal_quarter_id, sum(l.merchandise)::DOUBLE AS sales FROM line_facts l JOIN calendar c USING (date_analytics_id)
  WHERE l.is_return_line = 0 GROUP BY 1) s USING (fiscal_quarter_id)

-- key: yesterday_orders
SELECT order_analytics_id, order_number, source, date_ordered FROM sales_header
WHERE CAST(date_ordered AS DATE) = DATE '2000-06-15' - INTERVAL 1 DAY

-- key: hourly_demand
SELECT event_type, CAST(ts AS DATE) AS order_date, CAST(extract(hour FROM ts) AS BIGINT) AS order_hour,
  sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS demand
FROM events GROUP BY 1, 2, 3

-- key: day_range
SELECT CAST(date_ordered AS DATE) AS order_date, count(*) AS orders FROM sales_header
WHERE CAST(date_ordered AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-03-31' GROUP BY 1

-- key: share_of_total
SELECT order_number, channel_code_desc, net_amount::DOUBLE AS net_amount,
  (sum(net_amount) OVER (PARTITION BY channel_code_desc))::DOUBLE AS channel_total,
  net_amount::DOUBLE / nullif((sum(net_amount) OVER (PARTITION BY channel_code_desc))::DOUBLE, 0) AS channel_share,
  (sum(net_amount) OVER ())::DOUBLE AS overall_total,
  net_amount::DOUBLE / nullif((sum(net_amount) OVER ())::DOUBLE, 0) AS overall_share
FROM order_header

-- key: pareto
WITH c AS (SELECT target_key, sum(net_amount) AS sales FROM order_header GROUP BY 1),
r AS (
  SELECT *, sum(sales) OVER (ORDER BY sales DESC NULLS LAST, target_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
    sum(sales) OVER () AS total FROM c)
SELECT target_key, sales::DOUBLE AS sales, running::DOUBLE AS running, total::DOUBLE AS total,
  running::DOUBLE / nullif(total::DOUBLE, 0) AS cumulative_share FROM r

-- key: rank_family
WITH o AS (SELECT order_number, channel_code_desc, CAST(floor(net_amount / 100) AS BIGINT) AS hundreds FROM order_header)
SELECT order_number, channel_code_desc, hundreds,
  row_number() OVER (PARTITION BY channel_code_desc ORDER BY hundreds DESC NULLS LAST, order_number) AS row_number,
  rank() OVER (PARTITION BY channel_code_desc ORDER BY hundreds DESC NULLS LAST) AS rank,
  dense_rank() OVER (PARTITION BY channel_code_desc ORDER BY hundreds DESC NULLS LAST) AS dense_rank
FROM o

-- key: running_total
SELECT order_number, channel_code_desc, net_amount::DOUBLE AS net_amount,
  (sum(net_amount) OVER (PARTITION BY channel_code_desc ORDER BY order_date, order_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS running
FROM order_header

-- key: rank_by_total
WITH c AS (
  SELECT product_analytics_id, coalesce(sales_channel, 'pos') AS sales_channel, attribution_location_analytics_id, sum(merchandise) AS sales
  FROM line_facts WHERE is_return_line = 0 GROUP BY 1, 2, 3),
s AS (SELECT *, sum(sales) OVER (PARTITION BY product_analytics_id, sales_channel) AS sub_total FROM c)
SELECT product_analytics_id, sales_channel, attribution_location_analytics_id, sales::DOUBLE AS sales, sub_total::DOUBLE AS sub_total,
  row_number() OVER (PARTITION BY product_analytics_id ORDER BY sub_total DESC NULLS LAST, sales_channel, attribution_location_analytics_id) AS row_number
FROM s

-- key: top_n
WITH r AS (
  SELECT order_number, channel_code_desc, net_amount,
    row_number() OVER (PARTITION BY channel_code_desc ORDER BY net_amount DESC NULLS LAST, order_number) AS in_channel,
    row_number() OVER (ORDER BY net_amount DESC NULLS LAST, order_number) AS overall FROM order_header)
SELECT order_number, channel_code_desc, net_amount::DOUBLE AS net_amount, 'channel' AS scope FROM r WHERE in_channel <= 5
UNION ALL SELECT order_number, channel_code_desc, net_amount::DOUBLE, 'overall' FROM r WHERE overall <= 20

-- key: group_average
SELECT order_number, channel_code_desc, net_amount::DOUBLE AS net_amount,
  (sum(net_amount) OVER (PARTITION BY channel_code_desc))::DOUBLE / (count(net_amount) OVER (PARTITION BY channel_code_desc)) AS channel_mean
FROM order_header

-- key: latest_per_key
SELECT alt_order_number_2, date_ordered, order_analytics_id, order_number FROM (
  SELECT *, row_number() OVER (PARTITION BY alt_order_number_2 ORDER BY date_ordered DESC NULLS LAST, order_analytics_id DESC) AS rn
  FROM sales_header WHERE alt_order_number_2 IS NOT NULL) x WHERE rn = 1

-- key: latest_with_ties
SELECT product_analytics_id, current_arrival_date, po_line_number, quantity_open::DOUBLE AS quantity_open FROM (
  SELECT *, rank() OVER (PARTITION BY product_analytics_id ORDER BY current_arrival_date DESC NULLS LAST) AS r FROM po_details) x WHERE r = 1

-- key: snapshot_at_max
WITH m AS (SELECT location_analytics_id, max(date_analytics_id) AS d FROM product_history GROUP BY 1)
SELECT h.product_analytics_id, h.location_analytics_id, h.date_analytics_id, h.quantity_on_hand::DOUBLE AS quantity_on_hand,
  h.available_fair_market_value::DOUBLE AS available_fair_market_value, h.in_transit_fair_market_value::DOUBLE AS in_transit_fair_market_value
FROM product_history h JOIN m ON h.location_analytics_id = m.location_analytics_id AND h.date_analytics_id = m.d

-- key: collapse_lines
SELECT order_analytics_id, product_analytics_id, sum(quantity)::DOUBLE AS quantity, sum(merchandise)::DOUBLE AS merchandise,
  max(date_ordered) AS date_ordered, min(order_line_type) AS order_line_type,
  sum(unit_price)::DOUBLE / count(unit_price) AS unit_price_mean
FROM sales_line GROUP BY 1, 2

-- key: last_value
WITH x AS (SELECT *, rank() OVER (PARTITION BY target_key ORDER BY order_date DESC) AS r FROM order_header)
SELECT target_key, order_date AS last_order_date, max(net_amount)::DOUBLE AS last_amount FROM x WHERE r = 1 GROUP BY 1, 2

-- key: customer_year
SELECT target_key, order_year, count(DISTINCT order_number) AS frequency, sum(net_amount)::DOUBLE AS sales,
  sum(net_amount)::DOUBLE / count(net_amount) AS avg_order_value
FROM order_header WHERE target_key <> -1 AND net_amount > 0 GROUP BY 1, 2

-- key: frequency_bucket
WITH y AS (
  SELECT target_key, order_year, count(DISTINCT order_number) AS n FROM order_header WHERE target_key <> -1 AND net_amount > 0 GROUP BY 1, 2)
SELECT order_year, CASE WHEN n <= 2 THEN n ELSE 3 END AS frequency_bucket, count(*) AS customers FROM y GROUP BY 1, 2

-- key: spend_band
WITH y AS (
  SELECT target_key, order_year, sum(net_amount) AS s FROM order_header WHERE target_key <> -1 AND net_amount > 0 GROUP BY 1, 2)
SELECT order_year, CASE WHEN s <= 1000 THEN '0-1000' WHEN s <= 2500 THEN '1001-2500' WHEN s <= 5000 THEN '2501-5000'
  WHEN s <= 7500 THEN '5001-7500' WHEN s <= 10000 THEN '7501-10000' ELSE '10000+' END AS band,
  count(*) AS customers, sum(s)::DOUBLE AS sales FROM y GROUP BY 1, 2

-- key: cohort_size
WITH f AS (SELECT target_key, min(order_year) AS first_period FROM order_header WHERE target_key <> -1 AND net_amount > 0 GROUP BY 1)
SELECT first_period, count(*) AS cohort_customers, CAST(sum(count(*)) OVER () AS BIGINT) AS all_customers,
  count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS cohort_share FROM f GROUP BY 1

-- key: price_mix
WITH l AS (
  SELECT h.target_key, h.order_year, o.net_amount, o.price IN (49, 59, 69, 79, 195, 200, 210, 250, 295) AS is_full
  FROM order_line o JOIN order_header h USING (order_number) WHERE o.net_amount > 0 AND h.target_key <> -1 AND h.net_amount > 0),
g AS (
  SELECT target_key, order_year, coalesce(sum(net_amount) FILTER (is_full), 0) AS f, coalesce(sum(net_amount) FILTER (NOT is_full), 0) AS s
  FROM l GROUP BY 1, 2)
SELECT target_key, order_year, f::DOUBLE AS fullprice_sales, s::DOUBLE AS sale_sales,
  CASE WHEN f > 0 AND s = 0 THEN 'FullPriceOnly' WHEN f = 0 AND s > 0 THEN 'SaleOnly' WHEN f > 0 AND s > 0 THEN 'Mixed' ELSE 'Unknown' END AS price_mix_type
FROM g

-- key: tenure_in_year
WITH b AS (SELECT * FROM order_header WHERE target_key <> -1 AND net_amount > 0),
f AS (SELECT target_key, min(order_year) AS y FROM b GROUP BY 1)
SELECT b.order_year, CASE WHEN b.order_year = f.y THEN 'FirstYear' WHEN b.order_year > f.y THEN 'PostFirstYear' ELSE 'PreFirstYear' END AS tenure,
  count(DISTINCT b.target_key) AS customers, sum(b.net_amount)::DOUBLE AS sales
FROM b JOIN f USING (target_key) GROUP BY 1, 2

-- key: mix_segment
WITH g AS (
  SELECT target_key, sum(coalesce(cooking_school_amount, 0)) AS c, sum(net_amount - coalesce(cooking_school_amount, 0)) AS m
  FROM order_header WHERE target_key <> -1 AND net_amount > 0 GROUP BY 1)
SELECT target_key, c::DOUBLE AS class_sales, m::DOUBLE AS merch_sales,
  CASE WHEN c > 0 AND m > 0 THEN 'Culinary+Merch' WHEN c > 0 AND m = 0 THEN 'CulinaryOnly' WHEN c = 0 THEN 'NonCulinary' ELSE 'Other' END AS segment
FROM g

-- key: cohort_orders
SELECT target_key, order_number, net_amount::DOUBLE AS net_amount FROM order_header
WHERE target_key <> -1 AND net_amount > 0 AND target_key IN (
  SELECT target_key FROM order_header WHERE target_key <> -1 AND net_amount > 0 AND sub_categories_purchased LIKE '%999%')

-- key: proximity
SELECT t.target_key, CASE WHEN t.miles_to_closest_store < 25 THEN 'NEAR STORE' ELSE 'NOT NEAR STORE' END AS store_proximity,
  CASE WHEN s.culinary = 'Y' THEN 'CULINARY' ELSE 'NO CULINARY' END AS culinary_proximity
FROM target t JOIN store_master s ON t.closest_store_id = s.store_id

-- key: customer_tenure
WITH f AS (SELECT target_key, min(order_date) AS d FROM order_header WHERE target_key <> -1 AND net_amount > 0 GROUP BY 1)
SELECT t.target_key, CASE WHEN t.original_entered_date = CAST(f.d AS DATE) THEN 'New' ELSE 'Existing' END AS tenure_since_order,
  CASE WHEN strftime(t.original_entered_date, '%Y') = '2000' THEN 'New' ELSE 'Existing' END AS tenure_by_year
FROM target t LEFT JOIN f USING (target_key)

-- key: category_mix
SELECT h.target_key, count(DISTINCT p.category_name) AS distinct_categories, sum(l.net_amount)::DOUBLE AS category_sales,
  coalesce(sum(CASE WHEN p.category_name = 'COOKING SCHOOL' THEN l.net_amount ELSE 0 END), 0)::DOUBLE AS chosen_sales,
  coalesce(sum(CASE WHEN p.category_name <> 'COOKING SCHOOL' THEN l.net_amount ELSE 0 END), 0)::DOUBLE AS other_sales
FROM order_header h JOIN order_line l USING (order_number) JOIN product p ON l.item_number = p.sku
WHERE h.target_key <> -1 AND h.net_amount > 0 GROUP BY 1

-- key: recency_segment
WITH b AS (SELECT target_key, CAST(order_date AS DATE) AS d FROM order_header WHERE target_key <> -1 AND net_amount > 0),
g AS (SELECT target_key, d, lag(d) OVER (PARTITION BY target_key ORDER BY d) AS prev FROM b),
m AS (SELECT target_key, max(d) AS last FROM b GROUP BY 1),
x AS (SELECT m.target_key, m.last, max(g.prev) AS prev FROM m JOIN g ON g.target_key = m.target_key AND g.d = m.last GROUP BY 1, 2)
SELECT target_key, last AS last_order_date, prev AS prev_order_date, datediff('day', prev, last) AS days_since_prev,
  CASE WHEN datediff('day', prev, last) BETWEEN 1 AND 365 THEN 'ACTIVE' WHEN datediff('day', prev, last) BETWEEN 366 AND 730 THEN 'LAPSED'
    WHEN datediff('day', prev, last) > 730 THEN 'DEEP LAPSED' ELSE '(null)' END AS buying_segment
FROM x

-- key: multi_year_qualified
WITH y AS (
  SELECT target_key, order_year, count(DISTINCT order_number) AS n, sum(net_amount) AS s FROM order_header
  WHERE target_key <> -1 AND net_amount > 0 GROUP BY 1, 2)
SELECT target_key FROM y WHERE order_year = 1997 AND n <= 50
INTERSECT SELECT target_key FROM y WHERE order_year = 1998 AND s >= 200 AND n <= 50
INTERSECT SELECT target_key FROM y WHERE order_year = 1999 AND s >= 400 AND n <= 50

-- key: contactable
SELECT target_key, email FROM target
WHERE email IS NOT NULL AND email NOT LIKE '%internal%' AND email NOT LIKE '%INTERNAL%' AND email_valid_syntax = 1 AND do_not_email <> 'Y'
  AND target_key NOT IN (SELECT target_key FROM order_header WHERE target_key <> -1 AND net_amount > 0 AND channel_code_desc = '5-LOW')

-- key: lifecycle_year
WITH h AS (
  SELECT a.date_ordered_analytics_id, coalesce(a.email, o.email) AS email FROM sales_header a
  LEFT JOIN sales_header o ON a.alt_order_number_1 = o.order_number AND a.source = 'xcenter' AND a.order_type = 'bopis'
    AND o.source = 'oroms' AND o.order_type LIKE '%bopis%'),
act AS (
  SELECT DISTINCT h.email, c.fiscal_year FROM h JOIN calendar c ON c.date_analytics_id = h.date_ordered_analytics_id WHERE h.email IS NOT NULL),
f AS (SELECT email, min(fiscal_year) AS y FROM act GROUP BY 1)
SELECT act.email, act.fiscal_year,
  CASE WHEN f.y = act.fiscal_year THEN 'New customer' WHEN p.email IS NOT NULL THEN 'Retained customer' ELSE 'Reactivated customer' END AS customer_type
FROM act JOIN f USING (email) LEFT JOIN act p ON p.email = act.email AND p.fiscal_year + 1 = act.fiscal_year

-- key: lifecycle_rolling
WITH h AS (
  SELECT a.date_ordered_analytics_id, coalesce(a.email, o.email) AS email,
    CASE WHEN a.source = 'oroms' OR a.order_type LIKE '%bopis%' OR a.order_type = 'ship_from_store' THEN 'Direct'
      WHEN a.source = 'xcenter' THEN 'Retail' END AS ch
  FROM sales_header a
  LEFT JOIN sales_header o ON a.alt_order_number_1 = o.order_number AND a.source = 'xcenter' AND a.order_type = 'bopis'
    AND o.source = 'oroms' AND o.order_type LIKE '%bopis%'),
act AS (
  SELECT DISTINCT h.email, h.ch, c.month_analytics_id AS m FROM h JOIN calendar c ON c.date_analytics_id = h.date_ordered_analytics_id
  WHERE h.email IS NOT NULL),
f AS (SELECT email, ch, min(m) AS first FROM act GROUP BY 1, 2),
recent AS (SELECT DISTINCT b.email, b.ch, b.m FROM act a JOIN act b ON a.email = b.email AND a.ch = b.ch AND a.m BETWEEN b.m - 12 AND b.m - 1),
older AS (SELECT DISTINCT b.email, b.ch, b.m FROM act a JOIN act b ON a.email = b.email AND a.ch = b.ch AND a.m < b.m - 12)
SELECT act.email, act.ch AS sales_channel_type, act.m AS month_analytics_id,
  CASE WHEN act.m = f.first THEN 'New' WHEN r.email IS NOT NULL THEN 'Retained' WHEN o.email IS NOT NULL THEN 'Reactivated' ELSE 'Unclassified' END AS customer_type
FROM act JOIN f USING (email, ch)
LEFT JOIN recent r ON r.email = act.email AND r.ch = act.ch AND r.m = act.m
LEFT JOIN older o ON o.email = act.email AND o.ch = act.ch AND o.m = act.m

-- key: segment_totals
SELECT h.source, count(DISTINCT coalesce(h.email, CAST(w.order_analytics_id AS VARCHAR))) AS customer_count,
  count(DISTINCT w.order_analytics_id) AS order_count, sum(w.merchandise)::DOUBLE AS total_order_value, sum(w.quantity)::DOUBLE AS total_units
FROM written_sales w JOIN sales_header h USING (order_analytics_id) GROUP BY 1

-- key: channel_type
SELECT source, order_type, CASE WHEN source = 'oroms' OR order_type LIKE '%bopis%' OR order_type = 'ship_from_store' THEN 'Direct'
  WHEN source = 'xcenter' THEN 'Retail' END AS channel_type, count(*) AS orders
FROM sales_header GROUP BY 1, 2, 3

-- key: anonymous_orders
SELECT order_analytics_id, email FROM sales_header WHERE email IS NULL OR email IN (SELECT email FROM non_customer_emails)

-- key: enrich_email
SELECT a.order_analytics_id, a.source, a.order_type, coalesce(a.email, o.email) AS email FROM sales_header a
LEFT JOIN sales_header o ON a.alt_order_number_1 = o.order_number AND a.source = 'xcenter' AND a.order_type = 'bopis'
  AND o.source = 'oroms' AND o.order_type LIKE '%bopis%'

-- key: exclude_orders
SELECT order_analytics_id, count(*) AS lines, sum(merchandise)::DOUBLE AS sales FROM sales_line
WHERE order_analytics_id NOT IN (
  SELECT order_analytics_id FROM sales_line
  WHERE sales_channel LIKE '%amazon%' OR sales_channel LIKE '%amzbopis%' OR order_line_type LIKE '%amazon%')
GROUP BY 1

-- key: surrogate_id
SELECT email, dense_rank() OVER (ORDER BY email) AS email_id FROM (SELECT DISTINCT email FROM sales_header WHERE email IS NOT NULL) e

-- key: new_customers
WITH w AS (
  SELECT DISTINCT fiscal_week_id FROM calendar
  WHERE fiscal_week_id < (SELECT fiscal_week_id FROM calendar WHERE gregorian_date = DATE '1996-06-15') ORDER BY 1 DESC LIMIT 52),
f AS (SELECT email, min(date_ordered_analytics_id) AS d FROM sales_header WHERE email IS NOT NULL GROUP BY 1)
SELECT count(email) AS new_customers FROM f LEFT JOIN calendar c ON c.date_analytics_id = f.d
WHERE c.fiscal_week_id IN (SELECT fiscal_week_id FROM w)

-- key: reactivated
WITH h AS (
  SELECT a.date_ordered_analytics_id, coalesce(a.email, o.email) AS email FROM sales_header a
  LEFT JOIN sales_header o ON a.alt_order_number_1 = o.order_number AND a.source = 'xcenter' AND a.order_type = 'bopis'
    AND o.source = 'oroms' AND o.order_type LIKE '%bopis%'),
y AS (SELECT DISTINCT h.email, c.fiscal_year FROM h JOIN calendar c ON c.date_analytics_id = h.date_ordered_analytics_id WHERE h.email IS NOT NULL)
SELECT c1.fiscal_year, count(DISTINCT c1.email) AS reactivated_customers FROM y c1
LEFT JOIN y c2 ON c1.email = c2.email AND c1.fiscal_year = c2.fiscal_year + 1
JOIN y c3 ON c1.email = c3.email AND c3.fiscal_year < c1.fiscal_year - 1
WHERE c2.email IS NULL GROUP BY 1

-- key: retained
WITH m AS (
  SELECT DISTINCT email, year(date_ordered) AS y, month(date_ordered) AS mo FROM sales_header WHERE email IS NOT NULL),
y AS (SELECT DISTINCT email, y FROM m)
SELECT m.y AS order_year, m.mo AS order_month, count(DISTINCT m.email) AS retained_customers
FROM m JOIN y ON m.email = y.email AND m.y = y.y + 1 GROUP BY 1, 2

-- key: allowed_sales
SELECT source, sales_channel, order_line_type, count(*) AS lines, sum(merchandise)::DOUBLE AS sales FROM sales_line
WHERE (source = 'xcenter' AND order_line_type = 'in_store_sale') OR (source = 'oroms' AND (
    (sales_channel = 'web' AND order_line_type = 'ecommerce') OR (sales_channel = 'culinary_orders' AND order_line_type = 'ecommerce')
    OR (sales_channel = 'slt_bopis' AND order_line_type = 'bopis') OR (sales_channel = 'walmart_go_local' AND order_line_type = 'bopis')
    OR (sales_channel = 'customer_service' AND order_line_type = 'phone') OR (sales_channel = 'culinary_orders' AND order_line_type = 'phone')))
GROUP BY 1, 2, 3

-- key: product_category
SELECT CASE WHEN p.level_5_name = 'WARRANTY' THEN 'Warranty' WHEN p.level_3_name = 'GIFT CERTIFICATES' THEN 'GiftCard'
  WHEN p.level_3_name = 'COOKING SCHOOL' THEN 'CulinaryClass' ELSE 'HardGood' END AS product_category,
  sum(d.merchandise)::DOUBLE AS sales, sum(d.quantity)::DOUBLE AS units
FROM delivered_sales d JOIN product_to_merchandising_taxonomy p USING (product_analytics_id) GROUP BY 1

-- key: grouping_sets
SELECT attribution_location_analytics_id, sales_channel, false AS is_total, sum(merchandise)::DOUBLE AS sales, count(DISTINCT order_analytics_id) AS orders
FROM line_facts GROUP BY 1, 2
UNION ALL
SELECT attribution_location_analytics_id, 'All', true, sum(merchandise)::DOUBLE, count(DISTINCT order_analytics_id) FROM line_facts GROUP BY 1

-- key: conditional_pivot
SELECT product_analytics_id, coalesce(sum(merchandise) FILTER (sales_channel = 'web'), 0)::DOUBLE AS web,
  coalesce(sum(merchandise) FILTER (sales_channel = 'slt_bopis'), 0)::DOUBLE AS slt_bopis,
  coalesce(sum(merchandise) FILTER (sales_channel IS NULL), 0)::DOUBLE AS pos
FROM line_facts WHERE is_return_line = 0 GROUP BY 1

-- key: dense_grid
WITH b AS (
  SELECT w.product_analytics_id, w.date_analytics_id, st.channel_analytics_id AS channel, sum(w.merchandise) AS m, sum(w.quantity) AS q
  FROM written_sales w LEFT JOIN sales_line l USING (order_line_analytics_id)
  LEFT JOIN locations st ON st.location_analytics_id = l.attribution_location_analytics_id GROUP BY 1, 2, 3),
g AS (
  SELECT k.product_analytics_id, k.date_analytics_id, ch.channel_analytics_id AS channel
  FROM (SELECT DISTINCT product_analytics_id, date_analytics_id FROM b) k CROSS JOIN channels ch)
SELECT coalesce(b.product_analytics_id, g.product_analytics_id) AS product_analytics_id,
  coalesce(b.date_analytics_id, g.date_analytics_id) AS date_analytics_id, coalesce(b.channel, g.channel) AS channel,
  coalesce(b.m, 0)::DOUBLE AS merchandise, coalesce(b.q, 0)::DOUBLE AS quantity,
  CAST(CASE WHEN g.channel IS NOT NULL THEN 1 END AS BIGINT) AS in_grid
FROM b FULL JOIN g ON b.product_analytics_id = g.product_analytics_id AND b.date_analytics_id = g.date_analytics_id AND b.channel = g.channel

-- key: market_basket
WITH b AS (
  SELECT w.order_analytics_id, w.order_line_analytics_id, w.product_analytics_id, st.channel_analytics_id AS channel, w.merchandise, w.quantity
  FROM written_sales w LEFT JOIN sales_line l USING (order_line_analytics_id)
  LEFT JOIN locations st ON st.location_analytics_id = l.attribution_location_analytics_id),
o AS (SELECT order_analytics_id, sum(merchandise) AS m, sum(quantity) AS q FROM b GROUP BY 1),
a AS (
  SELECT b.order_analytics_id, count(DISTINCT sa.order_analytics_id) AS n FROM store_agents sa
  JOIN b ON sa.order_line_analytics_id = b.order_line_analytics_id GROUP BY 1)
SELECT b.order_analytics_id, b.product_analytics_id, b.channel, sum(b.merchandise)::DOUBLE AS sales, sum(b.quantity)::DOUBLE AS units,
  any_value(o.m)::DOUBLE AS order_sales, any_value(o.q)::DOUBLE AS order_units, coalesce(any_value(a.n), 0) AS agent_orders
FROM b JOIN o USING (order_analytics_id) LEFT JOIN a USING (order_analytics_id) GROUP BY 1, 2, 3

-- key: all_keys
SELECT location_analytics_id, product_analytics_id FROM delivered_returns
UNION SELECT location_analytics_id, product_analytics_id FROM product_history
UNION SELECT location_analytics_id, product_analytics_id FROM cosa

-- key: merge_wide
WITH s AS (SELECT product_analytics_id, sum(merchandise) AS v FROM line_facts WHERE is_return_line = 0 GROUP BY 1),
r AS (SELECT product_analytics_id, sum(merchandise) AS v FROM line_facts WHERE is_return_line = 1 GROUP BY 1),
c AS (SELECT product_analytics_id, sum(cosa) AS v FROM cosa GROUP BY 1)
SELECT product_analytics_id, s.v::DOUBLE AS sales, r.v::DOUBLE AS returns, c.v::DOUBLE AS cost_adjustment
FROM s FULL JOIN r USING (product_analytics_id) FULL JOIN c USING (product_analytics_id)

-- key: day_two_day
SELECT attribution_location_analytics_id, (sum(merchandise) FILTER (CAST(dt AS DATE) = DATE '2000-06-15'))::DOUBLE AS sales_day,
  sum(merchandise)::DOUBLE AS sales_2day, (sum(quantity) FILTER (CAST(dt AS DATE) = DATE '2000-06-15'))::DOUBLE AS units_day,
  sum(quantity)::DOUBLE AS units_2day
FROM line_facts WHERE is_return_line = 0 AND CAST(dt AS DATE) BETWEEN DATE '2000-06-14' AND DATE '2000-06-15' GROUP BY 1

-- key: demand_classes
WITH po AS (SELECT DISTINCT order_analytics_id, product_analytics_id FROM drop_ship_po),
l AS (
  SELECT w.date_analytics_id, w.merchandise, s.sales_channel AS c, p.level_3_analytics_id AS l3, p.level_5_analytics_id AS l5,
    po.order_analytics_id IS NOT NULL AS ds
  FROM written_sales w JOIN sales_line s USING (order_line_analytics_id)
  LEFT JOIN product_to_merchandising_taxonomy p ON p.product_analytics_id = w.product_analytics_id
  LEFT JOIN po ON po.order_analytics_id = w.order_analytics_id AND po.product_analytics_id = w.product_analytics_id),
u AS (
  SELECT date_analytics_id, 212 AS class_id, merchandise FROM l WHERE NOT ds AND l3 <> 4 AND c IN ('web', 'customer_service', 'slt_sfs')
  UNION ALL SELECT date_analytics_id, 250275, merchandise FROM l WHERE ds AND c IN ('web', 'customer_service')
  UNION ALL SELECT date_analytics_id, 337, merchandise FROM l WHERE c = 'amazon_marketplace'
  UNION ALL SELECT date_analytics_id, 353, merchandise FROM l WHERE c = 'slt_bopis'
  UNION ALL SELECT date_analytics_id, 250220, merchandise FROM l WHERE c = 'walmart_go_local'
  UNION ALL SELECT date_analytics_id, 500198, merchandise FROM l WHERE l5 = 500198
  UNION ALL SELECT date_analytics_id, 216, merchandise FROM l WHERE l5 = 216
  UNION ALL SELECT date_analytics_id, 461000001, merchandise FROM l WHERE l5 = 461000001
  UNION ALL SELECT date_analytics_id, 500086, merchandise FROM l WHERE c = 'culinary_orders')
SELECT date_analytics_id, CAST(class_id AS BIGINT) AS class_id, sum(merchandise)::DOUBLE AS dollars FROM u GROUP BY 1, 2

-- key: demand_vs_plan
WITH po AS (SELECT DISTINCT order_analytics_id, product_analytics_id FROM drop_ship_po),
l AS (
  SELECT w.date_analytics_id, w.merchandise, s.sales_channel AS c, p.level_3_analytics_id AS l3, p.level_5_analytics_id AS l5,
    po.order_analytics_id IS NOT NULL AS ds
  FROM written_sales w JOIN sales_line s USING (order_line_analytics_id)
  LEFT JOIN product_to_merchandising_taxonomy p ON p.product_analytics_id = w.product_analytics_id
  LEFT JOIN po ON po.order_analytics_id = w.order_analytics_id AND po.product_analytics_id = w.product_analytics_id),
k AS (SELECT unnest([212, 250275, 337, 353, 250220, 500198, 216, 461000001, 500086]) AS class_id),
d AS (
  SELECT l.date_analytics_id, k.class_id, sum(l.merchandise) AS dollars FROM l JOIN k ON
    CASE k.class_id WHEN 212 THEN NOT ds AND l3 <> 4 AND c IN ('web', 'customer_service', 'slt_sfs')
      WHEN 250275 THEN ds AND c IN ('web', 'customer_service') WHEN 337 THEN c = 'amazon_marketplace' WHEN 353 THEN c = 'slt_bopis'
      WHEN 250220 THEN c = 'walmart_go_local' WHEN 500086 THEN c = 'culinary_orders' ELSE l5 = k.class_id END
  GROUP BY 1, 2)
SELECT ca.date_analytics_id, ca.gregorian_date, CAST(k.class_id AS BIGINT) AS class_id,
  coalesce(CASE k.class_id WHEN 212 THEN b.dc_sfs_forecasted_demand WHEN 250275 THEN b.drop_ship_forecasted_demand
    WHEN 337 THEN b.amazon_marketplace_forecasted_demand WHEN 353 THEN b.slt_bopis_forecasted_demand
    WHEN 250220 THEN b.walmart_go_local_forecasted_demand WHEN 500198 THEN b.gift_card_forecasted_demand
    WHEN 216 THEN b.warranty_forecasted_demand WHEN 500086 THEN b.culinary_forecasted_demand END, 0)::DOUBLE AS forecast_demand,
  coalesce(CASE k.class_id WHEN 212 THEN b.dc_sfs_budgeted_demand WHEN 250275 THEN b.drop_ship_budgeted_demand
    WHEN 337 THEN b.amazon_marketplace_budgeted_demand WHEN 353 THEN b.slt_bopis_budgeted_demand
    WHEN 250220 THEN b.walmart_go_local_budgeted_demand WHEN 500198 THEN b.gift_card_budgeted_demand
    WHEN 216 THEN b.warranty_budgeted_demand WHEN 500086 THEN b.culinary_budgeted_demand END, 0)::DOUBLE AS budgeted_demand,
  coalesce(d.dollars, 0)::DOUBLE AS dollars
FROM calendar ca CROSS JOIN k
LEFT JOIN direct_forecast_sales_budget b ON b.date_analytics_id = ca.date_analytics_id
LEFT JOIN d ON d.date_analytics_id = ca.date_analytics_id AND d.class_id = k.class_id

-- key: discount_net
WITH c AS (SELECT order_line_analytics_id FROM pos_discounts WHERE discount_code LIKE 'COOKING%'),
s AS (
  SELECT date_analytics_id, attribution_location_analytics_id AS loc, sum(merchandise) AS d, sum(quantity) AS u, count(DISTINCT order_analytics_id) AS o
  FROM line_facts JOIN c USING (order_line_analytics_id) WHERE is_return_line = 0 GROUP BY 1, 2),
r AS (
  SELECT date_analytics_id, attribution_location_analytics_id AS loc, sum(merchandise) AS d, sum(quantity) AS u, count(DISTINCT order_analytics_id) AS o
  FROM line_facts JOIN c USING (order_line_analytics_id) WHERE is_return_line = 1 GROUP BY 1, 2)
SELECT coalesce(s.date_analytics_id, r.date_analytics_id) AS date_analytics_id, coalesce(s.loc, r.loc) AS attribution_location_analytics_id,
  (coalesce(s.d, 0) - coalesce(r.d, 0))::DOUBLE AS net_dollars, (coalesce(s.u, 0) - coalesce(r.u, 0))::DOUBLE AS net_units,
  coalesce(s.o, 0) + coalesce(r.o, 0) AS orders
FROM s FULL JOIN r ON s.date_analytics_id = r.date_analytics_id AND s.loc = r.loc

-- key: store_kpis
WITH d AS (SELECT date_analytics_id, gregorian_date = DATE '2000-06-15' AS today FROM calendar
  WHERE gregorian_date IN (DATE '2000-06-14', DATE '2000-06-15')),
s AS (SELECT attribution_location_analytics_id AS k, sum(merchandise) FILTER (today) AS a, sum(merchandise) AS b FROM line_facts JOIN d USING (date_analytics_id) GROUP BY 1),
t AS (SELECT location_analytics_id AS k, sum(traffic_out_count) FILTER (today) AS a, sum(traffic_out_count) AS b FROM shoppertrak_traffic JOIN d USING (date_analytics_id) GROUP BY 1),
c AS (SELECT location_analytics_id AS k, sum(hasaddress) FILTER (today) AS a, sum(hasaddress) AS b, sum(hasemail) FILTER (today) AS e, sum(hasemail) AS f FROM store_kpi JOIN d USING (date_analytics_id) GROUP BY 1),
p AS (SELECT location_analytics_id AS k, sum(culinary_discount_forecast) FILTER (today) AS a, sum(culinary_discount_forecast) AS b FROM forecast_and_budget JOIN d USING (date_analytics_id) GROUP BY 1)
SELECT k AS location_analytics_id, s.a::DOUBLE AS sales_day, s.b::DOUBLE AS sales_2day, CAST(t.a AS BIGINT) AS traffic_day, CAST(t.b AS BIGINT) AS traffic_2day,
  CAST(c.a AS BIGINT) AS address_day, CAST(c.b AS BIGINT) AS address_2day, CAST(c.e AS BIGINT) AS email_day, CAST(c.f AS BIGINT) AS email_2day,
  p.a::DOUBLE AS class_forecast_day, p.b::DOUBLE AS class_forecast_2day
FROM s FULL JOIN t USING (k) FULL JOIN c USING (k) FULL JOIN p USING (k)

-- key: dropship_split
SELECT w.date_analytics_id, EXISTS (SELECT 1 FROM drop_ship_po p WHERE p.order_analytics_id = w.order_analytics_id
  AND p.product_analytics_id = w.product_analytics_id) AS is_dropship, sum(w.merchandise)::DOUBLE AS sales
FROM written_sales w GROUP BY 1, 2

-- key: current_price
WITH l AS (
  SELECT product_analytics_id, price, row_number() OVER (PARTITION BY product_analytics_id ORDER BY snapshot_date DESC NULLS LAST, price DESC) AS rn
  FROM product_price_history)
SELECT p.product_analytics_id, p.retail_price::DOUBLE AS retail_price, coalesce(l.price, p.retail_price)::DOUBLE AS current_retail_price
FROM products p LEFT JOIN l ON l.product_analytics_id = p.product_analytics_id AND l.rn = 1

-- key: price_ending
WITH p AS (SELECT CAST(floor(price * 100) AS BIGINT) AS cents FROM product_price_history)
SELECT CAST(CASE WHEN cents IS NULL THEN 5 WHEN cents % 10 = 6 THEN 3 WHEN cents % 10 = 9 THEN 2 WHEN cents % 100 = 1 THEN 4 ELSE 1 END AS BIGINT) AS type_id,
  CASE WHEN cents IS NULL THEN 'NP' WHEN cents % 10 = 6 THEN 'POS' WHEN cents % 10 = 9 THEN 'MKD' WHEN cents % 100 = 1 THEN 'MOS' ELSE 'REG' END AS type_code,
  CASE WHEN cents IS NULL THEN 'No Price' WHEN cents % 10 = 6 THEN 'POS' WHEN cents % 10 = 9 THEN 'Markdown' WHEN cents % 100 = 1 THEN 'MOS' ELSE 'Regular' END AS type_description,
  count(*) AS prices
FROM p GROUP BY 1, 2, 3

-- key: receipt_age
WITH a AS (SELECT product_analytics_id, datediff('day', last_receipt_date, DATE '2000-06-15') AS d FROM products)
SELECT product_analytics_id, d AS age_days,
  CAST(CASE WHEN d <= 91 THEN 5 WHEN d BETWEEN 92 AND 182 THEN 4 WHEN d BETWEEN 183 AND 273 THEN 3 WHEN d BETWEEN 274 AND 364 THEN 2 ELSE 1 END AS BIGINT) AS bucket_id,
  CASE WHEN d <= 91 THEN 'Aged Last 13 Weeks' WHEN d BETWEEN 92 AND 182 THEN 'Aged 14 - 26 Weeks' WHEN d BETWEEN 183 AND 273 THEN 'Aged 27 - 39 Weeks'
    WHEN d BETWEEN 274 AND 364 THEN 'Aged 40 - 52 Weeks' ELSE 'Aged Greater than 52 Weeks' END AS bucket
FROM a

-- key: price_type_sales
SELECT coalesce(h.price_type, 'other') AS price_type,
  CAST(CASE coalesce(h.price_type, 'other') WHEN 'regular_price' THEN 1 WHEN 'promotional_sale' THEN 2 WHEN 'markdown_sale' THEN 3
    WHEN 'marked_out_of_stock' THEN 4 WHEN 'other' THEN 5 ELSE 6 END AS BIGINT) AS type_order,
  sum(s.merchandise)::DOUBLE AS sales, count(*) AS lines
FROM delivered_sales s LEFT JOIN product_price_history h
  ON h.product_analytics_id = s.product_analytics_id AND h.date_analytics_id = s.date_analytics_id
GROUP BY 1, 2

-- key: department_dim
SELECT m.taxonomy_analytics_id AS level_3_analytics_id, m.name AS department_name, CAST(m.taxonomy_code AS BIGINT) AS department_code,
  CASE WHEN m.taxonomy_analytics_id IN (500007, 500010, 250007, 500012, 8) THEN 'Entertaining'
    WHEN m.taxonomy_analytics_id IN (500005, 250003, 3, 500006, 250004, 250005, 6, 500008, 4, 500004) THEN 'Kitchen' ELSE 'Other' END AS merch_group,
  sum(d.merchandise)::DOUBLE AS sales
FROM delivered_sales d JOIN product_to_merchandising_taxonomy p USING (product_analytics_id)
JOIN merchandising_taxonomies m ON m.taxonomy_analytics_id = p.level_3_analytics_id AND m.level = 3
GROUP BY 1, 2, 3, 4

-- key: collection_dim
SELECT p.product_analytics_id, a.collection, CAST(m.taxonomy_code AS BIGINT) AS department_code, t.level_3_analytics_id,
  max(c.collection_name) AS collection_name
FROM products p JOIN product_to_merchandising_taxonomy t USING (product_analytics_id)
JOIN merchandising_taxonomies m ON m.taxonomy_analytics_id = t.level_3_analytics_id AND m.level = 3
JOIN slt_product_attributes a ON a.product_analytics_id = p.product_analytics_id
LEFT JOIN collections c ON c.collection = a.collection AND CAST(c.department AS BIGINT) = CAST(m.taxonomy_code AS BIGINT)
GROUP BY 1, 2, 3, 4

-- key: open_backorders
SELECT product_analytics_id, min(CAST(date_ordered AS DATE)) AS earliest_backorder_date, sum(merchandise)::DOUBLE AS open_backorder_dollars,
  sum(quantity)::DOUBLE AS open_backorder_units, datediff('day', min(CAST(date_ordered AS DATE)), DATE '2000-06-15') AS earliest_backorder_age_days
FROM sales_line WHERE is_backorder = 1 AND status = 'open' AND product_analytics_id IS NOT NULL AND CAST(date_ordered AS DATE) >= DATE '1996-01-01'
GROUP BY 1

-- key: on_hand
SELECT h.product_analytics_id, sum(CASE WHEN location_analytics_id = 904 THEN quantity_on_hand ELSE 0 END)::DOUBLE AS on_hand_904,
  sum(CASE WHEN location_analytics_id = 903 THEN quantity_on_hand ELSE 0 END)::DOUBLE AS on_hand_903,
  sum(CASE WHEN location_analytics_id = 2 THEN quantity_on_hand ELSE 0 END)::DOUBLE AS on_hand_2
FROM product_history h JOIN calendar c USING (date_analytics_id)
WHERE c.gregorian_date = DATE '2000-06-15' AND h.location_analytics_id IN (904, 903, 2) GROUP BY 1

-- key: next_arrivals
SELECT product_analytics_id, location_analytics_id, rn AS arrival_order,
  CASE rn WHEN 1 THEN 'Next PO' WHEN 2 THEN '2nd Next PO' WHEN 3 THEN '3rd Next PO' END AS arrival_label,
  current_arrival_date, purchase_order_analytics_id, quantity_open::DOUBLE AS quantity_open
FROM (
  SELECT *, row_number() OVER (PARTITION BY product_analytics_id
    ORDER BY current_arrival_date_analytics_id NULLS LAST, purchase_order_analytics_id, po_line_number) AS rn
  FROM po_details WHERE quantity_open > 0 AND product_analytics_id IS NOT NULL AND is_closed = 0) x
WHERE rn <= 3

-- key: coverage
WITH bo AS (
  SELECT product_analytics_id, sum(quantity) AS units FROM sales_line
  WHERE is_backorder = 1 AND status = 'open' AND product_analytics_id IS NOT NULL GROUP BY 1),
st AS (
  SELECT product_analytics_id, sum(CASE WHEN location_analytics_id = 904 THEN quantity_on_hand END) AS a,
    sum(CASE WHEN location_analytics_id = 903 THEN quantity_on_hand END) AS b
  FROM product_history GROUP BY 1),
oo AS (
  SELECT product_analytics_id, sum(CASE WHEN quantity_open < 0 THEN 0 ELSE quantity_open END) AS o FROM po_details
  WHERE is_closed = 0 AND location_analytics_id = 904 GROUP BY 1),
nx AS (
  SELECT product_analytics_id, quantity_open AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY product_analytics_id
      ORDER BY current_arrival_date_analytics_id NULLS LAST, purchase_order_analytics_id, po_line_number) AS rn
    FROM po_details WHERE quantity_open > 0 AND is_closed = 0) x WHERE rn = 1 AND location_analytics_id = 904)
SELECT bo.product_analytics_id, bo.units::DOUBLE AS open_backorder_units, greatest(bo.units - coalesce(nx.n, 0), 0)::DOUBLE AS oversold_units,
  (coalesce(st.a, 0) + coalesce(oo.o, 0))::DOUBLE / nullif(bo.units::DOUBLE, 0) AS coverage_ratio,
  bo.units::DOUBLE / nullif((coalesce(st.a, 0) + coalesce(st.b, 0))::DOUBLE, 0) AS backorder_to_stock_ratio
FROM bo LEFT JOIN st USING (product_analytics_id) LEFT JOIN oo USING (product_analytics_id) LEFT JOIN nx USING (product_analytics_id)

-- key: open_vs_received
WITH b AS (
  SELECT *, coalesce(next_cost_effective_date, DATE '2099-12-31') AS nced, coalesce(cancel_date, DATE '2099-12-31') AS cd,
    coalesce(vendor_po_name, 'not populated') AS vpn, CASE WHEN quantity_open < 0 THEN 0 ELSE quantity_open END AS q
  FROM po_details WHERE is_closed = 0),
o AS (
  SELECT vpn, purchase_order_analytics_id AS po, po_line_number AS pl, nced, cd, location_analytics_id AS loc, sum(q * landed_cost) AS lc,
    sum(q * vendor_cost) AS vc, sum(q) AS ou, sum(quantity_ordered) AS oru FROM b GROUP BY 1, 2, 3, 4, 5, 6),
r AS (
  SELECT b.vpn, pr.purchase_order_analytics_id AS po, pr.po_line_number AS pl, b.nced, b.cd, pr.location_analytics_id AS loc, sum(pr.recieved_quantity) AS ru
  FROM po_receipts pr JOIN b ON pr.location_analytics_id = b.location_analytics_id AND pr.po_line_number = b.po_line_number
    AND pr.purchase_order_analytics_id = b.purchase_order_analytics_id AND pr.received_date_analytics_id = b.current_arrival_date_analytics_id
  GROUP BY 1, 2, 3, 4, 5, 6)
SELECT vpn AS vendor_po_name, po AS purchase_order_analytics_id, pl AS po_line_number, nced AS next_cost_effective_date, cd AS cancel_date,
  loc AS location_analytics_id, lc::DOUBLE AS open_landed_cost, vc::DOUBLE AS open_vendor_cost, ou::DOUBLE AS open_units,
  oru::DOUBLE AS ordered_units, ru::DOUBLE AS received_units
FROM o FULL JOIN r USING (vpn, po, pl, nced, cd, loc)

-- key: stale_days
WITH b AS (
  SELECT purchase_order_analytics_id, po_line_number, vendor_analytics_id, product_analytics_id, written_date AS po_written_date,
    datediff('day', current_arrival_date, DATE '2000-06-15') AS stale_days FROM po_details WHERE is_closed = 0)
SELECT *, (sum(stale_days) OVER (PARTITION BY product_analytics_id))::DOUBLE / (count(stale_days) OVER (PARTITION BY product_analytics_id)) AS avg_stale_days,
  row_number() OVER (PARTITION BY vendor_analytics_id ORDER BY po_written_date DESC NULLS LAST, purchase_order_analytics_id, po_line_number) AS vendor_recency
FROM b

-- key: inventory_position
WITH n AS (
  SELECT h.location_analytics_id AS loc, sum(available_fair_market_value) AS a, sum(in_transit_fair_market_value) AS t
  FROM product_history h JOIN calendar c USING (date_analytics_id) WHERE c.gregorian_date = DATE '2000-06-15' GROUP BY 1),
p AS (
  SELECT h.location_analytics_id AS loc, sum(available_fair_market_value) AS a
  FROM product_history h JOIN calendar c USING (date_analytics_id) WHERE c.gregorian_date = DATE '2000-06-08' GROUP BY 1),
y AS (
  SELECT h.location_analytics_id AS loc, sum(available_fair_market_value) AS a
  FROM product_history h JOIN calendar c ON h.date_analytics_id = c.last_year_date_analytics_id WHERE c.gregorian_date = DATE '2000-06-15' GROUP BY 1)
SELECT loc AS location_analytics_id, n.a::DOUBLE AS current_available, n.t::DOUBLE AS current_in_transit, p.a::DOUBLE AS prior_available,
  y.a::DOUBLE AS last_year_available
FROM n FULL JOIN p USING (loc) FULL JOIN y USING (loc)

-- key: active_stores
WITH d AS (
  SELECT date_analytics_id, attribution_location_analytics_id AS s, CASE WHEN sum(merchandise) > 0 THEN 1 ELSE 0 END AS f
  FROM line_facts WHERE is_return_line = 0 GROUP BY 1, 2),
w AS (
  SELECT l.channel_analytics_id AS channel, d.date_analytics_id, sum(d.f) AS store_count
  FROM d JOIN locations l ON d.s = l.location_analytics_id JOIN calendar c ON c.date_analytics_id = d.date_analytics_id
  WHERE c.gregorian_date BETWEEN DATE '2000-06-04' AND DATE '2000-06-10' GROUP BY 1, 2)
SELECT w.channel, w.date_analytics_id, CAST(w.store_count AS BIGINT) AS store_count FROM w
JOIN (SELECT channel, max(date_analytics_id) AS m FROM w GROUP BY 1) x ON w.channel = x.channel AND w.date_analytics_id = x.m

-- key: changes
WITH n AS (
  SELECT h.product_analytics_id AS k, sum(available_fair_market_value) AS a, sum(in_transit_fair_market_value) AS t
  FROM product_history h JOIN calendar c USING (date_analytics_id) WHERE c.gregorian_date = DATE '2000-06-15' GROUP BY 1),
p AS (
  SELECT h.product_analytics_id AS k, sum(available_fair_market_value) AS a
  FROM product_history h JOIN calendar c USING (date_analytics_id) WHERE c.gregorian_date = DATE '2000-06-08' GROUP BY 1),
y AS (
  SELECT h.product_analytics_id AS k, sum(available_fair_market_value) AS a
  FROM product_history h JOIN calendar c ON h.date_analytics_id = c.last_year_date_analytics_id WHERE c.gregorian_date = DATE '2000-06-15' GROUP BY 1)
SELECT k AS product_analytics_id, n.a::DOUBLE AS current_available, n.t::DOUBLE AS current_in_transit, p.a::DOUBLE AS prior_available,
  y.a::DOUBLE AS last_year_available, (n.a - y.a)::DOUBLE AS yoy_change, (n.a - y.a)::DOUBLE / nullif(y.a::DOUBLE, 0) AS yoy_change_pct,
  (n.a - p.a)::DOUBLE AS wow_change, (n.a - p.a)::DOUBLE / nullif(p.a::DOUBLE, 0) AS wow_change_pct
FROM n FULL JOIN p USING (k) FULL JOIN y USING (k)

-- key: region_map
WITH s AS (SELECT attribution_location_analytics_id AS location_analytics_id, sum(merchandise)::DOUBLE AS sales FROM line_facts GROUP BY 1)
SELECT l.location_analytics_id, l.name AS store_name,
  CASE WHEN district_code IN ('NW', 'WC') THEN 'West Coast' WHEN district_code IN ('TX', 'CHI') THEN 'Mid-West' WHEN district_code IN ('FL', 'WDC') THEN 'Florida'
    WHEN district_code IN ('OV', 'EC') THEN 'East Coast' WHEN district_code = 'DC' THEN 'ecommerce' WHEN channel_code = 'warehouse' THEN 'DC' ELSE 'zOther' END AS region,
  CAST(CASE WHEN district_code IN ('NW', 'WC') THEN 1 WHEN district_code IN ('TX', 'CHI') THEN 2 WHEN district_code IN ('FL', 'WDC') THEN 3
    WHEN district_code IN ('OV', 'EC') THEN 4 WHEN district_code = 'DC' THEN 5 WHEN channel_code = 'warehouse' THEN 6 ELSE 7 END AS BIGINT) AS region_order,
  coalesce(district_code, 'No Code') AS district_code,
  CASE district_code WHEN 'NW' THEN 'West Coast North' WHEN 'WC' THEN 'West Coast South' WHEN 'CHI' THEN 'Greater Chicago' WHEN 'TX' THEN 'Texas'
    WHEN 'FL' THEN 'Florida' WHEN 'EC' THEN 'East Coast' WHEN 'WDC' THEN 'District of Columbia' WHEN 'OV' THEN 'Ohio Valley' WHEN 'DC' THEN 'ecommerce'
    ELSE CASE WHEN channel_code = 'warehouse' THEN 'DC' ELSE 'Other' END END AS district_name,
  CAST(CASE district_code WHEN 'NW' THEN 1 WHEN 'WC' THEN 2 WHEN 'CHI' THEN 3 WHEN 'TX' THEN 4 WHEN 'FL' THEN 5 WHEN 'EC' THEN 6 WHEN 'OV' THEN 7
    WHEN 'WDC' THEN 8 WHEN 'DC' THEN 9 ELSE CASE WHEN channel_code = 'warehouse' THEN 10 ELSE 11 END END AS BIGINT) AS district_order,
  CASE WHEN l.location_analytics_id IN (14, 18, 42, 76, 113, 122, 125, 138, 144, 154, 157, 159, 160, 161, 162, 171, 172, 174, 175) THEN 'Y' ELSE 'N' END AS is_flag_store,
  s.sales
FROM locations l LEFT JOIN s USING (location_analytics_id)

-- key: fill_rate
WITH x AS (
  SELECT s.sku, s.quantity, s.sub_total, i.unit_price FROM sales_line s
  LEFT JOIN sales_header h ON h.order_number = s.order_number
  LEFT JOIN sfcc_order_item i ON i.sfcc_order_number = h.ecom_order_number AND i.sku = s.sku
  WHERE (s.is_return <> 'TRUE' OR s.is_return IS NULL) AND (s.is_canceled <> 'TRUE' OR s.is_canceled IS NULL)),
a AS (
  SELECT c.sku, c.location_code, c.start_date, c.maximum_seats, c.price, sum(coalesce(x.quantity, 0)) AS paid, sum(coalesce(x.sub_total, 0)) AS actual,
    coalesce(sum(x.unit_price)::DOUBLE / nullif(count(x.unit_price), 0), min(c.price)::DOUBLE) AS cost
  FROM culinary_products c LEFT JOIN x ON x.sku = c.sku GROUP BY 1, 2, 3, 4, 5)
SELECT sku, location_code, start_date, maximum_seats, price::DOUBLE AS price, paid::DOUBLE AS paid_seats, actual::DOUBLE AS actual_revenue,
  cost AS cost, (maximum_seats - paid)::DOUBLE AS available_seats,
  CASE WHEN maximum_seats = 0 THEN 0 ELSE ((CAST(paid AS BIGINT) * 20000 + maximum_seats) // (2 * maximum_seats)) / 10000 END AS fill_rate,
  actual::DOUBLE + (maximum_seats - paid)::DOUBLE * cost AS potential_revenue
FROM a

-- key: resolve_name
SELECT o.sfcc_order_number, CASE WHEN o.customer_name = 'Guest Chef' THEN trim(coalesce(b.first_name, '') || ' ' || coalesce(b.last_name, ''))
  ELSE o.customer_name END AS customer_name
FROM sfcc_order o LEFT JOIN sfcc_billing_address b USING (sfcc_order_number)

-- key: cancelled_lines
WITH l AS (
  SELECT order_line_analytics_id, sku, attribution_location_analytics_id, quantity, quantity_returned, quantity_canceled, sub_total,
    quantity - quantity_returned - quantity_canceled AS net_quantity FROM sales_line)
SELECT order_line_analytics_id, sku, attribution_location_analytics_id, quantity::DOUBLE AS quantity, quantity_returned::DOUBLE AS quantity_returned,
  quantity_canceled::DOUBLE AS quantity_canceled, sub_total::DOUBLE AS sub_total, net_quantity::DOUBLE AS net_quantity,
  CASE WHEN quantity = 0 THEN 0 ELSE sub_total::DOUBLE / quantity::DOUBLE END AS seat_price,
  CASE WHEN quantity = 0 THEN 0 ELSE net_quantity::DOUBLE * (sub_total::DOUBLE / quantity::DOUBLE) END AS extended_price,
  (sum(sub_total) OVER (PARTITION BY sku))::DOUBLE AS class_revenue, (sum(net_quantity) OVER (PARTITION BY sku))::DOUBLE AS class_net_quantity,
  rank() OVER (PARTITION BY attribution_location_analytics_id ORDER BY sub_total DESC NULLS LAST) AS rank_in_class
FROM l

-- key: tender_chain
SELECT a.rtl_loc_id, a.trans_seq, a.create_date, b.cust_party_id, coalesce(c.payable_to_address2, c.payable_to_apt) AS payable_to_apartment,
  d.tndr_id, abs(d.amt)::DOUBLE AS amount
FROM trn_trans a
JOIN trl_rtrans b USING (organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq)
JOIN ttr_send_check_tndr_lineitm c USING (organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq)
JOIN ttr_tndr_lineitm d USING (organization_id, rtl_loc_id, business_date, wkstn_id, trans_seq)
JOIN trl_rtrans_lineitm e ON e.organization_id = a.organization_id AND e.rtl_loc_id = a.rtl_loc_id AND e.business_date = a.business_date
  AND e.wkstn_id = a.wkstn_id AND e.trans_seq = a.trans_seq AND e.rtrans_lineitm_seq = d.rtrans_lineitm_seq
WHERE a.trans_statcode = 'COMPLETE' AND a.post_void_flag = 0 AND d.tndr_id = 'HOME_OFFICE_CHECK' AND e.void_flag = 0
  AND CAST(a.create_date AS DATE) BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'
  AND a.create_user_id <> 'DATALOADER' AND b.create_user_id <> 'DATALOADER' AND c.create_user_id <> 'DATALOADER'
  AND d.create_user_id <> 'DATALOADER' AND e.create_user_id <> 'DATALOADER'

-- key: preferred_contact
SELECT party_id, telephone_number FROM (
  SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY contact_flag DESC, create_date DESC, telephone_number DESC) AS rn
  FROM crm_party_telephone WHERE telephone_number IS NOT NULL) x WHERE rn = 1

-- key: payment_lines
SELECT so.sfcc_order_number, sl.order_line_analytics_id, sl.sku, pi.last_4, oi.product_name, cp.class_type, sl.quantity::DOUBLE AS quantity,
  sl.sub_total::DOUBLE AS sub_total
FROM sfcc_order so JOIN sales_header oh ON oh.ecom_order_number = so.sfcc_order_number
JOIN sales_line sl ON sl.order_number = oh.order_number
JOIN sfcc_order_item oi ON oi.sfcc_order_number = so.sfcc_order_number AND oi.sku = sl.sku
JOIN sfcc_payment_instrument pi ON pi.sfcc_order_number = so.sfcc_order_number
LEFT JOIN culinary_products cp ON cp.sku = sl.sku
WHERE pi.card_type = 'Amex' AND oi.product_type = 'Culinary' AND so.order_date >= DATE '1998-01-01' AND so.order_date < DATE '2000-01-01'

-- key: discount_attribution
WITH g AS (
  SELECT f.date_analytics_id, f.product_analytics_id, f.order_line_analytics_id, coalesce(d.discount_code, 'No Discount') AS discount_code,
    coalesce(d.subdiscount_code, 'No Sub-Code') AS subdiscount_code, sum(f.merchandise) AS m, sum(f.quantity) AS q,
    sum(f.fair_market_value) AS c, coalesce(sum(d.discount_amount), 0) AS da
  FROM line_facts f LEFT JOIN pos_discounts d ON d.order_line_analytics_id = f.order_line_analytics_id
  WHERE f.is_return_line = 0 GROUP BY 1, 2, 3, 4, 5)
SELECT date_analytics_id, product_analytics_id, order_line_analytics_id, discount_code, subdiscount_code, m::DOUBLE AS dollars, q::DOUBLE AS units,
  (m - c)::DOUBLE AS margin, c::DOUBLE AS cost, da::DOUBLE AS discount_dollars,
  CAST(CASE WHEN row_number() OVER (PARTITION BY date_analytics_id, product_analytics_id, order_line_analytics_id
    ORDER BY discount_code, subdiscount_code) = 1 THEN 1 ELSE 0 END AS BIGINT) AS unique_factor
FROM g
