-- key: market_basket_report
WITH basket_lines AS (
  SELECT s.order_analytics_id, s.product_analytics_id, t.channel_analytics_id, s.merchandise, s.quantity, c.gregorian_date BETWEEN DATE '2000-05-01' AND DATE '2000-05-31' AS shown,
    bool_or(c.gregorian_date BETWEEN DATE '2000-05-01' AND DATE '2000-05-31') OVER (PARTITION BY s.order_analytics_id) AS order_shown
  FROM written_sales s JOIN calendar c ON c.date_analytics_id = s.date_analytics_id LEFT JOIN sales_line l ON l.order_line_analytics_id = s.order_line_analytics_id
  LEFT JOIN locations t ON t.location_analytics_id = l.attribution_location_analytics_id),
entries AS (
  SELECT order_analytics_id, product_analytics_id, channel_analytics_id, merchandise, quantity, NULL AS present FROM basket_lines WHERE order_shown UNION ALL
  SELECT order_analytics_id, product_analytics_id, unnest((SELECT list(channel_analytics_id) FROM channels)), 0, 0, 1 FROM basket_lines WHERE shown),
cells AS (
  SELECT order_analytics_id, product_analytics_id, channel_analytics_id, sum(merchandise) AS sales, sum(quantity) AS units, max(present) AS present FROM entries GROUP BY 1, 2, 3),
agents AS (
  SELECT l.order_analytics_id, count(DISTINCT a.order_analytics_id) AS agents FROM sales_line l JOIN store_agents a USING (order_line_analytics_id) GROUP BY 1),
named AS (
  SELECT c.*, n.channel_code, x.level_3_analytics_id, m.name, m.taxonomy_code, r.product_name, h.order_number, coalesce(a.agents, 0) AS agents
  FROM cells c JOIN channels n USING (channel_analytics_id) JOIN products r USING (product_analytics_id) JOIN product_to_merchandising_taxonomy x USING (product_analytics_id)
  JOIN merchandising_taxonomies m ON m.level = 3 AND m.taxonomy_analytics_id = x.level_3_analytics_id
  LEFT JOIN sales_header h ON h.order_analytics_id = c.order_analytics_id LEFT JOIN agents a ON a.order_analytics_id = c.order_analytics_id),
totals AS (SELECT product_analytics_id, channel_analytics_id AS channel, sum(sales) AS sales FROM named GROUP BY GROUPING SETS ((1, 2), (1)))
SELECT channel_analytics_id AS channel, channel_code, order_analytics_id AS original_order_analytics_id, order_number AS original_order_number, level_3_analytics_id,
  name AS level_3_name, CAST(taxonomy_code AS BIGINT) AS taxonomy_code, n.product_analytics_id, product_name, n.sales::DOUBLE AS written_gross_sales,
  units::DOUBLE AS written_gross_units, agents AS primary_product_identifier, CAST(present AS BIGINT) AS order_presence_flag, t.sales::DOUBLE AS total_sales_per_sku,
  n.sales::DOUBLE / nullif(t.sales::DOUBLE, 0) AS channel_sales_share_for_sku,
  row_number() OVER (PARTITION BY n.product_analytics_id ORDER BY s.sales DESC NULLS LAST, channel_code, order_analytics_id) AS sku_channel_rank_within_sku
FROM named n JOIN totals t ON t.product_analytics_id = n.product_analytics_id AND t.channel IS NULL
JOIN totals s ON s.product_analytics_id = n.product_analytics_id AND s.channel = n.channel_analytics_id

-- key: open_backorders_report
WITH facts AS (
  SELECT product_analytics_id, 'ordered' AS kind, CAST(date_ordered AS DATE) AS day, merchandise AS amount, quantity AS units FROM sales_line
  WHERE is_backorder = 1 AND status = 'open' AND CAST(date_ordered AS DATE) >= DATE '1996-01-01' UNION ALL
  SELECT product_analytics_id, 'at ' || location_analytics_id, NULL, NULL, quantity_on_hand FROM product_history JOIN calendar USING (date_analytics_id)
  WHERE gregorian_date = DATE '2000-06-15' AND location_analytics_id IN (2, 903, 904) UNION ALL
  SELECT product_analytics_id, 'coming', NULL, NULL, greatest(quantity_open, 0) FROM po_details WHERE is_closed = 0 AND location_analytics_id = 904),
sums AS (
  SELECT product_analytics_id, min(day) AS first_day, sum(amount) AS dollars, sum(units) FILTER (kind = 'ordered') AS units, sum(units) FILTER (kind = 'coming') AS coming,
    coalesce(sum(units) FILTER (kind = 'at 904'), 0) AS at_904, coalesce(sum(units) FILTER (kind = 'at 903'), 0) AS at_903, coalesce(sum(units) FILTER (kind = 'at 2'), 0) AS at_2,
    bool_or(kind LIKE 'at %') AS stocked
  FROM facts GROUP BY product_analytics_id),
arriving AS (
  SELECT DISTINCT ON (product_analytics_id) product_analytics_id, location_analytics_id = 904 AS wanted, quantity_open, current_arrival_date, purchase_order_analytics_id
  FROM po_details WHERE quantity_open > 0 AND is_closed = 0
  ORDER BY product_analytics_id, current_arrival_date_analytics_id NULLS LAST, purchase_order_analytics_id, po_line_number),
prices AS (
  SELECT DISTINCT ON (product_analytics_id) product_analytics_id, price FROM product_price_history ORDER BY product_analytics_id, snapshot_date DESC NULLS LAST, price DESC),
endings(id, code, description) AS (VALUES (1, 'REG', 'Regular'), (2, 'MKD', 'Markdown'), (3, 'POS', 'POS'), (4, 'MOS', 'MOS'), (5, 'NP', 'No Price')),
ages(id, label, least, most) AS (VALUES (5, 'Aged Last 13 Weeks', -100000, 91), (4, 'Aged 14 - 26 Weeks', 92, 182), (3, 'Aged 27 - 39 Weeks', 183, 273), (2, 'Aged 40 - 52 Weeks', 274, 364)),
listed AS (
  SELECT p.product_analytics_id, p.product_name, coalesce(p.vendor_analytics_id, 0) AS vendor_analytics_id, coalesce(v.vendor_name, 'Blank') AS vendor_name, x.level_3_analytics_id,
    m.name AS level_3_name, CAST(m.taxonomy_code AS BIGINT) AS taxonomy_code, s.first_day, s.dollars, s.units, s.coming, s.stocked,
    CASE WHEN s.stocked THEN s.at_904 END AS at_904, CASE WHEN s.stocked THEN s.at_903 END AS at_903, CASE WHEN s.stocked THEN s.at_2 END AS at_2,
    CASE WHEN a.wanted THEN a.quantity_open END AS next_units, CASE WHEN a.wanted THEN a.current_arrival_date END AS next_day, CASE WHEN a.wanted THEN a.purchase_order_analytics_id END AS next_order,
    coalesce(r.price, p.retail_price) AS price, p.last_receipt_date, DATE '2000-06-15' - p.last_receipt_date AS age
  FROM products p JOIN product_to_merchandising_taxonomy x USING (product_analytics_id) JOIN merchandising_taxonomies m ON m.taxonomy_analytics_id = x.level_3_analytics_id AND m.level = 3
  LEFT JOIN vendors v ON v.vendor_analytics_id = p.vendor_analytics_id LEFT JOIN sums s ON s.product_analytics_id = p.product_analytics_id
  LEFT JOIN arriving a ON a.product_analytics_id = p.product_analytics_id LEFT JOIN prices r ON r.product_analytics_id = p.product_analytics_id),
departments AS (SELECT level_3_analytics_id, coalesce(sum(units), 0) AS units FROM listed GROUP BY 1),
ended AS (
  SELECT *, CASE WHEN price IS NULL THEN 5 WHEN floor(price * 100) % 10 = 6 THEN 3 WHEN floor(price * 100) % 10 = 9 THEN 2 WHEN floor(price * 100) % 100 = 1 THEN 4 ELSE 1 END AS ending,
    row_number() OVER (PARTITION BY level_3_analytics_id ORDER BY coalesce(dollars, 0) DESC, coalesce(units, 0) DESC, product_analytics_id) AS place FROM listed)
SELECT product_analytics_id, product_name, vendor_analytics_id, vendor_name, l.level_3_analytics_id, level_3_name, taxonomy_code, first_day AS earliest_backorder_date,
  dollars::DOUBLE AS open_backorder_dollars, l.units::DOUBLE AS open_backorder_units, at_904::DOUBLE AS on_hand_904, at_903::DOUBLE AS on_hand_903, at_2::DOUBLE AS on_hand_2,
  coming::DOUBLE AS open_on_order_units, next_units::DOUBLE AS next_po_units, next_day AS next_po_eta, next_order AS next_po_number, price::DOUBLE AS file_retail_price,
  last_receipt_date, CAST(age AS BIGINT) AS last_receipt_age, CAST(e.id AS BIGINT) AS current_price_type_id, e.code AS current_price_type_code, e.description AS current_price_type_description,
  CAST(coalesce(g.id, 1) AS BIGINT) AS receipt_age_bucket_id, coalesce(g.label, 'Aged Greater than 52 Weeks') AS receipt_age_bucket,
  greatest(coalesce(l.units, 0) - coalesce(next_units, 0), 0)::DOUBLE AS oversold_units,
  (coalesce(at_904, 0) + coalesce(coming, 0))::DOUBLE / nullif(coalesce(l.units, 0)::DOUBLE, 0) AS coverage_ratio,
  coalesce(l.units, 0)::DOUBLE / nullif((coalesce(at_904, 0) + coalesce(at_903, 0) + coalesce(at_2, 0))::DOUBLE, 0) AS backorder_to_stock_ratio, place AS bo_rank_in_dept,
  d.units::DOUBLE AS total_bo_units_in_dept, coalesce(l.units, 0)::DOUBLE / nullif(d.units::DOUBLE, 0) AS bo_unit_share_in_dept
FROM ended l JOIN endings e ON e.id = l.ending JOIN departments d ON d.level_3_analytics_id = l.level_3_analytics_id LEFT JOIN ages g ON l.age BETWEEN g.least AND g.most
WHERE coalesce(first_day >= DATE '1996-02-01', TRUE)

-- key: planning_dashboard
WITH stock_days(shown, date_analytics_id) AS (
  SELECT 'now', date_analytics_id FROM calendar WHERE gregorian_date = DATE '2000-06-15' UNION ALL
  SELECT 'prior', date_analytics_id FROM calendar WHERE gregorian_date = DATE '2000-06-08' UNION ALL
  SELECT 'year', last_year_date_analytics_id FROM calendar WHERE gregorian_date = DATE '2000-06-15'),
store_days(shown, day, date_analytics_id) AS (
  SELECT 'now', date_analytics_id, date_analytics_id FROM calendar c
  WHERE EXISTS (SELECT 1 FROM calendar w WHERE w.fiscal_week_id = c.fiscal_week_id AND w.gregorian_date BETWEEN DATE '2000-06-04' AND DATE '2000-06-10') UNION ALL
  SELECT 'year', date_analytics_id, last_year_date_analytics_id FROM calendar WHERE gregorian_date BETWEEN DATE '2000-06-04' AND DATE '2000-06-10'),
stock AS (
  SELECT t.channel_analytics_id AS channel, sum(available_fair_market_value) FILTER (shown = 'now') AS now, sum(in_transit_fair_market_value) FILTER (shown = 'now') AS coming,
    sum(available_fair_market_value) FILTER (shown = 'prior') AS prior, sum(available_fair_market_value) FILTER (shown = 'year') AS year
  FROM product_history h JOIN stock_days USING (date_analytics_id) JOIN locations t ON t.location_analytics_id = h.location_analytics_id
  WHERE h.product_analytics_id IN (SELECT product_analytics_id FROM product_to_merchandising_taxonomy
    WHERE level_3_analytics_id IN (3, 6, 8, 250003, 250004, 250005, 250007, 500004, 500005, 500006, 500007, 500008, 500010, 500012)) GROUP BY 1),
trading AS (
  SELECT shown, day, t.channel_analytics_id AS channel, l.attribution_location_analytics_id AS location, sum(s.merchandise) > 0 AS traded
  FROM delivered_sales s JOIN store_days USING (date_analytics_id) JOIN sales_line l USING (order_line_analytics_id)
  JOIN locations t ON t.location_analytics_id = l.attribution_location_analytics_id WHERE l.attribution_location_analytics_id <> 2 GROUP BY 1, 2, 3, 4),
stores AS (
  SELECT channel, count(*) FILTER (shown = 'now' AND traded) AS now, count(*) FILTER (shown = 'year' AND traded) AS year, bool_or(shown = 'now') AS has_now, bool_or(shown = 'year') AS has_year
  FROM trading r WHERE day = (SELECT max(day) FROM trading o WHERE o.shown = r.shown AND o.channel = r.channel) GROUP BY 1),
sides AS (
  SELECT channel, s.now, s.coming, s.prior, s.year, CASE WHEN has_now THEN c.now END AS stores_now, CASE WHEN has_year THEN c.year END AS stores_year
  FROM stock s FULL JOIN stores c USING (channel) WHERE channel IN ('1', '2', '5'))
SELECT channel, now::DOUBLE AS current_available, coming::DOUBLE AS current_in_transit, prior::DOUBLE AS prior_available, year::DOUBLE AS last_year_available,
  stores_now AS current_store_count, stores_year AS ly_store_count, (SELECT sum(now) FROM sides)::DOUBLE AS total_curr_avail_all_channels,
  now::DOUBLE / nullif((SELECT sum(now) FROM sides)::DOUBLE, 0) AS curr_avail_share_of_total, (now - year)::DOUBLE AS yoy_available_change,
  (now - year)::DOUBLE / nullif(year::DOUBLE, 0) AS yoy_available_change_pct, (now - prior)::DOUBLE AS wow_available_change,
  (now - prior)::DOUBLE / nullif(prior::DOUBLE, 0) AS wow_available_change_pct, now::DOUBLE / nullif(stores_now, 0) AS current_inv_per_store,
  row_number() OVER (ORDER BY now DESC NULLS LAST, channel) AS channel_rank_by_current_inv
FROM sides

-- key: class_fill_rate
WITH sold AS (
  SELECT l.sku, sum(l.quantity) AS seats, sum(l.sub_total) AS revenue, sum(i.unit_price) AS prices, count(i.unit_price) AS priced
  FROM sales_line l LEFT JOIN sales_header h ON h.order_number = l.order_number LEFT JOIN sfcc_order_item i ON i.sfcc_order_number = h.ecom_order_number AND i.sku = l.sku
  WHERE coalesce(l.is_return, '') <> 'TRUE' AND coalesce(l.is_canceled, '') <> 'TRUE' GROUP BY l.sku),
classes AS (
  SELECT sku, location_code, start_date, instructor_name, maximum_seats, is_class_cancelled, count(*) AS times, min(price) AS price
  FROM culinary_products WHERE sku NOT LIKE 'CSA%' AND start_date BETWEEN TIMESTAMP '2000-01-01 00:00:00' AND TIMESTAMP '2000-12-31 23:59:59' GROUP BY 1, 2, 3, 4, 5, 6),
filled AS (
  SELECT c.*, t.name AS store_name, t.district_code, p.short_description, coalesce(s.seats, 0) * times AS paid, coalesce(s.revenue, 0) * times AS revenue,
    coalesce(s.prices::DOUBLE / nullif(s.priced, 0), c.price::DOUBLE) AS cost,
    CASE maximum_seats WHEN 0 THEN 0 ELSE CAST(floor((CAST(coalesce(s.seats, 0) * times AS BIGINT) * 20000 + maximum_seats) / (2 * maximum_seats)) AS BIGINT) END AS per_10000
  FROM classes c LEFT JOIN sold s ON s.sku = c.sku LEFT JOIN locations t ON t.location_code = c.location_code LEFT JOIN products p ON p.sku = c.sku),
districts AS (SELECT district_code, sum(revenue) AS revenue, sum(per_10000) AS per_10000, count(*) AS classes FROM filled GROUP BY 1)
SELECT f.store_name, f.location_code AS store, f.district_code, CAST(f.start_date AS DATE) AS date_start, strftime(f.start_date, '%H:%M:%S') AS time_start, f.sku AS class_sku,
  f.short_description AS class_name, f.instructor_name AS chef_name, f.maximum_seats AS max_seats, f.paid::DOUBLE AS paid_in_full, (f.maximum_seats - f.paid)::DOUBLE AS available_seats,
  f.per_10000 / 10000 AS fill_rate, f.cost, f.revenue::DOUBLE + (f.maximum_seats - f.paid)::DOUBLE * f.cost AS potential, f.revenue::DOUBLE AS actual, f.is_class_cancelled,
  d.revenue::DOUBLE AS district_total_revenue, (d.per_10000 / 10000) / d.classes AS district_avg_fill_rate,
  1 + (SELECT count(*) FROM filled o WHERE o.district_code IS NOT DISTINCT FROM f.district_code AND o.per_10000 > f.per_10000) AS fill_rate_rank_in_district
FROM filled f JOIN districts d ON d.district_code IS NOT DISTINCT FROM f.district_code
