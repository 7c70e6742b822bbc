-- key: customer_frequency_in_order
SELECT order_year, frequency_bucket, sales_bucket, total_sales, row_number() OVER (ORDER BY order_year, frequency_bucket, sales_bucket) AS position
FROM report_customer_frequency_and_spend

-- key: merch_vs_culinary_in_order
SELECT customer_segment, total_sales,
  row_number() OVER (ORDER BY list_position(['AllCustomers', 'Culinary+Merch', 'CulinaryOnly', 'NonCulinary', 'Other'], customer_segment)) AS position
FROM report_merch_vs_culinary_customers

-- key: open_backorders_in_order
SELECT level_3_analytics_id, product_analytics_id, bo_rank_in_dept,
  row_number() OVER (ORDER BY level_3_analytics_id, bo_rank_in_dept, product_analytics_id) AS position
FROM report_open_backorders_report

-- key: returns_by_store_maintained
SELECT * FROM report_returns_by_store

-- key: customers_by_grain
SELECT CASE grouping(source, year(date_ordered)) WHEN 0 THEN 'source and year' WHEN 1 THEN 'source' WHEN 2 THEN 'year' ELSE 'all' END AS grain,
  source, CAST(year(date_ordered) AS BIGINT) AS order_year, count(DISTINCT email) AS customers
FROM sales_header WHERE email IS NOT NULL GROUP BY GROUPING SETS ((source, year(date_ordered)), (source), (year(date_ordered)), ())

-- key: to_date_every_day
WITH daily AS (
  SELECT date_analytics_id AS day, coalesce(sales_channel, 'pos') AS sales_channel, sum(merchandise) AS sales, sum(quantity) AS units
  FROM line_facts WHERE is_return_line = 0 GROUP BY 1, 2),
placed AS (
  SELECT d.gregorian_date AS shown, f.sales_channel, f.sales, f.units, c.date_analytics_id = f.day AS now, c.fiscal_week_id = d.fiscal_week_id AS week,
    c.fiscal_month_id = d.fiscal_month_id AS month, c.fiscal_quarter_id = d.fiscal_quarter_id AS quarter
  FROM calendar d JOIN calendar c ON c.fiscal_year = d.fiscal_year AND c.gregorian_date <= d.gregorian_date
  JOIN daily f ON f.day = c.date_analytics_id OR f.day = c.last_year_date_analytics_id
  WHERE d.gregorian_date BETWEEN DATE '1999-05-12' AND DATE '2000-06-14')
SELECT shown AS gregorian_date, sales_channel,
  (sum(sales) FILTER (week AND now))::DOUBLE AS sales_week, (sum(sales) FILTER (week AND NOT now))::DOUBLE AS sales_week_ly,
  (sum(sales) FILTER (month AND now))::DOUBLE AS sales_month, (sum(sales) FILTER (month AND NOT now))::DOUBLE AS sales_month_ly,
  (sum(sales) FILTER (quarter AND now))::DOUBLE AS sales_quarter, (sum(sales) FILTER (quarter AND NOT now))::DOUBLE AS sales_quarter_ly,
  (sum(sales) FILTER (now))::DOUBLE AS sales_year, (sum(sales) FILTER (NOT now))::DOUBLE AS sales_year_ly,
  (sum(units) FILTER (week AND now))::DOUBLE AS units_week, (sum(units) FILTER (week AND NOT now))::DOUBLE AS units_week_ly,
  (sum(units) FILTER (month AND now))::DOUBLE AS units_month, (sum(units) FILTER (month AND NOT now))::DOUBLE AS units_month_ly,
  (sum(units) FILTER (quarter AND now))::DOUBLE AS units_quarter, (sum(units) FILTER (quarter AND NOT now))::DOUBLE AS units_quarter_ly,
  (sum(units) FILTER (now))::DOUBLE AS units_year, (sum(units) FILTER (NOT now))::DOUBLE AS units_year_ly
FROM placed GROUP BY 1, 2

-- key: sales_by_overlapping_periods
WITH spans AS (
  SELECT 'week' AS kind, CAST(fiscal_week_id AS VARCHAR) AS id, min(date_analytics_id) AS first, max(date_analytics_id) AS last FROM calendar GROUP BY 2 UNION ALL
  SELECT 'month', CAST(fiscal_month_id AS VARCHAR), min(date_analytics_id), max(date_analytics_id) FROM calendar GROUP BY 2 UNION ALL
  SELECT 'quarter', CAST(fiscal_quarter_id AS VARCHAR), min(date_analytics_id), max(date_analytics_id) FROM calendar GROUP BY 2 UNION ALL
  SELECT 'year', CAST(fiscal_year AS VARCHAR), min(date_analytics_id), max(date_analytics_id) FROM calendar GROUP BY 2)
SELECT kind, id, sum(merchandise)::DOUBLE AS sales, count(*) AS lines
FROM line_facts JOIN spans ON date_analytics_id BETWEEN first AND last WHERE is_return_line = 0 GROUP BY kind, id

-- key: lifecycle_by_state
SELECT email, sales_channel_type, month_analytics_id AS period, customer_type FROM report_lifecycle_rolling
WHERE month_analytics_id = (SELECT max(month_analytics_id) FROM report_lifecycle_rolling)
