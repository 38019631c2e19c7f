"""Shared CTEs: the input views of the jobs, restated over the raw tables."""

RETAIL = """
lines AS (
  SELECT l.*, o.*,
    CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS invoice_no,
    CAST(l_partkey AS VARCHAR) AS stock_code,
    p_name AS description,
    CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT) AS quantity,
    p_retailprice AS unit_price,
    round(l_extendedprice / l_quantity / 100) * 100 AS paid_price,
    l_extendedprice AS gross_price,
    CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE o_orderdate END
      + to_hours(CAST(7 + o_orderkey % 13 AS INTEGER)) AS invoice_ts,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey + 1 END AS customer_id,
    n_name AS country,
    CASE r_name WHEN 'AMERICA' THEN 'south' WHEN 'AFRICA' THEN 'equator' ELSE 'north' END AS hemisphere,
    l_linenumber AS line_no, l_partkey AS part_no, l_quantity AS line_quantity
  FROM lineitem l
  JOIN orders o ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
retail AS (
  SELECT *, CAST(invoice_ts AS DATE) AS invoice_date, round(quantity * unit_price, 2) AS total_price
  FROM lines
)"""

WEB = """
ev AS (
  SELECT event_id, ts, user_id, event_type,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
    CAST(round(value * 1000000) AS BIGINT) AS micros,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day
  FROM events
),
geo AS (
  SELECT n_nationkey, n_name AS country, r_name AS continent,
    r_name || '-' || CAST(n_nationkey % 2 AS VARCHAR) AS sub_continent
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
hits AS (
  SELECT event_id, ts, user_id, day, k, event_type, micros,
    CAST(user_id AS VARCHAR) || '-' || CAST(day // (1 + user_id % 10) AS VARCHAR) AS visitor,
    day * 10 + user_id % 10 AS visit_id,
    strftime(ts, '%Y%m%d') AS date,
    CASE WHEN event_type = 'click' THEN '1' WHEN event_type = 'view' THEN '2'
         WHEN event_type = 'purchase' THEN '6' WHEN event_type = 'error' THEN '0'
         WHEN k < 34 THEN '3' WHEN k < 50 THEN '4' ELSE '5' END AS action,
    CASE WHEN event_type = 'purchase' THEN 'T' || CAST(event_id AS VARCHAR) END AS transaction_id,
    CASE WHEN event_type = 'purchase' THEN micros END AS transaction_revenue,
    CASE user_id % 6 WHEN 0 THEN 'organic' WHEN 1 THEN 'cpc' WHEN 2 THEN 'cpm'
      WHEN 3 THEN 'referral' WHEN 4 THEN 'affiliate' ELSE '(none)' END AS channel,
    CASE (user_id + day) % 4 WHEN 0 THEN '(not set)' WHEN 1 THEN 'Campaign A'
      WHEN 2 THEN 'Campaign B' ELSE 'Campaign C' END AS campaign,
    continent, sub_continent, country, country || '-' || CAST(user_id % 3 AS VARCHAR) AS region
  FROM ev JOIN geo ON user_id % 25 = n_nationkey
),
sessions AS (
  SELECT visitor, visit_id, date, user_id, day, channel, campaign, continent, sub_continent, country, region,
    epoch(min(ts)) AS start_seconds,
    count(*) AS hit_count,
    NULLIF(count(*) FILTER (event_type IN ('view', 'click')), 0) AS pageviews,
    NULLIF(date_sub('second', min(ts), max(ts)), 0) AS time_on_site,
    CASE WHEN count(*) = 1 THEN 1 END AS bounces,
    NULLIF(count(*) FILTER (event_type = 'purchase'), 0) AS transactions,
    CAST(sum(transaction_revenue) AS BIGINT) AS revenue,
    CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) > 0
      THEN least(100, 10 * count(*)) END AS session_quality,
    row_number() OVER (PARTITION BY visitor ORDER BY day) AS visit_number
  FROM hits
  GROUP BY visitor, visit_id, date, user_id, day, channel, campaign, continent, sub_continent, country, region
)"""

PRODUCTS = """
items AS (
  SELECT h.*, i.i,
    (h.event_id * 7 + i.i * 13) % (SELECT count(*) FROM part) AS partkey,
    CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS n_items
  FROM hits h JOIN (SELECT unnest([0, 1]) AS i) i
    ON i.i < CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END
  WHERE event_type <> 'error'
),
products AS (
  SELECT items.*,
    CASE k % 10 WHEN 0 THEN '(not set)' WHEN 1 THEN 'Home/' WHEN 2 THEN 'Drinkware'
      WHEN 3 THEN '${escCatTitle}' WHEN 4 THEN 'Wearables/Men''s T-Shirts'
      WHEN 5 THEN 'Home/Office/Writing Instruments/'
      ELSE 'Home/' || p_type || '/' || p_brand || '/' END AS category,
    CAST(1 + k % 5 AS BIGINT) AS product_quantity,
    CASE WHEN event_type = 'purchase' THEN micros // n_items END AS product_revenue,
    CAST(round(p_retailprice * 1000000) AS BIGINT) AS product_price,
    (event_type = 'view') AS is_impression,
    (event_type = 'click') AS is_click
  FROM items JOIN part ON partkey = p_partkey
)"""

# The category rules, written for the few raw paths that the inputs contain.
LEVELS = """
cleaned AS (
  SELECT *,
    regexp_replace(regexp_replace(regexp_replace(
      replace(replace(replace(category, '${escCatTitle}', '@'),
        '${productitem.product.origCatName}', '@'), '(not set)', '@'),
      '/$', ''), '^Home/', ''), '^/', '') AS bare
  FROM products
),
mapped AS (
  SELECT *, CASE replace(bare, '@', 'Unavailable')
      WHEN 'Home' THEN ''
      WHEN 'Drinkware' THEN 'Accessories/Drinkware'
      WHEN 'Wearables/Men''s T-Shirts' THEN 'Apparel/Men''s/Men''s-T-Shirts'
      WHEN 'Office/Writing Instruments' THEN 'Office/Writing'
      ELSE replace(bare, '@', 'Unavailable') END AS path,
    CASE replace(bare, '@', '')
      WHEN 'Home' THEN ''
      WHEN 'Drinkware' THEN 'Accessories/Drinkware'
      WHEN 'Wearables/Men''s T-Shirts' THEN 'Apparel/Men''s/Men''s-T-Shirts'
      WHEN 'Office/Writing Instruments' THEN 'Office/Writing'
      ELSE replace(bare, '@', '') END AS blank_path
  FROM cleaned
),
leveled AS (
  SELECT *,
    split_part(path, '/', 1) AS main_category,
    COALESCE(NULLIF(split_part(path, '/', 2), ''), 'Other') AS sub_category,
    COALESCE(NULLIF(split_part(path, '/', 3), ''), 'Other') AS subsub_category,
    COALESCE(NULLIF(split_part(path, '/', 1), ''), 'Other') AS main_or_other
  FROM mapped
)"""


def with_ctes(*ctes: str):
    head = "WITH " + ",".join(ctes)

    def build(body: str, *more: str) -> str:
        return head + "".join("," + m for m in more) + "\n" + body.strip()

    return build


retail = with_ctes(RETAIL)
web = with_ctes(WEB)
products = with_ctes(WEB, PRODUCTS)
levels = with_ctes(WEB, PRODUCTS, LEVELS)


def rounded(sql: str, *columns: str, digits: int = 6) -> str:
    """Round the columns whose floating sums depend on the order of the rows."""
    parts = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
    return f"SELECT * REPLACE ({parts}) FROM (\n{sql}\n)"
