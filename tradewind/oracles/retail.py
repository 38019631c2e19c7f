"""SQL twins of the retail jobs."""

from .base import levels, retail, rounded

ORDERS = """
paid AS (
  SELECT customer_id, invoice_date AS order_date, invoice_no AS order_id
  FROM retail WHERE invoice_no NOT LIKE 'C%'
)"""

PERIOD_INDEX = {
    "month": "year({0}) * 12 + month({0})",
    "quarter": "year({0}) * 4 + quarter({0})",
    "week": "date_diff('day', DATE '1970-01-05', {0}) // 7",
}


def retention(build, orders: str, period: str) -> dict[str, str]:
    """Activity, churn and cohorts over a CTE (customer_id, order_date, order_id)."""
    start = f"CAST(date_trunc('{period}', order_date) AS DATE)"
    active = f"""
active AS (
  SELECT DISTINCT customer_id, {start} AS period FROM paid WHERE customer_id IS NOT NULL
),
present AS (SELECT period, row_number() OVER (ORDER BY period) AS n FROM (SELECT DISTINCT period FROM active)),
churned AS (
  SELECT a.customer_id, q.period
  FROM active a JOIN present p ON a.period = p.period JOIN present q ON q.n = p.n + 1
  ANTI JOIN active b ON b.customer_id = a.customer_id AND b.period = q.period
)"""
    number = PERIOD_INDEX[period]
    return {
        "period_activity": build(
            f"""SELECT {start} AS period, count(DISTINCT order_id) AS orders,
  count(DISTINCT customer_id) AS customers FROM paid GROUP BY 1""",
            orders,
        ),
        "customer_period_purchases": build(
            f"""SELECT customer_id, {start} AS period, count(DISTINCT order_id) AS purchase_count
FROM paid WHERE customer_id IS NOT NULL GROUP BY ALL""",
            orders,
        ),
        "churned_customers": build("SELECT * FROM churned", orders, active),
        "churn_rate": build(
            """SELECT p.period, a.n AS active_customers, COALESCE(c.n, 0) AS churned_customers,
  round_even(CAST(CASE WHEN b.n IS NOT NULL THEN COALESCE(c.n, 0) END AS DOUBLE) / b.n * 100.0, 3) AS churn_rate
FROM present p
JOIN (SELECT period, count(*) AS n FROM active GROUP BY 1) a ON a.period = p.period
LEFT JOIN present q ON q.n = p.n - 1
LEFT JOIN (SELECT period, count(*) AS n FROM active GROUP BY 1) b ON b.period = q.period
LEFT JOIN (SELECT period, count(*) AS n FROM churned GROUP BY 1) c ON c.period = p.period""",
            orders,
            active,
        ),
        "cohort_retention": build(
            f"""SELECT g.cohort, CAST(g.cohort_index AS BIGINT) AS cohort_index,
  COALESCE(c.customers, 0) AS customers, CAST(COALESCE(c.customers, 0) AS DOUBLE) / z.customers AS retention
FROM (SELECT a.cohort, b.cohort_index FROM (SELECT DISTINCT cohort FROM cells) a,
  (SELECT DISTINCT cohort_index FROM cells) b) g
JOIN cells z ON z.cohort = g.cohort AND z.cohort_index = 0
LEFT JOIN cells c ON c.cohort = g.cohort AND c.cohort_index = g.cohort_index""",
            orders,
            active,
            f"""
cells AS (
  SELECT cohort, {number.format("period")} - ({number.format("cohort")}) AS cohort_index, count(*) AS customers
  FROM (SELECT *, min(period) OVER (PARTITION BY customer_id) AS cohort FROM active)
  GROUP BY ALL
)""",
        ),
    }


def _retention_queries():
    found = {}
    for period in ("month", "quarter"):
        for name, sql in retention(retail, ORDERS, period).items():
            found[f"{name}_{period}"] = sql
    months = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in (1, 4, 7, 10)]
    start = "strftime(date_trunc('quarter', order_date), '%Y-%m')"
    cells = ", ".join(
        f"count(DISTINCT CASE WHEN {start} = '{m}' THEN order_id END) AS p_{m.replace('-', '_')}" for m in months
    )
    found["customer_period_matrix_quarter"] = retail(
        f"SELECT customer_id, {cells} FROM paid WHERE customer_id IS NOT NULL GROUP BY 1", ORDERS
    )
    found["churned_customers_in_quarter"] = (
        f"SELECT * FROM ({found['churned_customers_quarter']}) WHERE period = DATE '2001-07-01'"
    )
    found["monthly_churn_by_country"] = retail(
        """SELECT CAST(date_trunc('month', invoice_ts) AS DATE) AS month, country,
  CAST(NULLIF(count(*) FILTER (customer_id IS NOT NULL AND date_sub('day', invoice_ts, following) > 30), 0) AS DOUBLE)
    / count(*) AS churn_rate
FROM (SELECT *, lead(invoice_ts) OVER (PARTITION BY customer_id
  ORDER BY invoice_ts, invoice_no, line_no, part_no, line_quantity) AS following FROM retail)
GROUP BY ALL"""
    )
    return found


ORDER = "invoice_ts, invoice_no, line_no, part_no, line_quantity"

SEASONED = """
seasoned AS (
  SELECT *, CASE WHEN hemisphere = 'equator' THEN 'Summer'
    WHEN month(invoice_date) IN (12, 1, 2) THEN CASE hemisphere WHEN 'north' THEN 'Winter' ELSE 'Summer' END
    WHEN month(invoice_date) IN (3, 4, 5) THEN CASE hemisphere WHEN 'north' THEN 'Spring' ELSE 'Autumn' END
    WHEN month(invoice_date) IN (6, 7, 8) THEN CASE hemisphere WHEN 'north' THEN 'Summer' ELSE 'Winter' END
    ELSE CASE hemisphere WHEN 'north' THEN 'Autumn' ELSE 'Spring' END END AS season
  FROM retail
)"""
KEYWORD = """CASE WHEN description LIKE '%cold%' OR description LIKE '%old%' THEN 'Cold-Related'
    WHEN description LIKE '%hot%' OR description LIKE '%red%' THEN 'Outdoor-Related' ELSE 'Other' END"""

LOYAL = """
base AS (
  SELECT * FROM retail WHERE quantity > 0 AND customer_id IS NOT NULL AND quantity <> 3114 AND stock_code <> 'D'
),
pairs AS (
  SELECT customer_id, stock_code, count(*) AS purchase_count, avg(quantity) AS mean_quantity,
    min(invoice_ts) AS first_purchase, max(invoice_ts) AS most_recent_purchase,
    date_sub('day', min(invoice_ts), max(invoice_ts)) AS timeframe
  FROM base GROUP BY ALL
),
loyal AS (SELECT * FROM pairs WHERE purchase_count > 1 AND (purchase_count > 2 OR timeframe >= 365)),
shares AS (
  SELECT l.customer_id, l.n AS loyal_items, u.n AS distinct_items, CAST(l.n AS DOUBLE) / u.n AS loyal_probability
  FROM (SELECT customer_id, count(*) AS n FROM loyal GROUP BY 1) l
  JOIN (SELECT customer_id, count(DISTINCT stock_code) AS n FROM base GROUP BY 1) u ON u.customer_id = l.customer_id
)"""


def _customers() -> dict[str, str]:
    first_country = f"SELECT customer_id, arg_min(country, ({ORDER})) AS country FROM base GROUP BY 1"
    return {
        "season_label": retail(
            """SELECT country, month(invoice_date) AS month, season, count(*) AS lines FROM seasoned GROUP BY ALL""",
            SEASONED,
        ),
        "keyword_category": retail(
            f"SELECT description, {KEYWORD} AS category, count(*) AS lines FROM retail GROUP BY ALL"
        ),
        "seasonal_sales": retail(
            f"""SELECT season, {KEYWORD} AS category, CAST(sum(quantity) AS BIGINT) AS quantity
FROM seasoned GROUP BY ALL""",
            SEASONED,
        ),
        "impulsive_customers": retail(
            """SELECT customer_id, year, p.n AS total_purchases, c.n AS total_cancellations,
  CAST(c.n AS DOUBLE) / p.n AS cancellation_rate, strongly_impulsive, weakly_impulsive
FROM (SELECT customer_id, year, count(*) AS n FROM rows_ WHERE NOT cancelled GROUP BY ALL) p
JOIN (
  SELECT customer_id, year, count(*) AS n, count(*) FILTER (distance <= 1) AS strongly_impulsive,
    count(*) FILTER (distance BETWEEN 2 AND 7) AS weakly_impulsive
  FROM (
    SELECT c.customer_id, c.year, c.id, min(abs(date_diff('day', p.invoice_date, c.invoice_date))) AS distance
    FROM rows_ c LEFT JOIN rows_ p
      ON p.customer_id = c.customer_id AND p.year = c.year AND NOT p.cancelled
    WHERE c.cancelled GROUP BY ALL)
  GROUP BY ALL) c USING (customer_id, year)
WHERE CAST(c.n AS DOUBLE) / p.n >= 0.5 AND p.n > 5""",
            """
rows_ AS (
  SELECT COALESCE(customer_id, 0) AS customer_id, year(invoice_date) AS year, invoice_date,
    invoice_no LIKE 'C%' AS cancelled, row_number() OVER () AS id FROM retail
)""",
        ),
        "loyal_items": retail(
            "SELECT *, CAST(timeframe AS DOUBLE) / purchase_count AS purchase_frequency FROM loyal", LOYAL
        ),
        "repeat_item_descriptions": retail(
            """SELECT DISTINCT l.stock_code, loyal_buyers, description
FROM (SELECT stock_code, count(*) AS loyal_buyers FROM loyal GROUP BY 1) l
LEFT JOIN base ON base.stock_code = l.stock_code""",
            LOYAL,
        ),
        "loyal_probability": retail("SELECT * FROM shares", LOYAL),
        "loyal_share": retail(
            """SELECT total_customers, loyal_customers,
  round_even(CAST(loyal_customers AS DOUBLE) / total_customers, 4) * 100.0 AS loyal_percent
FROM (SELECT (SELECT count(DISTINCT customer_id) FROM base) AS total_customers,
  (SELECT count(*) FROM shares WHERE loyal_probability > 0.04) AS loyal_customers)""",
            LOYAL,
        ),
        "loyal_by_country": retail(
            f"""SELECT country, count(*) AS customers FROM ({first_country})
WHERE customer_id IN (SELECT customer_id FROM shares WHERE loyal_probability > 0.04) GROUP BY 1""",
            LOYAL,
        ),
        "customers_by_country": retail(
            f"SELECT country, count(*) AS customers FROM ({first_country}) GROUP BY 1", LOYAL
        ),
        "discount_driven": retail(
            """SELECT d.customer_id, total_discount, total_spent, total_discount * -100.0 / total_spent AS avg_discount
FROM (SELECT customer_id,
    CAST(-sum(round(CAST(l_extendedprice AS DECIMAL(14, 2)) * CAST(l_discount AS DECIMAL(4, 2)), 2)) AS DOUBLE) AS total_discount
  FROM retail WHERE l_discount > 0 AND customer_id IS NOT NULL GROUP BY 1) d
JOIN (SELECT customer_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total_spent
  FROM retail WHERE quantity > 0 AND quantity <> 3114 AND customer_id IS NOT NULL GROUP BY 1) p
  ON p.customer_id = d.customer_id
WHERE total_discount * -100.0 / total_spent >= 5"""
        ),
    }


BASE = """
base AS (SELECT * FROM retail WHERE quantity > 0 AND unit_price > 0 AND country <> 'Unspecified')"""
VELOCITY = """
weekly AS (
  SELECT stock_code, description, CAST(date_trunc('week', invoice_date) AS DATE) AS week, sum(quantity) AS quantity
  FROM base GROUP BY ALL
),
item_weeks AS (SELECT stock_code, count(DISTINCT week) AS weeks FROM weekly GROUP BY 1),
velocity AS (
  SELECT stock_code, description, CAST(sum(quantity) AS DOUBLE) / (count(*) * any_value(weeks)) AS sales_velocity,
    CAST(sum(quantity) AS DOUBLE) / any_value(weeks) AS documented
  FROM weekly JOIN item_weeks USING (stock_code) GROUP BY ALL
),
tiers AS (
  SELECT stock_code, description, sales_velocity,
    CASE WHEN sales_velocity > (SELECT quantile_cont(sales_velocity, 0.75) FROM velocity) THEN 'High'
      WHEN sales_velocity < (SELECT quantile_cont(sales_velocity, 0.25) FROM velocity) THEN 'Low'
      ELSE 'Medium' END AS tier
  FROM velocity
)"""
GAPS = f"""
gaps AS (
  SELECT * FROM (
    SELECT stock_code, invoice_date, country, date_diff('day',
      lag(invoice_date) OVER (PARTITION BY stock_code ORDER BY {ORDER}), invoice_date) AS time_gap
    FROM base)
  WHERE time_gap > 0
)"""
STOCKOUTS = """
tier_lines AS (
  SELECT g.*, t.tier, time_gap > CASE t.tier WHEN 'High' THEN 30 WHEN 'Medium' THEN 60 ELSE 90 END AS stockout
  FROM gaps g JOIN (SELECT DISTINCT stock_code, tier FROM tiers) t USING (stock_code)
  QUALIFY count(*) OVER (PARTITION BY g.stock_code, t.tier)
    > CASE t.tier WHEN 'High' THEN 10 WHEN 'Medium' THEN 15 ELSE 20 END
),
stockouts AS (
  SELECT tier, stock_code, count(*) AS total_purchases, count(*) FILTER (stockout) AS total_stockouts,
    CAST(count(*) FILTER (stockout) AS DOUBLE) / count(*) AS stockout_rate
  FROM tier_lines GROUP BY ALL HAVING count(*) FILTER (stockout) > 0
),
by_country AS (
  SELECT country, CAST(count(*) FILTER (stockout) AS DOUBLE) / count(*) AS stockout_rate, avg(time_gap) AS avg_time_gap
  FROM tier_lines GROUP BY 1
)"""
COUNTRIES = """
countries AS (
  SELECT country, CAST(sum(quantity) AS BIGINT) AS total_quantity, avg(quantity) AS avg_quantity_per_item,
    count(*) AS items
  FROM (SELECT country, stock_code, sum(quantity) AS quantity FROM base GROUP BY ALL) GROUP BY 1
)"""
DEMAND = """
weekly_demand AS (
  SELECT stock_code, CAST(date_trunc('week', invoice_date) AS DATE) AS week, CAST(sum(quantity) AS BIGINT) AS quantity
  FROM retail GROUP BY ALL
),
demand AS (
  SELECT stock_code, CAST(sum(quantity) AS BIGINT) AS total_demand, avg(quantity) AS avg_weekly_demand,
    stddev_samp(quantity) AS demand_std
  FROM weekly_demand GROUP BY 1
)"""
SERIES = """
spans AS (SELECT stock_code, min(week) AS first_week, max(week) AS last_week FROM weekly_demand GROUP BY 1),
calendar AS (
  SELECT stock_code, CAST(unnest(generate_series(first_week, last_week, INTERVAL 7 DAY)) AS DATE) AS week FROM spans
),
series AS (
  SELECT c.stock_code, c.week + 6 AS week_end, COALESCE(quantity, 0) AS quantity
  FROM calendar c LEFT JOIN weekly_demand d ON d.stock_code = c.stock_code AND d.week = c.week
)"""
FORECAST = """
timed AS (
  SELECT s.*, first_week + 6 AS first_end, last_week + 6 AS last_end,
    CAST(date_diff('day', first_week + 6, week_end) / 7 AS DOUBLE) AS t, CAST(quantity AS DOUBLE) AS y
  FROM series s JOIN spans p ON p.stock_code = s.stock_code
),
fits AS (
  SELECT stock_code, any_value(first_end) AS first_end, any_value(last_end) AS last_end,
    CASE WHEN count(*) > 1 THEN regr_slope(y, t) ELSE 0 END AS slope,
    CASE WHEN count(*) > 1 THEN regr_intercept(y, t) ELSE avg(y) END AS intercept,
    avg(y) FILTER (date_diff('day', week_end, last_end) < 70) AS observed_mean
  FROM timed GROUP BY 1
),
residuals AS (
  SELECT d.stock_code, week(week_end) AS w, y - intercept - slope * t AS residual
  FROM timed d JOIN fits f ON f.stock_code = d.stock_code
),
seasonal AS (SELECT stock_code, w, avg(residual) AS effect FROM residuals GROUP BY ALL),
sigmas AS (SELECT stock_code, COALESCE(stddev_samp(residual), 0) AS sigma FROM residuals GROUP BY 1),
future AS (
  SELECT f.*, last_end + 7 * CAST(step AS INTEGER) AS week_end,
    date_diff('day', first_end, last_end + 7 * CAST(step AS INTEGER)) / 7 AS t
  FROM fits f, (SELECT unnest(range(1, 53)) AS step)
),
predicted AS (
  SELECT u.stock_code, u.week_end, observed_mean, sigma, intercept + slope * t + COALESCE(effect, 0) AS yhat
  FROM future u JOIN sigmas g ON g.stock_code = u.stock_code
  LEFT JOIN seasonal s ON s.stock_code = u.stock_code AND s.w = week(u.week_end)
),
leveled_forecast AS (
  SELECT *, yhat - (avg(yhat) OVER (PARTITION BY stock_code) - observed_mean) AS level FROM predicted
)"""


def _supply() -> dict[str, str]:
    columns = """stock_code, description, quantity, unit_price, total_price, customer_id, country, invoice_date,
  invoice_ts, invoice_no, line_no, part_no, line_quantity"""
    items = """
items AS (SELECT stock_code, CAST(sum(quantity) AS BIGINT) AS quantity FROM base GROUP BY 1)"""
    return {
        "supply_base": retail(f"SELECT {columns} FROM base", BASE),
        "weekly_sales_velocity": retail(
            "SELECT stock_code, description, sales_velocity FROM velocity", BASE, VELOCITY
        ),
        "weekly_sales_velocity_documented": retail(
            "SELECT stock_code, description, documented AS sales_velocity FROM velocity", BASE, VELOCITY
        ),
        "velocity_tier": retail("SELECT * FROM tiers", BASE, VELOCITY),
        "purchase_gaps": retail("SELECT * FROM gaps", BASE, GAPS),
        "stockout_rate": retail("SELECT * FROM stockouts", BASE, VELOCITY, GAPS, STOCKOUTS),
        "stockout_tier_mean": rounded(
            retail(
                "SELECT tier, avg(stockout_rate) AS mean_stockout_rate FROM stockouts GROUP BY 1",
                BASE, VELOCITY, GAPS, STOCKOUTS,
            ),
            "mean_stockout_rate",
        ),
        "country_quantity": retail(
            """SELECT country, CAST(sum(quantity) AS BIGINT) AS quantity, ln(CAST(sum(quantity) AS DOUBLE)) AS log_quantity
FROM base GROUP BY 1""",
            BASE,
        ),
        "country_stockout": retail("SELECT * FROM by_country", BASE, VELOCITY, GAPS, STOCKOUTS),
        "country_summary": retail("SELECT * FROM countries", BASE, COUNTRIES),
        "stockout_quantity_corr": rounded(
            retail(
                """SELECT CASE WHEN stddev_pop(stockout_rate) > 0 THEN corr(stockout_rate, CAST(total_quantity AS DOUBLE)) END
  AS correlation
FROM by_country JOIN countries USING (country)""",
                BASE, VELOCITY, GAPS, STOCKOUTS, COUNTRIES,
            ),
            "correlation",
        ),
        "top_items": retail("SELECT * FROM items ORDER BY quantity DESC, stock_code LIMIT 10", BASE, items),
        "underperforming_items": retail(
            "SELECT * FROM items WHERE quantity < (SELECT quantile_cont(quantity, 0.25) FROM items)", BASE, items
        ),
        "customer_value": retail(
            """SELECT customer_id, CAST(sum(CAST(total_price AS DECIMAL(18, 2))) AS DOUBLE) AS total_spending,
  count(*) AS frequency FROM base WHERE customer_id IS NOT NULL GROUP BY 1""",
            BASE,
        ),
        "orders_by_hour": retail("SELECT hour(invoice_ts) AS hour, count(*) AS lines FROM base GROUP BY 1", BASE),
        "orders_by_weekday": retail(
            """SELECT day_no, weekday, count(b.stock_code) AS lines
FROM (VALUES (0::BIGINT, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'),
  (5, 'Saturday'), (6, 'Sunday')) v(day_no, weekday)
LEFT JOIN base b ON isodow(b.invoice_date) - 1 = day_no GROUP BY ALL""",
            BASE,
        ),
        "orders_by_month": retail("SELECT month(invoice_ts) AS month, count(*) AS lines FROM base GROUP BY 1", BASE),
        "weekly_demand_stats": rounded(retail("SELECT * FROM demand", DEMAND), "demand_std"),
        "inventory_policy": rounded(
            retail(
                """SELECT *, avg_weekly_demand * 2 + safety_stock AS reorder_point
FROM (SELECT *, CASE WHEN total_demand > 0 THEN sqrt(2.0::DOUBLE * total_demand * 50 / 2) ELSE 0 END AS eoq,
    1.65::DOUBLE * demand_std * sqrt(2.0::DOUBLE) AS safety_stock
  FROM demand WHERE demand_std > 0 AND avg_weekly_demand > 0)""",
                DEMAND,
            ),
            "demand_std", "eoq", "safety_stock", "reorder_point",
        ),
        "weekly_series": retail("SELECT * FROM series", DEMAND, SERIES),
        "demand_forecast": rounded(
            retail(
                """SELECT stock_code, CAST(week_end AS DATE) AS week_end, greatest(level, 0) AS forecast,
  greatest(level - 1.28 * sigma, 0) AS lower, greatest(level + 1.28 * sigma, 0) AS upper FROM leveled_forecast""",
                DEMAND, SERIES, FORECAST,
            ),
            "forecast", "lower", "upper",
            digits=4,
        ),
    }


PRICED = """
sold AS (
  SELECT description, quantity, paid_price AS unit_price FROM retail
  WHERE quantity > 0 AND paid_price > 0 AND description IS NOT NULL
),
priced AS (SELECT * FROM sold QUALIFY count(*) OVER (PARTITION BY description) >= 10),
points AS (SELECT description, unit_price, CAST(sum(quantity) AS BIGINT) AS quantity FROM priced GROUP BY ALL)"""
MARKET = """
steps AS (
  SELECT description, abs(
    (CAST(quantity AS DOUBLE) / lag(CAST(quantity AS DOUBLE)) OVER w - 1)
    / NULLIF(unit_price / lag(unit_price) OVER w - 1, 0)) AS elasticity
  FROM points WINDOW w AS (PARTITION BY description ORDER BY unit_price)
),
elastic AS (SELECT description, avg(elasticity) AS price_elasticity FROM steps WHERE elasticity < 10 GROUP BY 1),
summary AS (
  SELECT description, CAST(sum(quantity) AS BIGINT) AS total_quantity,
    CAST(sum(CAST(unit_price AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS avg_unit_price
  FROM priced GROUP BY 1
),
market AS (SELECT * FROM elastic LEFT JOIN summary USING (description)),
bounds AS (
  SELECT quantile_cont(total_quantity, 0.33) AS low, quantile_cont(total_quantity, 0.66) AS high,
    median(total_quantity) AS middle FROM market
),
scored AS (
  SELECT m.*, CASE WHEN total_quantity < low THEN 'Low' WHEN total_quantity < high THEN 'Medium' ELSE 'High' END
      AS demand_category,
    CASE WHEN price_elasticity < 1 THEN 0 WHEN price_elasticity = 1 THEN 1 ELSE 2 END
      + CASE WHEN total_quantity < middle THEN 0 WHEN total_quantity = middle THEN 1 ELSE 2 END AS score
  FROM market m, bounds
),
judged AS (
  SELECT * EXCLUDE (score), CASE WHEN score <= 1 THEN 'Low' WHEN score = 2 THEN 'Medium' ELSE 'High' END AS competition
  FROM scored
)"""


def _pricing() -> dict[str, str]:
    return {
        "pricing_base": retail("SELECT description, quantity, unit_price FROM priced", PRICED),
        "price_points": retail("SELECT * FROM points", PRICED),
        "price_elasticity": rounded(retail("SELECT * FROM elastic", PRICED, MARKET), "price_elasticity"),
        "product_summary": rounded(retail("SELECT * FROM summary", PRICED, MARKET), "avg_unit_price"),
        "demand_category": retail(
            "SELECT description, total_quantity, demand_category FROM judged", PRICED, MARKET
        ),
        "competition": retail("SELECT description, competition FROM judged", PRICED, MARKET),
        "adjusted_price": rounded(
            retail(
                """SELECT *, least(avg_unit_price * (1 + price_elasticity * CAST(CASE demand_category || competition
    WHEN 'HighHigh' THEN -0.05 WHEN 'HighMedium' THEN 0.05 WHEN 'HighLow' THEN 0.10
    WHEN 'MediumMedium' THEN 0.03 WHEN 'MediumLow' THEN 0.05
    WHEN 'LowHigh' THEN -0.10 WHEN 'LowMedium' THEN -0.05 ELSE 0 END AS DOUBLE)),
  avg_unit_price * 1.2) AS adjusted_price FROM judged""",
                PRICED,
                MARKET,
            ),
            "price_elasticity",
            "avg_unit_price",
            "adjusted_price",
        ),
    }


BEHAVIOR = """
behavior AS (
  SELECT l.visitor AS users, s.visit_number, l.visit_id, l.date, CAST(floor(start_seconds) AS BIGINT) AS start_time, action, transaction_id,
    transaction_revenue / 1e6 AS transaction_revenue, hit_count AS num_hits, pageviews, time_on_site,
    CAST(COALESCE(session_quality, -1) AS BIGINT) AS session_quality, revenue / 1e6 AS totals_revenue,
    COALESCE(transactions, 0) AS transactions, product_price / 1e6 AS price, l.channel AS medium, l.continent,
    l.sub_continent AS subcontinent, l.country, l.region, split_part(blank_path, '/', 1) AS main_category,
    COALESCE(NULLIF(split_part(blank_path, '/', 2), ''), 'Other') AS sub_category,
    COALESCE(NULLIF(split_part(blank_path, '/', 3), ''), 'Other') AS subsub_category
  FROM leveled l JOIN sessions s ON s.user_id = l.user_id AND s.day = l.day
)"""
FEATURES = """
features AS (
  SELECT users, visit_id, transaction_id, visit_number, COALESCE(time_on_site, 0) AS time_on_site,
    COALESCE(pageviews, 0) AS pageviews, session_quality, COALESCE(totals_revenue, 0.0) AS totals_revenue,
    transactions, price, action, continent, COALESCE(NULLIF(main_category, ''), 'Other') AS main_category,
    month(strptime(date, '%Y%m%d')) AS month
  FROM behavior
)"""


def _behavior_csv() -> dict[str, str]:
    return {
        "csv_accepted_visits": levels(
            """SELECT users, visit_id, CAST(strptime(date, '%Y%m%d') AS DATE) AS visit_date,
  make_timestamp(start_time * 1000000) AS visit_start, count(*) AS rows, CAST(sum(round(price * 1000000)) AS BIGINT) AS price_micros
FROM behavior WHERE visit_id % 97 <> 13 AND visit_id % 101 <> 7 GROUP BY ALL""",
            BEHAVIOR,
        ),
        "csv_refused_rows": levels(
            """SELECT CASE WHEN visit_id % 97 = 13 THEN 'bad date' ELSE 'bad start_time' END AS reason, count(*) AS rows
FROM behavior WHERE visit_id % 97 = 13 OR visit_id % 101 = 7 GROUP BY ALL""",
            BEHAVIOR,
        ),
    }


def _cleaning() -> dict[str, str]:
    raw = ["invoice_no", "stock_code", "description", "quantity", "unit_price", "customer_id", "country", "invoice_ts"]

    def nulls(column):
        return f"""SELECT '{column}' AS "column", count(*) - count({column}) AS nulls, count(*) AS rows FROM retail"""

    def summary(column):
        return f"""SELECT '{column}' AS "column", count({column}) AS count, avg({column}) AS mean,
  stddev_samp({column}) AS std, CAST(min({column}) AS DOUBLE) AS min,
  CAST(quantile_cont({column}, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont({column}, 0.5) AS DOUBLE) AS median,
  CAST(quantile_cont({column}, 0.75) AS DOUBLE) AS q75, CAST(max({column}) AS DOUBLE) AS max FROM retail"""

    z = ["visit_number", "time_on_site", "pageviews", "session_quality", "totals_revenue", "price"]
    scores = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in z)

    def levels_of(feature):
        return f"""SELECT '{feature}' AS feature, {feature} AS level, count(*) AS rows FROM features
WHERE {feature} <> (SELECT min({feature}) FROM features) GROUP BY ALL"""

    listing = "split(p_type || '|' || p_brand || '|' || replace(p_name, ' ', '|'), '|')"
    depth = ", ".join(f"{listing}[{i}] AS category_{i}" for i in range(1, 8))
    return {
        "clean_retail": retail(
            """SELECT DISTINCT invoice_no, CASE stock_code WHEN '40' THEN 'POST' ELSE stock_code END AS stock_code,
  CASE description WHEN 'old plate' THEN 'POSTAGE' ELSE description END AS description, quantity, unit_price, customer_id,
  CASE country WHEN 'NATION_1' THEN 'Ireland' WHEN 'NATION_2' THEN 'South Africa' ELSE country END AS country,
  invoice_date, strftime(invoice_ts, '%H:%M:%S') AS invoice_time, total_price
FROM retail
WHERE customer_id IS DISTINCT FROM 15 AND (invoice_no LIKE 'C%' OR quantity >= 0)
  AND NOT (customer_id IS NULL AND unit_price = 0) AND unit_price <> 905.0
  AND stock_code NOT IN ('10', '20', '30') AND invoice_no NOT IN ('100', 'C101')"""
        ),
        "retail_outliers": retail(
            f"""SELECT {", ".join(raw[:5])}, COALESCE(customer_id, 0) AS customer_id, country, invoice_ts
FROM kept WHERE unit_price <> (SELECT min(unit_price) FROM kept)""",
            """
kept AS (SELECT * FROM retail WHERE description <> 'old plate' AND quantity NOT IN (-49, 49))""",
        ),
        "clean_listings": f"""SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name,
  round(p_retailprice - p_size, 2) AS discounted_price, p_retailprice AS actual_price,
  p_size / 100.0::DOUBLE AS discount_percentage, CAST((p_size % 5) || '.' || (p_size % 10) AS DOUBLE) AS rating,
  CAST(p_size AS BIGINT) * 1000 + p_size * 11 AS rating_count, {depth}
FROM part WHERE p_size <> 7 AND p_size <> 9""",
        "clean_behavior": levels("SELECT * FROM behavior", BEHAVIOR),
        "profile_null_counts": retail("\nUNION ALL ".join(nulls(c) for c in raw)),
        "profile_countries": retail("SELECT country, count(*) AS rows FROM retail GROUP BY 1"),
        "profile_describe": rounded(
            retail(summary("quantity") + "\nUNION ALL " + summary("unit_price")), "mean", "std"
        ),
        "profile_date_span": retail(
            """SELECT min(invoice_date) AS first, max(invoice_date) AS last,
  date_diff('day', min(invoice_date), max(invoice_date)) AS days FROM retail"""
        ),
        "profile_currency": "SELECT '₹' AS first_character, count(*) AS rows FROM part",
        "feature_frame": levels("SELECT * FROM features", BEHAVIOR, FEATURES),
        "standardize": rounded(
            levels(f"SELECT * REPLACE ({scores}) FROM features", BEHAVIOR, FEATURES), *z
        ),
        "cyclical_month": rounded(
            levels(
                """SELECT month, sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos,
  count(*) AS rows FROM features GROUP BY ALL""",
                BEHAVIOR,
                FEATURES,
            ),
            "month_sin",
            "month_cos",
        ),
        "one_hot": levels(
            "\nUNION ALL ".join(levels_of(f) for f in ("main_category", "continent", "action")), BEHAVIOR, FEATURES
        ),
    }


def queries() -> dict[str, str]:
    return {**_retention_queries(), **_customers(), **_supply(), **_pricing(), **_cleaning(), **_behavior_csv()}
