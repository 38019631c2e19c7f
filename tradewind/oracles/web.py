"""SQL twins of the web jobs."""

from itertools import product

from .base import levels, products, rounded, web
from .retail import retention

LEVELS = "main_category, sub_category, subsub_category"

FUNNEL_ACTION = """CASE action WHEN '1' THEN 'Click through of product lists' WHEN '2' THEN 'Product detail views'
    WHEN '5' THEN 'Check out' WHEN '6' THEN 'Completed purchase' END"""

FUNNEL_CATEGORY = """CASE
    WHEN category LIKE '%Office%' OR category IN ('Notebooks & Journals', 'Writing') THEN 'Office'
    WHEN category LIKE '%Apparel%' OR category LIKE '%Wearables%' OR category LIKE '%Men%' THEN 'Apparel'
    WHEN category LIKE '%Bags%' OR category IN ('Backpacks', 'More Bags') THEN 'Bags'
    WHEN category LIKE '%Brand%' OR category IN ('Apple', 'YouTube', 'Waze', 'Google') THEN 'Brands'
    WHEN category LIKE '%Drinkware%' OR category LIKE '%Fun%' OR category IN
      ('Mugs', 'Fruit Games', 'Housewares', 'Headgear', 'Headwear', 'Tumblers') THEN 'Accessories'
    WHEN category LIKE '%Lifestyle%' THEN 'Lifestyle'
    WHEN category LIKE '%Electronics%' THEN 'Electronics'
    WHEN category IN ('Home', '${escCatTitle}', '(not set)', '${productitem.product.origCatName}') THEN 'Unavailable'
    WHEN category LIKE '%Sale%' THEN 'Sale'
    ELSE 'Other' END"""

MERGED = """CASE WHEN main_or_other IN ('Brands', 'Limited Supply', 'Sale', 'Kids', 'Unavailable')
    THEN 'Other' ELSE main_or_other END"""

# Product rows of visits that have a transaction.
SOLD = """
sold AS (
  SELECT l.*, s.transactions AS session_transactions
  FROM leveled l JOIN sessions s ON s.user_id = l.user_id AND s.day = l.day
)"""

WEB_ORDERS = """
paid AS (
  SELECT visitor AS customer_id, CAST(ts AS DATE) AS order_date, transaction_id AS order_id
  FROM hits WHERE transaction_revenue > 0
)"""

METRICS = """
metrics AS (
  SELECT visit_number, time_on_site, pageviews, hit_count AS num_hits,
    CAST(COALESCE(session_quality, {quality}) AS BIGINT) AS session_quality,
    COALESCE(revenue, 0) / 1e6 AS totals_revenue, COALESCE(transactions, 0) AS transactions
  FROM sessions
)"""

METRIC_NAMES = [
    "visit_number", "time_on_site", "pageviews", "num_hits", "session_quality", "totals_revenue", "transactions",
]

EVENT_FLAGS = """
flags AS (
  SELECT CAST(action AS INTEGER) AS action, product_price / 1e6 AS price,
    CASE WHEN is_impression THEN 1 ELSE 0 END AS impression, CASE WHEN is_click THEN 1 ELSE 0 END AS click
  FROM products
)"""

SUMS = "CAST(sum({0}) AS BIGINT)"


def total(column: str) -> str:
    return SUMS.format(column)


def correlations(names: list[str], source: str) -> str:
    cells = [
        f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN isfinite(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END AS correlation FROM {source}"
        for a, b in product(names, names)
    ]
    return "\nUNION ALL ".join(cells)


def sensitivity(tiers: str) -> str:
    return f"""SELECT visitor AS full_visitor_id, count(DISTINCT transaction_id) AS purchase_count,
  CAST(sum(transaction_revenue) AS DOUBLE) / NULLIF(count(transaction_revenue), 0) / 1e6 AS avg_order_value,
  {tiers} AS segment
FROM (SELECT *, CAST(sum(transaction_revenue) OVER (PARTITION BY visitor) AS DOUBLE)
    / NULLIF(count(transaction_revenue) OVER (PARTITION BY visitor), 0) / 1e6 AS aov FROM hits)
GROUP BY visitor, aov"""


FIVE = """CASE WHEN aov < 10 THEN 'Price-Sensitive' WHEN aov BETWEEN 10 AND 20 THEN 'Semi Price-Sensitive'
  WHEN aov BETWEEN 20 AND 50 THEN 'Medium Price-Sensitive'
  WHEN aov BETWEEN 50 AND 100 THEN 'Semi-Low Price-Sensitive' ELSE 'Low-Sensitivity' END"""
THREE = """CASE WHEN aov < 20 THEN 'Very Price-Sensitive' WHEN aov BETWEEN 20 AND 100 THEN 'Medium Price-Sensitive'
  ELSE 'Non Price-Sensitive' END"""


def _funnel() -> dict[str, str]:
    reached = """
reached AS (
  SELECT count(DISTINCT visitor) FILTER (action = '1') AS a1, count(DISTINCT visitor) FILTER (action = '2') AS a2,
    count(DISTINCT visitor) FILTER (action = '3') AS a3, count(DISTINCT visitor) FILTER (action = '4') AS a4,
    count(DISTINCT visitor) FILTER (action = '5') AS a5, count(DISTINCT visitor) FILTER (action = '6') AS a6
  FROM items
)"""
    return {
        "conversion_funnel": products(
            f"""SELECT {FUNNEL_ACTION} AS action, {FUNNEL_CATEGORY} AS category, count(visitor) AS users
FROM products WHERE action <> '0' AND action <> '3' AND action <> '4' GROUP BY ALL"""
        ),
        "funnel_rates": products(
            """SELECT 'Product List Clicks' AS step, CAST(a2 AS DOUBLE) / a1 * 100.0 AS rate FROM reached
UNION ALL SELECT 'Product Detail Views', CAST(a5 AS DOUBLE) / a2 * 100.0 FROM reached
UNION ALL SELECT 'Checkout', CAST(a6 AS DOUBLE) / a5 * 100.0 FROM reached
UNION ALL SELECT 'Cart Abandonment', CAST(a4 AS DOUBLE) / a3 * 100.0 FROM reached""",
            reached,
        ),
        "funnel_cumulative": rounded(
            products(
                """SELECT 'Product List Clicks' AS stage, CAST(100 AS DOUBLE) AS percent_left
UNION ALL SELECT 'Product Detail Views', 100.0 * a2 / a1 FROM reached
UNION ALL SELECT 'Checkout', 100.0 * a5 / a1 FROM reached
UNION ALL SELECT 'Completed Purchase', 100.0 * a6 / a1 FROM reached""",
                reached,
            ),
            "percent_left",
        ),
        "product_funnel": levels(
            f"""SELECT main_category, action, users,
  CASE WHEN before IS NULL OR (before = 0 AND users = 0) THEN 100.0
    ELSE round_even(CAST(users AS DOUBLE) / NULLIF(before, 0) * 100.0, 1) END AS percentage
FROM (
  SELECT g.main_category, g.action, COALESCE(n, 0) AS users,
    lag(COALESCE(n, 0)) OVER (PARTITION BY g.main_category ORDER BY g.stage) AS before
  FROM (SELECT * FROM (SELECT DISTINCT {MERGED} AS main_category FROM leveled WHERE action IN ('1', '2', '5', '6')),
    (VALUES ('Click through of product lists', 1), ('Product detail views', 2), ('Check out', 3),
      ('Completed purchase', 4)) v(action, stage)) g
  LEFT JOIN (SELECT {MERGED} AS main_category, {FUNNEL_ACTION} AS action, count(*) AS n
    FROM leveled WHERE action IN ('1', '2', '5', '6') GROUP BY ALL) c
    ON c.main_category = g.main_category AND c.action = g.action)"""
        ),
        "action_distribution": products(
            """SELECT CAST(action AS BIGINT) AS action, count(*) AS rows FROM products
WHERE action <> '0' GROUP BY ALL"""
        ),
        "stage_distribution": products(
            f"""SELECT {FUNNEL_ACTION} AS action, count(*) AS rows FROM products
WHERE action IN ('1', '2', '5', '6') GROUP BY ALL"""
        ),
    }


def _visitors() -> dict[str, str]:
    purchases = """SELECT visitor AS users, count(DISTINCT transaction_id) AS total_purchases,
  sum(transaction_revenue) / 1e6 AS total_revenue
FROM hits WHERE action = '6' GROUP BY ALL"""
    top = """SELECT visitor AS users, CAST(sum(COALESCE(pageviews, 0)) AS BIGINT) AS pageviews,
  CAST(sum(COALESCE(time_on_site, 0)) AS BIGINT) AS time_on_site, CAST(sum(transactions) AS BIGINT) AS transactions
FROM sessions GROUP BY ALL"""

    def summary(column):
        return f"""SELECT '{column}' AS "column", count({column}) AS count, avg({column}) AS mean,
  stddev_samp({column}) AS std, CAST(min({column}) AS DOUBLE) AS min,
  CAST(quantile_cont({column}, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont({column}, 0.5) AS DOUBLE) AS median,
  CAST(quantile_cont({column}, 0.75) AS DOUBLE) AS q75, CAST(max({column}) AS DOUBLE) AS max FROM buyers"""

    def histogram(tiers):
        return f"""
segments AS ({sensitivity(tiers)}),
spans AS (SELECT segment, min(avg_order_value) AS low, max(avg_order_value) AS high FROM segments GROUP BY 1)"""

    bins = """SELECT s.segment, CAST(least(floor(COALESCE((avg_order_value - low) / NULLIF(high - low, 0), 0.5) * 10), 9)
    AS BIGINT) AS bin, count(*) AS visitors
FROM segments s JOIN spans r ON s.segment = r.segment WHERE avg_order_value IS NOT NULL GROUP BY ALL"""
    return {
        "purchases_per_user": web(purchases),
        "purchases_per_user_describe": rounded(
            web(
                summary("total_purchases") + "\nUNION ALL " + summary("total_revenue"),
                f"\nbuyers AS ({purchases})",
            ),
            "mean",
            "std",
        ),
        "purchase_averages": web(
            """SELECT CASE WHEN p.visit_id IS NOT NULL THEN 'Purchase' ELSE 'No Purchase' END AS visit_type,
  avg(visit_number) AS average_visit_no, avg(time_on_site) AS avg_time, avg(pageviews) AS avg_pgviews
FROM sessions v LEFT JOIN (SELECT visitor, visit_id FROM hits WHERE action = '6') p
  ON v.visitor = p.visitor AND v.visit_id = p.visit_id GROUP BY 1"""
        ),
        "top_customers": web(top),
        "top_customers_10": web(top + " ORDER BY transactions DESC NULLS LAST, time_on_site DESC, pageviews DESC, users LIMIT 10"),
        "session_metrics": web("SELECT * FROM metrics", METRICS.format(quality=-1)),
        "nested_session_metrics": web("SELECT * FROM metrics", METRICS.format(quality=-1)),
        "nested_conversion_funnel": products(
            f"""SELECT {FUNNEL_ACTION} AS action, {FUNNEL_CATEGORY} AS category, count(visitor) AS users
FROM (SELECT visitor, hit.action, unnest(hit.categories) AS category FROM (SELECT visitor, unnest(hits) AS hit FROM folded))
WHERE action <> '0' AND action <> '3' AND action <> '4' GROUP BY ALL""",
            """
folded AS (
  SELECT visitor, day, list(struct_pack(action := action, categories := categories)) AS hits
  FROM (
    SELECT h.visitor, h.day, h.event_id, h.action, list(p.category) FILTER (p.event_id IS NOT NULL) AS categories
    FROM hits h LEFT JOIN products p ON p.event_id = h.event_id GROUP BY ALL)
  GROUP BY visitor, day
)""",
        ),
        "session_correlation": rounded(
            web(correlations(METRIC_NAMES, "metrics"), METRICS.format(quality=-1)), "correlation"
        ),
        "session_correlation_zero_quality": rounded(
            web(correlations(METRIC_NAMES, "metrics"), METRICS.format(quality=0)), "correlation"
        ),
        "product_event_correlation": rounded(
            products(correlations(["action", "price", "impression", "click"], "flags"), EVENT_FLAGS), "correlation"
        ),
        "price_sensitivity_5": web(sensitivity(FIVE)),
        "price_sensitivity_3": web(sensitivity(THREE)),
        "price_segment_counts_5": web(
            "SELECT segment, count(*) AS visitors FROM segments GROUP BY 1", f"\nsegments AS ({sensitivity(FIVE)})"
        ),
        "price_segment_counts_3": web(
            "SELECT segment, count(*) AS visitors FROM segments GROUP BY 1", f"\nsegments AS ({sensitivity(THREE)})"
        ),
        "order_value_histogram_5": web(bins, histogram(FIVE)),
        "order_value_histogram_3": web(bins, histogram(THREE)),
        "visitor_frequency": web(
            f"""SELECT CASE WHEN visit_number <= 1 THEN 'First-time' WHEN visit_number <= 5 THEN 'Occasional'
    ELSE 'Frequent' END AS visitor_category,
  CAST(sum(COALESCE(revenue, 0)) AS DOUBLE) / count(*) / 1e6 AS mean_revenue,
  CAST(sum(COALESCE(revenue, 0)) AS DOUBLE) / 1e6 AS total_revenue,
  CAST(sum(COALESCE(transactions, 0)) AS DOUBLE) / count(*) AS mean_transactions,
  {total("COALESCE(transactions, 0)")} AS total_transactions
FROM sessions GROUP BY 1"""
        ),
        "revenue_regression": rounded(
            web(
                """SELECT regr_slope(totals_revenue, transactions) AS slope,
  regr_intercept(totals_revenue, transactions) AS intercept FROM metrics""",
                METRICS.format(quality=-1),
            ),
            "slope",
            "intercept",
        ),
    }


def _marketing() -> dict[str, str]:
    def performance(key, transactions, pageviews, time_on_site):
        return f"""SELECT *, total_revenue / NULLIF(total_transactions, 0) AS avg_order_value,
  CAST(total_transactions AS DOUBLE) / total_sessions AS conversion_rate
FROM (SELECT {key}, count(DISTINCT visitor) AS total_users, count(*) AS total_sessions,
    {transactions} AS total_transactions, sum(revenue) / 1e6 AS total_revenue, avg({pageviews}) AS avg_pageviews,
    avg({time_on_site}) AS avg_time_on_site, avg(COALESCE(bounces, 0)) AS avg_bounces
  FROM sessions GROUP BY 1)"""

    raw_channels = f"""
raw AS (
  SELECT channel, category, {LEVELS}, count(DISTINCT visitor) AS total_users, count(*) AS total_sessions,
    count(DISTINCT transaction_id) AS total_transactions, {total("COALESCE(product_revenue, 0)")} AS amount
  FROM leveled GROUP BY ALL
)"""
    rollup = f"""
mains AS (
  SELECT channel, main_category, {total("total_users")} AS total_users, {total("total_sessions")} AS total_sessions,
    {total("total_transactions")} AS total_transactions, sum(amount) / 1e6 AS total_revenue
  FROM raw GROUP BY ALL
)"""
    daily = """
daily AS (
  SELECT campaign, strptime(date, '%Y%m%d')::DATE AS date,
    CAST(count(*) FILTER (visit_number <> 1) AS DOUBLE) / count(*) AS return_rate
  FROM sessions GROUP BY ALL
)"""
    engaged = """
engaged AS (SELECT campaign, pageviews, time_on_site FROM sessions WHERE pageviews IS NOT NULL AND time_on_site IS NOT NULL)"""

    def box(metric):
        quantiles = ", ".join(
            f"CAST(quantile_cont({metric}, {p}) AS DOUBLE) AS {n}"
            for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
        )
        return f"""SELECT campaign, '{metric}' AS metric, min({metric}) AS min, {quantiles}, max({metric}) AS max
FROM engaged GROUP BY 1"""

    return {
        "channel_conversion_rate": levels(
            f"""SELECT channel, {LEVELS}, visitors AS total_visitors, conversions AS total_conversions,
  CAST(conversions AS DOUBLE) / visitors * 100.0 AS conversion_rate
FROM (SELECT channel, category, {LEVELS}, count(DISTINCT visitor) AS visitors,
    count(*) FILTER (session_transactions > 0) AS conversions
  FROM sold WHERE date <= '20240125' GROUP BY ALL)""",
            SOLD,
        ),
        "channel_performance": web(performance("channel", total("transactions"), "pageviews", "time_on_site")),
        "campaign_performance": web(
            performance(
                "campaign", f"COALESCE({total('transactions')}, 0)", "COALESCE(pageviews, 0)", "COALESCE(time_on_site, 0)"
            )
        ),
        "campaign_revenue_share": web(
            """SELECT CASE WHEN campaign = '(not set)' THEN 'Non-campaign' ELSE 'Campaign' END AS label,
  sum(COALESCE(revenue, 0)) / 1e6 AS revenue,
  CAST(sum(COALESCE(revenue, 0)) AS DOUBLE) / (SELECT CAST(sum(revenue) AS DOUBLE) FROM sessions) * 100.0 AS percentage
FROM sessions GROUP BY 1"""
        ),
        "campaigns_with_revenue": web(
            """SELECT campaign, sum(revenue) / 1e6 AS revenue, CAST(sum(revenue) AS DOUBLE) / (SELECT
    CAST(sum(revenue) AS DOUBLE) FROM sessions WHERE campaign <> '(not set)') * 100.0 AS percentage
FROM sessions WHERE campaign <> '(not set)' GROUP BY 1 HAVING sum(revenue) > 0"""
        ),
        "campaign_engagement": web("SELECT * FROM engaged", engaged),
        "campaign_engagement_boxplot": web(box("pageviews") + "\nUNION ALL " + box("time_on_site"), engaged),
        "return_rate_daily": web("SELECT * FROM daily", daily),
        "return_rate_monthly": rounded(
            web(
                """SELECT campaign, strftime(date, '%Y-%m') AS month, avg(return_rate) AS return_rate
FROM daily GROUP BY ALL""",
                daily,
            ),
            "return_rate",
        ),
        "new_vs_returning": web(
            """SELECT campaign, new_customers, returning_customers,
  CASE WHEN returning_customers = 0 THEN 0 ELSE CAST(new_customers AS DOUBLE) / returning_customers END AS ratio
FROM (
  SELECT campaign, count(DISTINCT t.visitor) FILTER (t.date = f.first_day) AS new_customers,
    count(DISTINCT t.visitor) FILTER (t.date <> f.first_day) AS returning_customers
  FROM sessions t JOIN (SELECT visitor, min(date) AS first_day FROM sessions GROUP BY 1) f ON t.visitor = f.visitor
  WHERE campaign IS NOT NULL AND campaign <> '(not set)' GROUP BY 1)"""
        ),
        "campaign_info": web(
            """SELECT m.*, first_visit_date, last_visit_date
FROM (SELECT campaign, channel, count(DISTINCT visitor) AS user_count, sum(revenue) / 1e6 AS total_revenue
  FROM sessions WHERE campaign <> '(not set)' GROUP BY ALL) m
JOIN (SELECT campaign, min(strptime(date, '%Y%m%d')::DATE) AS first_visit_date,
  max(strptime(date, '%Y%m%d')::DATE) AS last_visit_date FROM sessions GROUP BY 1) d ON m.campaign = d.campaign"""
        ),
        "channel_category_metrics": levels(
            f"""SELECT channel, {LEVELS}, total_users, total_sessions, total_transactions,
  amount / 1e6 AS total_revenue FROM raw""",
            raw_channels,
        ),
        "channel_category_rollup": levels("SELECT * FROM mains", raw_channels, rollup),
        "channel_roi": rounded(
            levels(
                """SELECT channel, revenue, cost, (revenue - cost) / cost AS roi
FROM (
  SELECT channel, sum(total_revenue) AS revenue,
    CASE channel WHEN 'organic' THEN 84000.0
      WHEN 'cpc' THEN sum(total_sessions * rate)
      WHEN 'affiliate' THEN sum(total_revenue * commission) END AS cost
  FROM (SELECT *, CASE main_category WHEN 'Accessories' THEN 2.92::DOUBLE WHEN 'Apparel' THEN 2.92 WHEN 'Office' THEN 3.0
      WHEN 'Other' THEN 2.8 WHEN 'SMALL' THEN 2.5 WHEN 'MEDIUM' THEN 2.5 WHEN 'LARGE' THEN 2.5
      WHEN 'STANDARD' THEN 2.5 WHEN 'ECONOMY' THEN 2.5 END AS rate,
      CASE main_category WHEN 'Accessories' THEN 0.1::DOUBLE WHEN 'Apparel' THEN 0.1 WHEN 'Office' THEN 0.06 ELSE 0.05 END AS commission
    FROM mains)
  GROUP BY 1)""",
                raw_channels,
                rollup,
            ),
            "revenue",
            "cost",
            "roi",
        ),
    }


def _sales() -> dict[str, str]:
    days = f"""
days AS (
  SELECT strftime(ts, '%Y-%m') AS month, date, category, {LEVELS}, {total("product_quantity")} AS sales_qty,
    {total("COALESCE(product_revenue, 0)")} AS amount
  FROM leveled WHERE action = '6' GROUP BY ALL
)"""
    raw = f"""
raw AS (
  SELECT category, {LEVELS}, count(DISTINCT visitor || CAST(visit_id AS VARCHAR)) AS transaction_count,
    {total("COALESCE(product_revenue, 0)")} AS amount
  FROM sold WHERE session_transactions IS NOT NULL GROUP BY ALL
)"""

    def share_level(depth, columns):
        names = ["main_category", "sub_category", "subsub_category"]
        shown = ", ".join(n if n in columns else f"NULL AS {n}" for n in names)
        return f"""SELECT CAST({depth} AS BIGINT) AS depth, {shown}, {total("transaction_count")} AS transaction_count,
  sum(amount) / 1e6 AS revenue,
  CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM raw) * 100.0 AS revenue_percent,
  CAST(sum(transaction_count) AS DOUBLE) / (SELECT CAST(sum(transaction_count) AS DOUBLE) FROM raw) * 100.0
    AS transaction_percent FROM raw GROUP BY {", ".join(columns)}"""

    def top5(value, shown):
        return f"""SELECT main_category, {shown},
  CAST(v AS DOUBLE) / (SELECT CAST(sum({value}) AS DOUBLE) FROM raw) * 100.0 AS percentage
FROM (
  SELECT CASE WHEN r <= 5 THEN main_category ELSE 'Other' END AS main_category, {total("v")} AS v
  FROM (SELECT *, row_number() OVER (ORDER BY main_category IN ('Unavailable', 'Other'), v DESC, main_category) AS r
      FROM (SELECT main_category, sum({value}) AS v FROM raw GROUP BY 1)
      WHERE main_category NOT IN ('Unavailable', 'Other')
    UNION ALL SELECT main_category, sum({value}), 99 FROM raw WHERE main_category IN ('Unavailable', 'Other') GROUP BY 1)
  GROUP BY 1)"""

    places = f"""
places AS (
  SELECT continent, sub_continent AS subcontinent, country, {total("revenue")} AS amount,
    {total("transactions")} AS total_transactions
  FROM sessions GROUP BY ALL
)"""
    continents = f"""
continents AS (
  SELECT continent, count(DISTINCT transaction_id) AS transactions, {total("COALESCE(product_revenue, 0)")} AS amount
  FROM products GROUP BY 1
),
shares AS (
  SELECT *, CAST(transactions AS DOUBLE) / (SELECT CAST(sum(transactions) AS DOUBLE) FROM continents) * 100.0
      AS transaction_percent,
    CAST(amount AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM continents) * 100.0 AS revenue_percent
  FROM continents
)"""
    america = f"""
america AS (SELECT * FROM leveled WHERE continent = 'AMERICA'),
countries AS (
  SELECT sub_continent, country, {total("COALESCE(product_revenue, 0)")} AS amount FROM america GROUP BY ALL
),
top_sub AS (SELECT sub_continent FROM countries GROUP BY 1 ORDER BY sum(amount) DESC, sub_continent LIMIT 1),
top_countries AS (SELECT * FROM countries WHERE sub_continent IN (SELECT sub_continent FROM top_sub))"""
    mains = f"""
mains AS (SELECT main_or_other AS main_category, {total("COALESCE(product_revenue, 0)")} AS amount FROM america GROUP BY 1)"""

    def top_categories(base):
        return levels(
            f"""SELECT main_category, amount / 1e6 AS revenue,
  CAST(amount AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM {base}) * 100.0 AS revenue_percent
FROM mains ORDER BY amount DESC, main_category LIMIT 6""",
            america,
            mains,
        )

    return {
        "daily_revenue": web(
            """SELECT strptime(date, '%Y%m%d')::DATE AS date, sum(revenue) / 1e6 AS total_revenue
FROM sessions GROUP BY 1"""
        ),
        "monthly_revenue": web(
            """SELECT CAST(date_trunc('month', strptime(date, '%Y%m%d')) AS DATE) AS month,
  sum(COALESCE(revenue, 0)) / 1e6 AS total_revenue FROM sessions GROUP BY 1"""
        ),
        "product_daily_revenue": products(
            """SELECT CAST(ts AS DATE) AS date, sum(COALESCE(product_revenue, 0)) / 1e6 AS daily_revenue
FROM products GROUP BY 1"""
        ),
        "product_monthly_revenue": products(
            """SELECT CAST(date_trunc('month', ts) AS DATE) AS month,
  sum(COALESCE(product_revenue, 0)) / 1e6 AS monthly_revenue FROM products GROUP BY 1"""
        ),
        "sales_by_category_day": levels(
            f"SELECT month, {LEVELS}, sales_qty, amount / 1e6 AS revenue FROM days", days
        ),
        "sales_by_category_month": levels(
            f"""SELECT month, {LEVELS}, {total("sales_qty")} AS total_sales, sum(amount) / 1e6 AS total_revenue,
  avg(sales_qty) AS avg_sales, CAST(sum(amount) AS DOUBLE) / count(*) / 1e6 AS avg_revenue FROM days GROUP BY ALL""",
            days,
        ),
        "popular_categories": levels(
            f"""SELECT month, {LEVELS}, sales_qty, amount / 1e6 AS revenue
FROM days QUALIFY row_number() OVER (PARTITION BY month ORDER BY amount DESC, sales_qty DESC, {LEVELS}) <= 3""",
            days,
        ),
        "sales_by_category": levels(
            f"""SELECT {LEVELS}, sales_qty, revenue FROM (
  SELECT category, {LEVELS}, {total("product_quantity")} AS sales_qty,
    sum(COALESCE(product_revenue, 0)) / 1e6 AS revenue
  FROM sold WHERE session_transactions IS NOT NULL GROUP BY ALL)""",
            SOLD,
        ),
        "category_transactions": levels(
            f"SELECT category, {LEVELS}, transaction_count, amount / 1e6 AS revenue FROM raw", SOLD, raw
        ),
        "category_share_levels": levels(
            share_level(1, ["main_category"])
            + "\nUNION ALL "
            + share_level(2, ["main_category", "sub_category"])
            + "\nUNION ALL "
            + share_level(3, ["main_category", "sub_category", "subsub_category"]),
            SOLD,
            raw,
        ),
        "top5_other_revenue": levels(top5("amount", "v / 1e6 AS revenue"), SOLD, raw),
        "top5_other_transactions": levels(top5("transaction_count", "v AS transaction_count"), SOLD, raw),
        "product_preference": levels(
            f"""SELECT main_category, product_transaction, amount / 1e6 AS product_revenue,
  CAST(product_transaction AS DOUBLE) / (SELECT CAST(sum(product_transaction) AS DOUBLE) FROM m) * 100.0
    AS transaction_percent,
  CAST(amount AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM m) * 100.0 AS revenue_percent
FROM m""",
            f"""
r AS (SELECT category, main_or_other, count(DISTINCT transaction_id) AS t,
  sum(COALESCE(product_revenue, 0)) AS a FROM leveled GROUP BY ALL),
m AS (SELECT main_or_other AS main_category, {total("t")} AS product_transaction, {total("a")} AS amount
  FROM r GROUP BY 1)""",
        ),
        "kpi_overview": products(
            """SELECT count(DISTINCT visitor) AS total_users, count(DISTINCT visit_id) AS total_sessions,
  count(DISTINCT transaction_id) AS total_transactions, sum(COALESCE(product_revenue, 0)) / 1e6 AS total_revenue,
  count(DISTINCT CASE WHEN COALESCE(product_revenue, 0) > 0 THEN visitor END) AS users_with_purchase FROM products"""
        ),
        "revenue_by_region": web(
            "SELECT continent, subcontinent, country, amount / 1e6 AS total_revenue, total_transactions FROM places",
            places,
        ),
        "revenue_by_continent": web(
            "SELECT continent, COALESCE(sum(revenue), 0) / 1e6 AS total_revenue FROM sessions GROUP BY 1"
        ),
        "top_countries_by_revenue": web(
            """SELECT country, amount / 1e6 AS total_revenue,
  CAST(amount AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM places) * 100.0 AS revenue_percent
FROM places ORDER BY amount DESC NULLS LAST, country, subcontinent LIMIT 10""",
            places,
        ),
        "top_countries_by_transactions": web(
            """SELECT country, total_transactions, CAST(total_transactions AS DOUBLE) /
  (SELECT CAST(sum(total_transactions) AS DOUBLE) FROM places) * 100.0 AS transaction_percent
FROM places ORDER BY total_transactions DESC NULLS LAST, country, subcontinent LIMIT 10""",
            places,
        ),
        "continent_share": products(
            "SELECT continent, transactions, amount / 1e6 AS revenue, transaction_percent, revenue_percent FROM shares",
            continents,
        ),
        "continent_vs_other": rounded(
            products(
                f"""SELECT CASE WHEN continent = 'AMERICA' THEN continent ELSE 'Other' END AS continent,
  {total("transactions")} AS transactions, sum(amount) / 1e6 AS revenue,
  sum(transaction_percent) AS transaction_percent, sum(revenue_percent) AS revenue_percent FROM shares GROUP BY 1""",
                continents,
            ),
            "transaction_percent",
            "revenue_percent",
        ),
        "subcontinent_rank": levels(
            """SELECT sub_continent, sum(amount) / 1e6 AS revenue,
  CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM countries) * 100.0 AS revenue_percent
FROM countries GROUP BY 1""",
            america,
        ),
        "country_rank_in_top": levels(
            """SELECT country, amount / 1e6 AS revenue,
  CAST(amount AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM top_countries) * 100.0 AS revenue_percent
FROM top_countries""",
            america,
        ),
        "top_categories": top_categories("top_countries"),
        "top_categories_of_total": top_categories("mains"),
        "region_share_in_category": levels(
            """SELECT main_category, position, region, amount / 1e6 AS revenue, percentage FROM (
  SELECT *, CAST(amount AS DOUBLE) / NULLIF(sum(amount) OVER (PARTITION BY main_category), 0) * 100.0 AS percentage,
    row_number() OVER (PARTITION BY main_category ORDER BY amount DESC, region) AS position
  FROM (SELECT main_or_other AS main_category, region, sum(COALESCE(product_revenue, 0)) AS amount FROM america
    WHERE country = 'NATION_1' AND main_or_other IN ('Apparel', 'Office', 'Accessories', 'Bags', 'Electronics')
    GROUP BY ALL)) WHERE position <= 5""",
            america,
        ),
        "category_monthly_trend": levels(
            """SELECT month, main_category, amount / 1e6 AS revenue FROM m
WHERE main_category <> 'Unavailable' AND main_category IN
  (SELECT main_category FROM m GROUP BY 1 ORDER BY sum(amount) DESC, main_category LIMIT 6)""",
            america,
            """
m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, main_category,
  sum(COALESCE(product_revenue, 0)) AS amount FROM america GROUP BY ALL)""",
        ),
        "clean_categories": levels(
            f"SELECT category, {LEVELS} FROM leveled GROUP BY ALL"
        ),
    }


def _web_retention() -> dict[str, str]:
    found = {}
    for period in ("month", "week"):
        for name, sql in retention(web, WEB_ORDERS, period).items():
            found[f"web_{name}_{period}"] = sql
    return found


def queries() -> dict[str, str]:
    return {**_funnel(), **_visitors(), **_marketing(), **_sales(), **_web_retention()}
