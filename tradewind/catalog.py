"""Registry: query name -> callable that runs a job on the tables of a folder.

The callables only wire sources to jobs and pass the parameters that suit the tables. Columns whose
floating sums depend on the order of the rows are rounded here, so that results can be compared.
"""

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed_values as fixed
from .functions.categories import category_levels
from .operators import eager, quantiles
from .operators import retention as periods
from .operators.lineage import shared_folder
from .plans import cleaning, clusters, funnel, marketing, pricing, retail_customers, retention, sales
from .plans import segments, supply, visitors
from .sources import files
from .sources.listings import listings
from .sources.retail import LINE_ORDER, retail_invoices, retail_items, retail_lines, spending_lines
from .sources.web import event_hits, event_products, event_sessions, flat_hits, flat_products, flat_sessions
from .sources.web import fold_sessions

Query = Callable[[SparkSession, str], DataFrame]

LAST_QUARTER = date(2001, 7, 1)
CONTINENT = "AMERICA"
COUNTRY = "NATION_1"
SHORT_RANGE_END = "20240125"
# Part types are main categories too; PROMO is left without a rate.
CLICK_RATES = fixed.COST_PER_CLICK | dict.fromkeys(["SMALL", "MEDIUM", "LARGE", "STANDARD", "ECONOMY"], 2.5)


# No customer of these tables comes back for a fifth of their items.
LOYALTY = 0.04
# Items have few lines here, months apart; the words occur in lower case.
STOCKOUT_RULES = [("High", 10, 30), ("Medium", 15, 60), ("Low", 20, 90)]
COLD, OUTDOOR = ["cold", "old"], ["hot", "red"]
RETAIL_RULES = {
    "dropped_customers": [15],
    "country_aliases": {"NATION_1": "Ireland", "NATION_2": "South Africa"},
    "bad_prices": [905.0],
    "dropped_stock_codes": ["10", "20", "30"],
    "dropped_invoices": ["100", "C101"],
    "stock_aliases": {"40": "POST"},
    "description_aliases": {"old plate": "POSTAGE"},
}
OUTLIER_DESCRIPTIONS, OUTLIER_QUANTITIES = ["old plate"], [-49, 49]


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    # Adding zero turns a negative zero into zero.
    return frame.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


# --- inputs ----------------------------------------------------------------------


def _orders(spark, folder):
    return retention.retail_orders(retail_invoices(spark, folder))


def _hits(spark, folder):
    return event_hits(spark, folder)


def _products(spark, folder):
    return event_products(event_hits(spark, folder), spark, folder)


def _plain_products(spark, folder):
    """Products without category and price."""
    return event_products(event_hits(spark, folder), spark, folder, catalog=False)


def _sold_products(spark, folder, last_day=None):
    """Products with the totals of their session."""
    until = {"last_day": last_day} if last_day else {}
    return event_products(event_hits(spark, folder, session_totals=True, **until), spark, folder)


# --- jobs ------------------------------------------------------------------------


def _retention() -> dict[str, Query]:
    jobs = {}
    sources = [("", _orders, ("month", "quarter")), ("web_", lambda s, d: retention.web_orders(_hits(s, d)), ("month", "week"))]
    operators = {
        "period_activity": periods.period_activity,
        "customer_period_purchases": periods.customer_periods,
        "churned_customers": periods.churned_customers,
        "churn_rate": periods.churn_rate,
        "cohort_retention": periods.cohort_retention,
    }
    for prefix, source, grains in sources:
        for grain in grains:
            for name, job in operators.items():
                jobs[f"{prefix}{name}_{grain}"] = lambda s, d, job=job, src=source, g=grain: job(src(s, d), g)
    jobs["customer_period_matrix_quarter"] = lambda s, d: periods.customer_period_matrix(_orders(s, d), "quarter")
    jobs["churned_customers_in_quarter"] = lambda s, d: periods.churned_customers(_orders(s, d), "quarter", LAST_QUARTER)
    jobs["monthly_churn_by_country"] = lambda s, d: retention.monthly_churn_by_country(
        retail_lines(s, d, "customer_id", "invoice_date", "country", *LINE_ORDER)
    )
    return jobs


def _funnel() -> dict[str, Query]:
    return {
        "clean_categories": lambda s, d: _products(s, d).select("category").distinct().withColumns(
            category_levels(F.col("category"))
        ),
        "conversion_funnel": lambda s, d: funnel.conversion_funnel(_products(s, d)),
        "funnel_rates": lambda s, d: funnel.funnel_rates(_plain_products(s, d)),
        "funnel_cumulative": lambda s, d: rounded(funnel.funnel_cumulative(_plain_products(s, d)), "percent_left"),
        "product_funnel": lambda s, d: funnel.product_funnel(_products(s, d)),
        "action_distribution": lambda s, d: funnel.action_distribution(_plain_products(s, d)),
        "stage_distribution": lambda s, d: funnel.stage_distribution(_plain_products(s, d)),
    }


def _visitors() -> dict[str, Query]:
    v = visitors

    def segments(tiers):
        return lambda s, d: v.price_sensitivity(_hits(s, d), tiers)

    five, three = segments(fixed.SENSITIVITY_FIVE), segments(fixed.SENSITIVITY_THREE)
    return {
        "purchases_per_user": lambda s, d: v.purchases_per_user(_hits(s, d)),
        "purchases_per_user_describe": lambda s, d: rounded(
            quantiles.describe(v.purchases_per_user(_hits(s, d)), ["total_purchases", "total_revenue"]), "mean", "std"
        ),
        "purchase_averages": lambda s, d: v.purchase_averages(event_sessions(s, d), _hits(s, d)),
        "top_customers": lambda s, d: v.top_customers(event_sessions(s, d)),
        "top_customers_10": lambda s, d: v.top_customers(event_sessions(s, d), 10),
        "session_metrics": lambda s, d: v.session_metrics(event_sessions(s, d)),
        "session_correlation": lambda s, d: rounded(v.session_correlation(event_sessions(s, d)), "correlation"),
        "session_correlation_zero_quality": lambda s, d: rounded(
            v.session_correlation(event_sessions(s, d), missing_quality=0), "correlation"
        ),
        "product_event_correlation": lambda s, d: rounded(v.product_event_correlation(_products(s, d)), "correlation"),
        "price_sensitivity_5": five,
        "price_sensitivity_3": three,
        "price_segment_counts_5": lambda s, d: v.segment_counts(five(s, d)),
        "price_segment_counts_3": lambda s, d: v.segment_counts(three(s, d)),
        "order_value_histogram_5": lambda s, d: v.order_value_histogram(five(s, d)),
        "order_value_histogram_3": lambda s, d: v.order_value_histogram(three(s, d)),
        "visitor_frequency": lambda s, d: v.visitor_frequency(event_sessions(s, d)),
        "revenue_regression": lambda s, d: rounded(v.revenue_regression(event_sessions(s, d)), "slope", "intercept"),
    }


def _marketing() -> dict[str, Query]:
    m = marketing
    jobs = {
        "channel_conversion_rate": lambda s, d: m.channel_conversion_rate(_sold_products(s, d, SHORT_RANGE_END)),
        "channel_category_metrics": lambda s, d: m.channel_category_metrics(_products(s, d)),
        "channel_category_rollup": lambda s, d: m.channel_category_rollup(_products(s, d)),
        "channel_roi": lambda s, d: rounded(m.channel_roi(_products(s, d), CLICK_RATES), "revenue", "cost", "roi"),
        "return_rate_monthly": lambda s, d: rounded(m.return_rate_monthly(event_sessions(s, d)), "return_rate"),
    }
    over_sessions = [
        m.channel_performance, m.campaign_performance, m.campaign_revenue_share, m.campaigns_with_revenue,
        m.campaign_engagement, m.campaign_engagement_boxplot, m.return_rate_daily, m.new_vs_returning,
        m.campaign_info,
    ]
    for job in over_sessions:
        jobs[job.__name__] = lambda s, d, job=job: job(event_sessions(s, d))
    return jobs


def _sales() -> dict[str, Query]:
    jobs = {}
    for job in [
        sales.daily_revenue, sales.monthly_revenue, sales.revenue_by_region, sales.revenue_by_continent,
        sales.top_countries_by_revenue, sales.top_countries_by_transactions,
    ]:
        jobs[job.__name__] = lambda s, d, job=job: job(event_sessions(s, d))
    for job in [
        sales.product_daily_revenue, sales.product_monthly_revenue, sales.kpi_overview, sales.continent_share,
    ]:
        jobs[job.__name__] = lambda s, d, job=job: job(_plain_products(s, d))
    for job in [
        sales.sales_by_category_day, sales.sales_by_category_month, sales.popular_categories, sales.product_preference,
    ]:
        jobs[job.__name__] = lambda s, d, job=job: job(_products(s, d))
    for job in [
        sales.sales_by_category, sales.category_transactions, sales.category_share_levels, sales.top5_other_revenue,
        sales.top5_other_transactions,
    ]:
        jobs[job.__name__] = lambda s, d, job=job: job(_sold_products(s, d))
    for job in [sales.subcontinent_rank, sales.country_rank_in_top]:
        jobs[job.__name__] = lambda s, d, job=job: job(_plain_products(s, d), CONTINENT)
    for job in [sales.top_categories, sales.category_monthly_trend]:
        jobs[job.__name__] = lambda s, d, job=job: job(_products(s, d), CONTINENT)
    jobs["continent_vs_other"] = lambda s, d: rounded(
        sales.continent_vs_other(_plain_products(s, d), CONTINENT), "transaction_percent", "revenue_percent"
    )
    jobs["top_categories_of_total"] = lambda s, d: sales.top_categories(
        _products(s, d), CONTINENT, denominator="total"
    )
    jobs["region_share_in_category"] = lambda s, d: sales.region_share_in_category(_products(s, d), CONTINENT, COUNTRY)
    return jobs


def _customer_lines(spark, folder, *more):
    columns = ["invoice_no", "stock_code", "quantity", "invoice_ts", "customer_id", *more]
    return retail_lines(spark, folder, *columns)


def _ordered_customer_lines(spark, folder):
    return _customer_lines(spark, folder, "country", "line_no", "part_no", "line_quantity")


def _retail_customers() -> dict[str, Query]:
    r = retail_customers
    season_columns = ["invoice_date", "country", "hemisphere", "part_no", "quantity"]
    return {
        "season_label": lambda s, d: r.season_label(retail_lines(s, d, "invoice_date", "country", "hemisphere")),
        "keyword_category": lambda s, d: r.keyword_categories(
            retail_lines(s, d, "part_no"), COLD, OUTDOOR, items=retail_items(s, d)
        ),
        "seasonal_sales": lambda s, d: r.seasonal_sales(
            retail_lines(s, d, *season_columns), COLD, OUTDOOR, items=retail_items(s, d)
        ),
        "impulsive_customers": lambda s, d: r.impulsive_customers(retail_lines(s, d, "customer_id", "invoice_no", "invoice_date")),
        "loyal_items": lambda s, d: r.loyal_items(_customer_lines(s, d)),
        "repeat_item_descriptions": lambda s, d: r.repeat_item_descriptions(_customer_lines(s, d, "description")),
        "loyal_probability": lambda s, d: r.loyal_probability(_customer_lines(s, d)),
        "loyal_share": lambda s, d: r.loyal_share(_customer_lines(s, d), LOYALTY),
        "loyal_by_country": lambda s, d: r.loyal_by_country(_ordered_customer_lines(s, d), LOYALTY),
        "customers_by_country": lambda s, d: r.customers_by_country(_ordered_customer_lines(s, d)),
        "discount_driven": lambda s, d: r.discount_driven(spending_lines(s, d)),
    }


SUPPLY_COLUMNS = [
    "stock_code", "description", "quantity", "unit_price", "total_price", "customer_id", "country", "invoice_date",
    *LINE_ORDER,
]
ITEM_COLUMNS = {"description", "unit_price", "total_price"}


def _supply() -> dict[str, Query]:
    def base(spark, folder):
        return supply.supply_base(retail_lines(spark, folder, *SUPPLY_COLUMNS))

    def by_item(job, *arguments, **options):
        """The job on lines that are added up by item before they are joined with the items."""

        def query(spark, folder):
            lines = retail_lines(spark, folder, *[c for c in SUPPLY_COLUMNS if c not in ITEM_COLUMNS])
            items = supply.sold_items(retail_items(spark, folder))
            return job(supply.supply_base(lines), *arguments, items=items, **options)

        return query

    def demand(spark, folder):
        return retail_lines(spark, folder, "stock_code", "quantity", "invoice_date")

    jobs = {"supply_base": base, "customer_value": lambda s, d: supply.customer_value(base(s, d))}
    for job in [
        supply.weekly_sales_velocity, supply.purchase_gaps, supply.country_quantity, supply.country_summary,
        supply.top_items, supply.underperforming_items, supply.orders_by_hour, supply.orders_by_weekday,
        supply.orders_by_month,
    ]:
        jobs[job.__name__] = by_item(job)
    for job, columns in [
        (supply.stockout_tier_mean, ["mean_stockout_rate"]),
        (supply.stockout_quantity_corr, ["correlation"]),
    ]:
        jobs[job.__name__] = lambda s, d, job=by_item(job, STOCKOUT_RULES), c=columns: rounded(job(s, d), *c)
    jobs |= {
        "stockout_rate": by_item(supply.stockout_rate, STOCKOUT_RULES),
        "country_stockout": by_item(supply.country_stockout, STOCKOUT_RULES),
        "weekly_sales_velocity_documented": by_item(supply.weekly_sales_velocity, documented=True),
        "velocity_tier": lambda s, d: supply.velocity_tier(jobs["weekly_sales_velocity"](s, d)),
        "weekly_demand_stats": lambda s, d: rounded(supply.weekly_demand_stats(demand(s, d)), "demand_std"),
        "inventory_policy": lambda s, d: rounded(
            supply.inventory_policy(demand(s, d)), "demand_std", "eoq", "safety_stock", "reorder_point"
        ),
        "weekly_series": lambda s, d: supply.weekly_series(demand(s, d)),
        "demand_forecast": lambda s, d: rounded(
            supply.demand_forecast(demand(s, d)), "forecast", "lower", "upper", digits=4
        ),
    }
    return jobs


# An order line becomes one invoice line.
LINE_KEY = ["invoice_no", "line_no"]


def _priced(spark, folder, *more):
    lines = retail_lines(spark, folder, "description", "quantity", "paid_price", *more)
    return lines.withColumnRenamed("paid_price", "unit_price")


def _pricing() -> dict[str, Query]:
    def by_item(job):
        """The job on lines that are added up by item before they are joined with the items."""

        def query(spark, folder):
            lines = retail_lines(spark, folder, "part_no", "quantity", "paid_price")
            return job(lines.withColumnRenamed("paid_price", "unit_price"), items=retail_items(spark, folder).drop("unit_price"))

        return query

    def by_item_rounded(job, *columns, digits=6):
        return lambda s, d: rounded(by_item(job)(s, d), *columns, digits=digits)

    return {
        "pricing_base": lambda s, d: pricing.pricing_base(_priced(s, d, *LINE_KEY), LINE_KEY),
        "price_points": by_item(pricing.price_points),
        "price_elasticity": by_item_rounded(pricing.price_elasticity, "price_elasticity"),
        "product_summary": by_item_rounded(pricing.product_summary, "avg_unit_price"),
        "demand_category": by_item(pricing.demand_category),
        "competition": by_item(pricing.competition),
        "adjusted_price": by_item_rounded(pricing.adjusted_price, "price_elasticity", "avg_unit_price", "adjusted_price"),
        "description_clusters": by_item(clusters.description_clusters),
        "cluster_samples": lambda s, d: clusters.cluster_samples(by_item(clusters.description_clusters)(s, d)),
        "elbow_wcss": by_item_rounded(clusters.elbow_wcss, "wcss", digits=4),
        "category_elasticity": by_item_rounded(clusters.category_elasticity, "price_elasticity"),
    }


def _behavior(spark, folder):
    return cleaning.clean_behavior(cleaning.behavior_table(_sold_products(spark, folder)))


def _cleaning() -> dict[str, Query]:
    raw_columns = ["invoice_no", "stock_code", "description", "quantity", "unit_price", "customer_id", "country"]

    def raw(spark, folder):
        return retail_lines(spark, folder, *raw_columns, "invoice_ts")

    def item_quantities(spark, folder):
        """Quantity and price of the lines, equal ones of an item as one row."""
        lines, items = retail_lines(spark, folder, "part_no", "quantity"), retail_items(spark, folder)
        return eager.sum_by(lines, ["quantity", "unit_price"], {"lines": F.lit(1).cast("bigint")}, items)

    return {
        "clean_retail": lambda s, d: cleaning.clean_retail(raw(s, d), **RETAIL_RULES),
        "retail_outliers": lambda s, d: cleaning.retail_outliers(raw(s, d), OUTLIER_DESCRIPTIONS, OUTLIER_QUANTITIES),
        "clean_listings": lambda s, d: cleaning.clean_listings(listings(s, d)),
        "clean_behavior": _behavior,
        "profile_null_counts": lambda s, d: cleaning.null_counts(raw(s, d)),
        "profile_countries": lambda s, d: cleaning.distinct_values(retail_lines(s, d, "country"), "country"),
        "profile_describe": lambda s, d: rounded(
            quantiles.describe(item_quantities(s, d), ["quantity", "unit_price"], "lines"), "mean", "std"
        ),
        "profile_date_span": lambda s, d: cleaning.date_span(retail_lines(s, d, "invoice_date"), "invoice_date"),
        "profile_currency": lambda s, d: cleaning.first_characters(listings(s, d), "actual_price"),
    }


def _nested() -> dict[str, Query]:
    """Jobs on sessions that were folded, written by day and read back with the fields they need."""

    def stored(spark, folder, *fields):
        path = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
        files.write_web_sessions(fold_sessions(spark, folder), path)
        return files.read_web_sessions(spark, path, "00010101", "99991231", list(fields))

    return {
        "nested_conversion_funnel": lambda s, d: funnel.conversion_funnel(
            flat_products(flat_hits(stored(s, d, "v2ProductCategory")))
        ),
        "nested_session_metrics": lambda s, d: visitors.session_metrics(flat_sessions(stored(s, d))),
    }


def _behavior_csv() -> dict[str, Query]:
    """Behaviour rows written as CSV, some with a day that does not exist or a time that is none, and read back."""

    def stored(spark, folder):
        rows = cleaning.behavior_table(_sold_products(spark, folder))
        visit = F.col("visit_id")
        damaged = rows.withColumns(
            {
                "date": F.when(visit % 97 == 13, "20240230").otherwise(F.col("date")),
                "start_time": F.when(visit % 101 == 7, "n/a").otherwise(F.col("start_time").cast("string")),
            }
        )
        path = f"{shared_folder(spark)}/behavior-{uuid.uuid4().hex}"
        files.write_csv(damaged.select(*files.BEHAVIOR_CSV.fieldNames()), path)
        return files.read_behavior_csv(spark, path)

    def visits(rows):
        named = rows.withColumnsRenamed({"date": "visit_date", "start_time": "visit_start"})
        counts = [F.count("*").alias("rows"), F.sum("price").alias("price_micros")]
        return named.groupBy("users", "visit_id", "visit_date", "visit_start").agg(*counts)

    return {
        "csv_accepted_visits": lambda s, d: visits(files.accepted(stored(s, d))),
        "csv_refused_rows": lambda s, d: files.refused_rows(stored(s, d)),
    }


def _segments() -> dict[str, Query]:
    def features(spark, folder):
        return segments.feature_frame(_behavior(spark, folder))

    def fitted(spark, folder):
        return segments.Segmentation(features(spark, folder))

    return {
        "feature_frame": features,
        "standardize": lambda s, d: rounded(segments.standardize(features(s, d)), *segments.STANDARDIZED),
        "cyclical_month": lambda s, d: rounded(
            segments.cyclical_month(features(s, d)).groupBy("month", *segments.CYCLE).agg(F.count("*").alias("rows")),
            *segments.CYCLE,
        ),
        "feature_covariance": lambda s, d: rounded(segments.feature_covariance(features(s, d)), "covariance"),
        "one_hot": lambda s, d: segments.one_hot_counts(features(s, d)),
        "pca_loadings": lambda s, d: rounded(fitted(s, d).loadings(), "loading"),
        "pca_strong_loadings": lambda s, d: rounded(fitted(s, d).strong_loadings(), "loading"),
        "pca_explained_variance": lambda s, d: rounded(fitted(s, d).explained(), "ratio", "cumulative"),
        "kmeans_segments": lambda s, d: fitted(s, d).segments(),
        "kmeans_segments_on_features": lambda s, d: fitted(s, d).segments(on="features"),
        "cluster_centers": lambda s, d: rounded(fitted(s, d).centers(), "value"),
        "cluster_centers_on_features": lambda s, d: rounded(fitted(s, d).centers(on="features"), "value"),
    }


def queries() -> dict[str, Query]:
    return {
        **_retention(),
        **_funnel(),
        **_visitors(),
        **_marketing(),
        **_sales(),
        **_retail_customers(),
        **_supply(),
        **_pricing(),
        **_cleaning(),
        **_segments(),
        **_nested(),
        **_behavior_csv(),
    }
