"""Channel and campaign jobs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import LEVELS, category_levels, lookup
from ..functions.fixed_values import (
    COMMISSION,
    COMMISSION_OTHERWISE,
    COST_PER_CLICK,
    ORGANIC_YEARLY_COST,
)
from ..functions.numbers import micros, percent, ratio, zero
from ..operators.distinct import distinct_counts
from ..operators.quantiles import grouped_quantiles
from ..operators.shares import with_percent

NOT_SET = "(not set)"


def channel_conversion_rate(products: DataFrame) -> DataFrame:
    """Conversions per hundred distinct visitors, by channel and raw category.

    A conversion is a product row of a visit with transactions, so a rate can exceed 100. Raw
    categories that clean to the same levels stay separate rows.
    """
    converted = F.count_if(F.col("session_transactions") > 0)
    visitors = F.countDistinct("full_visitor_id")
    rates = products.groupBy("channel", "category").agg(
        visitors.alias("total_visitors"), converted.alias("total_conversions")
    )
    return rates.select(
        "channel",
        *[c.alias(name) for name, c in category_levels(F.col("category")).items()],
        "total_visitors",
        "total_conversions",
        percent(F.col("total_conversions"), F.col("total_visitors")).alias("conversion_rate"),
    )


def _performance(sessions: DataFrame, key: str, transactions, pageviews, time_on_site) -> DataFrame:
    sums = sessions.groupBy(key).agg(
        F.countDistinct("full_visitor_id").alias("total_users"),
        F.count("*").alias("total_sessions"),
        transactions.alias("total_transactions"),
        micros(F.sum("transaction_revenue")).alias("total_revenue"),
        F.avg(pageviews).alias("avg_pageviews"),
        F.avg(time_on_site).alias("avg_time_on_site"),
        F.avg(zero(F.col("bounces"))).alias("avg_bounces"),
    )
    return sums.withColumns(
        {
            "avg_order_value": ratio(F.col("total_revenue"), F.col("total_transactions")),
            "conversion_rate": ratio(F.col("total_transactions"), F.col("total_sessions")),
        }
    )


def channel_performance(sessions: DataFrame) -> DataFrame:
    """Averages ignore missing page views and times; transactions stay null when there are none."""
    return _performance(
        sessions, "channel", F.sum("transactions"), F.col("pageviews"), F.col("time_on_site")
    )


def campaign_performance(sessions: DataFrame) -> DataFrame:
    """Every metric is zero-filled; a campaign without transactions has no order value."""
    return _performance(
        sessions,
        "campaign",
        zero(F.sum("transactions")),
        zero(F.col("pageviews")),
        zero(F.col("time_on_site")),
    )


def campaign_revenue_share(sessions: DataFrame) -> DataFrame:
    """Revenue with and without a campaign; a missing campaign name counts as a campaign."""
    label = F.when(F.col("campaign").eqNullSafe(NOT_SET), "Non-campaign").otherwise("Campaign")
    summed = sessions.groupBy(label.alias("label")).agg(F.sum(zero(F.col("transaction_revenue"))).alias("amount"))
    return with_percent(summed, percentage="amount").select(
        "label", micros(F.col("amount")).alias("revenue"), "percentage"
    )


def campaigns_with_revenue(sessions: DataFrame) -> DataFrame:
    named = sessions.where(~F.col("campaign").eqNullSafe(NOT_SET))
    summed = named.groupBy("campaign").agg(F.sum("transaction_revenue").alias("amount")).where("amount > 0")
    return with_percent(summed, percentage="amount").select(
        "campaign", micros(F.col("amount")).alias("revenue"), "percentage"
    )


def campaign_engagement(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("pageviews").isNotNull() & F.col("time_on_site").isNotNull()).select(
        "campaign", "pageviews", "time_on_site"
    )


def campaign_engagement_boxplot(sessions: DataFrame) -> DataFrame:
    """Five-number summary of pages and seconds per campaign."""
    wanted = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    boxes = grouped_quantiles(campaign_engagement(sessions), ["pageviews", "time_on_site"], wanted, ["campaign"])
    whole = {c: F.col(c).cast("bigint") for c in ("min", "max")}
    return boxes.withColumnRenamed("column", "metric").withColumns(whole)


def return_rate_daily(sessions: DataFrame) -> DataFrame:
    """Share of visits by someone seen before, per campaign and day."""
    back = F.count_if(F.col("new_visits").isNull())
    return sessions.groupBy("campaign", F.to_date("date", "yyyyMMdd").alias("date")).agg(
        ratio(back, F.count("*")).alias("return_rate")
    )


def return_rate_monthly(sessions: DataFrame) -> DataFrame:
    """Mean of the daily rates, not the rate of the month."""
    daily = return_rate_daily(sessions)
    month = F.date_format("date", "yyyy-MM")
    return daily.groupBy("campaign", month.alias("month")).agg(F.avg("return_rate").alias("return_rate"))


def _day_number() -> Column:
    """A `yyyyMMdd` day as the number it spells, whose extremes a hash aggregate can hold."""
    return F.col("date").try_cast("int")


def new_vs_returning(sessions: DataFrame) -> DataFrame:
    """Distinct new and returning visitors per campaign; new means on the visitor's first day.

    One row per visitor and campaign carries the first and last day, which decides both counts, so
    the window sees at most one row per campaign and no distinct count or self-join is needed.
    """
    spans = sessions.groupBy("full_visitor_id", "campaign").agg(
        F.min(_day_number()).alias("first_day"), F.max(_day_number()).alias("last_day")
    )
    first = F.min("first_day").over(Window.partitionBy("full_visitor_id"))
    named = spans.withColumn("first_visit", first).where(F.col("campaign") != NOT_SET)
    counts = named.groupBy("campaign").agg(
        F.count_if(F.col("first_day") == F.col("first_visit")).alias("new_customers"),
        F.count_if(F.col("last_day") > F.col("first_visit")).alias("returning_customers"),
    )
    share = F.coalesce(ratio(F.col("new_customers"), F.col("returning_customers")), F.lit(0.0))
    return counts.withColumn("ratio", share)


def campaign_info(sessions: DataFrame) -> DataFrame:
    """Users and revenue per campaign and channel, with the campaign's first and last day."""
    named = sessions.where(F.col("campaign") != NOT_SET)
    metrics = named.groupBy("campaign", "channel").agg(
        F.countDistinct("full_visitor_id").alias("user_count"),
        micros(F.sum("transaction_revenue")).alias("total_revenue"),
    )
    dates = sessions.groupBy("campaign").agg(
        F.to_date(F.min(_day_number()).cast("string"), "yyyyMMdd").alias("first_visit_date"),
        F.to_date(F.max(_day_number()).cast("string"), "yyyyMMdd").alias("last_visit_date"),
    )
    return metrics.join(dates, "campaign")


def _channel_categories(products: DataFrame) -> DataFrame:
    rows = distinct_counts(
        products,
        [F.col("channel"), F.col("category")],
        {"total_users": F.col("full_visitor_id"), "total_transactions": F.col("transaction_id")},
        {"total_sessions": F.lit(1).cast("bigint"), "amount": zero(F.col("product_revenue"))},
    )
    return rows.select("*", *[c.alias(name) for name, c in category_levels(F.col("category")).items()])


def channel_category_metrics(products: DataFrame) -> DataFrame:
    """Metrics by channel and raw category. `total_sessions` counts product rows."""
    return _channel_categories(products).select(
        "channel",
        *LEVELS,
        "total_users",
        "total_sessions",
        "total_transactions",
        micros(F.col("amount")).alias("total_revenue"),
    )


def _channel_rollup(products: DataFrame) -> DataFrame:
    return _channel_categories(products).groupBy("channel", "main_category").agg(
        F.sum("total_users").alias("total_users"),
        F.sum("total_sessions").alias("total_sessions"),
        F.sum("total_transactions").alias("total_transactions"),
        F.sum("amount").alias("amount"),
    )


def channel_category_rollup(products: DataFrame) -> DataFrame:
    """The metrics summed to main categories; users seen in several raw categories count again."""
    return _channel_rollup(products).withColumn("total_revenue", micros(F.col("amount"))).drop("amount")


def channel_roi(products: DataFrame, cost_per_click: dict[str, float] = COST_PER_CLICK) -> DataFrame:
    """Revenue, cost and return of each channel; channels without a cost model have null cost.

    Clicks in a category without a rate cost nothing. The commission is the revenue-weighted mean
    rate times revenue, which is the sum of revenue times rate.
    """
    rows = _channel_rollup(products).withColumn("revenue", micros(F.col("amount")))
    main = F.col("main_category")
    clicks = F.sum(F.col("total_sessions") * lookup(main, cost_per_click))
    commission = F.sum(F.col("revenue") * F.coalesce(lookup(main, COMMISSION), F.lit(COMMISSION_OTHERWISE)))
    channels = rows.groupBy("channel").agg(
        micros(F.sum("amount")).alias("revenue"), clicks.alias("clicks"), commission.alias("commission")
    )
    cost = (
        F.when(F.col("channel") == "organic", F.lit(float(ORGANIC_YEARLY_COST)))
        .when(F.col("channel") == "cpc", zero(F.col("clicks")))
        .when(F.col("channel") == "affiliate", F.col("commission"))
    )
    return channels.select(
        "channel", "revenue", cost.alias("cost"), ratio(F.col("revenue") - cost, cost).alias("roi")
    )
