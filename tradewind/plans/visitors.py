"""Jobs about visitors and visits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import PURCHASE_ACTION, SENSITIVITY_FIVE
from ..functions.labels import tier, visitor_category
from ..functions.numbers import micros, ratio, zero
from ..operators.shares import correlation_pairs

SESSION_METRICS = [
    "visit_number", "time_on_site", "pageviews", "num_hits", "session_quality", "totals_revenue", "transactions",
]


def purchases_per_user(hits: DataFrame) -> DataFrame:
    bought = hits.where(F.col("action") == PURCHASE_ACTION)
    return bought.groupBy(F.col("full_visitor_id").alias("users")).agg(
        F.countDistinct("transaction_id").alias("total_purchases"),
        micros(F.sum(zero(F.col("transaction_revenue")))).alias("total_revenue"),
    )


def purchase_averages(sessions: DataFrame, hits: DataFrame) -> DataFrame:
    """Averages of visits with and without a purchase.

    A visit counts once per purchase hit, as if joined to every one of them; the weight says the
    same without the fan-out, so a visit with very many purchases stays one row.
    """
    purchases = (
        hits.where(F.col("action") == PURCHASE_ACTION)
        .groupBy("full_visitor_id", "visit_id")
        .agg(F.count("*").alias("purchase_hits"))
    )
    visits = sessions.join(purchases, ["full_visitor_id", "visit_id"], "left")
    weight = F.coalesce("purchase_hits", F.lit(1))

    def average(name):
        value = F.col(name)
        return ratio(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))

    kind = F.when(F.col("purchase_hits").isNotNull(), "Purchase").otherwise("No Purchase")
    return visits.groupBy(kind.alias("visit_type")).agg(
        average("visit_number").alias("average_visit_no"),
        average("time_on_site").alias("avg_time"),
        average("pageviews").alias("avg_pgviews"),
    )


def top_customers(sessions: DataFrame, n: int | None = None) -> DataFrame:
    """Visitors by transactions, time and pages; ties go to the smaller id."""
    totals = sessions.groupBy(F.col("full_visitor_id").alias("users")).agg(
        F.sum(zero(F.col("pageviews"))).alias("pageviews"),
        F.sum(zero(F.col("time_on_site"))).alias("time_on_site"),
        F.sum("transactions").alias("transactions"),
    )
    ordered = totals.orderBy(F.desc("transactions"), F.desc("time_on_site"), F.desc("pageviews"), "users")
    return ordered if n is None else ordered.limit(n)


def session_metrics(sessions: DataFrame, missing_quality: int = -1) -> DataFrame:
    return sessions.select(
        "visit_number",
        "time_on_site",
        "pageviews",
        F.col("hit_count").alias("num_hits"),
        F.coalesce("session_quality", F.lit(missing_quality).cast("bigint")).alias("session_quality"),
        micros(zero(F.col("total_transaction_revenue"))).alias("totals_revenue"),
        zero(F.col("transactions")).alias("transactions"),
    )


def session_correlation(sessions: DataFrame, missing_quality: int = -1) -> DataFrame:
    return correlation_pairs(session_metrics(sessions, missing_quality), SESSION_METRICS)


def product_event_correlation(products: DataFrame) -> DataFrame:
    """Correlation of action, price, impression and click; only a literal true counts as one."""
    flags = products.select(
        F.col("action").cast("int").alias("action"),
        micros(F.col("product_price")).alias("price"),
        F.coalesce("is_impression", F.lit(False)).cast("int").alias("impression"),
        F.coalesce("is_click", F.lit(False)).cast("int").alias("click"),
    )
    return correlation_pairs(flags, ["action", "price", "impression", "click"])


def price_sensitivity(hits: DataFrame, tiers: list[tuple] = SENSITIVITY_FIVE) -> DataFrame:
    """Visitors by average order value; visitors without an order fall to the last tier."""
    average = ratio(F.sum("transaction_revenue"), F.count("transaction_revenue")) / 1e6
    visitors = hits.groupBy("full_visitor_id").agg(
        F.countDistinct("transaction_id").alias("purchase_count"), average.alias("avg_order_value")
    )
    return visitors.withColumn("segment", tier(F.col("avg_order_value"), tiers))


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.count("*").alias("visitors"))


def order_value_histogram(segments: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins between each segment's extremes, the last one closed."""
    known = segments.where(F.col("avg_order_value").isNotNull())
    ranges = known.groupBy("segment").agg(F.min("avg_order_value").alias("low"), F.max("avg_order_value").alias("high"))
    # One row per tier.
    placed = known.join(F.broadcast(ranges), "segment")
    position = ratio(F.col("avg_order_value") - F.col("low"), F.col("high") - F.col("low"))
    bin_no = F.least(F.floor(F.coalesce(position, F.lit(0.5)) * bins), F.lit(bins - 1).cast("bigint"))
    return placed.groupBy("segment", bin_no.alias("bin")).agg(F.count("*").alias("visitors"))


def visitor_frequency(sessions: DataFrame) -> DataFrame:
    """Revenue and transactions of first-time, occasional and frequent visits."""
    revenue = F.sum(zero(F.col("total_transaction_revenue")))
    transactions = F.sum(zero(F.col("transactions")))
    return sessions.groupBy(visitor_category(F.col("visit_number")).alias("visitor_category")).agg(
        (ratio(revenue, F.count("*")) / 1e6).alias("mean_revenue"),
        micros(revenue).alias("total_revenue"),
        ratio(transactions, F.count("*")).alias("mean_transactions"),
        transactions.alias("total_transactions"),
    )


def revenue_regression(sessions: DataFrame) -> DataFrame:
    """Least-squares line of session revenue on session transactions."""
    revenue = micros(zero(F.col("total_transaction_revenue")))
    transactions = zero(F.col("transactions")).cast("double")
    return sessions.agg(
        F.regr_slope(revenue, transactions).alias("slope"), F.regr_intercept(revenue, transactions).alias("intercept")
    )
