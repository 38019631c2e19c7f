"""Season, impulse, loyalty and discount analyses of retail customers.

Lines are reduced to one row per customer and day, or per customer and item, before any window or
second grouping, so a customer with a large part of all lines never lands whole in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import (
    COLD_KEYWORDS,
    EQUATOR_COUNTRIES,
    LOYALTY_OUTLIER_QUANTITIES,
    NORTHERN_COUNTRIES,
    OUTDOOR_KEYWORDS,
    SOUTHERN_COUNTRIES,
)
from ..functions.labels import keyword_category, season
from ..functions.numbers import money_sum, ratio
from ..operators.eager import sum_by
from ..sources.retail import LINE_ORDER



# --- seasons ----------------------------------------------------------------------


def country_hemisphere(country: Column) -> Column:
    """Hemisphere of a country name, null when it is not listed."""
    return (
        F.when(country.isin(NORTHERN_COUNTRIES), "north")
        .when(country.isin(SOUTHERN_COUNTRIES), "south")
        .when(country.isin(EQUATOR_COUNTRIES), "equator")
    )


def _hemisphere(lines: DataFrame) -> Column:
    return F.col("hemisphere") if "hemisphere" in lines.columns else country_hemisphere(F.col("country"))


def with_season(lines: DataFrame) -> DataFrame:
    return lines.withColumn("season", season(F.month("invoice_date"), _hemisphere(lines)))


def season_label(lines: DataFrame) -> DataFrame:
    """Season of every country and month that has lines."""
    month = F.month("invoice_date").cast("bigint")
    return with_season(lines).groupBy("country", month.alias("month"), "season").agg(F.count("*").alias("lines"))


def keyword_categories(
    lines: DataFrame,
    cold: list[str] = COLD_KEYWORDS,
    outdoor: list[str] = OUTDOOR_KEYWORDS,
    items: DataFrame | None = None,
) -> DataFrame:
    """Lines and category of every description; with `items`, descriptions come from there."""
    counted = sum_by(lines, ["description"], {"lines": F.lit(1).cast("bigint")}, items)
    return counted.withColumn("category", keyword_category(F.col("description"), cold, outdoor))


def seasonal_sales(
    lines: DataFrame,
    cold: list[str] = COLD_KEYWORDS,
    outdoor: list[str] = OUTDOOR_KEYWORDS,
    items: DataFrame | None = None,
) -> DataFrame:
    """Quantity by season and category; with `items`, each item is put in its category once."""
    category = keyword_category(F.col("description"), cold, outdoor)
    lines = with_season(lines)
    if items is None:
        lines = lines.withColumn("category", category)
    else:
        items = items.withColumn("category", category)
    return sum_by(lines, ["season", "category"], {"quantity": F.col("quantity")}, items)


# --- impulse ----------------------------------------------------------------------


def impulsive_customers(
    lines: DataFrame, min_rate: float = 0.5, min_purchases: int = 5, strong_days: int = 1, weak_days: int = 7
) -> DataFrame:
    """Customers and years with many cancellations, most of them soon after or before a purchase.

    A cancellation is strong when any purchase of the customer in that year lies within a day, weak
    within a week. The nearest purchases before and after decide that, and they are found over the
    days of a year: at most 366 rows per customer and year. A missing customer counts as number 0.
    """
    cancelled = F.col("invoice_no").startswith("C")
    days = (
        lines.withColumn("customer_id", F.coalesce("customer_id", F.lit(0)))
        .groupBy("customer_id", F.year("invoice_date").cast("bigint").alias("year"), "invoice_date")
        .agg(F.count_if(~cancelled).alias("purchases"), F.count_if(cancelled).alias("cancellations"))
    )
    day = F.col("invoice_date")
    bought = F.when(F.col("purchases") > 0, day)
    year = Window.partitionBy("customer_id", "year")

    def latest(order):
        # A running frame in either direction costs one step per row.
        running = year.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.last(bought, ignorenulls=True).over(running)

    before = F.datediff(day, latest(F.asc("invoice_date")))
    after = F.datediff(latest(F.desc("invoice_date")), day)
    near = days.withColumn("distance", F.least(before, after))
    strong = F.col("distance") <= strong_days
    weak = (F.col("distance") > strong_days) & (F.col("distance") <= weak_days)

    def cancellations_where(condition):
        return F.sum(F.when(condition, F.col("cancellations")).otherwise(0))

    years = near.groupBy("customer_id", "year").agg(
        F.sum("purchases").alias("total_purchases"),
        F.sum("cancellations").alias("total_cancellations"),
        cancellations_where(strong).alias("strongly_impulsive"),
        cancellations_where(weak).alias("weakly_impulsive"),
    )
    rate = ratio(F.col("total_cancellations"), F.col("total_purchases"))
    return years.withColumn("cancellation_rate", rate).where(
        (F.col("total_cancellations") > 0)
        & (F.col("cancellation_rate") >= min_rate)
        & (F.col("total_purchases") > min_purchases)
    )


# --- loyalty ----------------------------------------------------------------------


def loyalty_base(lines: DataFrame, outliers: list[int] = LOYALTY_OUTLIER_QUANTITIES) -> DataFrame:
    """Purchases by known customers without discount lines and quantity outliers."""
    return lines.where(
        (F.col("quantity") > 0)
        & F.col("customer_id").isNotNull()
        & (F.col("customer_id") != 0)
        & ~F.col("quantity").isin(outliers)
        & (F.col("stock_code") != "D")
    )


def _customer_items(lines: DataFrame, with_country: bool = False) -> DataFrame:
    """One row per customer and item, flagged loyal when bought often or a year apart."""
    measures = [
        F.count("*").alias("purchase_count"),
        F.avg("quantity").alias("mean_quantity"),
        F.min("invoice_ts").alias("first_purchase"),
        F.max("invoice_ts").alias("most_recent_purchase"),
    ]
    if with_country:
        measures.append(F.min(F.struct(*LINE_ORDER, "country")).alias("first_line"))
    items = loyalty_base(lines).groupBy("customer_id", "stock_code").agg(*measures)
    span = F.timestamp_diff("DAY", F.col("first_purchase"), F.col("most_recent_purchase"))
    repeated = (F.col("purchase_count") > 2) | ((F.col("purchase_count") > 1) & (F.col("timeframe") >= 365))
    return items.withColumn("timeframe", span).withColumn("loyal", repeated)


def loyal_items(lines: DataFrame) -> DataFrame:
    """Items a customer came back for, with the mean days between purchases."""
    loyal = _customer_items(lines).where("loyal").drop("loyal")
    return loyal.withColumn("purchase_frequency", ratio(F.col("timeframe"), F.col("purchase_count")))


def repeat_item_descriptions(lines: DataFrame) -> DataFrame:
    """Loyally bought items with their number of loyal buyers and every description they carry."""
    buyers = _customer_items(lines).where("loyal").groupBy("stock_code").agg(F.count("*").alias("loyal_buyers"))
    described = loyalty_base(lines).select("stock_code", "description").distinct()
    return buyers.join(described, "stock_code", "left")


def _loyalty(items: DataFrame, *more: Column) -> DataFrame:
    customers = items.groupBy("customer_id").agg(
        F.count_if("loyal").alias("loyal_items"), F.count("*").alias("distinct_items"), *more
    )
    return customers.withColumn("loyal_probability", ratio(F.col("loyal_items"), F.col("distinct_items")))


def loyal_probability(lines: DataFrame) -> DataFrame:
    """Share of a customer's distinct items that are loyally bought, for customers with any."""
    return _loyalty(_customer_items(lines)).where("loyal_items > 0")


def loyal_share(lines: DataFrame, threshold: float = 0.2) -> DataFrame:
    customers = _loyalty(_customer_items(lines))
    counts = customers.agg(
        F.count("*").alias("total_customers"),
        F.count_if(F.col("loyal_probability") > threshold).alias("loyal_customers"),
    )
    share = F.bround(ratio(F.col("loyal_customers"), F.col("total_customers")), 4) * 100.0
    return counts.withColumn("loyal_percent", share)


def _customer_countries(lines: DataFrame) -> DataFrame:
    first = F.min("first_line").alias("first_line")
    customers = _loyalty(_customer_items(lines, with_country=True), first)
    return customers.withColumn("country", F.col("first_line.country"))


def loyal_by_country(lines: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Loyal customers by the country of their first line."""
    loyal = _customer_countries(lines).where(F.col("loyal_probability") > threshold)
    return loyal.groupBy("country").agg(F.count("*").alias("customers"))


def customers_by_country(lines: DataFrame) -> DataFrame:
    return _customer_countries(lines).groupBy("country").agg(F.count("*").alias("customers"))


# --- discounts --------------------------------------------------------------------


def discount_driven(
    lines: DataFrame, min_percent: float = 5, outliers: list[int] = LOYALTY_OUTLIER_QUANTITIES
) -> DataFrame:
    """Customers whose discounts reach a percentage of what they spent.

    Discount lines (`D`) and purchases are summed in one pass; customers that lack either drop out.
    """
    discount = F.col("stock_code") == "D"
    purchase = ~discount & (F.col("quantity") > 0) & ~F.col("quantity").isin(outliers)
    known = lines.where(F.col("customer_id").isNotNull() & (F.col("customer_id") != 0))
    sums = known.groupBy("customer_id").agg(
        money_sum(F.when(discount, F.col("total_price"))).alias("total_discount"),
        money_sum(F.when(purchase, F.col("total_price"))).alias("total_spent"),
    )
    average = F.try_divide(F.col("total_discount") * -100.0, F.col("total_spent"))
    return sums.withColumn("avg_discount", average).where(F.col("avg_discount") >= min_percent)
