"""Revenue by day, place and product category."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import LEVELS, category_levels, main_category
from ..functions.fixed_values import PURCHASE_ACTION, REGIONAL_CATEGORIES
from ..functions.numbers import micros, percent, zero
from ..operators.distinct import distinct_counts
from ..operators.shares import top_n_and_other, totals_of, with_percent


def _date():
    return F.to_date("date", "yyyyMMdd")


def _levels():
    return [c.alias(name) for name, c in category_levels(F.col("category")).items()]


# --- over time -------------------------------------------------------------------


def daily_revenue(sessions: DataFrame) -> DataFrame:
    """Session revenue per day, null on a day without any."""
    return sessions.groupBy(_date().alias("date")).agg(
        micros(F.sum("total_transaction_revenue")).alias("total_revenue")
    )


def monthly_revenue(sessions: DataFrame) -> DataFrame:
    month = F.trunc(_date(), "month")
    amount = F.sum(zero(F.col("total_transaction_revenue")))
    return sessions.groupBy(month.alias("month")).agg(micros(amount).alias("total_revenue"))


def product_daily_revenue(products: DataFrame) -> DataFrame:
    return products.groupBy(_date().alias("date")).agg(
        micros(F.sum(zero(F.col("product_revenue")))).alias("daily_revenue")
    )


def product_monthly_revenue(products: DataFrame) -> DataFrame:
    return products.groupBy(F.trunc(_date(), "month").alias("month")).agg(
        micros(F.sum(zero(F.col("product_revenue")))).alias("monthly_revenue")
    )


def _category_days(products: DataFrame) -> DataFrame:
    """Quantity and amount bought per day and raw category."""
    bought = products.where(F.col("action") == PURCHASE_ACTION)
    days = bought.groupBy("date", "category").agg(
        F.sum(zero(F.col("product_quantity"))).alias("sales_qty"),
        F.sum(zero(F.col("product_revenue"))).alias("amount"),
    )
    return days.select(F.date_format(_date(), "yyyy-MM").alias("month"), *_levels(), "sales_qty", "amount")


def sales_by_category_day(products: DataFrame) -> DataFrame:
    """One row per day and raw category, labelled with the month."""
    return _category_days(products).withColumn("revenue", micros(F.col("amount"))).drop("amount")


def sales_by_category_month(products: DataFrame) -> DataFrame:
    """Sum and mean of the daily rows."""
    rows = F.count("*").cast("double")
    return _category_days(products).groupBy("month", *LEVELS).agg(
        F.sum("sales_qty").alias("total_sales"),
        micros(F.sum("amount")).alias("total_revenue"),
        F.avg("sales_qty").alias("avg_sales"),
        (F.sum("amount").cast("double") / rows / 1e6).alias("avg_revenue"),
    )


def popular_categories(products: DataFrame, n: int = 3) -> DataFrame:
    """The daily category rows with the highest revenue of each month."""
    order = Window.partitionBy("month").orderBy(F.desc("amount"), F.desc("sales_qty"), *LEVELS)
    ranked = _category_days(products).withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
    return ranked.select("month", *LEVELS, "sales_qty", micros(F.col("amount")).alias("revenue"))


# --- by product category ---------------------------------------------------------


def sales_by_category(products: DataFrame) -> DataFrame:
    """Quantity and revenue per raw category, over visits with a transaction."""
    sold = products.where(F.col("session_transactions").isNotNull())
    return (
        sold.groupBy("category")
        .agg(
            F.sum(zero(F.col("product_quantity"))).alias("sales_qty"),
            micros(F.sum(zero(F.col("product_revenue")))).alias("revenue"),
        )
        .select(*_levels(), "sales_qty", "revenue")
    )


def _category_transactions(products: DataFrame) -> DataFrame:
    visit = F.concat("full_visitor_id", F.col("visit_id").cast("string"))
    sold = products.where(F.col("session_transactions").isNotNull())
    return (
        sold.groupBy("category")
        .agg(F.countDistinct(visit).alias("transaction_count"), F.sum(zero(F.col("product_revenue"))).alias("amount"))
        .select("category", *_levels(), "transaction_count", "amount")
    )


def category_transactions(products: DataFrame) -> DataFrame:
    return _category_transactions(products).withColumn("revenue", micros(F.col("amount"))).drop("amount")


def category_share_levels(products: DataFrame) -> DataFrame:
    """Revenue and transactions, with their percentages, at one, two and three category levels."""
    rows = _category_transactions(products)
    totals = totals_of(rows, "amount", "transaction_count")
    depth = F.when(F.grouping_id() == 0, 3).when(F.grouping_id() == 1, 2).when(F.grouping_id() == 3, 1)
    rolled = rows.rollup(*LEVELS).agg(
        depth.cast("bigint").alias("depth"),
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("amount").alias("amount"),
    )
    return rolled.where(F.col("depth").isNotNull()).withColumn("whole", totals).select(
        "depth",
        *LEVELS,
        "transaction_count",
        micros(F.col("amount")).alias("revenue"),
        percent(F.col("amount"), F.col("whole.amount")).alias("revenue_percent"),
        percent(F.col("transaction_count"), F.col("whole.transaction_count")).alias("transaction_percent"),
    )


def top5_other_revenue(products: DataFrame) -> DataFrame:
    top = top_n_and_other(_category_transactions(products), "main_category", "amount")
    shared = with_percent(top, percentage="amount")
    return shared.select("main_category", micros(F.col("amount")).alias("revenue"), "percentage")


def top5_other_transactions(products: DataFrame) -> DataFrame:
    top = top_n_and_other(_category_transactions(products), "main_category", "transaction_count")
    return with_percent(top, percentage="transaction_count")


def product_preference(products: DataFrame) -> DataFrame:
    """Transactions and revenue per main category; transactions are distinct per raw category."""
    raw = products.groupBy("category").agg(
        F.countDistinct("transaction_id").alias("product_transaction"),
        F.sum(zero(F.col("product_revenue"))).alias("amount"),
    )
    mains = raw.groupBy(main_category(F.col("category")).alias("main_category")).agg(
        F.sum("product_transaction").alias("product_transaction"), F.sum("amount").alias("amount")
    )
    shared = with_percent(mains, transaction_percent="product_transaction", revenue_percent="amount")
    return shared.withColumn("product_revenue", micros(F.col("amount"))).drop("amount")


# --- by place ---------------------------------------------------------------------


def kpi_overview(products: DataFrame) -> DataFrame:
    """Store-wide totals. Visit ids collide between visitors; they are counted alone all the same."""
    counted = {
        "total_users": F.col("full_visitor_id"),
        "total_sessions": F.col("visit_id"),
        "total_transactions": F.col("transaction_id"),
        "users_with_purchase": F.when(F.col("product_revenue") > 0, F.col("full_visitor_id")),
    }
    found = distinct_counts(products, [], counted, {"total_revenue": zero(F.col("product_revenue"))})
    return found.withColumn("total_revenue", micros(F.col("total_revenue")))


def _places(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("continent", F.col("sub_continent").alias("subcontinent"), "country").agg(
        F.sum("total_transaction_revenue").alias("amount"), F.sum("transactions").alias("total_transactions")
    )


def revenue_by_region(sessions: DataFrame) -> DataFrame:
    return _places(sessions).withColumn("total_revenue", micros(F.col("amount"))).drop("amount")


def revenue_by_continent(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("continent").agg(
        micros(zero(F.sum("total_transaction_revenue"))).alias("total_revenue")
    )


def top_countries_by_revenue(sessions: DataFrame, n: int = 10) -> DataFrame:
    shared = with_percent(_places(sessions), revenue_percent="amount")
    top = shared.orderBy(F.desc("amount"), "country", "subcontinent").limit(n)
    return top.select("country", micros(F.col("amount")).alias("total_revenue"), "revenue_percent")


def top_countries_by_transactions(sessions: DataFrame, n: int = 10) -> DataFrame:
    shared = with_percent(_places(sessions), transaction_percent="total_transactions")
    top = shared.orderBy(F.desc("total_transactions"), "country", "subcontinent").limit(n)
    return top.select("country", "total_transactions", "transaction_percent")


def _continents(products: DataFrame) -> DataFrame:
    sums = products.groupBy("continent").agg(
        F.countDistinct("transaction_id").alias("transactions"),
        F.sum(zero(F.col("product_revenue"))).alias("amount"),
    )
    return with_percent(sums, transaction_percent="transactions", revenue_percent="amount")


def continent_share(products: DataFrame) -> DataFrame:
    return _continents(products).withColumn("revenue", micros(F.col("amount"))).drop("amount")


def continent_vs_other(products: DataFrame, continent: str) -> DataFrame:
    """The continents folded to two rows: the named one and all others."""
    side = F.when(F.col("continent") == continent, F.col("continent")).otherwise("Other")
    folded = _continents(products).groupBy(side.alias("continent")).agg(
        *[F.sum(c).alias(c) for c in ("transactions", "amount", "transaction_percent", "revenue_percent")]
    )
    return folded.withColumn("revenue", micros(F.col("amount"))).drop("amount")


def _within(products: DataFrame, continent: str) -> DataFrame:
    return products.where(F.col("continent") == continent)


def _country_sums(products: DataFrame, continent: str) -> DataFrame:
    return (
        _within(products, continent)
        .groupBy("sub_continent", "country")
        .agg(F.sum(zero(F.col("product_revenue"))).alias("amount"))
    )


def _subcontinent_sums(countries: DataFrame) -> DataFrame:
    return countries.groupBy("sub_continent").agg(F.sum("amount").alias("amount"))


def _in_top_subcontinent(countries: DataFrame) -> DataFrame:
    ranked = _subcontinent_sums(countries).orderBy(F.desc("amount"), "sub_continent")
    top = ranked.limit(1).select("sub_continent").scalar()
    return countries.where(F.col("sub_continent") == top)


def _main_amounts(products: DataFrame, *keys: Column, blank_as_other: bool = True) -> DataFrame:
    """Revenue per key and main category; paths are cleaned after the raw ones are summed."""
    raw = products.groupBy(*keys, "category").agg(F.sum(zero(F.col("product_revenue"))).alias("amount"))
    names = [c for c in raw.columns if c not in ("category", "amount")]
    main = main_category(F.col("category"), blank_as_other)
    return raw.groupBy(*names, main.alias("main_category")).agg(F.sum("amount").alias("amount"))


def subcontinent_rank(products: DataFrame, continent: str) -> DataFrame:
    shared = with_percent(_subcontinent_sums(_country_sums(products, continent)), revenue_percent="amount")
    return shared.select("sub_continent", micros(F.col("amount")).alias("revenue"), "revenue_percent").orderBy(
        F.desc("revenue")
    )


def country_rank_in_top(products: DataFrame, continent: str) -> DataFrame:
    """Countries of the sub-continent with the highest revenue."""
    countries = _in_top_subcontinent(_country_sums(products, continent))
    shared = with_percent(countries.select("country", "amount"), revenue_percent="amount")
    return shared.select("country", micros(F.col("amount")).alias("revenue"), "revenue_percent").orderBy(
        F.desc("revenue")
    )


def top_categories(
    products: DataFrame, continent: str, n: int = 6, denominator: str = "top_subcontinent"
) -> DataFrame:
    """Main categories with the highest revenue.

    The percentage is of the top sub-continent's revenue, or with `denominator="total"` of all of
    the continent's revenue.
    """
    mains = _main_amounts(_within(products, continent))
    base = mains if denominator == "total" else _in_top_subcontinent(_country_sums(products, continent))
    whole = totals_of(base, "amount")["amount"]
    top = mains.orderBy(F.desc("amount"), "main_category").limit(n)
    return top.select(
        "main_category",
        micros(F.col("amount")).alias("revenue"),
        percent(F.col("amount"), whole).alias("revenue_percent"),
    )


def region_share_in_category(
    products: DataFrame, continent: str, country: str, categories: list[str] = REGIONAL_CATEGORIES, n: int = 5
) -> DataFrame:
    """The regions of a country with the largest share of each listed category."""
    sold = _within(products, continent).where(F.col("country") == country)
    sums = _main_amounts(sold, F.col("region")).where(F.col("main_category").isin(categories))
    per_category = Window.partitionBy("main_category")
    shared = sums.withColumn("percentage", percent(F.col("amount"), F.sum("amount").over(per_category)))
    position = F.row_number().over(per_category.orderBy(F.desc("amount"), "region"))
    top = shared.withColumn("position", position.cast("bigint")).where(F.col("position") <= n)
    return top.select("main_category", "position", "region", micros(F.col("amount")).alias("revenue"), "percentage")


def category_monthly_trend(products: DataFrame, continent: str, n: int = 6) -> DataFrame:
    """Monthly revenue of the categories with the highest total, `Unavailable` hidden afterwards."""
    month = F.trunc(_date(), "month").alias("month")
    months = _main_amounts(_within(products, continent), month, blank_as_other=False)
    totals = months.groupBy("main_category").agg(F.sum("amount").alias("amount"))
    top = totals.orderBy(F.desc("amount"), "main_category").limit(n).select("main_category")
    # `top` has at most n rows.
    kept = months.join(F.broadcast(top), "main_category", "left_semi").where(F.col("main_category") != "Unavailable")
    return kept.select("month", "main_category", micros(F.col("amount")).alias("revenue"))
