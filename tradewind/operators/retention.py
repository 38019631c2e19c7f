"""Period activity, churn and cohorts of any (customer, date, order) data.

The windows below run over rows already reduced to one per customer and period, so that their
partitions are bounded by the number of calendar periods, however many orders a customer has.
"""

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent, ratio
from ..functions.periods import period_number, period_start
from .distinct import distinct_counts


# Calendar months in a period of the matrix.
MONTHS = {"month": 1, "quarter": 3}


def period_activity(orders: DataFrame, period: str) -> DataFrame:
    """Distinct orders and distinct customers per period."""
    start = period_start(F.col("order_date"), period)
    counted = {"orders": F.col("order_id"), "customers": F.col("customer_id")}
    return distinct_counts(orders.where(F.col("order_date").isNotNull()), [start.alias("period")], counted)


def customer_periods(orders: DataFrame, period: str) -> DataFrame:
    """Distinct orders per customer and period, in long form."""
    start = period_start(F.col("order_date"), period)
    return (
        orders.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
        .groupBy("customer_id", start.alias("period"))
        .agg(F.countDistinct("order_id").alias("purchase_count"))
    )


def spanned_periods(orders: DataFrame, period: str) -> list[date]:
    """First days of all periods of the years with orders, first to last; their number is bounded by the calendar."""
    known = orders.where(F.col("customer_id").isNotNull())
    start = period_start(F.col("order_date"), period)
    first, last = known.agg(F.min(start), F.max(start)).first()
    if first is None:
        return []
    years = range(first.year, last.year + 1)
    return [date(year, month, 1) for year in years for month in range(1, 13, MONTHS[period])]


def customer_period_matrix(orders: DataFrame, period: str, periods: list[date] | None = None) -> DataFrame:
    """The long form pivoted to one column per period, zero-filled.

    The columns are all periods of the years that the orders span. A caller that lists the periods gets these columns,
    and `p_other` with what lies outside them, so that no purchase is lost.
    """
    wide = customer_periods(orders, period).withColumn("period", F.date_format("period", "yyyy_MM"))
    names = [p.strftime("%Y_%m") for p in (spanned_periods(orders, period) if periods is None else periods)]
    if periods is not None:
        listed = F.col("period").isin(names)
        wide = wide.withColumn("period", F.when(listed, F.col("period")).otherwise("other"))
        names = [*names, "other"]
    pivoted = wide.groupBy("customer_id").pivot("period", names).agg(F.sum("purchase_count"))
    return pivoted.na.fill(0).withColumnsRenamed({name: f"p_{name}" for name in names})


def _active(orders: DataFrame, period: str) -> DataFrame:
    start = period_start(F.col("order_date"), period)
    known = F.col("customer_id").isNotNull() & F.col("order_date").isNotNull() & F.col("order_id").isNotNull()
    return orders.where(known).select("customer_id", start.alias("period")).distinct()


def _present_periods(active: DataFrame) -> DataFrame:
    """Periods with any activity and the one that follows each; bounded by the calendar.

    Counting customers, rather than taking distinct periods, keeps the grouping below intact, so
    Spark reuses its shuffle instead of reading the orders again.
    """
    counted = active.groupBy("period").agg(F.count("*").alias("n")).where("n > 0")
    return counted.select("period", F.lead("period").over(Window.orderBy("period")).alias("following"))


def _lapses(orders: DataFrame, period: str) -> DataFrame:
    """Active (customer, period) rows, flagged when the customer skips the following one."""
    active = _active(orders, period)
    periods = F.broadcast(_present_periods(active))
    per_customer = Window.partitionBy("customer_id").orderBy("period")
    seen = active.withColumn("next_active", F.lead("period").over(per_customer))
    lapsed = F.col("following").isNotNull() & ~F.col("next_active").eqNullSafe(F.col("following"))
    return seen.join(periods, "period").withColumn("lapsed", lapsed)


def churned_customers(orders: DataFrame, period: str, of: date | None = None) -> DataFrame:
    """Customers active in one period and absent in the next period that has data.

    `of` keeps the customers lost in the period that starts on that date.
    """
    lapses = _lapses(orders, period).where("lapsed")
    churned = lapses.select("customer_id", F.col("following").alias("period"))
    return churned if of is None else churned.where(F.col("period") == of)


def churn_rate(orders: DataFrame, period: str) -> DataFrame:
    """Customers lost per hundred active in the previous period, to three places half-even."""
    counts = (
        _lapses(orders, period)
        .groupBy("period")
        .agg(F.count("*").alias("active_customers"), F.count_if("lapsed").alias("lost"))
    )
    order = Window.orderBy("period")
    lost = F.lag("lost").over(order)
    rate = percent(lost, F.lag("active_customers").over(order))
    return counts.select(
        "period",
        "active_customers",
        F.coalesce(lost, F.lit(0)).alias("churned_customers"),
        F.bround(rate, 3).alias("churn_rate"),
    )


def cohort_retention(orders: DataFrame, period: str) -> DataFrame:
    """Share of each first-purchase cohort active again after so many periods."""
    active = _active(orders, period)
    first = F.min("period").over(Window.partitionBy("customer_id"))
    age = period_number(F.col("period"), period) - period_number(F.col("cohort"), period)
    cells = (
        active.withColumn("cohort", first)
        .groupBy("cohort", age.alias("cohort_index"))
        .agg(F.count("*").alias("customers"))
    )
    # Cells are bounded by the calendar; every cohort gets every index that occurs.
    indexes = cells.agg(F.collect_set("cohort_index")).scalar()
    grid = cells.where("cohort_index = 0").select(
        "cohort", F.col("customers").alias("cohort_size"), F.explode(indexes).alias("cohort_index")
    )
    filled = grid.join(cells, ["cohort", "cohort_index"], "left")
    customers = F.coalesce("customers", F.lit(0))
    return filled.select(
        "cohort",
        "cohort_index",
        customers.alias("customers"),
        ratio(customers, F.col("cohort_size")).alias("retention"),
    )
