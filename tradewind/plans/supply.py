"""Sales velocity, stockouts, inventory policy and demand forecasts.

With `items` (`part_no`, `description`), lines are added up by item before they meet the item table; the
filter on prices is then one on the items (`sold_items`).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import (
    HOLDING_COST,
    LEAD_TIME_WEEKS,
    ORDER_COST,
    SERVICE_LEVEL_FACTOR,
    STOCKOUT_RULES,
    WEEKDAYS,
)
from ..functions.labels import weekday_name
from ..functions.numbers import money_sum, pearson, ratio
from ..functions.periods import period_start, week_end
from ..operators.eager import ITEM, sum_by
from ..operators.quantiles import exact_quantiles
from ..sources.retail import LINE_ORDER



def supply_base(lines: DataFrame) -> DataFrame:
    """Lines sold at a price to a known country; lines without prices are left to `sold_items`."""
    sold = lines.where((F.col("quantity") > 0) & (F.col("country") != "Unspecified"))
    return sold.where(F.col("unit_price") > 0) if "unit_price" in lines.columns else sold


def sold_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("unit_price") > 0)


# --- velocity ---------------------------------------------------------------------


def weekly_sales_velocity(base: DataFrame, documented: bool = False, items: DataFrame | None = None) -> DataFrame:
    """Mean over weeks of weekly quantity divided by the weeks in which the item sold.

    That divides by weeks twice; `documented=True` gives total quantity per selling week instead.
    The window sees one row per item, description and week.
    """
    known = base.where(F.col("stock_code").isNotNull()).withColumn("week", period_start(F.col("invoice_date"), "week"))
    if items is None:
        known = known.where(F.col("description").isNotNull())
    else:
        items = items.where(F.col("description").isNotNull())
    weekly = sum_by(known, ["stock_code", "description", "week"], {"quantity": F.col("quantity")}, items)
    return _velocity(weekly, documented)


def _velocity(weekly: DataFrame, documented: bool) -> DataFrame:
    item = Window.partitionBy("stock_code")
    ranked = weekly.withColumn("week_rank", F.dense_rank().over(item.orderBy("week")))
    ranked = ranked.withColumn("item_weeks", F.max("week_rank").over(item))
    divisor = F.max("item_weeks") if documented else F.count("*") * F.max("item_weeks")
    return ranked.groupBy("stock_code", "description").agg(
        ratio(F.sum("quantity"), divisor).alias("sales_velocity")
    )


def velocity_tier(velocity: DataFrame) -> DataFrame:
    """High above the third quartile, Low below the first, else Medium."""
    quartiles = exact_quantiles(velocity, "sales_velocity", {"q1": 0.25, "q3": 0.75})
    bounded = velocity.withColumn("bounds", quartiles.select(F.struct("q1", "q3")).scalar())
    speed = F.col("sales_velocity")
    label = F.when(speed > F.col("bounds.q3"), "High").when(speed < F.col("bounds.q1"), "Low").otherwise("Medium")
    return bounded.withColumn("tier", label).drop("bounds")


# --- stockouts --------------------------------------------------------------------


def item_days(base: DataFrame, items: DataFrame | None = None, with_first: bool = True) -> DataFrame:
    """Quantity and, if asked for, the first line of every item, description and day."""
    own = ["stock_code", "description"] if items is None else [ITEM, "stock_code"]
    sums = [F.sum("quantity").alias("quantity")]
    if with_first:
        sums.append(F.min(F.struct(*LINE_ORDER, "country")).alias("first"))
    days = base.where(F.col("stock_code").isNotNull()).groupBy(*own, "invoice_date").agg(*sums)
    return days if items is None else days.join(items.select(ITEM, "description"), ITEM)


def purchase_gaps(base: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Lines that follow the item's previous line by at least a day, with the days between.

    Only the first line of an item's day can have a gap, so lines are reduced to one per item and
    day before the window.
    """
    return _gaps(item_days(base, items))


def _gaps(item_days: DataFrame) -> DataFrame:
    days = item_days.select("stock_code", "invoice_date").distinct()
    if "first" in item_days.columns:
        first = F.min("first")["country"].alias("country")
        days = item_days.groupBy("stock_code", "invoice_date").agg(first)
    previous = F.lag("invoice_date").over(Window.partitionBy("stock_code").orderBy("invoice_date"))
    gap = F.datediff("invoice_date", previous).cast("bigint")
    return days.withColumn("time_gap", gap).where(F.col("time_gap") > 0)


def _tier_gaps(base: DataFrame, rules: list[tuple], items: DataFrame | None, with_country: bool) -> DataFrame:
    """Gap lines of the items in each tier that have enough of them, flagged as stockouts.

    Velocities and gaps come from the same days. Both branches ask for all columns, none of which is ever null:
    with a column less, Spark would plan another aggregate and read the lines again.
    """
    spark = base.sparkSession
    dim = spark.createDataFrame([(t, int(n), int(d)) for t, n, d in rules], "tier string, min_lines bigint, days bigint")
    days = item_days(base, items, with_country).where(F.col("quantity").isNotNull())
    if with_country:
        days = days.where(F.col("first").isNotNull())
    sold = days.where(F.col("description").isNotNull())
    week = period_start(F.col("invoice_date"), "week")
    weekly = sold.groupBy("stock_code", "description", week.alias("week")).agg(F.sum("quantity").alias("quantity"))
    tiers = velocity_tier(_velocity(weekly, False)).select("stock_code", "tier").distinct()
    # `dim` has one row per tier.
    joined = _gaps(days).join(tiers, "stock_code").join(F.broadcast(dim), "tier")
    lines = F.count("*").over(Window.partitionBy("stock_code", "tier"))
    kept = joined.withColumn("lines", lines).where(F.col("lines") > F.col("min_lines"))
    return kept.withColumn("stockout", F.col("time_gap") > F.col("days"))


def stockout_rate(
    base: DataFrame, rules: list[tuple] = STOCKOUT_RULES, items: DataFrame | None = None
) -> DataFrame:
    """Share of an item's gap lines that look like a stockout, where there is any."""
    found = _tier_gaps(base, rules, items, False).groupBy("tier", "stock_code").agg(
        F.count("*").alias("total_purchases"), F.count_if("stockout").alias("total_stockouts")
    )
    rate = ratio(F.col("total_stockouts"), F.col("total_purchases"))
    return found.where(F.col("total_stockouts") > 0).withColumn("stockout_rate", rate)


def stockout_tier_mean(
    base: DataFrame, rules: list[tuple] = STOCKOUT_RULES, items: DataFrame | None = None
) -> DataFrame:
    return stockout_rate(base, rules, items).groupBy("tier").agg(F.avg("stockout_rate").alias("mean_stockout_rate"))


# --- countries --------------------------------------------------------------------


def country_quantity(base: DataFrame, items: DataFrame | None = None) -> DataFrame:
    sums = sum_by(base, ["country"], {"quantity": F.col("quantity")}, items)
    return sums.withColumn("log_quantity", F.log(F.col("quantity").cast("double")))


def country_stockout(
    base: DataFrame, rules: list[tuple] = STOCKOUT_RULES, items: DataFrame | None = None
) -> DataFrame:
    return _tier_gaps(base, rules, items, True).groupBy("country").agg(
        ratio(F.count_if("stockout"), F.count("*")).alias("stockout_rate"),
        F.avg("time_gap").alias("avg_time_gap"),
    )


def country_summary(base: DataFrame, items: DataFrame | None = None) -> DataFrame:
    sold = sum_by(base, ["country", "stock_code"], {"quantity": F.col("quantity")}, items)
    return sold.groupBy("country").agg(
        F.sum("quantity").alias("total_quantity"),
        F.avg("quantity").alias("avg_quantity_per_item"),
        F.count("*").alias("items"),
    )


def stockout_quantity_corr(
    base: DataFrame, rules: list[tuple] = STOCKOUT_RULES, items: DataFrame | None = None
) -> DataFrame:
    joined = country_stockout(base, rules, items).join(country_summary(base, items), "country")
    return joined.agg(pearson(F.col("stockout_rate"), F.col("total_quantity")).alias("correlation"))


# --- items and customers ----------------------------------------------------------


def _item_quantity(base: DataFrame, items: DataFrame | None) -> DataFrame:
    return sum_by(base, ["stock_code"], {"quantity": F.col("quantity")}, items)


def top_items(base: DataFrame, n: int = 10, items: DataFrame | None = None) -> DataFrame:
    return _item_quantity(base, items).orderBy(F.desc("quantity"), "stock_code").limit(n)


def underperforming_items(base: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Items that sold less than the first quartile."""
    sold = _item_quantity(base, items)
    bound = exact_quantiles(sold, "quantity", {"q1": 0.25}).scalar()
    return sold.where(F.col("quantity") < bound)


def customer_value(base: DataFrame) -> DataFrame:
    """Spending and line count per known customer, highest spending first."""
    known = base.where(F.col("customer_id").isNotNull())
    sums = known.groupBy("customer_id").agg(
        money_sum(F.col("total_price")).alias("total_spending"), F.count("*").alias("frequency")
    )
    return sums.orderBy(F.desc("total_spending"), "customer_id")


# --- order times ------------------------------------------------------------------


def _lines_by(base: DataFrame, name: str, value: Column, items: DataFrame | None) -> DataFrame:
    return sum_by(base.withColumn(name, value), [name], {"lines": F.lit(1).cast("bigint")}, items)


def orders_by_hour(base: DataFrame, items: DataFrame | None = None) -> DataFrame:
    return _lines_by(base, "hour", F.hour("invoice_ts").cast("bigint"), items)


def orders_by_weekday(base: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Lines per weekday, Monday first; a day without lines shows zero."""
    counts = _lines_by(base, "weekday", weekday_name(F.col("invoice_date")), items).withColumnRenamed("lines", "n")
    days = base.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "day_no bigint, weekday string")
    # Seven rows on either side.
    joined = days.join(F.broadcast(counts), "weekday", "left")
    return joined.select("day_no", "weekday", F.coalesce("n", F.lit(0)).alias("lines")).orderBy("day_no")


def orders_by_month(base: DataFrame, items: DataFrame | None = None) -> DataFrame:
    return _lines_by(base, "month", F.month("invoice_ts").cast("bigint"), items)


# --- inventory --------------------------------------------------------------------


def weekly_demand_stats(lines: DataFrame) -> DataFrame:
    """Total, mean and deviation of weekly quantity per item; returns count as negative demand."""
    week = period_start(F.col("invoice_date"), "week")
    weekly = lines.groupBy("stock_code", week.alias("week")).agg(F.sum("quantity").alias("quantity"))
    return weekly.groupBy("stock_code").agg(
        F.sum("quantity").alias("total_demand"),
        F.avg("quantity").alias("avg_weekly_demand"),
        F.stddev_samp("quantity").alias("demand_std"),
    )


def inventory_policy(
    lines: DataFrame,
    order_cost: float = ORDER_COST,
    holding_cost: float = HOLDING_COST,
    service_factor: float = SERVICE_LEVEL_FACTOR,
    lead_weeks: float = LEAD_TIME_WEEKS,
) -> DataFrame:
    """Economic order quantity, safety stock and reorder point of items with varying demand."""
    demand = F.col("total_demand")
    order = F.when(demand > 0, F.sqrt(demand * (2.0 * order_cost) / float(holding_cost))).otherwise(0.0)
    safety = F.col("demand_std") * float(service_factor) * F.sqrt(F.lit(float(lead_weeks)))
    stats = weekly_demand_stats(lines).withColumns({"eoq": order, "safety_stock": F.coalesce(safety, F.lit(0.0))})
    stats = stats.withColumn("reorder_point", F.col("avg_weekly_demand") * float(lead_weeks) + F.col("safety_stock"))
    return stats.where((F.col("demand_std") > 0) & (F.col("avg_weekly_demand") > 0)).orderBy(
        F.desc("total_demand"), "stock_code"
    )


# --- forecast ---------------------------------------------------------------------


def item_series(lines: DataFrame) -> DataFrame:
    """The weekly series of every item as one row: its first week (named by its Sunday) and the `quantities` from
    there to its last week, zero in weeks without lines.

    What is gathered are an item's weeks with lines; each also stands for the empty weeks up to the next one, so
    the series needs no join against a calendar.
    """
    start = week_end(F.col("invoice_date"))
    weekly = lines.groupBy("stock_code", start.alias("start")).agg(F.sum("quantity").alias("quantity"))
    # Added up first, then moved by item once: a week's partial lists would be no smaller than its row.
    weekly = weekly.where(F.col("start").isNotNull()).repartition("stock_code")
    items = weekly.groupBy("stock_code").agg(F.sort_array(F.collect_list(F.struct("start", "quantity"))).alias("weeks"))

    def run(week, i):
        days = F.datediff(F.get("weeks", i + 1)["start"], week["start"])
        empty = F.coalesce((days / 7).cast("int"), F.lit(1)) - 1
        return F.concat(F.array(week["quantity"]), F.array_repeat(F.lit(0).cast("bigint"), empty))

    quantities = F.flatten(F.transform("weeks", run))
    return items.select("stock_code", F.get("weeks", F.lit(0))["start"].alias("first_week"), quantities.alias("quantities"))


def weekly_series(lines: DataFrame) -> DataFrame:
    """Quantity per item and calendar week (named by its Sunday), zero in weeks without lines."""
    # No array is empty; of a plain explode Spark would make a filter that works all arrays out once more.
    quantity = F.posexplode_outer("quantities").alias("week", "quantity")
    weeks = item_series(lines).select("stock_code", "first_week", quantity)
    return weeks.select("stock_code", F.expr("date_add(first_week, 7 * week)").alias("week_end"), "quantity")


def _array_sum(array: Column, value=lambda x: x) -> Column:
    """Sum of the values that are not null, zero without any."""
    return F.aggregate(array, F.lit(0.0), lambda so_far, x: so_far + F.coalesce(value(x), F.lit(0.0)))


def _array_mean(array: Column) -> Column:
    """Mean of the values that are not null, null without any."""
    def sums(total, n):
        return F.named_struct(F.lit("total"), total, F.lit("n"), n)

    def add(so_far, x):
        return sums(so_far["total"] + F.coalesce(x, F.lit(0.0)), so_far["n"] + x.isNotNull().cast("int"))

    return F.aggregate(array, sums(F.lit(0.0), F.lit(0)), add, lambda found: ratio(found["total"], found["n"]))


def demand_forecast(lines: DataFrame, weeks_ahead: int = 52, recent_weeks: int = 10, band: float = 1.28) -> DataFrame:
    """Weekly forecast per item from a linear trend and the mean residual of each week of the year.

    The forecast is shifted so that its mean equals the mean of the last observed weeks, then cut at
    zero; the band is the same shift of plus and minus `band` residual deviations. An item's series is
    one row, at most one number per calendar week, and every step from there on works within the row: nothing
    is shuffled, sorted or grouped after the series.
    """
    n = F.size("quantities")
    series = item_series(lines).withColumns(
        {
            "last_week": F.date_add("first_week", 7 * (n - 1)),
            "points": F.filter(
                F.transform("quantities", lambda q, i: F.named_struct(F.lit("t"), i.cast("double"), F.lit("y"), q.cast("double"))),
                lambda p: p["y"].isNotNull(),
            ),
        }
    )
    points = F.col("points")
    series = series.withColumns(
        {
            "mean_t": ratio(_array_sum(points, lambda p: p["t"]), F.size("points")),
            "mean_y": ratio(_array_sum(points, lambda p: p["y"]), F.size("points")),
        }
    )
    off_t = lambda p: p["t"] - F.col("mean_t")
    covariance = _array_sum(points, lambda p: off_t(p) * (p["y"] - F.col("mean_y")))
    slope = F.coalesce(ratio(covariance, _array_sum(points, lambda p: off_t(p) * off_t(p))), F.lit(0.0))
    series = series.withColumn("slope", slope).withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_t"))
    residual = lambda q, i: q.cast("double") - F.col("intercept") - F.col("slope") * i.cast("double")
    fitted = series.withColumn("residuals", F.transform("quantities", residual))

    total = _array_sum(F.col("residuals"))
    spread = _array_sum(F.col("residuals"), lambda r: r * r) - total * total / n
    recent = F.slice("quantities", F.greatest(n - recent_weeks + 1, F.lit(1)), recent_weeks)
    known = F.filter(recent, lambda q: q.isNotNull())
    # Where the first week of each year of weeks lies in the series, the year after the last included.
    thursday_year = [F.year(F.date_sub(c, 3)) for c in ("first_week", "last_week")]
    year_start = lambda y: F.datediff(week_end(F.make_date(y, F.lit(1), F.lit(4))), "first_week") / 7
    models = fitted.withColumns(
        {
            "sigma": F.coalesce(F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), n - 1.0)), F.lit(0.0)),
            "observed_mean": F.when(F.size(known) > 0, ratio(_array_sum(known), F.size(recent))),
            "years": F.transform(F.sequence(thursday_year[0], thursday_year[1] + 1), lambda y: year_start(y).cast("int")),
        }
    )

    def season(week_of_year):
        def residual_of(year):
            place = F.get("years", year) + week_of_year - 1
            return F.when(place < F.get("years", year + 1), F.get("residuals", place))

        return _array_mean(F.transform(F.sequence(F.lit(0), F.size("years") - 2), residual_of))

    def ahead(step):
        week_of_year = F.weekofyear(F.date_add("last_week", 7 * step))
        return F.col("intercept") + F.col("slope") * (n - 1 + step) + F.coalesce(season(week_of_year), F.lit(0.0))

    yhat = F.transform(F.sequence(F.lit(1), F.lit(weeks_ahead)), ahead)
    bias = _array_mean(F.col("yhat")) - F.col("observed_mean")
    shifted = models.withColumn("yhat", yhat).withColumn("bias", bias)
    # Outer, as in `weekly_series`.
    weeks = F.posexplode_outer("yhat").alias("week", "yhat")
    future = shifted.select("stock_code", "last_week", "sigma", "bias", weeks).withColumn("level", F.col("yhat") - F.col("bias"))

    def cut(value):
        return F.greatest(value, F.lit(0.0))

    return future.select(
        "stock_code",
        F.expr("date_add(last_week, 7 * (week + 1))").alias("week_end"),
        cut(F.col("level")).alias("forecast"),
        cut(F.col("level") - band * F.col("sigma")).alias("lower"),
        cut(F.col("level") + band * F.col("sigma")).alias("upper"),
    )
