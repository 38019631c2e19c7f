"""Churn and cohort jobs over retail invoices and over web purchases."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio


def retail_orders(lines: DataFrame) -> DataFrame:
    """Invoices without cancellations, in the shape the retention operators take."""
    return lines.where(~F.col("invoice_no").startswith("C")).select(
        "customer_id", F.col("invoice_date").alias("order_date"), F.col("invoice_no").alias("order_id")
    )


def web_orders(hits: DataFrame) -> DataFrame:
    """Web transactions with revenue, in the shape the retention operators take."""
    return hits.where(F.col("transaction_revenue") > 0).select(
        F.col("full_visitor_id").alias("customer_id"),
        F.to_date("date", "yyyyMMdd").alias("order_date"),
        F.col("transaction_id").alias("order_id"),
    )


def monthly_churn_by_country(lines: DataFrame, idle_days: int = 30) -> DataFrame:
    """Lines followed by more than `idle_days` without another line of the customer, per country.

    Only the last line of a customer's day can be followed by such a gap; of lines at the same time, the last by
    invoice and line number counts. Lines are first reduced to invoices, by counters that a hash aggregate
    holds, then to one row per customer, day and country, which carries all that both counts need: one scan,
    and windows over at most the days of the calendar.
    """
    lines = lines.withColumn("country", F.coalesce("country", F.lit("Unknown")))
    invoices = lines.groupBy("customer_id", "invoice_date", "country", "invoice_ts", "invoice_no").agg(
        F.count("*").alias("lines"), F.max("line_no").alias("line_no")
    )
    order = F.struct("invoice_ts", "invoice_no", "line_no")
    days = invoices.groupBy("customer_id", "invoice_date", "country").agg(
        F.sum("lines").alias("lines"), F.min("invoice_ts").alias("first_ts"), F.max(order).alias("last_line")
    )
    # One shuffle by customer serves both windows.
    days = days.repartition("customer_id")
    first_of_day = F.min("first_ts").over(Window.partitionBy("customer_id", "invoice_date"))
    customer = Window.partitionBy("customer_id").orderBy("invoice_date", "last_line")
    days = days.withColumn("day_first_ts", first_of_day).withColumns(
        {
            "next_date": F.lead("invoice_date").over(customer),
            "next_ts": F.lead("day_first_ts").over(customer),
        }
    )
    idle = F.timestamp_diff("DAY", F.col("last_line.invoice_ts"), F.col("next_ts"))
    last_of_day = F.col("next_date") > F.col("invoice_date")
    churned = F.count_if(F.col("customer_id").isNotNull() & last_of_day & (idle > idle_days))
    counts = days.groupBy(F.trunc("invoice_date", "month").alias("month"), "country").agg(
        F.sum("lines").alias("lines"), F.nullif(churned, F.lit(0)).alias("churned_lines")
    )
    return counts.select("month", "country", ratio(F.col("churned_lines"), F.col("lines")).alias("churn_rate"))
