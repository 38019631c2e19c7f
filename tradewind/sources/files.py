"""File sources and sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import BEHAVIOR_CSV, LISTING_CSV, RETAIL_CSV, web_session


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_web_sessions(
    spark: SparkSession, path: str, first_day: str, last_day: str, product_fields: list[str] | None = None
) -> DataFrame:
    """Nested sessions between two `yyyyMMdd` days, both included.

    With the files laid out as `date=yyyyMMdd/`, the filter prunes folders before any read. Name the
    product fields a job needs to leave the others unread.
    """
    # Visits that were folded into several rows number these in `part`.
    schema = web_session(product_fields).add("part", T.IntegerType())
    sessions = spark.read.schema(schema).parquet(path)
    return sessions.where(F.col("date").cast("string").between(first_day, last_day))


def write_web_sessions(sessions: DataFrame, path: str) -> None:
    """One folder per day; small days are one file, large days several of about equal size."""
    sessions.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(path)


def read_retail_csv(spark: SparkSession, path: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Raw invoice lines in the column names of the retail jobs."""
    raw = spark.read.schema(RETAIL_CSV).option("header", True).csv(path)
    return raw.select(
        F.col("InvoiceNo").alias("invoice_no"),
        F.col("StockCode").alias("stock_code"),
        F.col("Description").alias("description"),
        F.col("Quantity").alias("quantity"),
        F.col("UnitPrice").alias("unit_price"),
        F.col("CustomerID").cast("bigint").alias("customer_id"),
        F.col("Country").alias("country"),
        F.try_to_timestamp("InvoiceDate", F.lit(timestamp_format)).cast("timestamp_ntz").alias("invoice_ts"),
    )


def read_listings_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTING_CSV).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


CORRUPT = "_corrupt_record"


def read_checked_csv(
    spark: SparkSession, path: str, schema: T.StructType, dates: dict[str, str], epochs: list[str]
) -> DataFrame:
    """Rows of a CSV file with typed columns, and in `refused` what is wrong with a row, null if nothing is.

    `dates` names text columns with their format, `epochs` columns of seconds; both become dates and timestamps.
    A value that cannot be read is null and gives the row its reason, `bad <column>` of the first one; a row with
    another number of columns is `malformed row`. A null value is nothing wrong.
    """
    # Columns are read as text, so that what a job does not use is checked all the same.
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    reader = spark.read.schema(text.add(CORRUPT, T.StringType())).option("header", True)
    raw = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    typed |= {name: F.try_to_timestamp(name, F.lit(form)).cast("date") for name, form in dates.items()}
    typed |= {name: F.timestamp_seconds(typed[name]).cast("timestamp_ntz") for name in epochs}
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed row")
    for name, value in typed.items():
        reason = reason.when(F.col(name).isNotNull() & value.isNull(), f"bad {name}")
    return raw.select(*[value.alias(name) for name, value in typed.items()], reason.alias("refused"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("refused").isNull()).drop("refused")


def refused_rows(checked: DataFrame) -> DataFrame:
    """Number of rows refused for each reason."""
    return checked.where(F.col("refused").isNotNull()).groupBy(F.col("refused").alias("reason")).agg(F.count("*").alias("rows"))


def read_behavior_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flattened behaviour rows, one per product of a hit, with dates and times read and checked."""
    return read_checked_csv(spark, path, BEHAVIOR_CSV, {"date": "yyyyMMdd"}, ["start_time"])


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """One Parquet data set per result name, written by the executors."""
    for name, frame in results.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)
