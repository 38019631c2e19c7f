"""Formatted product listings derived from the part table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import table

CURRENCY = "₹"


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as text listings: currency-prefixed prices, commas, per cent signs and `|` paths."""
    parts = table(spark, folder, "part")
    size = F.col("p_size")

    def text(column):
        return column.cast("string")

    # Thousands separator of prices below one million.
    def money(amount):
        whole = F.floor(amount).cast("bigint")
        cents = F.round((amount - whole) * 100).cast("bigint")
        thousands, rest = F.floor(whole / 1000).cast("bigint"), whole % 1000
        head = F.when(whole >= 1000, F.concat(text(thousands), F.lit(","), F.lpad(text(rest), 3, "0"))).otherwise(text(rest))
        return F.concat(F.lit(CURRENCY), head, F.lit("."), F.lpad(text(cents), 2, "0"))

    return parts.select(
        text(F.col("p_partkey")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.concat_ws("|", "p_type", "p_brand", F.regexp_replace("p_name", " ", "|")).alias("category"),
        money(F.col("p_retailprice") - size).alias("discounted_price"),
        money(F.col("p_retailprice")).alias("actual_price"),
        F.concat(text(size), F.lit("%")).alias("discount_percentage"),
        F.when(size == 7, "|").otherwise(F.concat(text(size % 5), F.lit("."), text(size % 10))).alias("rating"),
        F.when(size != 9, F.concat(text(size), F.lit(","), F.lpad(text(size * 11), 3, "0"))).alias("rating_count"),
        F.lit("").alias("about_product"),
        F.lit("").alias("product_link"),
    )
