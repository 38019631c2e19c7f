"""Cleaning of invoice lines, product listings and web behaviour, and column profiles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.categories import category_levels
from ..functions.numbers import micros, zero

# --- retail -----------------------------------------------------------------------


def clean_retail(
    raw: DataFrame,
    dropped_customers: list[int] = fixed.GENERIC_COUNTRY_CUSTOMERS,
    country_aliases: dict[str, str] = fixed.COUNTRY_ALIASES,
    bad_prices: list[float] = fixed.BAD_DEBT_PRICES,
    dropped_stock_codes: list[str] = fixed.NON_PRODUCT_STOCK_CODES,
    dropped_invoices: list[str] = fixed.FAULTY_INVOICES,
    stock_aliases: dict[str, str] = fixed.POSTAGE_STOCK_CODES,
    description_aliases: dict[str, str] = fixed.POSTAGE_DESCRIPTIONS,
) -> DataFrame:
    """Distinct, valid invoice lines with their date, time and total price.

    Every rule but the removal of duplicates is a filter or a projection of the scan.
    """

    def keep(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    lines = raw.where(
        keep(F.col("customer_id").isin(dropped_customers))
        & keep(~F.col("invoice_no").startswith("C") & (F.col("quantity") < 0))
        & keep(F.col("customer_id").isNull() & (F.col("unit_price") == 0))
        & keep(F.col("unit_price").isin(bad_prices))
        & keep(F.col("stock_code").isin(dropped_stock_codes))
        & keep(F.col("invoice_no").isin(dropped_invoices))
    )
    lines = lines.na.replace(country_aliases, subset=["country"]).distinct()
    lines = lines.na.replace(stock_aliases, subset=["stock_code"])
    lines = lines.na.replace(description_aliases, subset=["description"])
    return lines.withColumns(
        {
            "invoice_date": F.to_date("invoice_ts"),
            "invoice_time": F.date_format("invoice_ts", "HH:mm:ss"),
            "total_price": F.round(F.col("quantity") * F.col("unit_price"), 2),
        }
    ).drop("invoice_ts")


def retail_outliers(
    lines: DataFrame,
    descriptions: list[str] = fixed.OUTLIER_DESCRIPTIONS,
    quantities: list[int] = fixed.OUTLIER_QUANTITIES,
) -> DataFrame:
    """Lines without service descriptions, quantity outliers and the lowest remaining price.

    A missing customer becomes number 0; a missing description is no service and stays.
    """
    known = lines.withColumn("customer_id", F.coalesce("customer_id", F.lit(0)))
    service = F.coalesce(F.col("description").isin(descriptions), F.lit(False))
    kept = known.where(~service & ~F.col("quantity").isin(quantities))
    lowest = kept.agg(F.min("unit_price")).scalar()
    return kept.where(F.col("unit_price") != lowest)


# --- listings ---------------------------------------------------------------------

LISTING_TEXT = ["product_link", "img_link", "review_content", "review_title", "about_product"]
CATEGORY_DEPTH = 7


def formatted_number(text: Column) -> Column:
    """Number in a text with thousands commas, null when there is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def clean_listings(raw: DataFrame) -> DataFrame:
    """Distinct listings with numeric prices, rating and discount and up to seven category levels."""
    valid = raw.drop(*LISTING_TEXT).where(
        F.col("rating_count").isNotNull() & ~F.coalesce(F.col("rating").contains("|"), F.lit(False))
    )
    parts = F.split("category", r"\|")

    def price(name):
        # The first character is the currency.
        return formatted_number(F.substring(F.col(name), 2, 1_000))

    discount = F.replace(F.col("discount_percentage"), F.lit("%"), F.lit("")).try_cast("double") / 100.0
    return (
        valid.distinct()
        .withColumns(
            {
                "discounted_price": price("discounted_price"),
                "actual_price": price("actual_price"),
                "rating": formatted_number(F.col("rating")),
                "rating_count": F.coalesce(formatted_number(F.col("rating_count")).cast("bigint"), F.lit(0)),
                "discount_percentage": discount,
                **{f"category_{i + 1}": F.get(parts, F.lit(i)) for i in range(CATEGORY_DEPTH)},
            }
        )
        .drop("category")
    )


# --- web behaviour ----------------------------------------------------------------


def behavior_table(products: DataFrame) -> DataFrame:
    """Visit, hit and product in one flat row; needs products that carry session totals."""
    return products.select(
        F.col("full_visitor_id").alias("users"),
        F.col("session_visit_number").alias("visit_number"),
        "visit_id",
        "date",
        F.col("session_visit_start_time").alias("start_time"),
        "action",
        "transaction_id",
        "transaction_revenue",
        F.col("session_hit_count").alias("num_hits"),
        F.col("session_pageviews").alias("pageviews"),
        F.col("session_time_on_site").alias("time_on_site"),
        F.col("session_session_quality").alias("session_quality"),
        F.col("session_total_transaction_revenue").alias("totals_revenue"),
        F.col("session_transactions").alias("transactions"),
        F.col("product_price").alias("price"),
        F.col("category").alias("product_category"),
        F.col("channel").alias("medium"),
        "continent",
        F.col("sub_continent").alias("subcontinent"),
        "country",
        "region",
    )


def clean_behavior(behavior: DataFrame) -> DataFrame:
    """Category levels with blank placeholders, money in units, quality and transactions filled."""
    return behavior.withColumns(
        {
            **category_levels(F.col("product_category"), placeholder=""),
            "totals_revenue": micros(F.col("totals_revenue")),
            "transaction_revenue": micros(F.col("transaction_revenue")),
            "price": micros(F.col("price")),
            "session_quality": F.coalesce("session_quality", F.lit(-1).cast("bigint")),
            "transactions": zero(F.col("transactions")),
        }
    ).drop("product_category")


# --- profiles ---------------------------------------------------------------------


def null_counts(df: DataFrame) -> DataFrame:
    """Rows and nulls of every column, in one pass."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in df.columns])
    cells = [F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"n_{c}")).alias("nulls")) for c in df.columns]
    return counts.select("rows", F.explode(F.array(*cells)).alias("cell")).select("cell.*", "rows")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Every value of a column with its number of rows."""
    return df.groupBy(column).agg(F.count("*").alias("rows"))


def date_span(df: DataFrame, column: str) -> DataFrame:
    first, last = F.min(column), F.max(column)
    return df.agg(first.alias("first"), last.alias("last"), F.datediff(last, first).cast("bigint").alias("days"))


def first_characters(df: DataFrame, column: str) -> DataFrame:
    """Rows per first character, to see whether one currency or prefix is used throughout."""
    return df.groupBy(F.substring(F.col(column), 1, 1).alias("first_character")).agg(F.count("*").alias("rows"))
