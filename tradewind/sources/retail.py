"""Retail invoice lines from the order tables.

Every order line becomes an invoice line; a returned line becomes a cancellation (`C` invoice,
negative quantity, dated by its shipping date). Only the tables that the requested columns come
from are joined: each foreign key has exactly one match, so leaving a join out changes no row.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import table

# Keys start at 0, which the impulse analysis keeps for a missing customer.
CUSTOMER_SHIFT = 1
UNKNOWN_CUSTOMER_EVERY = 53

PART_COLUMNS = {"description", "unit_price", "total_price"}
ORDER_COLUMNS = {"invoice_ts", "invoice_date", "customer_id"}
PLACE_COLUMNS = {"country", "hemisphere"}
HEMISPHERES = {"AMERICA": "south", "AFRICA": "equator"}

# Total order of the lines: no two lines agree on all of these.
LINE_ORDER = ["invoice_ts", "invoice_no", "line_no", "part_no", "line_quantity"]


def _orders(spark: SparkSession, folder: str, with_place: bool) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if not with_place:
        return orders
    region = table(spark, folder, "region")
    # Nations and regions are fixed lists of 25 and 5 rows.
    place = table(spark, folder, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    hemisphere = F.lit("north")
    for name, half in HEMISPHERES.items():
        hemisphere = F.when(F.col("r_name") == name, half).otherwise(hemisphere)
    place = place.select("n_nationkey", F.col("n_name").alias("country"), hemisphere.alias("hemisphere"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    customers = customers.join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def retail_lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Invoice lines with the named columns (see `LINE_COLUMNS`)."""
    wanted = set(columns)
    lines = table(spark, folder, "lineitem")
    if wanted & (ORDER_COLUMNS | PLACE_COLUMNS):
        orders = _orders(spark, folder, bool(wanted & PLACE_COLUMNS))
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if wanted & PART_COLUMNS:
        parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(*[LINE_COLUMNS[name]().alias(name) for name in columns])


def retail_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items that lines name in `part_no`, one row each, for jobs that add up lines before they join."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("part_no"), F.col("p_name").alias("description"), F.col("p_retailprice").alias("unit_price")
    )


def retail_invoices(spark: SparkSession, folder: str) -> DataFrame:
    """One row per purchase invoice, without cancellations.

    Lines are reduced to invoices before the join with their orders, by the tasks that scan them;
    the result is already partitioned for that join.
    """
    sold = table(spark, folder, "lineitem").where(~_returned()).select("l_orderkey").distinct()
    orders = _orders(spark, folder, False)
    return sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("invoice_no"),
        _customer().alias("customer_id"),
        F.to_date(_purchase_ts()).alias("invoice_date"),
    )


def spending_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines at their price before discount, each followed by a `D` line for its discount.

    Both come from one scan and one join.
    """
    lines = table(spark, folder, "lineitem")
    lines = lines.join(_orders(spark, folder, False), F.col("l_orderkey") == F.col("o_orderkey"))
    # Decimals, so that half a cent rounds the same way everywhere.
    price = F.col("l_extendedprice").cast("decimal(16,2)")
    saved = F.round(price * F.col("l_discount").cast("decimal(4,2)"), 2)

    def entry(stock_code, quantity, amount):
        return F.struct(
            stock_code.alias("stock_code"), quantity.alias("quantity"), amount.cast("double").alias("total_price")
        )

    bought = entry(F.col("l_partkey").cast("string"), _quantity(), price)
    discount = entry(F.lit("D"), F.lit(-1).cast("bigint"), -saved)
    entries = F.when(F.col("l_discount") > 0, F.array(bought, discount)).otherwise(F.array(bought))
    return lines.select(_customer().alias("customer_id"), F.explode(entries).alias("e")).select("customer_id", "e.*")


def _returned():
    return F.col("l_returnflag") == "R"


def _invoice_no():
    return F.concat(F.when(_returned(), "C").otherwise(""), F.col("l_orderkey").cast("string"))


def _quantity():
    units = F.col("l_quantity").cast("bigint")
    return F.when(_returned(), -units).otherwise(units)


def _opening_hours():
    return F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 13 + 7).cast("int"))


def _purchase_ts():
    return F.col("o_orderdate") + _opening_hours()


def _invoice_ts():
    return F.when(_returned(), F.col("l_shipdate")).otherwise(F.col("o_orderdate")) + _opening_hours()


def _customer():
    known = F.col("l_orderkey") % UNKNOWN_CUSTOMER_EVERY != 0
    return F.when(known, F.col("o_custkey") + CUSTOMER_SHIFT)


LINE_COLUMNS = {
    "invoice_no": _invoice_no,
    "stock_code": lambda: F.col("l_partkey").cast("string"),
    "description": lambda: F.col("p_name"),
    "quantity": _quantity,
    "unit_price": lambda: F.col("p_retailprice"),
    "paid_price": lambda: F.round(F.col("l_extendedprice") / F.col("l_quantity") / 100.0) * 100.0,
    "total_price": lambda: F.round(_quantity() * F.col("p_retailprice"), 2),
    "invoice_ts": _invoice_ts,
    "invoice_date": lambda: F.to_date(_invoice_ts()),
    "customer_id": _customer,
    "country": lambda: F.col("country"),
    "hemisphere": lambda: F.col("hemisphere"),
    "line_no": lambda: F.col("l_linenumber"),
    "part_no": lambda: F.col("l_partkey"),
    "line_quantity": lambda: F.col("l_quantity"),
}
