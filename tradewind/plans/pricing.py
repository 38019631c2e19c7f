"""Price elasticity, competition and suggested prices.

Everything is computed from one row per description and price, which carries the number of lines
and the quantity; the windows over a description are bounded by its distinct prices. With `items`
(`part_no`, `description`), the lines have no description and are added up by item first.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import PRICE_CAP
from ..functions.labels import price_step
from ..functions.numbers import ratio
from ..operators.eager import sum_by
from ..operators.quantiles import exact_quantiles
from ..operators.skew import join_keyed

MIN_LINES = 10


def sold_lines(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("quantity") > 0) & (F.col("unit_price") > 0) & F.col("description").isNotNull())


def pricing_base(lines: DataFrame, key: list[str], min_lines: int = MIN_LINES) -> DataFrame:
    """Sold lines of the descriptions that have enough of them.

    `key` names the columns that tell the lines apart. The lines of a hot description are spread by them,
    as equal lines, spread by their values, would all meet in one task.
    """
    sold = sold_lines(lines)
    counts = sold.groupBy("description").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    frequent = counts.where(F.col("n") >= min_lines)
    return join_keyed(sold, frequent, ["description"], "n", total, key).drop("n", *key)


def sold_by(lines: DataFrame, keys: list[str], items: DataFrame | None) -> DataFrame:
    """Quantity and number of the sold lines by `keys`."""
    sums = {"quantity": F.col("quantity"), "lines": F.lit(1).cast("bigint")}
    if items is None:
        return sum_by(sold_lines(lines), keys, sums)
    sold = lines.where((F.col("quantity") > 0) & (F.col("unit_price") > 0))
    return sum_by(sold, keys, sums, items.where(F.col("description").isNotNull()))


def _price_rows(lines: DataFrame, min_lines: int, items: DataFrame | None) -> DataFrame:
    rows = sold_by(lines, ["description", "unit_price"], items)
    total = F.sum("lines").over(Window.partitionBy("description"))
    return rows.withColumn("description_lines", total).where(F.col("description_lines") >= min_lines)


def price_points(lines: DataFrame, min_lines: int = MIN_LINES, items: DataFrame | None = None) -> DataFrame:
    return _price_rows(lines, min_lines, items).select("description", "unit_price", "quantity")


def _summaries(lines: DataFrame, min_lines: int, max_elasticity: float, items: DataFrame | None) -> DataFrame:
    """Elasticity, quantity and mean price per description, in one grouping."""
    by_price = Window.partitionBy("description").orderBy("unit_price")

    def change(column):
        return F.try_divide(F.col(column).cast("double"), F.lag(column).over(by_price).cast("double")) - 1.0

    rows = _price_rows(lines, min_lines, items)
    rows = rows.withColumn("elasticity", F.abs(F.try_divide(change("quantity"), change("unit_price"))))
    valid = F.when(F.col("elasticity") < max_elasticity, F.col("elasticity"))
    paid = F.sum(F.col("unit_price").cast("decimal(18,2)") * F.col("lines").cast("decimal(18,0)"))
    return rows.groupBy("description").agg(
        F.avg(valid).alias("price_elasticity"),
        F.sum("quantity").alias("total_quantity"),
        ratio(paid, F.sum("lines")).alias("avg_unit_price"),
    )


def product_summary(lines: DataFrame, min_lines: int = MIN_LINES, items: DataFrame | None = None) -> DataFrame:
    return _summaries(lines, min_lines, 10, items).drop("price_elasticity")


def _elastic(lines: DataFrame, min_lines: int, max_elasticity: float, items: DataFrame | None) -> DataFrame:
    return _summaries(lines, min_lines, max_elasticity, items).where(F.col("price_elasticity").isNotNull())


def price_elasticity(
    lines: DataFrame, min_lines: int = MIN_LINES, max_elasticity: float = 10, items: DataFrame | None = None
) -> DataFrame:
    """Mean absolute elasticity over the price steps; descriptions without a valid step drop out."""
    return _elastic(lines, min_lines, max_elasticity, items).select("description", "price_elasticity")


def _market(lines: DataFrame, min_lines: int, max_elasticity: float, items: DataFrame | None) -> DataFrame:
    products = _elastic(lines, min_lines, max_elasticity, items)
    wanted = {"low": 0.33, "high": 0.66, "middle": 0.5}
    bounds = exact_quantiles(products, "total_quantity", wanted).select(F.struct(*wanted)).scalar()
    products = products.withColumn("bounds", bounds)
    quantity, elasticity = F.col("total_quantity"), F.col("price_elasticity")

    def score(value, middle):
        return F.when(value < middle, 0).when(value == middle, 1).otherwise(2)

    demand = F.when(quantity < F.col("bounds.low"), "Low").when(quantity < F.col("bounds.high"), "Medium").otherwise("High")
    total = score(elasticity, F.lit(1.0)) + score(quantity, F.col("bounds.middle"))
    competition = F.when(total <= 1, "Low").when(total == 2, "Medium").otherwise("High")
    return products.withColumns({"demand_category": demand, "competition": competition}).drop("bounds")


def demand_category(
    lines: DataFrame, min_lines: int = MIN_LINES, max_elasticity: float = 10, items: DataFrame | None = None
) -> DataFrame:
    market = _market(lines, min_lines, max_elasticity, items)
    return market.select("description", "total_quantity", "demand_category")


def competition(
    lines: DataFrame, min_lines: int = MIN_LINES, max_elasticity: float = 10, items: DataFrame | None = None
) -> DataFrame:
    return _market(lines, min_lines, max_elasticity, items).select("description", "competition")


def adjusted_price(
    lines: DataFrame, min_lines: int = MIN_LINES, max_elasticity: float = 10, items: DataFrame | None = None
) -> DataFrame:
    """Mean price moved by the market step times elasticity, by at most a fifth upwards."""
    market = _market(lines, min_lines, max_elasticity, items)
    step = price_step(F.col("demand_category"), F.col("competition"))
    price = F.col("avg_unit_price")
    moved = price * (F.lit(1.0) + step * F.col("price_elasticity"))
    return market.withColumn("adjusted_price", F.least(moved, price * PRICE_CAP))
