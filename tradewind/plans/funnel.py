"""Conversion funnel jobs over product hits."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import funnel_category, merged_funnel_category
from ..functions.fixed_values import ACTION_LABELS
from ..functions.labels import action_label, in_funnel, stage_rank
from ..functions.numbers import percent


def _staged_counts(products: DataFrame) -> DataFrame:
    """Rows per action and raw category, so that paths are classified once and not per row."""
    staged = products.where(in_funnel(F.col("action")))
    return staged.groupBy("action", "category").agg(F.count("full_visitor_id").alias("users"))


def conversion_funnel(products: DataFrame) -> DataFrame:
    """Product hits per stage and coarse category. `users` counts rows, not distinct visitors."""
    counts = _staged_counts(products)
    return counts.groupBy(
        action_label(F.col("action")).alias("action"), funnel_category(F.col("category")).alias("category")
    ).agg(F.sum("users").alias("users"))


def _users_by_action(products: DataFrame) -> DataFrame:
    """One row with the distinct visitors of each action code."""
    reached = products.groupBy("action").agg(F.countDistinct("full_visitor_id").alias("users"))
    return reached.agg(*[F.max(F.when(F.col("action") == str(a), F.col("users"))).alias(f"a{a}") for a in range(1, 7)])


FUNNEL_STEPS = [
    ("Product List Clicks", "a2", "a1"),
    ("Product Detail Views", "a5", "a2"),
    ("Checkout", "a6", "a5"),
    ("Cart Abandonment", "a4", "a3"),
]


def funnel_rates(products: DataFrame) -> DataFrame:
    """Visitors that reach the next stage per hundred in this one, by distinct visitors."""
    steps = [
        F.struct(F.lit(name).alias("step"), percent(F.col(reached), F.col(base)).alias("rate"))
        for name, reached, base in FUNNEL_STEPS
    ]
    return _users_by_action(products).select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def funnel_cumulative(products: DataFrame) -> DataFrame:
    """Per cent of the start that is left at each stage: the running product of the rates."""
    left = F.lit(100.0)
    stages = [("Product List Clicks", left)]
    names = ["Product Detail Views", "Checkout", "Completed Purchase"]
    for name, (_, reached, base) in zip(names, FUNNEL_STEPS[:3]):
        left = left * (percent(F.col(reached), F.col(base)) / 100.0)
        stages.append((name, left))
    rows = [F.struct(F.lit(n).alias("stage"), v.alias("percent_left")) for n, v in stages]
    return _users_by_action(products).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def product_funnel(products: DataFrame) -> DataFrame:
    """Rows per main category and stage with the step percentage, absent stages kept as zero."""
    counts = (
        _staged_counts(products)
        .groupBy(
            merged_funnel_category(F.col("category")).alias("main_category"),
            action_label(F.col("action")).alias("action"),
        )
        .agg(F.sum("users").alias("users"))
    )
    stages = F.array(*[F.lit(name) for name in ACTION_LABELS.values()])
    grid = counts.select("main_category").distinct().select("main_category", F.explode(stages).alias("action"))
    filled = grid.join(counts, ["main_category", "action"], "left").withColumn("users", F.coalesce("users", F.lit(0)))
    before = F.lag("users").over(Window.partitionBy("main_category").orderBy(stage_rank(F.col("action"))))
    step = percent(F.col("users"), before)
    unset = before.isNull() | ((before == 0) & (F.col("users") == 0))
    return filled.withColumn("percentage", F.when(unset, 100.0).otherwise(F.bround(step, 1)))


def action_distribution(products: DataFrame) -> DataFrame:
    action = F.col("action").cast("int")
    return products.where(action != 0).groupBy(action.cast("bigint").alias("action")).agg(F.count("*").alias("rows"))


def stage_distribution(products: DataFrame) -> DataFrame:
    staged = products.where(in_funnel(F.col("action")))
    labeled = staged.groupBy(action_label(F.col("action")).alias("action")).agg(F.count("*").alias("rows"))
    return labeled.where(F.col("action").isNotNull())
