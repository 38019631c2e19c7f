"""Shares of a total, top-n reports and correlations."""

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import UNRANKED_CATEGORIES
from ..functions.numbers import pearson, percent


def totals_of(df: DataFrame, *columns: str) -> Column:
    """Sums of columns over the whole frame, as one scalar struct."""
    return df.agg(F.struct(*[F.sum(c).alias(c) for c in columns])).scalar()


def with_percent(df: DataFrame, **shares: str) -> DataFrame:
    """Add `name=column` percentages of the column's total."""
    whole = df.withColumn("_whole", totals_of(df, *dict.fromkeys(shares.values())))
    shared = whole.withColumns({name: percent(F.col(c), F.col(f"_whole.{c}")) for name, c in shares.items()})
    return shared.drop("_whole")


def top_n_and_other(df: DataFrame, label: str, value: str, n: int = 5) -> DataFrame:
    """The `n` largest labels and one `Other` row for the rest and for unranked labels."""
    summed = df.groupBy(label).agg(F.sum(value).alias(value))
    # Unranked labels sort last and go after the limit: a filter before it would reach down into the
    # sums and end the reuse of their shuffle.
    ranked = summed.withColumn("unranked", F.col(label).isin(UNRANKED_CATEGORIES))
    top = ranked.orderBy("unranked", F.desc(value), label).limit(n).where(~F.col("unranked"))
    top = top.select(label, F.lit(True).alias("kept"))
    # `top` has at most n rows.
    marked = summed.join(F.broadcast(top), label, "left")
    folded = marked.select(F.when(F.col("kept"), F.col(label)).otherwise("Other").alias(label), value)
    empty = df.sparkSession.range(1).select(F.lit("Other").alias(label), F.lit(0).cast(df.schema[value].dataType).alias(value))
    return folded.unionByName(empty).groupBy(label).agg(F.sum(value).alias(value))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson matrix in long form; each pair uses the rows where both sides are present."""
    ordered = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    names = {pair: f"c{i}" for i, pair in enumerate(ordered)}
    row = df.agg(*[pearson(F.col(a), F.col(b)).alias(n) for (a, b), n in names.items()])
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(names.get((a, b)) or names[(b, a)]).alias("correlation"))
        for a, b in product(columns, columns)
    ]
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
