"""Exact sums and safe ratios."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(amount: Column) -> Column:
    """Units from an integer number of millionths."""
    return amount.cast("double") / F.lit(1e6)


def zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def money_sum(amount: Column) -> Column:
    """Sum of two-decimal amounts, exact and independent of row order."""
    return F.sum(amount.cast("decimal(18,2)")).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """Double quotient, null when the divisor is zero or either side is null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows that have both values, null when either side is constant."""
    x, y = x.cast("double"), y.cast("double")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread)


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100.0
