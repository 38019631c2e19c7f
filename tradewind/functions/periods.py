"""Calendar periods as start dates and as consecutive integers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("month", "quarter", "week")


def period_start(day: Column, period: str) -> Column:
    """First date of the month, quarter or Monday-based week that `day` falls in."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}")
    return F.trunc(day, period)


def period_number(start: Column, period: str) -> Column:
    """Consecutive number of a period, so that a difference counts periods."""
    if period == "month":
        number = F.year(start) * 12 + F.month(start)
    elif period == "quarter":
        number = F.year(start) * 4 + F.quarter(start)
    else:
        number = F.datediff(start, F.lit("1970-01-05").cast("date")) / 7
    return number.cast("bigint")


def week_end(day: Column) -> Column:
    """Sunday that closes the week of `day`."""
    return F.date_add(F.trunc(day, "week"), 6)
