"""Exact sums of doubles formed by numpy in tasks, the same in any order.

A number is rounded to DIGITS digits and split into its floor and the rest, as integers, which are added up by
tasks and then by Spark: the same as a sum of decimals with that many digits, without a decimal per number.
"""

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 12
UNIT = 10**DIGITS


def split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = np.floor(values)
    return whole.astype(np.int64), np.rint((values - whole) * UNIT).astype(np.int64)


def carry(whole: np.ndarray, part: np.ndarray) -> None:
    """Keep `part` below one; after every batch, so that it never overflows."""
    whole += part // UNIT
    part %= UNIT


def totals(sums: DataFrame, keys: Iterable[str]) -> list:
    """Rows of the keys, `whole` and `part`, added up over the tasks."""
    return sums.groupBy(*keys).agg(F.sum("whole").alias("whole"), F.sum("part").alias("part")).collect()


def number(row) -> float:
    return (row["whole"] * UNIT + row["part"]) / UNIT
