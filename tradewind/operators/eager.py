"""Sums below a join: lines are added up by item before the item table is joined."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "part_no"


def sum_by(lines: DataFrame, keys: list[str], sums: dict[str, Column], items: DataFrame | None = None) -> DataFrame:
    """Sums of line expressions by `keys`, which are columns of `lines` or, if given, of `items`.

    `items` has one row per `ITEM`. The tasks that scan the lines add them up by item and the lines' own keys,
    so that only groups are shuffled and joined, and an item with very many lines is a few rows in the join.
    A line whose item is not in `items` does not count.
    """
    if items is None:
        return lines.groupBy(*keys).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    own = [k for k in keys if k not in items.columns]
    partial = lines.groupBy(*dict.fromkeys([ITEM, *own])).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    joined = partial.join(items.select(*dict.fromkeys([ITEM, *[k for k in keys if k in items.columns]])), ITEM)
    return joined.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])
