"""Several exact distinct counts beside sums."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_counts(
    rows: DataFrame, by: list[Column], counted: dict[str, Column], sums: dict[str, Column] | None = None
) -> DataFrame:
    """Distinct values of each of `counted` and `sums`, per group of `by` (named columns) or over all.

    Spark copies every row once for each distinct count. Here the tasks that read the rows first reduce them to
    the combinations that occur, with their sums; only these are shuffled, and only these are copied.
    """
    sums = sums or {}
    keys = [c.alias(f"_d_{name}") for name, c in counted.items()]
    groups = [c.alias(f"_g{i}") for i, c in enumerate(by)]
    found = rows.groupBy(*groups, *keys).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    counts = [F.countDistinct(f"_d_{name}").alias(name) for name in counted]
    back = [F.col(f"_g{i}").alias(rows.select(c).columns[0]) for i, c in enumerate(by)]
    return found.groupBy(*back).agg(*counts, *[F.sum(f"_s_{name}").alias(name) for name in sums])
