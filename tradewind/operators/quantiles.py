"""Exact quantiles and summaries of columns with any number of distinct values, also per group.

`percentile` keeps every distinct value of a group in one task, which is right for bounded domains only. Here
the ranks are found by radix selection: doubles are mapped to 64-bit integers of the same order, and each pass
counts the next `DIGIT` bits of the values that share the bits found so far. A pass is a hash aggregate with a
map-side part; the window that adds up its counters sees at most 2 ** `FIRST` of them for a group, whatever the
values are and however they crowd. All columns, groups and ranks share the passes, and the passes share the
shuffle of the counted values.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 22 + 21 + 21 bits.
FIRST, DIGIT = 22, 21
SHIFTS = [42, 21, 0]


def ordered_bits(value: Column) -> Column:
    """The 64-bit integer in which a double's bits keep the order of the doubles; undefined values come last.

    A positive double's exponent and mantissa, read as one number, grow with the double; negative ones mirror it.
    """
    size = F.abs(value)
    # The logarithm may be off by one next to a power of two.
    guess = F.floor(F.log2(size))
    power = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(size < power, -1).when(size >= power * 2, 1).otherwise(0)
    mantissa = size / F.pow(F.lit(2.0), exponent) - 1.0
    normal = (exponent + 1023) * F.lit(1 << 52) + (mantissa * float(1 << 52)).cast("bigint")
    # Below the smallest normal number there is no exponent, only steps.
    steps = (size / F.lit(5e-324)).cast("bigint")
    bits = (
        F.when(F.isnan(value), F.lit(2047 * (1 << 52) + 1))
        .when(size == float("inf"), F.lit(2047 * (1 << 52)))
        .when(size < 2.2250738585072014e-308, steps)
        .otherwise(normal)
    )
    # Never null, so that a join on it adds no filter and the counted values stay shared.
    return F.coalesce(F.when(value < 0, -bits).otherwise(bits), F.lit(0).cast("bigint"))


def _counted(df: DataFrame, columns: list[str], by: list[str], weight: str | None) -> DataFrame:
    """Group, column, value, freq and bits of every distinct value, without nulls."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    cell = cells[0] if len(cells) == 1 else F.explode(F.array(*cells))
    copies = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    long = df.select(*by, copies.alias("weight"), cell.alias("cell")).select(*by, "weight", "cell.*")
    known = long.where(F.col("value").isNotNull())
    counted = known.groupBy(*by, "column", "value").agg(F.sum("weight").alias("freq"))
    return counted.withColumn("bits", ordered_bits(F.col("value")))


def _chosen(digits: DataFrame, keys: list[str], targets: Column) -> DataFrame:
    """The digits that hold a target's rank, with these targets and their ranks among what the digit holds."""
    window = Window.partitionBy(*keys).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    summed = digits.withColumn("until", F.sum("size").over(window)).withColumn("wanted", targets)
    before = F.col("until") - F.col("size")
    held = F.filter("wanted", lambda t: (before <= t["rank"]) & (t["rank"] < F.col("until")))
    inside = F.transform(held, lambda t: t.withField("rank", t["rank"] - before))
    return summed.withColumn("targets", inside).where(F.size("targets") > 0)


def _quantiles(counted: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """One row per group and column with its linearly interpolated quantiles."""
    keys = [*by, "column"]
    digits = counted.groupBy(*keys, F.shiftright("bits", SHIFTS[0]).alias("digit")).agg(F.sum("freq").alias("size"))
    targets = []
    for name, probability in wanted.items():
        position = F.lit(probability) * (F.col("n") - 1)
        for edge, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            fields = [F.lit(name).alias("name"), F.lit(edge).alias("edge"), rank.cast("bigint").alias("rank")]
            targets.append(F.struct(*fields, (position - F.floor(position)).alias("fraction")))
    total = F.sum("size").over(Window.partitionBy(*keys))
    found = _chosen(digits.withColumn("n", total), keys, F.array(*targets))
    for shift in SHIFTS[1:]:
        picks = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("digit").alias("prefix"), "targets")
        # Without groups there are two ranks for each quantile of a column, whatever the data; else the size decides.
        picks = picks if by else F.broadcast(picks)
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        same.append(F.shiftright("bits", shift + DIGIT) == F.col("prefix"))
        near = counted.join(picks, reduce(Column.__and__, same))
        digit = F.shiftright("bits", shift).alias("digit")
        digits = near.groupBy(*keys, "prefix", F.col("targets").alias("open"), digit).agg(
            F.sum("freq").alias("size"), F.max("value").alias("value")
        )
        found = _chosen(digits, [*keys, "prefix"], F.col("open"))
    each = found.select(*keys, "value", F.explode("targets").alias("t"))

    def at(name, edge):
        return F.max(F.when((F.col("t.name") == name) & (F.col("t.edge") == edge), F.col("value")))

    def fraction(name):
        return F.max(F.when(F.col("t.name") == name, F.col("t.fraction")))

    picked = [(at(n, "low") + (at(n, "high") - at(n, "low")) * fraction(n)).alias(n) for n in wanted]
    return each.groupBy(*keys).agg(*picked)


def exact_quantiles(
    df: DataFrame, column: str, wanted: dict[str, float], by: list[str] | None = None, weight: str | None = None
) -> DataFrame:
    """The linearly interpolated quantiles of `column` under each name.

    One row, null without values; with `by`, one row per group that has values. `weight` names a column that
    counts how often a row stands for itself.
    """
    by = by or []
    found = _quantiles(_counted(df, [column], by, weight), by, wanted)
    return found.drop("column") if by else found.agg(*[F.max(name).alias(name) for name in wanted])


def grouped_quantiles(df: DataFrame, columns: list[str], wanted: dict[str, float], by: list[str]) -> DataFrame:
    """The quantiles of several columns, one row per group and column."""
    return _quantiles(_counted(df, columns, by, None), by, wanted)


def _by_column(rows: DataFrame, *names: str) -> Column:
    """A frame with one row per column as a scalar map from column to struct."""
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(*names))))).scalar()


def describe(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum, one row per column that has values."""
    wanted = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    counted = _counted(df, columns, [], weight)
    value, freq = F.col("value"), F.col("freq")
    first = counted.groupBy("column").agg(
        F.sum("freq").alias("count"),
        (F.sum(value * freq) / F.sum("freq")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    stats = _by_column(first, "count", "mean", "min", "max")
    middle = F.try_element_at("stats", F.col("column"))["mean"]
    apart = counted.withColumn("stats", stats).withColumn("apart", (value - middle) * (value - middle) * freq)
    second = apart.groupBy("column").agg(F.sum("apart").alias("apart"), F.sum("freq").alias("n"))
    # One value has no deviation.
    std = F.sqrt(F.try_divide(F.col("apart"), (F.col("n") - 1).cast("double"))).alias("std")
    spread = _by_column(second.select("column", std), "std")
    found = _quantiles(counted, [], wanted).withColumn("stats", stats).withColumn("spread", spread)
    found = found.withColumn("stats", F.try_element_at("stats", "column"))
    return found.select(
        "column", "stats.count", "stats.mean", F.try_element_at("spread", "column")["std"].alias("std"), "stats.min",
        "q25", "median", "q75", "stats.max",
    )
