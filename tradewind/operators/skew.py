"""Join of a large side that may have hot keys with a side that has one row per key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this fraction of all rows, so there are fewer hot keys than this.
HOT_KEYS = 10_000
SPREAD = 1_000


def join_keyed(
    big: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: Column, spread_by: list[str]
) -> DataFrame:
    """Inner join of `big` with `keyed`, which is unique on `on` and counts its `big` rows in `weight`.

    Skewed-join handling splits a partition only when both sides are plain shuffles. Here `keyed`
    is an aggregate, already partitioned by the key, and a hot key would meet all of its rows in one
    task. The hot keys, fewer than `HOT_KEYS` because the weights add up to `total`, are broadcast
    instead; their rows are spread by `spread_by` over the shuffle for the other keys.
    """
    values = [c for c in keyed.columns if c not in on]
    is_hot = F.col(weight) * HOT_KEYS > total
    hot = keyed.where(is_hot).select(*on, *[F.col(c).alias(f"_hot_{c}") for c in values])
    # Hot keys keep a lane that no row of the large side takes.
    cold_lane = F.when(is_hot, -1).otherwise(0).alias("_lane")
    cold = keyed.select(*on, *[F.col(c).alias(f"_cold_{c}") for c in values], cold_lane)

    spread = F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).cast("int") + 1
    lane = F.when(F.col(f"_hot_{weight}").isNull(), 0).otherwise(spread)
    marked = big.join(F.broadcast(hot), on, "left").withColumn("_lane", lane)
    joined = marked.join(cold, [*on, "_lane"], "left")
    # Column by column, so that Spark drops the values nobody reads from both joins.
    found = {c: F.coalesce(f"_hot_{c}", f"_cold_{c}") for c in values}
    return joined.where(found[weight].isNotNull()).select(*big.columns, *[v.alias(c) for c, v in found.items()])
