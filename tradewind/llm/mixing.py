"""Mixing sources to target weights: subset-sum budget fitting over length counts.

Documents are counted by source and exact length in words. Sources share the total by weight; a target never
exceeds `MAX_REPEATS` times its source, and what is over is shared anew. Per source, every document is taken
a whole number of times; for the rest of the budget each length first gets its proportional count, and a
bounded-knapsack dynamic program over the lengths that are left closes the gap, mostly to the word. Large
gaps are closed on a grid of exact sums, then on finer ones. Then the wanted number of documents of each length
is chosen by a seeded hash.

What a task holds of a source is one row per distinct length, so it is bounded by the longest document.
Documents are ranked within a source and length in two steps, by hash buckets and within a bucket, so that
neither step sees more than about the square root of a group, though a third of all rows may share one
length. The driver sees one row per source.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of its own,
the last one; copies of a row are chosen independently of each other, by number; a source of size 0 has
target 0; an empty table gives an empty table; extra columns play no part.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .text import packed, row_key, words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 7
# Cells of the dynamic program, whatever the budget.
CELLS = 1 << 17
RESERVE = CELLS // 4


def shares(sizes: list[int], weights: list[float], most: int = MAX_REPEATS) -> list[float]:
    """Targets that add up to the total: by weight, none above `most` times its size, the excess shared anew."""
    targets = [0.0] * len(sizes)
    active = [i for i, size in enumerate(sizes) if size > 0]
    rest = float(sum(sizes))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if rest * weights[i] / total > most * sizes[i]]
        if not over:
            for i in active:
                targets[i] = rest * weights[i] / total
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        active = [i for i in active if i not in set(over)]
        rest -= sum(targets[i] for i in over)
    return targets


def fill(budget: int, lengths: np.ndarray, counts: np.ndarray, below: bool = False) -> np.ndarray:
    """How many of each length to take, so that the sum is as near to the budget as the grid can tell.

    With `below`, the sum does not exceed the budget, so that what it lacks can be filled on a finer grid.

    Bounded knapsack: counts are split into powers of two, and a part is added to all sums reached so far. Sums
    are kept in `CELLS` cells; each keeps the first sum that fell into it, exactly, with the part that led there
    and the cell before. The search ends with a sum in the budget's own cell. Up to half of `CELLS` words a cell is
    one sum and no choice is nearer; above, a cell is up to `2 * budget / CELLS` words wide.
    """
    chosen = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or not len(lengths):
        return chosen
    # All sums are multiples of what the lengths have in common.
    common = int(np.gcd.reduce(lengths))
    goal = common * round(budget / common)
    # A sum over the budget may be the nearest, but none over twice the budget: taking nothing is nearer.
    limit = 2 * int(budget)
    width = -(-(limit + 1) // CELLS)
    cells = limit // width + 1
    reached = np.full(cells, -1, dtype=np.int64)
    via = np.full(cells, -1, dtype=np.int64)
    previous = np.zeros(cells, dtype=np.int64)
    reached[0] = 0
    filled = np.zeros(1, dtype=np.int64)
    parts = []
    middle = goal // width - int(below and width > 1)
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        left, multiple = min(count, limit // length), 1
        while left > 0 and reached[middle] < 0:
            multiple = min(multiple, left)
            sums, before = reached[filled] + length * multiple, filled
            hit = np.flatnonzero(sums == goal)
            if len(hit):
                return _way_back(chosen, parts, via, previous, int(before[hit[0]]), (i, multiple))
            fits = sums <= limit
            sums, before = sums[fits], before[fits]
            # A sum, once in its cell, stays there: others lead back through it.
            new = reached[sums // width] < 0
            sums, before = sums[new], before[new]
            at, first = np.unique(sums // width, return_index=True)
            reached[at], via[at], previous[at] = sums[first], len(parts), before[first]
            filled = np.r_[filled, at]
            parts.append((i, multiple))
            left, multiple = left - multiple, multiple * 2
        if reached[middle] >= 0:
            break
    filled.sort()
    if below:
        filled = filled[reached[filled] <= budget]
    nearest = filled[np.argmin(np.abs(reached[filled] - budget))]
    return _way_back(chosen, parts, via, previous, int(nearest), None)


def _way_back(chosen, parts, via, previous, at: int, last: tuple[int, int] | None) -> np.ndarray:
    """The lengths taken on the way to a cell, and by a `last` part from there."""
    if last is not None:
        chosen[last[0]] += last[1]
    while at:
        i, multiple = parts[via[at]]
        chosen[i] += multiple
        at = int(previous[at])
    return chosen


def fit_source(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Times all documents are taken, and how many of each length are taken once more.

    The proportional counts, rounded down, then the program over the documents left. If that does not meet the
    budget, a sum somewhat below it is filled up on a finer grid; and the program runs over all documents anew, since
    few documents may only meet a budget out of proportion. The nearest of all these is taken.
    """
    size = int((lengths * counts).sum())
    nothing = np.zeros(len(lengths), dtype=np.int64)
    if not size:
        return 0, nothing
    # A target that is a multiple of the size but for rounding is that multiple.
    times = int((target + 0.5) // size)
    budget = int(round(target - times * size))
    if budget <= 0 or times >= MAX_REPEATS:
        return min(times, MAX_REPEATS), nothing
    wanted = counts * (budget / size)
    extra = np.where(lengths > 0, np.minimum(np.floor(wanted).astype(np.int64), counts), 0)

    def miss(taken):
        return budget - int((taken * lengths).sum())

    by_remainder = np.lexsort((lengths, -(wanted - extra)))
    def filled(taken, order, reserve=0):
        more = np.zeros_like(taken)
        more[order] = fill(miss(taken) - reserve, lengths[order], (counts - taken)[order], reserve > 0)
        return taken + more

    tried = [extra]
    while miss(extra) > 0:
        order = by_remainder[(lengths[by_remainder] > 0) & (counts[by_remainder] > extra[by_remainder])]
        tried.append(filled(extra, order))
        if not miss(tried[-1]):
            break
        # What is left open is large enough for an exact grid to close it.
        under = filled(extra, order, reserve=RESERVE)
        if not (under > extra).any():
            break
        tried.append(under)
        extra = under
    if all(miss(t) for t in tried):
        tried.append(filled(nothing, np.flatnonzero(lengths > 0)))
    # The first of equals, which keeps more of the proportions.
    return times, min(tried, key=lambda t: abs(miss(t)))


def _fit_group(rows: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = rows["_size"].to_numpy(), rows["_n"].to_numpy()
    times, extra = fit_source(lengths, counts, float(rows["_target"].iloc[0]))
    return rows[["_s", "_none", "_size", "_n", "_source_size", "_target"]].assign(_times=np.int64(times), _take=extra)


def _source() -> list[Column]:
    return [F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none")]


def decide(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per distinct row of `docs`: _id, _no_id, _key, _rows (its copies), _size, _source_size, _target,
    _times (how often all copies are taken) and _more (how many copies are taken once more).
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_no_id"),
        row_key(docs).alias("_key"),
        *_source(),
        F.size(words(F.col("text"))).cast("bigint").alias("_size"),
    )
    items = cut_lineage(rows.groupBy("_id", "_no_id", "_key", "_s", "_none", "_size").agg(F.count("*").alias("_rows")))
    counted = cut_lineage(items.groupBy("_s", "_none", "_size").agg(F.sum("_rows").alias("_n")))
    totals = counted.groupBy("_s", "_none").agg(F.sum(F.col("_size") * F.col("_n")).alias("size")).collect()
    totals = sorted(totals, key=lambda r: (r["_none"], r["_s"]))
    sizes = [r["size"] for r in totals]
    targets = shares(sizes, [weights[i % len(weights)] for i in range(len(totals))])
    listed = [(r["_s"], r["_none"], r["size"], t) for r, t in zip(totals, targets, strict=True)]
    wanted = spark.createDataFrame(listed, "_s string, _none boolean, _source_size bigint, _target double")
    schema = "_s string, _none boolean, _size bigint, _n bigint, _source_size bigint, _target double, _times bigint, _take bigint"
    plan = counted.join(wanted, ["_s", "_none"]).groupBy("_s", "_none").applyInPandas(_fit_group, schema)
    # Stored, so that the join with the documents deals both sides anew and can split a hot length.
    plan = cut_lineage(plan)

    group = ["_s", "_none", "_size"]
    draw = F.xxhash64(F.lit(seed), "_id", "_no_id", "_key")
    buckets = F.greatest(F.lit(1), F.floor(F.sqrt("_n"))).cast("bigint")
    drawn = items.join(plan, group).withColumn("_draw", draw).withColumn("_bucket", F.pmod("_draw", buckets))
    # Groups that are taken whole or not at all need no ranks.
    partial = cut_lineage(drawn.where((F.col("_take") > 0) & (F.col("_take") < F.col("_n"))))
    whole = drawn.where((F.col("_take") <= 0) | (F.col("_take") >= F.col("_n")))
    whole = whole.withColumn("_more", F.when(F.col("_take") > 0, F.col("_rows")).otherwise(0))

    in_bucket = partial.groupBy(*group, "_bucket").agg(F.sum("_rows").alias("_c"))
    until = F.sum("_c").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    before = in_bucket.withColumn("_before", until - F.col("_c")).drop("_c")
    ranked = partial.join(before, [*group, "_bucket"])
    order = Window.partitionBy(*group, "_bucket").orderBy("_draw", "_id", "_no_id", "_key")
    taken_before = F.col("_before") + F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    more = F.greatest(F.lit(0), F.least(F.col("_rows"), F.col("_take") - taken_before))
    columns = ["_id", "_no_id", "_key", "_rows", "_size", "_source_size", "_target", "_times", "_more"]
    return ranked.withColumn("_more", more).select(*columns).union(whole.select(*columns))


def mixed_sizes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))).alias("_i")
    rows = decide(docs, weights, seed).select("*", copies)
    times = F.col("_times") + (F.col("_i") <= F.col("_more")).cast("bigint")
    return rows.select(
        F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * times).alias("taken"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The documents of the mix with the columns they came with, each as often as it is taken."""
    total = F.col("_times") * F.col("_rows") + F.col("_more")
    chosen = decide(docs, weights, seed).where("_size > 0").select("_id", "_no_id", "_key", total.alias("_total"))
    own = docs.select(
        packed(docs, []),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_no_id"),
        row_key(docs).alias("_key"),
    )
    keys = ["_id", "_no_id", "_key"]
    # Copies of a row meet in the join and are counted in _total already.
    once = own.join(chosen.where("_total > 0"), keys).dropDuplicates(keys)
    return once.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_total")))).select("_row.*")
