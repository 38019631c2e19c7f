"""k-means whose result depends on the rows alone, not on their order or partitioning.

A point is a sparse vector (`indices`, `values`) with a `weight` and a `key`. The start is drawn by keyed hashes,
each centre with a chance in proportion to weight and squared distance from the ones before: of points that race
with exponential times of these rates, the first one is such a draw, so a draw is one aggregate, and several
starts share it. The start whose centres are nearest to the points goes on. Sums are exact, and distances are
compared after rounding, the first of equal clusters winning. In a step, tasks assign and add up their part of the
distinct points in numpy, Spark adds up the tasks, and the driver sees one row per cluster and dimension. Several
numbers of clusters share the steps. The distinct points are kept in memory, or on the disks of the executors, while
they are read, and in enough partitions for all cores: their bytes are few beside the work of a pass.
"""

import hashlib
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_point

STEPS = 20
STARTS = 8
DIGITS = 9
# Digits at which the costs of starts are compared.
COST_DIGITS = 6
_SUM = "decimal(28,12)"
POINTS_PER_TASK = 200_000


def key_hash(key: Column) -> Column:
    """60 bits of a digest that other engines have as well."""
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def distinct_points(points: DataFrame) -> DataFrame:
    """Equal points as one with their weight, and the smallest hash of their keys.

    Persisted, as every pass reads them; without the repartition their few bytes would be merged into few tasks.
    """
    tasks = max(2 * points.sparkSession.sparkContext.defaultParallelism, points.count() // POINTS_PER_TASK)
    equal = points.groupBy("indices", "values").agg(F.sum("weight").alias("weight"), F.min(key_hash(F.col("key"))).alias("h"))
    return equal.repartition(tasks, "h").persist()


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of point and dimension, and values, of all cells."""
    indices = batch.column("indices")
    point = np.repeat(np.arange(len(batch)), indices.value_lengths().to_numpy(zero_copy_only=False))
    dimension = indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return point, dimension, batch.column("values").flatten().to_numpy(zero_copy_only=False)


def _distances(cells: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, centers: np.ndarray) -> np.ndarray:
    """What `distances` gives, of `n` points."""
    point, dimension, value = cells
    squares = np.bincount(point, value * value, n)
    norms = (centers * centers).sum(axis=1)
    found = [squares + norm - 2.0 * np.bincount(point, value * c[dimension], n) for norm, c in zip(norms, centers, strict=True)]
    return np.round(np.stack(found, axis=1), DIGITS)


def _units(start: int, turn: int, keys: list[bytes]) -> np.ndarray:
    """A number between 0 and 1 for every key: the first 60 bits, as in `key_hash`, of a digest of all three."""
    before = b"%d|%d|" % (start, turn)
    digests = b"".join([hashlib.md5(before + key).digest() for key in keys])
    return ((np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.float64) + 0.5) / float(1 << 60)


def _draw_batches(batches: Iterator[pa.RecordBatch], found: list[np.ndarray], turn: int, draw: bool) -> Iterator[pa.RecordBatch]:
    """The cost of each start over a task's points, and the point that is first in its race, if it is to be drawn."""
    costs = np.zeros((2, len(found)), dtype=np.int64)
    first: list[tuple | None] = [None] * len(found)
    for batch in batches:
        cells, n = _cells(batch), len(batch)
        weight, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("weight", "h"))
        keys = [b"%d" % x for x in h.tolist()] if draw else []
        for s, centers in enumerate(found):
            d = _distances(cells, n, centers).min(axis=1) if len(centers) else np.ones(n)
            for total, share in zip(costs, fixed_point.split(weight * d), strict=True):
                total[s] += share.sum()
            if not draw or not (d > 0).any():
                continue
            with np.errstate(divide="ignore"):
                time = np.where(d > 0, -np.log(_units(s, turn, keys)) / np.maximum(weight * d, 0.0), np.inf)
            for i in np.flatnonzero(time == time.min()):
                own = (time[i], h[i], *(batch.column(c)[int(i)].as_py() for c in ("indices", "values")))
                if first[s] is None or own < first[s]:
                    first[s] = own
        fixed_point.carry(*costs)
    columns = [[None if x is None else x[j] for x in first] for j in range(4)]
    kinds = [pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
    arrays = [pa.array(np.arange(len(found)), pa.int32()), *[pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]]
    names = ["s", "time", "h", "indices", "values", "whole", "part"]
    yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(x) for x in costs]], names)


def seeds(points: DataFrame, ks: list[int], dimensions: int, starts: int = STARTS) -> dict[int, np.ndarray]:
    """The best start for each number of clusters, as dense rows: up to `k` of the distinct `points`.

    A start for fewer clusters is the beginning of one for more.
    """
    found = [np.zeros((0, dimensions)) for _ in range(starts)]
    best = {k: found[0] for k in ks}
    read = points.select("weight", F.col("h").cast("bigint").alias("h"), "indices", "values")
    schema = "s int, time double, h bigint, indices array<int>, values array<double>, whole bigint, part bigint"
    first = F.min(F.when(F.col("time").isNotNull(), F.struct("time", "h", "indices", "values"))).alias("first")
    for t in range(max(ks) + 1):
        # After the last draw only the costs are left to find.
        draws = read.mapInArrow(partial(_draw_batches, found=found, turn=t, draw=t < max(ks)), schema)
        sums = draws.groupBy("s").agg(first, F.sum("whole").alias("whole"), F.sum("part").alias("part"))
        rows = {row["s"]: row for row in sums.collect()}
        if t in best:
            costs = [round(fixed_point.number(rows[s]), COST_DIGITS) if rows else 0.0 for s in range(starts)]
            best[t] = found[costs.index(min(costs))]
        for s, row in rows.items():
            drawn = row["first"]
            if drawn is not None:
                point = np.zeros((1, dimensions))
                point[0, drawn["indices"]] = drawn["values"]
                found[s] = np.concatenate([found[s], point])
    return best


def distances(centers: np.ndarray) -> Column:
    """Squared distances of a point to all centres, rounded, in order."""
    k, dimensions = centers.shape
    # Folded to one literal when the plan is optimized.
    flat = F.from_json(F.lit(json.dumps(centers.ravel().tolist())), "array<double>")
    norms = F.from_json(F.lit(json.dumps((centers * centers).sum(axis=1).tolist())), "array<double>")

    def total(cells):
        return F.aggregate(cells, F.lit(0.0), lambda so_far, x: so_far + x)

    def to(c):
        dot = total(F.zip_with("indices", "values", lambda i, v: v * F.get(flat, i + c * dimensions)))
        return F.round(total(F.transform("values", lambda v: v * v)) + F.get(norms, c) - 2.0 * dot, DIGITS)

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), to)


def nearest(centers: np.ndarray) -> Column:
    """Number of the nearest centre, the first of equals; null without centres."""
    if not len(centers):
        return F.lit(None).cast("bigint")
    found = distances(centers)
    return (F.array_position(found, F.array_min(found)) - 1).cast("bigint")


def _sum_batches(batches: Iterator[pa.RecordBatch], centers: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums of weight (dimension -1) and of weighted values by cluster, over a task's points; cells of zero are left out."""
    sums = {k: np.zeros((2, len(c), c.shape[1] + 1), dtype=np.int64) for k, c in centers.items()}
    for batch in batches:
        weight = batch.column("weight").to_numpy(zero_copy_only=False)
        point, dimension, value = cells = _cells(batch)
        shares = [fixed_point.split(x) for x in (weight, weight[point] * value)]
        for k, c in centers.items():
            cluster = _distances(cells, len(batch), c).argmin(axis=1)
            for total, own, share in zip(sums[k], *shares, strict=True):
                np.add.at(total, (cluster, 0), own)
                np.add.at(total, (cluster[point], dimension + 1), share)
            fixed_point.carry(*sums[k])
    for k, (whole, part) in sums.items():
        cluster, cell = np.nonzero((whole != 0) | (part != 0))
        columns = [np.full(len(cell), k), cluster, cell - 1, whole[cluster, cell], part[cluster, cell]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["k", "cluster", "i", "whole", "part"])


def fit(points: DataFrame, ks: list[int], dimensions: int, steps: int = STEPS) -> dict[int, np.ndarray]:
    """Centres by number of clusters; fewer where there are fewer distinct points, none without points.

    A cluster that loses all its points keeps its centre.
    """
    points = distinct_points(points)
    try:
        return _steps(points, seeds(points, ks, dimensions), steps)
    finally:
        points.unpersist()


def _steps(points: DataFrame, centers: dict[int, np.ndarray], steps: int) -> dict[int, np.ndarray]:
    if not all(len(c) for c in centers.values()):
        return centers
    schema = "k bigint, cluster bigint, i bigint, whole bigint, part bigint"
    read = points.select("weight", "indices", "values")
    for _ in range(steps):
        found = read.mapInArrow(partial(_sum_batches, centers=centers), schema)
        sums = {(r["k"], r["cluster"], r["i"]): fixed_point.number(r) for r in fixed_point.totals(found, ["k", "cluster", "i"])}
        # A cluster without points keeps its centre.
        new = {k: np.where([[(k, j, -1) in sums] for j in range(len(c))], 0.0, c) for k, c in centers.items()}
        for (k, cluster, i), total in sums.items():
            if i >= 0:
                new[k][cluster, i] = total / sums[k, cluster, -1]
        if all(np.array_equal(new[k], c) for k, c in centers.items()):
            break
        centers = new
    return centers


def costs(points: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """(k, wcss): weighted squared distances to the nearest centres."""
    runs = F.array(
        *[
            F.struct(F.lit(k).cast("bigint").alias("k"), F.array_min(distances(c)).alias("d"))
            for k, c in centers.items()
            if len(c)
        ]
    )
    rows = points.select("weight", F.explode(runs).alias("run"))
    wcss = F.sum((F.col("weight") * F.col("run.d")).cast(_SUM)).cast("double")
    return rows.groupBy(F.col("run.k").alias("k")).agg(wcss.alias("wcss"))
