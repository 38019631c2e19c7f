"""Nearest neighbours by cosine through randomly rotated one-bit codes.

Every vector is turned by a seeded random rotation into `code_bits` dimensions and keeps one bit for each: the
sign. Next to the packed bits stands one correction scalar, the inner product of the unit vector and its own
code. A query is turned in the same way and rounded to four bits a component, so that its inner product with a
code is a sum of bit counts; divided by the correction scalar it estimates the cosine, without bias and with
an error whose bound follows from the scalar. A vector is compared exactly only if its bound reaches the
query's nearest found so far.

Queries meet the index in blocks. A cell starts with the exact cosines of the vectors its estimates like most,
and passes on its nearest few; a window over these settles the result. The exact cosine is summed in the same
way for every pair, so that equal vectors tie.

An error bound of `SPREAD` deviations is missed by about one pair in 40,000 of what is near enough to matter.

Defined results: a vector that is null, empty, all zeros or holds a null, infinite or undefined component
takes no part; a row without an id is no query and comes last among equal scores; repeated rows are rows of
their own, as queries and as candidates; vectors of different lengths never meet; an empty table, or one
without queries, gives an empty table; extra columns play no part.
"""

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Best, Rows, each_cell, finite_vectors, grouped, matrix, meet, repeated

QUERY_EVERY = 50
NEAREST = 5
SEED = 13
# Shorter vectors are padded: more bits than components make the bound tighter.
LEAST_BITS = 256
QUERY_BITS = 4
SPREAD = 4.0
# Estimates are 32-bit; this is far beyond their rounding.
SLACK = 1e-4
QUERIES_AT_ONCE = 256
CODES_AT_ONCE = 1_024
PAIRS_AT_ONCE = 1 << 16


# --- codes -------------------------------------------------------------------------


def code_bits(dim: int) -> int:
    """Length of the codes of vectors of `dim` components, in whole 64-bit words."""
    return max(LEAST_BITS, -(-dim // 64) * 64)


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """The first `dim` columns of a random rotation of `code_bits` dimensions, the same in every task."""
    bits = code_bits(dim)
    square, upper = np.linalg.qr(np.random.default_rng((SEED, dim)).standard_normal((bits, bits)))
    return (square * np.sign(np.diag(upper)))[:, :dim]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a largest component between a half and one; a power of two changes no cosine."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs (64-bit words) and correction scalars of unit vectors."""
    turned = unit @ rotation(unit.shape[1]).T
    signs = turned >= 0
    correction = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(signs, axis=1).view("<u8"), correction


class Queries:
    """Queries turned and rounded to four bits a component, as bit planes."""

    def __init__(self, unit: np.ndarray):
        turned = unit @ rotation(unit.shape[1]).T
        bits = turned.shape[1]
        self.low = turned.min(axis=1)
        levels = (1 << QUERY_BITS) - 1
        self.step = (turned.max(axis=1) - self.low) / levels
        rounded = np.rint((turned - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.uint8)
        lost = turned - (self.low[:, None] + self.step[:, None] * rounded)
        planes = [np.packbits(rounded >> p & 1, axis=1).view("<u8") for p in range(QUERY_BITS)]
        self.planes, self.root = np.stack(planes, axis=1), np.sqrt(bits)
        # Inner product with a code c of ones: (2 step * sum(rounded * c) + 2 low * ones - step * sum(rounded) - bits * low) / root
        self.fixed = -(self.step * rounded.sum(axis=1, dtype=np.int64) + bits * self.low) / self.root
        self.lost = np.sqrt((lost**2).sum(axis=1)) / self.root

    def bounds(self, some: slice, codes: np.ndarray, correction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines and how far above them the cosines may be, for some queries and some codes."""
        counted = np.zeros((some.stop - some.start, len(codes)), dtype=np.uint16)
        for p in range(QUERY_BITS):
            for w in range(codes.shape[1]):
                hit = np.bitwise_count(self.planes[some, p, w, None] & codes[None, :, w])
                counted += hit.astype(np.uint16) << np.uint16(p)
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        step, low, fixed = (v[some, None].astype(np.float32) for v in (2 * self.step / self.root, 2 * self.low / self.root, self.fixed))
        product = counted * step + low * ones.astype(np.float32) + fixed
        error = np.sqrt(np.maximum(0, 1 - correction**2) / (codes.shape[1] * 64 - 1))
        reach = SPREAD * (error + self.lost[some, None]) / correction + SLACK
        return product / correction.astype(np.float32), reach.astype(np.float32)


# --- the index ---------------------------------------------------------------------


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets, good = finite_vectors(batch.column("embedding"))
        dims = offsets[1:] - offsets[:-1]
        filled = np.r_[0, np.cumsum(values != 0)]
        good &= filled[offsets[1:]] > filled[offsets[:-1]]
        for dim in np.unique(dims[good]):
            at = np.flatnonzero(good & (dims == dim))
            vectors = values[offsets[at][:, None] + np.arange(dim)]
            fitted = scaled(vectors)
            codes, correction = encode(fitted / np.sqrt((fitted**2).sum(axis=1))[:, None])
            columns = [
                batch.column("vec_id").take(pa.array(at)),
                pa.array(np.full(len(at), dim, dtype=np.int32)),
                pa.array([row.tobytes() for row in vectors.astype("<f8")], pa.binary()),
                pa.array([row.tobytes() for row in codes], pa.binary()),
                pa.array(correction),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "data", "code", "correction"])


def index(embeddings: DataFrame) -> DataFrame:
    """no, vec_id, dim, data, code, correction and copies of each distinct row that takes part."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>"))
    schema = "vec_id bigint, dim int, data binary, code binary, correction double"
    return grouped(rows.mapInArrow(_index_batches, schema))


# --- search ------------------------------------------------------------------------


class _Search:
    """The queries of a cell and the nearest they have found."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        self.rows, dim = Rows(batch), batch.column("dim")[0].as_py()
        self.vectors = scaled(matrix(batch.column("data"), dim, "<f8"))
        self.norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.codes = Queries(self.vectors / self.norm[:, None])
        self.best, self.k = Best(len(self.norm), k, np.float64), k

    def compare(self, i: np.ndarray, j: np.ndarray, found: Rows, vectors: np.ndarray, norm: np.ndarray) -> None:
        """Exact cosines of the pairs (query i, row j), but for a query's own row."""
        copies = found.copies[j] - (self.rows.no[i] == found.no[j])
        i, j, copies = i[copies > 0], j[copies > 0], copies[copies > 0]
        step = max(1, PAIRS_AT_ONCE * 64 // vectors.shape[1])
        cosine = np.empty(len(i))
        for start in range(0, len(i), step):
            a, b = i[start : start + step], j[start : start + step]
            cosine[start : start + step] = (self.vectors[a] * vectors[b]).sum(axis=1) / (self.norm[a] * norm[b])
        near = cosine >= self.best.least[i]
        self.best.add(i[near], cosine[near], found, j[near], copies[near])


def _feed(search: _Search, batch: pa.RecordBatch) -> None:
    found, dim = Rows(batch), batch.column("dim")[0].as_py()
    vectors = scaled(matrix(batch.column("data"), dim, "<f8"))
    norm = np.sqrt((vectors**2).sum(axis=1))
    codes = matrix(batch.column("code"), code_bits(dim) // 64, "<u8")
    correction = batch.column("correction").to_numpy()
    for first in range(0, len(codes), CODES_AT_ONCE):
        rows = slice(first, min(first + CODES_AT_ONCE, len(codes)))
        for start in range(0, len(search.norm), QUERIES_AT_ONCE):
            some = slice(start, min(start + QUERIES_AT_ONCE, len(search.norm)))
            estimate, reach = search.codes.bounds(some, codes[rows], correction[rows])
            open_lists = np.flatnonzero(np.isneginf(search.best.least[some]))
            likely = np.zeros(estimate.shape, dtype=bool)
            if len(open_lists):
                # One more than the nearest asked for, as one of them may be the query's own row.
                few = min(search.k + 1, estimate.shape[1])
                top = np.argpartition(estimate[open_lists], -few, axis=1)[:, -few:]
                likely[open_lists[:, None], top] = True
                i, j = np.nonzero(likely)
                search.compare(i + some.start, j + rows.start, found, vectors, norm)
            i, j = np.nonzero((estimate + reach >= search.best.least[some, None]) & ~likely)
            search.compare(i + some.start, j + rows.start, found, vectors, norm)


def _closed(search: _Search) -> pa.RecordBatch:
    best = search.best
    columns = {
        "no": search.rows.no[best.list],
        "query_id": search.rows.id[best.list],
        "query_copies": search.rows.copies[best.list],
        "found_no": best.no,
        "score": best.score,
        "copies": best.copies,
    }
    ids = pa.array(best.id, mask=best.none)
    return pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), ids], [*columns, "vec_id"])


FOUND = "no bigint, query_id bigint, query_copies bigint, found_no bigint, score double, copies bigint, vec_id bigint"


def _task(runs: Iterator, k: int) -> Iterator[pa.RecordBatch]:
    return each_cell(runs, partial(_Search, k=k), _feed, _closed)


def nearest(embeddings: DataFrame, is_query: Column | None = None, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` nearest rows found for each query."""
    rows = index(embeddings)
    queries = rows.where(F.col("vec_id") % QUERY_EVERY == 0 if is_query is None else is_query)
    found = meet(queries, rows, partial(_task, k=k), FOUND)
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("found_no")]
    window = Window.partitionBy("no").orderBy(*order)
    few = found.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k)
    every = few.select("*", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("_each"))
    rank = F.row_number().over(Window.partitionBy("no").orderBy(*order, "_each"))
    ranked = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return repeated(ranked, "query_copies", ["no", "rank"]).select("query_id", "rank", "vec_id", "score")
