"""Hard negatives by exact integer inner products in a residue number system.

Components are scaled by 256 and rounded down. Anchors meet all rows in blocks, and the inner products of a
block are matrix products of residues: modulo each of several small primes, whose symmetric residues are so
small that a float32 product of them is exact, however it is summed. Chinese remaindering in mixed radix
turns the residues of a score into the signed score. There are as many primes as the largest possible score
of the block needs, so no component is too large.

Two passes over the blocks: the best rows of the anchor's label, its positives; then, for each positive, the
best rows of other labels within a window of scores below the positive's. A cell passes on the best few of
each list only, and windows over these few settle the result.

Defined results: a row with a null label, a null vector or a null, infinite or undefined component takes no
part; a row without an id is no anchor, comes last among equal scores and is a row like any other besides;
repeated rows are rows of their own, as anchors, positives and negatives; "other" leaves out just the anchor's
own row; vectors of different lengths have no inner product and never meet, empty ones have product zero;
scores beyond the range of a long count as its ends; an empty table, or one without anchors, gives an empty
table; extra columns play no part.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .blocks import Best, Rows, each_cell, finite_vectors, grouped, matrix, meet, repeated

ANCHOR_EVERY = 100
SHIFT_EVERY = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative's score lies between this part of the positive's and the positive's itself.
LEAST_PERCENT = 80
# Whole numbers up to this are exact in float32.
EXACT = 1 << 24
INNER = 1_024
# Scores that are computed at a time.
SCORES_AT_ONCE = 1 << 20
LONGS = np.iinfo(np.int64)


# --- residues ----------------------------------------------------------------------


def primes(most: int) -> list[int]:
    """The odd primes up to `most`, largest first."""
    sieve = np.ones(most + 1, dtype=bool)
    sieve[:2] = False
    for p in range(2, int(most**0.5) + 1):
        sieve[p * p :: p] &= not sieve[p]
    return [p for p in np.flatnonzero(sieve).tolist() if p > 2][::-1]


def moduli(bound: int, inner: int) -> tuple[list[int], int]:
    """Primes whose product exceeds twice the bound, and how many terms of a product may be summed in float32.

    Symmetric residues of p are up to p // 2, so `inner` products of two are exact while
    inner * (p // 2) ** 2 is at most 2 ** 24. Should that allow too few primes, fewer terms are summed at a time.
    """
    inner = max(1, min(inner, INNER))
    while True:
        chosen, product = [], 1
        for p in primes(2 * int((EXACT / inner) ** 0.5) + 1):
            if product > 2 * bound:
                break
            if inner * (p // 2) ** 2 <= EXACT:
                chosen.append(p)
                product *= p
        if product > 2 * bound:
            return chosen, inner
        if inner == 1:
            raise ValueError(f"no primes for scores up to {bound}")
        inner //= 2


def _symmetric(values: np.ndarray, p: int) -> np.ndarray:
    rest = values % p
    return np.where(rest > p // 2, rest - p, rest)


def residue_product(a: np.ndarray, b: np.ndarray, p: int, inner: int) -> np.ndarray:
    """a @ b.T modulo p, as numbers from 0 to p - 1; a and b are whole, of any integer kind."""
    x, y = (_symmetric(m, p).astype(np.float32) for m in (a, b))
    total = np.zeros((len(a), len(b)), dtype=np.int32)
    for k in range(0, a.shape[1], inner):
        total += (x[:, k : k + inner] @ y[:, k : k + inner].T).astype(np.int32) % p
    return total % p


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without any rounding, through residues; scores beyond a long count as its ends."""
    largest = [max((abs(int(v)) for v in (m.min(), m.max())), default=0) if m.size else 0 for m in (a, b)]
    bound = a.shape[1] * largest[0] * largest[1]
    chosen, inner = moduli(bound, a.shape[1])
    product = 1
    for p in chosen:
        product *= p
    # Mixed radix: score = d1 + d2 * p1 + d3 * p1 * p2 + .., each digit below its prime.
    digits = []
    for i, p in enumerate(chosen):
        digit = residue_product(a, b, p, inner).astype(np.int64)
        for earlier, q in zip(digits, chosen[:i], strict=True):
            digit = (digit - earlier) * pow(q, -1, p) % p
        digits.append(digit)
    kind = np.int64 if product < 1 << 62 else object
    total = np.zeros((len(a), len(b)), dtype=kind)
    radix = 1
    for digit, p in zip(digits, chosen, strict=True):
        total += digit.astype(kind) * radix
        radix *= p
    total = np.where(total > product // 2, total - product, total)
    return total if kind is np.int64 else np.clip(total, LONGS.min, LONGS.max).astype(np.int64)


# --- vectors -----------------------------------------------------------------------


def _scaled_bytes(values: np.ndarray) -> bytes:
    """Whole components as 16-bit numbers where they fit, else the original doubles."""
    scaled = np.floor(values * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 1 << 15:
        return scaled.astype("<i2").tobytes()
    return values.astype("<f8").tobytes()


def whole_components(data: pa.Array, dim: int) -> np.ndarray:
    """The scaled components of vectors of one length: 64-bit numbers, or Python's where these are too small."""
    wide = np.array([len(item) != 2 * dim for item in data.to_pylist()], dtype=bool) if dim else np.zeros(len(data), dtype=bool)
    narrow = matrix(data.filter(pa.array(~wide)), dim, "<i2").astype(np.int64)
    if not wide.any():
        return narrow
    # Scaling by a power of two is exact but for overflow, which whole numbers do not have.
    values = matrix(data.filter(pa.array(wide)), dim, "<f8")
    floors = [int(v) * SCALE if abs(v) >= 1 << 53 else int(np.floor(v * SCALE)) for v in values.ravel().tolist()]
    kind = np.int64 if all(abs(v) < 1 << 62 for v in floors) else object
    both = np.empty((len(data), dim), dtype=kind)
    both[~wide], both[wide] = narrow, np.array(floors, dtype=kind).reshape(values.shape)
    return both


def _packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets, good = finite_vectors(batch.column("embedding"))
        good &= batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(good)
        data = [_scaled_bytes(values[offsets[i] : offsets[i + 1]]) for i in at]
        dims = (offsets[1:] - offsets[:-1])[at]
        taken = [batch.column(c).take(pa.array(at)) for c in ("vec_id", "label")]
        columns = [*taken, pa.array(dims, pa.int32()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dim", "data"])


def vectors(embeddings: DataFrame) -> DataFrame:
    """no, vec_id, label (as mined with), dim, data and copies of each distinct row that takes part."""
    label, key = F.col("label").cast("bigint"), F.col("vec_id").cast("bigint")
    moved = F.when(key % SHIFT_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = embeddings.select(key.alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>"))
    return grouped(rows.mapInArrow(_packed_batches, "vec_id bigint, label bigint, dim int, data binary"))


# --- blocks ------------------------------------------------------------------------


class _Anchors:
    """The anchors of a cell and what they have found."""

    def __init__(self, batch: pa.RecordBatch, lists: int, k: int):
        self.rows, self.batch = Rows(batch), batch
        self.label = batch.column("label").to_numpy()
        self.data = whole_components(batch.column("data"), batch.column("dim")[0].as_py())
        self.best = Best(len(self.label) * lists, k, np.int64)
        self.at_once = max(1, min(len(self.label), 512))


def _scores(anchors: _Anchors, batch: pa.RecordBatch) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(anchors, rows, scores) piece by piece."""
    data = whole_components(batch.column("data"), batch.column("dim")[0].as_py())
    step = max(1, SCORES_AT_ONCE // anchors.at_once)
    for first in range(0, len(data), step):
        rows = slice(first, min(first + step, len(data)))
        for start in range(0, len(anchors.label), anchors.at_once):
            some = slice(start, min(start + anchors.at_once, len(anchors.label)))
            yield some, rows, exact_products(anchors.data[some], data[rows])


def _feed_positives(anchors: _Anchors, batch: pa.RecordBatch) -> None:
    found, label = Rows(batch), batch.column("label").to_numpy()
    for some, rows, score in _scores(anchors, batch):
        least = anchors.best.least[some, None]
        wanted = (anchors.label[some, None] == label[None, rows]) & (score >= least)
        i, j = np.nonzero(wanted)
        i, j, score = i + some.start, j + rows.start, score[i, j]
        # The anchor's own row is one of the copies of its group.
        copies = found.copies[j] - (anchors.rows.no[i] == found.no[j])
        some_left = copies > 0
        anchors.best.add(i[some_left], score[some_left], found, j[some_left], copies[some_left])


def _feed_negatives(anchors: _Anchors, batch: pa.RecordBatch) -> None:
    found, label = Rows(batch), batch.column("label").to_numpy()
    for some, rows, score in _scores(anchors, batch):
        other = anchors.label[some, None] != label[None, rows]
        for k in range(POSITIVES):
            lists = np.arange(some.start, some.stop) * POSITIVES + k
            low = np.maximum(anchors.low[some, k], anchors.best.least[lists])
            i, j = np.nonzero((score <= anchors.high[some, k, None]) & (score >= low[:, None]) & other)
            if len(i):
                anchors.best.add(lists[i], score[i, j], found, j + rows.start, found.copies[j + rows.start])


def _open_positives(batch: pa.RecordBatch) -> _Anchors:
    return _Anchors(batch, 1, POSITIVES)


def _open_negatives(batch: pa.RecordBatch) -> _Anchors:
    anchors = _Anchors(batch, POSITIVES, NEGATIVES)
    scores = batch.column("positive_scores").to_pylist()
    # No score is within a window that ends before it starts.
    anchors.high = np.full((len(scores), POSITIVES), LONGS.min, dtype=np.int64)
    anchors.low = np.full((len(scores), POSITIVES), LONGS.max, dtype=np.int64)
    for i, own in enumerate(scores):
        anchors.high[i, : len(own)] = own
        anchors.low[i, : len(own)] = [min(LONGS.max, -(-LEAST_PERCENT * s // 100)) for s in own]
    return anchors


def _closed(anchors: _Anchors, lists: int) -> pa.RecordBatch:
    best = anchors.best
    anchor = best.list // lists
    columns = {
        "no": anchors.rows.no[anchor],
        "anchor_id": anchors.rows.id[anchor],
        "anchor_copies": anchors.rows.copies[anchor],
        "k": (best.list % lists).astype(np.int32),
        "found_no": best.no,
        "score": best.score,
        "copies": best.copies,
    }
    ids = pa.array(best.id, mask=best.none)
    return pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), ids], [*columns, "vec_id"])


FOUND = "no bigint, anchor_id bigint, anchor_copies bigint, k int, found_no bigint, score bigint, copies bigint, vec_id bigint"


def _positive_task(runs: Iterator) -> Iterator[pa.RecordBatch]:
    return each_cell(runs, _open_positives, _feed_positives, partial(_closed, lists=1))


def _negative_task(runs: Iterator) -> Iterator[pa.RecordBatch]:
    return each_cell(runs, _open_negatives, _feed_negatives, partial(_closed, lists=POSITIVES))


def first_rows(found: DataFrame, lists: list[str], k: int) -> DataFrame:
    """The first `k` rows of each list, counting copies, with their `rank` from 1."""
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("found_no")]
    window = Window.partitionBy(*lists).orderBy(*order)
    few = found.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k).drop("_n")
    each = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))).alias("_copy")
    every = few.select("*", each)
    rank = F.row_number().over(Window.partitionBy(*lists).orderBy(*order, "_copy"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).drop("_copy", "copies")


def hard_negatives(embeddings: DataFrame, is_anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    rows = vectors(embeddings)
    chosen = F.col("vec_id") % ANCHOR_EVERY == 0 if is_anchor is None else is_anchor
    anchors = rows.where(chosen)
    positives = first_rows(meet(anchors, rows, _positive_task, FOUND), ["no"], POSITIVES)
    positive = F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("score"), F.col("vec_id"))))
    listed = positives.groupBy("no").agg(positive.alias("positives"))
    scores = F.transform("positives", lambda p: p["score"]).alias("positive_scores")
    # Stored: the next pass counts its queries and then reads them.
    with_positives = cut_lineage(anchors.join(listed, "no").select("*", scores))
    asking = with_positives.drop("positives")
    found = meet(asking, rows, _negative_task, FOUND)
    ranked = first_rows(found, ["no", "k"], NEGATIVES)
    named = ranked.join(with_positives.select("no", "positives"), "no").withColumn("_positive", F.get("positives", F.col("k")))
    rows_out = repeated(named, "anchor_copies", ["no", "k", "rank"])
    return rows_out.select(
        "anchor_id",
        F.col("_positive.vec_id").alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("_positive.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
