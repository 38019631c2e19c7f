"""A stated query set against all rows, in blocks, and the vectors both sides carry.

Queries are dealt to blocks by hash, rows as well. A cell is one block of each: its queries come first in the
sorted partition, then its rows stream past them, so that a task holds the queries of a cell and one batch of
rows. Every query meets every row of its vector length once. Blocks are bounded in rows and in bytes; there
are as many blocks of rows as the session has shuffle partitions, or more.

Rows that are equal in all that matters are one group with a count, so that a row that makes up a third of
the table is one row here.
"""

from collections.abc import Callable, Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage

QUERIES = 32_768
QUERY_BYTES = 32 << 20
ROWS = 1 << 18
# Copies of a result row that one task writes.
COPIES_AT_ONCE = 10_000


def finite_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, offsets into them, and which vectors are neither null nor hold a null, infinite or undefined value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    # `values` keeps what lies before and behind the array's own window, as the offsets do.
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    wrong = np.r_[0, np.cumsum(~np.isfinite(values))]
    known = ~column.is_null().to_numpy(zero_copy_only=False)
    return values, offsets, known & (wrong[offsets[1:]] == wrong[offsets[:-1]])


def grouped(rows: DataFrame) -> DataFrame:
    """`rows` with equal ones as one row, their number `copies` and a number `no` of the group; stored."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    return cut_lineage(counted.withColumn("no", F.monotonically_increasing_id()))


def meet(queries: DataFrame, rows: DataFrame, task: Callable, schema: str) -> DataFrame:
    """`task` (an iterator of cells to an iterator of batches) over all cells; both sides have `dim` and `no`.

    Columns that one side lacks are null there.
    """
    spark = queries.sparkSession
    asked, width = queries.agg(F.count("*"), F.max("dim")).first()
    known = rows.count()
    block = max(1, min(QUERIES, QUERY_BYTES // (8 * max(1, width or 0))))
    across = max(1, ceil(asked / block))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, ceil(known / ROWS), ceil(wanted / across))

    def place(own: int) -> Column:
        return F.pmod(F.xxhash64("no"), F.lit(own))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = rows.select("*", F.lit(1).alias("_side"), place(down).alias("_down"), every(across).alias("_across"))
    asking = queries.select("*", F.lit(0).alias("_side"), place(across).alias("_across"), every(down).alias("_down"))
    cells = asking.unionByName(dealt, allowMissingColumns=True)
    cells = cells.withColumn("_cell", (F.col("_across") * down + F.col("_down")).cast("int")).drop("_across", "_down")
    ordered = cells.repartitionById(across * down, F.col("_cell")).sortWithinPartitions("_cell", "dim", "_side")
    return ordered.mapInArrow(partial(_cells, task=task), schema)


def _cells(batches: Iterator[pa.RecordBatch], task: Callable) -> Iterator[pa.RecordBatch]:
    return task(_runs(batches))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, pa.RecordBatch]]:
    """(whether a cell starts, whether these are queries, rows) for each run of a cell's side in a batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("_cell", "dim", "_side")], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for start, end in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
            cell, is_query = tuple(keys[start, :2]), keys[start, 2] == 0
            yield cell != last, is_query, batch.slice(start, end - start)
            last = cell


def each_cell(runs: Iterator, opened: Callable, feed: Callable, closed: Callable) -> Iterator[pa.RecordBatch]:
    """Open a cell with its queries, feed it batches of its rows, close it to a batch of results.

    A cell without queries or without rows has none.
    """
    asked, state = [], None
    for starts, is_query, batch in runs:
        if starts:
            if state is not None:
                yield closed(state)
            asked, state = [], None
        if is_query:
            asked.append(batch)
        elif asked:
            if state is None:
                state = opened(pa.Table.from_batches(asked).combine_chunks().to_batches()[0])
            feed(state, batch)
    if state is not None:
        yield closed(state)


def matrix(data: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Vectors of one length that are stored as bytes, as the rows of a matrix."""
    return np.frombuffer(b"".join(data.to_pylist()), dtype=kind).reshape(len(data), dim)


class Best:
    """The best `k` rows of each of `n` lists: highest score, then smallest id, null last, then smallest number."""

    def __init__(self, n: int, k: int, kind: type):
        self.k, self.list = k, np.empty(0, dtype=np.int64)
        self.score, self.count = np.empty(0, dtype=kind), np.zeros(n, dtype=np.int64)
        self.no = self.id = self.copies = np.empty(0, dtype=np.int64)
        self.none = np.empty(0, dtype=bool)
        # The last score of a full list; a list with room takes any.
        self.least = np.full(n, -np.inf if kind is np.float64 else np.iinfo(np.int64).min, dtype=kind)

    def add(self, lists: np.ndarray, score: np.ndarray, rows: "Rows", at: np.ndarray, copies: np.ndarray) -> None:
        """Rows `at` as entries of `lists`, each with its count."""
        if not len(lists):
            return
        # Only the lists that get something are sorted anew.
        touched = np.zeros(len(self.count), dtype=bool)
        touched[lists] = True
        old = touched[self.list]
        parts = {
            "list": lists, "score": score, "no": rows.no[at], "id": rows.id[at], "none": rows.none[at], "copies": copies,
        }
        mixed = {name: np.concatenate([getattr(self, name)[old], new]) for name, new in parts.items()}
        # Scores are above the least long, so the order can be reversed by the complement.
        falling = ~mixed["score"] if mixed["score"].dtype == np.int64 else -mixed["score"]
        order = np.lexsort((mixed["no"], mixed["id"], mixed["none"], falling, mixed["list"]))
        sorted_lists = mixed["list"][order]
        first = np.r_[True, sorted_lists[1:] != sorted_lists[:-1]]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        kept = order[rank < self.k]
        lasts = order[rank == self.k - 1]
        self.least[mixed["list"][lasts]] = mixed["score"][lasts]
        for name in parts:
            setattr(self, name, np.concatenate([getattr(self, name)[~old], mixed[name][kept]]))
        self.count = np.bincount(self.list, minlength=len(self.count))


class Rows:
    """Numbers, ids and counts of a batch."""

    def __init__(self, batch: pa.RecordBatch):
        ids = batch.column("vec_id")
        self.no, self.copies = batch.column("no").to_numpy(), batch.column("copies").to_numpy()
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy()


def repeated(frame: DataFrame, copies: str, spread_by: list[str]) -> DataFrame:
    """Every row `copies` times; a row with very many is written by several tasks."""
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(copies) - 1) / COPIES_AT_ONCE)))
    dealt = frame.select("*", part.alias("_part")).repartition(*spread_by, "_part")
    here = F.least(F.lit(COPIES_AT_ONCE), F.col(copies) - F.col("_part") * COPIES_AT_ONCE)
    return dealt.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), here)).alias("_copy")).drop("_part", "_copy")
