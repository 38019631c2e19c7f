"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint has a bit for every bit position that is set in over half of the hashes of the text's word
shingles. Two texts are linked if their fingerprints differ in at most `bits` positions; the classes are
the connected components.

The links come from an index over the distinct fingerprints:

* Upper nodes are masked bit patterns. The 64 positions are cut into `bits` + 1 blocks; fingerprints within
  the distance agree on one block at least, so each is filed under its pattern of every block. A node with
  many members is cut again in the same way over the positions outside its mask, as often as needed, so
  that no task gets a large group, however many near copies there are; nothing is left out.
* Below an upper node the fingerprints are sorted by Gray rank, where common leading bits are neighbours.
  Runs that share 8, 16, .. bits are the lower nodes. Pairs of nodes are compared from the top, their
  differences add up, and a pair over the distance falls with everything below it.

A task passes on only a spanning star of the links it found, which keeps every component whole.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other; repeated
rows share a fingerprint and a component; a null doc_id is never the smallest of a component, and a
component without any other has a null id; an empty table gives an empty table.
"""

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .components import components
from .text import packed, row_key

SEED = 42
SHINGLE = 3
BITS = 2
# Members beyond which an upper node is cut again, unless all but MIN_FREE positions are masked by then.
# Distinct fingerprints with 12 free positions are 4,096 at most.
NODE_MEMBERS = 2_000
MIN_FREE = 12
# Rows and pairs a task works on at a time.
ROWS_AT_ONCE = 20_000
PAIRS_AT_ONCE = 4_000_000
_FULL = (1 << 64) - 1


# --- fingerprints ----------------------------------------------------------------


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes of a UTF-8 text's fingerprint, most significant first."""
    found = (text or b"").lower().split()
    if not found:
        return bytes(8)
    if len(found) <= shingle:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*[found[i:] for i in range(shingle)])))
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), 16_384):
        digests = b"".join(map(xxhash.xxh64_digest, shingles[i : i + 16_384], repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(shingles)).tobytes()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = b"".join(fingerprint(text.as_py(), shingle) for text in batch.column("text").cast(pa.binary()))
        values = pa.array(np.frombuffer(found, dtype=">i8").astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row_key"), values], ["doc_id", "_row_key", "_fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, _row_key and _fp of every document; _fp is the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(docs).alias("_row_key"), "text")
    return rows.mapInArrow(partial(_fingerprint_batches, shingle=shingle), "doc_id bigint, _row_key bigint, _fp bigint")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- the index --------------------------------------------------------------------


def _cut(free: int, parts: int) -> list[int]:
    """The positions set in `free`, from the top, as `parts` masks of about equal size."""
    positions = [p for p in range(63, -1, -1) if free >> p & 1]
    edges = [len(positions) * i // parts for i in range(parts + 1)]
    return [sum(1 << p for p in positions[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def gray_rank(fp: Column) -> Column:
    """Position of a bit pattern in Gray order: the exclusive or of all its right shifts."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


def _filed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Every fingerprint once under each mask."""
    filed = F.explode(F.array(*[F.lit(_signed(mask)) for mask in masks])).alias("mask")
    return fps.select("fp", filed).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def upper_nodes(fps: DataFrame, bits: int = BITS, members: int = NODE_MEMBERS) -> DataFrame:
    """(fp, mask, pattern): the members of the upper nodes that have two or more."""
    masks = _cut(_FULL, bits + 1)
    filed = _filed(fps, masks)
    done = None
    while True:
        # Counts are one row per node; the join is split by its skew like any other of two shuffles.
        counts = filed.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1")
        sized = cut_lineage(filed.join(counts.repartition("mask", "pattern"), ["mask", "pattern"]))
        free = {mask: 64 - mask.bit_count() for mask in masks}
        open_masks = [mask for mask in masks if free[mask] > max(MIN_FREE, bits + 1)]
        large = (F.col("n") > members) & F.col("mask").isin([_signed(m) for m in open_masks])
        small = sized.where(~large).select("fp", "mask", "pattern")
        done = small if done is None else done.union(small)
        rest = sized.where(large)
        if not open_masks or rest.isEmpty():
            return done
        finer = [(mask, mask | part) for mask in open_masks for part in _cut(_FULL ^ mask, bits + 1)]
        below = F.create_map(
            *[
                item
                for mask in open_masks
                for item in (F.lit(_signed(mask)), F.array(*[F.lit(_signed(new)) for old, new in finer if old == mask]))
            ]
        )
        filed = rest.select("fp", F.explode(below[F.col("mask")]).alias("mask"))
        filed = filed.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
        masks = sorted({new for _, new in finer})


def close_pairs(group: np.ndarray, free: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of the same group with at most `bits` differences.

    `group` ascends; `free` are the distinct patterns outside the mask, by Gray rank within a group.
    """
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    edges = np.r_[starts, n]
    left = right = np.flatnonzero(np.diff(edges) > 1)
    spent = np.zeros(len(left), dtype=np.uint8)
    for level in range(1, 9):
        shift = np.uint64(64 - 8 * level)
        head = free >> shift
        new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (head[1:] != head[:-1])])
        digit = (head[new] & np.uint64(255)).astype(np.uint8)
        # The children of a node are a range of the new nodes.
        first = np.searchsorted(new, edges[:-1])
        children = np.diff(np.r_[first, len(new)])
        products = children[left] * children[right]
        kept_left, kept_right, kept_spent = [], [], []
        at = 0
        while at < len(left):
            until = max(at + 1, int(np.searchsorted(np.cumsum(products[at:]), PAIRS_AT_ONCE, side="right")) + at)
            count = products[at:until]
            pair = np.repeat(np.arange(at, until), count)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            width = children[right[pair]]
            a, b = first[left[pair]] + inner // width, first[right[pair]] + inner % width
            total = spent[pair] + np.bitwise_count(digit[a] ^ digit[b])
            good = (total <= bits) & (a <= b)
            kept_left.append(a[good])
            kept_right.append(b[good])
            kept_spent.append(total[good].astype(np.uint8))
            at = until
        if not kept_left:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        left, right, spent = np.concatenate(kept_left), np.concatenate(kept_right), np.concatenate(kept_spent)
        edges = np.r_[new, n]
        # A node of one fingerprint paired with itself leads nowhere.
        useful = (left != right) | (edges[left + 1] - edges[left] > 1)
        left, right, spent = left[useful], right[useful], spent[useful]
    return edges[left], edges[right]


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of `n` indexes over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def _stars(columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    fp, mask, pattern = columns
    changed = (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])
    group = np.r_[0, np.cumsum(changed)] if len(fp) else np.empty(0, dtype=np.int64)
    free = fp.view(np.uint64) & ~mask.view(np.uint64)
    left, right = close_pairs(group, free, bits)
    root = roots_of(len(fp), left, right)
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["a", "b"])


def _star_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Whole nodes at a time; the last node of a batch may go on in the next one."""
    held = [np.empty(0, dtype=np.int64)] * 3
    for batch in batches:
        held = [np.r_[old, batch.column(c).to_numpy()] for old, c in zip(held, ("fp", "mask", "pattern"), strict=True)]
        if len(held[0]) < ROWS_AT_ONCE:
            continue
        _, mask, pattern = held
        changed = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))
        if len(changed):
            until = changed[-1] + 1
            yield _stars([x[:until] for x in held], bits)
            held = [x[until:] for x in held]
    if len(held[0]):
        yield _stars(held, bits)


def links(fps: DataFrame, bits: int = BITS, members: int = NODE_MEMBERS) -> DataFrame:
    """Pairs (a, b) of the distinct `fp` that link all fingerprints within the distance, directly or in steps."""
    nodes = upper_nodes(fps, bits, members).withColumn("rank", gray_rank(F.col("fp").bitwiseAND(F.bitwise_not("mask"))))
    # A Gray rank is unsigned: its sign bit orders the upper half after the lower one.
    ordered = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", F.col("rank") < 0, "rank")
    return ordered.select("fp", "mask", "pattern").mapInArrow(partial(_star_batches, bits=bits), "a bigint, b bigint")


# --- the operator ------------------------------------------------------------------


def _classes(found: DataFrame, bits: int) -> DataFrame:
    """(_fp, _root, component_id) of every distinct fingerprint."""
    distinct = cut_lineage(found.groupBy("_fp").agg(F.min("doc_id").alias("_first")))
    fps = distinct.select(F.col("_fp").alias("fp"))
    roots = components(links(fps, bits)).select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    rooted = distinct.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return cut_lineage(rooted.join(smallest, "_root").select("_fp", "_root", "component_id"))


def classify(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per document."""
    found = cut_lineage(fingerprints(docs, shingle))
    return _joined(found, bits).select("doc_id", hex_digits(F.col("_fp")).alias("fingerprint"), "component_id")


def _joined(found: DataFrame, bits: int) -> DataFrame:
    # A fingerprint may be hot on the side of the documents. Both sides are dealt anew, so that the skewed
    # join can split it.
    classes = _classes(found, bits)
    return found.join(classes, "_fp")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One document of every component, the one with the smallest doc_id, with the columns it came with.

    Of several rows with this doc_id, the one with the smallest hash of its content stays.
    """
    found = cut_lineage(fingerprints(docs, shingle))
    first = _joined(found, bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("_root").agg(F.min("doc_id").alias("_id"), F.min("_row_key").alias("_key"))
    kept = kept.select(F.coalesce("_id", F.lit(0)).alias("_id"), F.col("_id").isNull().alias("_no_id"), "_key").distinct()
    own = docs.select(
        packed(docs, []),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_no_id"),
        row_key(docs).alias("_key"),
    )
    keys = ["_id", "_no_id", "_key"]
    # The rows of a key are copies; they meet in the join, and dropping all but one needs no further shuffle.
    return own.join(kept, keys, "left_semi").dropDuplicates(keys).select("_row.*")
