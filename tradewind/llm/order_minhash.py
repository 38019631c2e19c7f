"""Order MinHash fingerprints, which follow the edit distance of texts.

A text is the sequence of its k-mers of code points, each numbered by its occurrence, so that repetitions
count. One hash of (k-mer, number) deals them to bins; in every bin the two smallest are selected, put back
in text order, and the ordered pair is hashed. Two texts agree in a bin if the same k-mers are smallest and
stand in the same order, which moving or replacing passages breaks. The likeness is the share of agreeing
bins among those that either text fills.

Defined results: null and empty texts have the empty fingerprint, all zeros, which is like itself (1) and
unlike any other (0); a text shorter than k is one k-mer; equal texts have equal fingerprints. For
`edited_neighbours`, documents are ordered by falling doc_id, nulls last, those of one id by a hash of the
text; the last is followed by the first, a single document by itself; an empty table gives an empty table.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 8
SELECTED = 2
BINS = 64
_BASE = 0x100000001B3
_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
EMPTY = np.zeros(BINS, dtype=np.uint16)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _kmers(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all k-mers, built from those of half their length."""
    value, length = codes.astype(np.uint64), 1
    want = min(K, len(codes))
    power = _BASE
    whole = None
    used = 0
    while True:
        if want & length:
            # Append the block of this length to what was gathered from shorter ones.
            if whole is None:
                whole, used = value, length
            else:
                n = len(codes) - used - length + 1
                factor = np.uint64(pow(_BASE, length, 1 << 64))
                whole, used = whole[:n] * factor + value[used : used + n], used + length
        if used == want:
            return _mixed(whole)
        n = len(value) - length
        value = value[:n] * np.uint64(power) + value[length : length + n]
        power = power * power % (1 << 64)
        length *= 2


def _by_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (without their low bits) and positions, ascending by both."""
    if len(hashes) <= int(_PLACE):
        packed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        packed.sort()
        return packed >> np.uint64(_PLACE_BITS), packed & _PLACE
    short = hashes >> np.uint64(_PLACE_BITS)
    order = np.argsort(short, kind="stable")
    return short[order], order.astype(np.uint64)


def sketch(text: str) -> np.ndarray:
    """16 bits per bin; 0 only for a bin without k-mers."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if not len(codes):
        return EMPTY
    kmer, place = _by_hash(_kmers(codes))
    # Copies of a k-mer are neighbours now, in text order: number them.
    index = np.arange(len(kmer))
    first = np.maximum.accumulate(np.where(np.r_[True, kmer[1:] != kmer[:-1]], index, 0))
    numbered = np.empty(len(kmer), dtype=np.uint64)
    numbered[place] = _mixed(kmer * np.uint64(0x9E3779B97F4A7C15) + (index - first).astype(np.uint64))
    value, place = _by_hash(numbered)
    shift = _BIN_SHIFT - np.uint64(_PLACE_BITS)
    edges = np.searchsorted(value, np.arange(BINS + 1, dtype=np.uint64) << shift)
    start, end = edges[:-1], edges[1:]
    filled, paired = start < end, start + 1 < end
    last = len(value) - 1
    a, b = np.minimum(start, last), np.minimum(start + 1, last)
    swap = paired & (place[b] < place[a])
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    pair = _mixed(value[a] * np.uint64(0xD6E8FEB86659FD93) + np.where(paired, value[b] + np.uint64(1), np.uint64(0)))
    return np.where(filled, 1 + pair % np.uint64(65535), 0).astype(np.uint16)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of agreeing bins, 0 to 1; 1 for two empty sketches."""
    filled = (one > 0) | (other > 0)
    return float(((one == other) & filled).sum() / filled.sum()) if filled.any() else 1.0


def digits(found: np.ndarray) -> str:
    """The fingerprint of a sketch: four hex digits per bin."""
    return found.astype(">u2").tobytes().hex()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [digits(sketch(text.as_py() or "")) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_fingerprint_batches, "doc_id bigint, fingerprint string")


# --- every document against its edited text and the next document ---------------------


def _bucket(bounds: list[int], low: int, high: int) -> Column:
    """How many bounds are at or above the id, by halving; null comes after all."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(F.col("doc_id") > bounds[middle], _bucket(bounds, low, middle)).otherwise(_bucket(bounds, middle + 1, high))


_OUTPUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_NAMES = [field.split()[0] for field in _OUTPUT.split(", ")]


def _compared(doc_id, text: str, own: np.ndarray, next_text: str, next_sketch: np.ndarray) -> tuple:
    cut = len(text) // 3
    edited = text[: len(text) - cut] + next_text[:cut]
    changed = sketch(edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return doc_id, len(text), digest, digits(own), digits(changed), likeness(own, changed), likeness(own, next_sketch)


def _neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order; the head of the following bucket closes each bucket (`tail`)."""
    held = None
    for batch in batches:
        rows = []
        for bucket, tail, doc_id, text in zip(*[batch.column(c) for c in ("bucket", "tail", "doc_id", "text")], strict=True):
            bucket, tail, doc_id, text = bucket.as_py(), tail.as_py(), doc_id.as_py(), text.as_py() or ""
            own = None
            if held is not None and held[0] == bucket:
                own = sketch(text)
                rows.append(_compared(*held[1:], text, own))
            # Only the first tail counts: those after it are further rows of the same id.
            held = None if tail else (bucket, doc_id, text, sketch(text) if own is None else own)
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, row, strict=True)) for row in rows], _SCHEMA)


_SCHEMA = pa.schema(
    [(name, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[kind]) for name, kind in (f.split() for f in _OUTPUT.split(", "))]
)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Every document with the fingerprints of its text and of its edited text, and two likenesses.

    The edit replaces the last third of the code points by as many of the next document's first. Neighbours
    meet without a global order: ids are dealt to buckets by quantiles, texts are shuffled once and sorted
    within a bucket, and the first document of each bucket also goes to the bucket before it.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / wanted for i in range(1, wanted)]
    found = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in steps]), 10_000).alias("q")).first()["q"]
    bounds = sorted(set(found or []), reverse=True)
    bucketed = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(_bucket(bounds, 0, len(bounds)))
    # One row per bucket.
    heads = rows.select("doc_id", bucketed.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()
    heads = sorted((row["bucket"], row["head"]) for row in heads)
    if not heads:
        return docs.sparkSession.createDataFrame([], _OUTPUT)
    before = {bucket: heads[i - 1][0] for i, (bucket, _) in enumerate(heads)}
    head_of = dict(heads)
    every = range(len(bounds) + 2)
    head = F.array(*[F.lit(head_of.get(b)).cast("bigint") for b in every])[F.col("bucket")]
    target = F.array(*[F.lit(before.get(b)).cast("int") for b in every])[F.col("bucket")]
    own = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    copy = F.struct(target.alias("bucket"), F.lit(1).alias("tail"))
    places = F.when(F.col("doc_id").eqNullSafe(head), F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.withColumn("bucket", bucketed).select("doc_id", "text", F.explode(places).alias("p"))
    dealt = dealt.select("p.bucket", "p.tail", "doc_id", "text")
    ordered = dealt.repartition(wanted, "bucket").sortWithinPartitions(
        "bucket", "tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text")
    )
    return ordered.mapInArrow(_neighbour_batches, _OUTPUT)
