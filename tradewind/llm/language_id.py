"""Language identification with bit-sliced Bloom filters over letter n-grams.

One filter serves all languages: a slot holds a bit for each language. The languages that contain an n-gram
are the bits set in all of its slots, one lookup per slot for any number of languages. A text scores a
language by the number of its n-grams with that bit, corrected for the false positives that the share of
set bits lets expect, and the highest corrected count decides.

A language contains an n-gram if the n-gram is not much rarer in its texts than in those of the language
where it is most frequent; foreign passages then leave no trace. All documents to learn from are counted.
The filter has as many slots as the fullest language needs for `FALSE_POSITIVES`; the driver gets and broadcasts
it. Where that would be more than `FILTER_BYTES`, nothing is broadcast: the n-grams of the texts are joined with
the table of learned n-grams, which gives exact counts.

Defined results: `und` with score 0 for null, for texts without letters, and if there is nothing to learn
from; a text whose n-grams are all unknown gets the most frequent language with a score of 1 / languages;
ties go to the language with more n-grams learned, then to the smaller name; a null doc_id counts as held
out; repeated rows get the same answer; an empty table gives an empty table; extra columns play no part.
"""

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .text import slices

SIZES = (3, 4)
# Fewest slots, and the distance of the hashes' bits in the hash of an n-gram.
SLOT_BITS = 20
HASHES = 3
# Chance aimed at that an n-gram foreign to the fullest language has its bit, and the largest filter to broadcast.
FALSE_POSITIVES = 0.02
FILTER_BYTES = 1 << 27
# Languages per word of a slot; the sign bit stays free.
WORD = 62
# An n-gram belongs to a language from this fraction of its highest relative frequency on.
SHARE = 0.2
# Rarer n-grams count only for languages with fewer than FEW n-grams of this count.
MIN_COUNT = 2
FEW = 10_000
FOLDS, HELD_OUT = 5, 0
UNDETERMINED = "und"
CHARS_AT_ONCE = 1_000_000
GRAMS_HELD = 2_000_000


class Filter(NamedTuple):
    """`slots[word]` are the bits by slot, 2**n of them; `learned` counts the n-grams learned by language."""

    languages: tuple[str, ...]
    slots: np.ndarray
    learned: tuple[int, ...]

    def false_positives(self) -> np.ndarray:
        """Chance that an n-gram foreign to a language has its bit."""
        shares = []
        for i in range(len(self.languages)):
            bits = (self.slots[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)
            shares.append(float(bits.mean()) ** HASHES)
        return np.array(shares)


class Table(NamedTuple):
    """The learned n-grams themselves, `member` (gram, lang), where a filter would be too large."""

    languages: tuple[str, ...]
    member: DataFrame
    learned: tuple[int, ...]


def slot_bits(members: int) -> int:
    """log2 of the slots that keep the filter at FALSE_POSITIVES with so many n-grams of a language."""
    share = FALSE_POSITIVES ** (1 / HASHES)
    return max(SLOT_BITS, math.ceil(math.log2(max(1, members) * HASHES / -math.log1p(-share))))


@lru_cache(maxsize=2)
def _letters(kinds: str) -> np.ndarray:
    found = (unicodedata.category(chr(code))[0] in kinds for code in range(0x110000))
    return np.fromiter(found, dtype=bool, count=0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams of all texts, the index of the text of each, and which texts have letters.

    Marks belong to the letters they stand on, but a text of marks alone has none. Letters are in lower case; a run of anything else is one blank. Blanks stand only at the edge of an
    n-gram, so that no n-gram spans words, or texts.
    """
    lowered = [text.lower() for text in texts]
    joined = " " + " ".join(lowered) + " "
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(text) + 1 for text in lowered])
    owner = np.r_[owner, np.int32(max(0, len(texts) - 1))]
    has_letters = np.zeros(len(texts), dtype=bool)
    # The character behind a text separates it from the next one.
    has_letters[np.r_[np.int32(0), owner[:-1]][_letters("L")[codes]]] = True
    letter = _letters("LM")[codes]
    keep = letter | np.r_[True, letter[:-1]]
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    # The separator before a text counts as part of the one before; the owner of an n-gram is its second place.
    owner, letter = np.r_[np.int32(0), owner[:-1]][keep], letter[keep]
    hashes, owners = [], []
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        inner = np.ones(n, dtype=bool)
        for j in range(1, size - 1):
            inner &= letter[j : n + j]
        at = np.flatnonzero(inner)
        value = np.full(len(at), size, dtype=np.uint64)
        for j in range(size):
            value = value * np.uint64(0x100000001B3) + codes[at + j]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        hashes.append(value)
        owners.append(owner[at + 1])
    none = np.empty(0, dtype=np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([none.astype(np.int32), *owners]), has_letters


# --- learning ----------------------------------------------------------------------


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    unique, place = np.unique(values, return_inverse=True)
    return unique, np.bincount(place, weights=counts, minlength=len(unique)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch], languages: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language, of a task's documents."""
    number = {name: i for i, name in enumerate(languages)}
    held: dict[int, list] = {i: [] for i in range(len(languages))}

    def flush():
        for i, parts in held.items():
            if parts:
                values, counts = _merged(parts)
                columns = [pa.array(values.view(np.int64)), pa.array(np.full(len(values), i, np.int32)), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "lang", "n"])
                parts.clear()

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for start, end in slices([len(t) for t in texts], CHARS_AT_ONCE):
            found, owner, _ = grams(texts[start:end])
            lang = np.array([number[x] for x in langs[start:end]], dtype=np.int32)[owner]
            for i in np.unique(lang).tolist():
                held[i].append(np.unique(found[lang == i], return_counts=True))
                if sum(len(values) for values, _ in held[i]) > GRAMS_HELD:
                    held[i] = [_merged(held[i])]
            if sum(len(v) for parts in held.values() for v, _ in parts) > 2 * GRAMS_HELD:
                yield from flush()
    yield from flush()


def _position(gram, hash_no: int, bits: int):
    # The bits of an n-gram go round, so that the last hash has as many as the others.
    at = SLOT_BITS * hash_no
    turned = F.shiftrightunsigned(gram, at).bitwiseOR(F.shiftleft(gram, 64 - at)) if at else gram
    return turned.bitwiseAND(F.lit((1 << bits) - 1))


def _places(found: np.ndarray, hash_no: int, bits: int) -> np.ndarray:
    at = SLOT_BITS * hash_no
    turned = (found >> np.uint64(at)) | (found << np.uint64(64 - at)) if at else found
    return turned & np.uint64((1 << bits) - 1)


def learn(labelled: DataFrame) -> Filter | Table | None:
    """The filter of all languages in `labelled` (text, lang), or their table; None without any."""
    labelled = labelled.where("lang is not null and text is not null")
    languages = tuple(sorted(row["lang"] for row in labelled.select("lang").distinct().collect()))
    if not languages:
        return None
    counted = labelled.select("text", "lang").mapInArrow(
        partial(_count_batches, languages=languages), "gram bigint, lang int, n bigint"
    )
    counted = cut_lineage(counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = {row["lang"]: row["n"] for row in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    relative = F.col("n") / F.array(*[F.lit(float(totals.get(i, 1))) for i in range(len(languages))])[F.col("lang")]
    often = counted.where(F.col("n") >= MIN_COUNT).groupBy("lang").agg(F.count("*").alias("n")).collect()
    often = {row["lang"]: row["n"] for row in often}
    small = [i for i in range(len(languages)) if often.get(i, 0) < FEW]
    # At most one entry per language in a list.
    kept = counted.where((F.col("n") >= MIN_COUNT) | F.col("lang").isin(small))
    by_gram = kept.withColumn("share", relative).groupBy("gram")
    by_gram = by_gram.agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("found"))
    member = by_gram.select("gram", "top", F.explode("found").alias("f")).where(F.col("f.share") >= SHARE * F.col("top"))
    member = cut_lineage(member.select("gram", F.col("f.lang").alias("lang")))
    learned = {row["lang"]: row["n"] for row in member.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    by_language = tuple(learned.get(i, 0) for i in range(len(languages)))
    words, bits = -(-len(languages) // WORD), slot_bits(max(by_language))
    if (words * 8) << bits > FILTER_BYTES:
        return Table(languages, member, by_language)
    slots = np.zeros((words, 1 << bits), dtype=np.uint64)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("lang") % WORD).cast("int"))
    placed = member.select(
        F.floor(F.col("lang") / WORD).cast("int").alias("word"),
        bit.alias("bit"),
        F.explode(F.array(*[_position(F.col("gram"), j, bits) for j in range(HASHES)])).alias("slot"),
    )
    # A row per word and slot at most: the size of the filter.
    rows = placed.groupBy("word", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    slots[rows["word"].to_numpy(), rows["slot"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint64)
    return Filter(languages, slots, by_language)


# --- deciding ----------------------------------------------------------------------


def decide(texts: list[str], known: Filter, chances: np.ndarray) -> list[tuple[str, float]]:
    """Language and score of every text; `chances` are the filter's false positives."""
    found, owner, has_letters = grams(texts)
    places = [_places(found, j, known.slots.shape[1].bit_length() - 1) for j in range(HASHES)]
    total = np.bincount(owner, minlength=len(texts))
    counts = np.zeros((len(known.languages), len(texts)))
    for word, slots in enumerate(known.slots):
        bits = slots[places[0]]
        for place in places[1:]:
            bits &= slots[place]
        for i in range(word * WORD, min((word + 1) * WORD, len(known.languages))):
            mine = (bits >> np.uint64(i % WORD)) & np.uint64(1) > 0
            counts[i] = np.bincount(owner[mine], minlength=len(texts))
    corrected = np.maximum(0.0, (counts - total * chances[:, None]) / np.maximum(1e-9, 1 - chances[:, None]))
    order = sorted(range(len(known.languages)), key=lambda i: (-known.learned[i], known.languages[i]))
    best = np.array(order)[np.argmax(corrected[order], axis=0)]
    sums = corrected.sum(axis=0)
    results = []
    for j in range(len(texts)):
        if not has_letters[j]:
            results.append((UNDETERMINED, 0.0))
        else:
            score = corrected[best[j], j] / sums[j] if sums[j] > 0 else 1 / len(known.languages)
            results.append((known.languages[best[j]], float(score)))
    return results


def _decide_batches(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    known = known.value
    chances = known.false_positives()
    for batch in batches:
        texts = [text or "" for text in batch.column("text").to_pylist()]
        for start, end in slices([len(t) for t in texts], CHARS_AT_ONCE):
            found = decide(texts[start:end], known, chances)
            part = batch.slice(start, end - start)
            names, scores = pa.array([x for x, _ in found]), pa.array([x for _, x in found])
            columns = [part.column("doc_id"), part.column("held_out"), names, scores]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of every text with their counts; a text with letters has a row without n-gram too."""
    for batch in batches:
        texts = [text or "" for text in batch.column("text").to_pylist()]
        for start, end in slices([len(t) for t in texts], CHARS_AT_ONCE):
            found, owner, has_letters = grams(texts[start:end])
            order = np.lexsort((found, owner))
            found, owner = found[order], owner[order]
            first = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])][: len(found)])
            counts = np.diff(np.r_[first, len(found)])
            alone = np.flatnonzero(has_letters)
            keys = batch.column("key").slice(start, end - start).take(pa.array(np.r_[owner[first], alone].astype(np.int64)))
            none = pa.nulls(len(alone), pa.int64())
            columns = [keys, pa.chunked_array([pa.array(found[first].view(np.int64)), none]).combine_chunks()]
            columns.append(pa.array(np.r_[counts, np.zeros(len(alone))].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["key", "gram", "n"])


def _identify_by_join(rows: DataFrame, known: Table) -> DataFrame:
    """Decides like the filter, from exact counts; copies of a text are decided once."""
    rows = rows.withColumn("key", F.sha2("text", 256))
    texts = rows.where("text is not null").select("key", "text").dropDuplicates(["key"])
    found = texts.mapInArrow(_gram_batches, "key string, gram bigint, n bigint")
    counts = found.join(known.member, "gram", "left").groupBy("key", "lang").agg(F.sum("n").alias("n"))
    order = sorted(range(len(known.languages)), key=lambda i: (-known.learned[i], known.languages[i]))
    rank = F.array(*[F.lit(order.index(i)) for i in range(len(order))])[F.col("lang")]
    hit = F.when(F.col("lang").isNotNull(), F.struct("n", (-rank).alias("rank")))
    best = counts.groupBy("key").agg(F.max(hit).alias("best"), F.sum(F.when(F.col("lang").isNotNull(), F.col("n"))).alias("total"))
    names = F.array(*[F.lit(known.languages[i]) for i in order])
    name = names[F.coalesce(-F.col("best.rank"), F.lit(0))]
    score = F.coalesce(F.col("best.n") / F.col("total"), F.lit(1 / len(order)))
    # Stored, so that the join below can split a text with very many copies.
    best = cut_lineage(best.select("key", name.alias("lang_pred"), score.alias("score")))
    columns = [F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score")]
    return rows.join(best, "key", "left").select("doc_id", "held_out", *columns)


def held_out(folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == HELD_OUT, F.lit(True))


def identify(docs: DataFrame, known: Filter | Table | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score; only the text decides."""
    rows = docs.select(F.col("doc_id"), held_out().alias("held_out"), F.col("text"))
    if known is None:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if isinstance(known, Table):
        return _identify_by_join(rows, known)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(partial(_decide_batches, known=shared), schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from four folds of the documents with a language and identify all."""
    return identify(docs, learn(docs.where(~held_out()).select("text", "lang")))
