"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi search.

The automaton over all pieces reads a text once. At each position it names, along its output links, every
piece that ends there; each relaxes the best score of its end by the best score of its start. The best path
has the highest sum of piece scores; of equal paths the one with the longest last piece wins, position by
position.

No piece of a usual vocabulary has a word mark (U+2581) after another character, so the search falls apart
at words, and the results of frequent words are kept in a bounded cache. A vocabulary with other pieces is
searched over the whole text instead.

Encoding is lossless for a vocabulary with byte pieces: characters without a piece, and word marks that are
in the text itself, become bytes, and `decode` gives the text back. A vocabulary without them gets the
unknown id there.

Defined results: null has null ids and decodes to null; an empty text has no ids; repeated rows are encoded
alike; an empty table gives an empty table; other columns pass through, those with the name of an output
column are replaced. The vocabulary is the only thing broadcast; its size does not depend on the texts.
"""

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import packed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 120_000
# Longer units are not kept, so that the cache is bounded in bytes as well.
CACHED_LENGTH = 64
CHARS_AT_ONCE = 1_000_000
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary(NamedTuple):
    """Pieces by id; `kinds` has n (normal), b (byte), u (unknown) or c (control and unused) for each."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())

    def kind(i):
        if model.is_byte(i):
            return "b"
        if model.is_unknown(i):
            return "u"
        return "c" if model.is_control(i) or model.is_unused(i) else "n"

    pieces = tuple(model.id_to_piece(i) for i in ids)
    return Vocabulary(pieces, tuple(model.get_score(i) for i in ids), "".join(map(kind, ids)))


class Codec:
    """Encoder and decoder of one vocabulary; a small helper that every worker builds for itself."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        self.bytes_of = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        normal = []
        for i, (piece, score, kind) in enumerate(zip(*vocabulary, strict=True)):
            if kind == "n":
                self.automaton.add_word(piece, (i, len(piece), score))
                normal.append((piece, score))
                self.bytes_of.append(piece.replace(MARK, " ").encode())
            elif kind == "b":
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            else:
                self.unknown = i if kind == "u" else self.unknown
                self.bytes_of.append(" ⁇ ".encode() if kind == "u" else b"")
        self.automaton.make_automaton()
        self.unknown_score = min((score for _, score in normal), default=0.0) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in normal if len(piece) == 1}
        self.by_word = not any(MARK in piece.lstrip(MARK) for piece, _ in normal)
        # Score by id along a path; a character in bytes pays once, with its leading byte.
        self.score_of = np.array([s if k == "n" else 0.0 for _, s, k in zip(*vocabulary, strict=True)])
        self.score_of[self.unknown] = self.unknown_score
        for value, i in self.byte_ids.items():
            self.score_of[i] = 0.0 if 0x80 <= value < 0xC0 else self.unknown_score
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _as_bytes(self, char: str) -> list[int]:
        if len(self.byte_ids) < 256:
            return [self.unknown]
        return [self.byte_ids[value] for value in char.encode()]

    def search(self, marked: str) -> list[int]:
        """Ids of the best path through a text with word marks for blanks."""
        n = len(marked)
        best = [0.0] + [float("-inf")] * n
        last: list[tuple[int, int, float] | None] = [None] * (n + 1)
        # Where every character is a piece, every position is reached by the time a piece starts there.
        foreign = [] if self.single.issuperset(marked) else [i for i, c in enumerate(marked) if c not in self.single]
        foreign.reverse()

        def pass_foreign(until):
            # A character that is no piece can always be passed, at the price of an unknown one.
            while foreign and foreign[-1] < until:
                at = foreign.pop()
                score = best[at] + self.unknown_score
                if score > best[at + 1]:
                    best[at + 1], last[at + 1] = score, (-1, 1, score)

        for end, item in self.automaton.iter(marked):
            if foreign:
                pass_foreign(end)
            _, length, score = item
            end += 1
            score += best[end - length]
            if score > best[end]:
                best[end], last[end] = score, item
        pass_foreign(n)
        path, at = [], n
        while at:
            i, length, _ = last[at]
            at -= length
            path += (i,) if i >= 0 else reversed(self._as_bytes(marked[at]))
        path.reverse()
        return path

    def _search_word(self, unit: str) -> bytes:
        if len(unit) > CACHED_LENGTH:
            # Where nothing separates words, a unit is a passage that hardly comes up again.
            return array("i", self.search(unit)).tobytes()
        found = self.older.get(unit) or array("i", self.search(unit)).tobytes()
        # Two generations: words that come up again outlive the turn.
        if len(self.cache) >= CACHED_WORDS:
            self.older, self.cache = self.cache, {}
        self.cache[unit] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        chunks = []
        # A word mark in the text itself goes into bytes, so that it is not taken for a blank.
        for i, part in enumerate(text.split(MARK) if text else ()):
            if i:
                chunks.append(array("i", self._as_bytes(MARK)).tobytes())
            marked = (MARK if i == 0 else "") + part.replace(" ", MARK)
            units = (_UNITS.findall(marked) if self.by_word else [marked]) if marked else []
            known, search = self.cache.get, self._search_word
            chunks += [known(unit) or search(unit) for unit in units]
        return np.frombuffer(b"".join(chunks), dtype=np.int32)

    def score(self, ids: np.ndarray) -> float:
        return float(self.score_of[ids].sum())

    def decode(self, ids: np.ndarray) -> str:
        bytes_of = self.bytes_of
        joined = b"".join([bytes_of[i] for i in ids.tolist()])
        return joined.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(vocabulary: Vocabulary) -> Codec:
    return Codec(vocabulary)


def _with(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("_row"), *arrays], ["_row", *names])


def _encode_batches(batches: Iterator[pa.RecordBatch], vocabulary, result: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(vocabulary.value)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for start, end in slices([len(t or "") for t in texts], CHARS_AT_ONCE):
            ids = [None if t is None else codec.encode(t) for t in texts[start:end]]
            part = batch.slice(start, end - start)
            scores = pa.array([None if x is None else codec.score(x) for x in ids], pa.float64())
            if result == "digest":
                yield _with(part, DIGEST, [*_digests(codec, texts[start:end], ids), scores])
            else:
                names, arrays = ["ids", "score"], [pa.array(ids, pa.list_(pa.int32())), scores]
                if result == "checked":
                    names.append("round_trip")
                    arrays.append(_round_trips(codec, texts[start:end], ids))
                yield _with(part, names, arrays)


DIGEST = ["n_chars", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip", "score"]


def _round_trips(codec: Codec, texts: list[str | None], ids: list[np.ndarray | None]) -> pa.Array:
    return pa.array([t is None or codec.decode(x) == t for t, x in zip(texts, ids, strict=True)], pa.bool_())


def _digests(codec: Codec, texts: list[str | None], ids: list[np.ndarray | None]) -> list[pa.Array]:
    in_bytes = np.zeros(len(codec.bytes_of), dtype=bool)
    in_bytes[list(codec.byte_ids.values())] = True
    none = np.empty(0, dtype=np.int32)
    known = [none if x is None else x for x in ids]
    return [
        pa.array([len(t or "") for t in texts], pa.int64()),
        pa.array([len(x) for x in known], pa.int64()),
        pa.array([int(in_bytes[x].sum()) for x in known], pa.int64()),
        pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in known], pa.string()),
        _round_trips(codec, texts, ids),
    ]


def _decode_batches(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    codec = _codec(vocabulary.value)
    for batch in batches:
        texts = [None if not ids.is_valid else codec.decode(ids.values.to_numpy()) for ids in batch.column("ids")]
        yield _with(batch, ["text"], [pa.array(texts, pa.string())])


def _mapped(rows: DataFrame, function, added: list[T.StructField]) -> DataFrame:
    schema = T.StructType([rows.schema["_row"], *added])
    return rows.mapInArrow(function, schema).select("_row.*", *[field.name for field in added])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """`docs` with `ids` (array of int) and `score` (sum of the scores along the best path)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    rows = docs.select(packed(docs, ["ids", "score"]), F.col("text"))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType())]
    return _mapped(rows, partial(_encode_batches, vocabulary=vocabulary, result="ids"), added)


def encode_checked(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """`docs` with `ids` and `score` in place of `text`, and whether decoding the ids gave the text back.

    Encoding and decoding share a pass, so that a task needs one worker and carries each text once.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    rows = docs.select(packed(docs, ["text", "ids", "score", "round_trip"]), F.col("text"))
    added = [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
    return _mapped(rows, partial(_encode_batches, vocabulary=vocabulary, result="checked"), added)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """`encoded` with `text` made from `ids`."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    rows = encoded.select(packed(encoded, ["text"]), F.col("ids"))
    return _mapped(rows, partial(_decode_batches, vocabulary=vocabulary), [T.StructField("text", T.StringType())])


def encode_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, lengths, hash of the ids (32-bit, little endian), whether decoding gives the text back, and score."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    rows = docs.select(F.struct("doc_id").alias("_row"), "text")
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType()]
    added = [T.StructField(name, kind) for name, kind in zip(DIGEST, kinds, strict=True)]
    return _mapped(rows, partial(_encode_batches, vocabulary=vocabulary, result="digest"), added)
