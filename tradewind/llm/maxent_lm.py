"""A hashed maximum-entropy language model, and the unigram score it is compared with.

A word is reached by a path of decisions through a tree of classes, 32 ways at each node, and
P(word | history) is the product of the decisions' chances. Frequent words are two decisions away, rarer ones
three to five. Each decision is a softmax over the node's frequencies plus sums of weight rows, one row for
each feature of the history: the word before (n-gram), the two words before (n-gram) and the second word
before alone (skip). Features are hashed to the rows of their node.

* Size: every word that occurs MIN_COUNT times and makes up 1 / LISTED of all tokens is in the tree, so the
  vocabulary grows with the corpus, up to LISTED words. All other words form one class, within which a word has
  its smoothed share of the counts, so that the model covers any text. Rows grow with the square root of the
  tokens, up to MAX_ROWS, and are dealt to the nodes by their frequency.
* Counts: every training token counts. Tasks count their own documents; Spark adds the counts up.
* Training: synchronous steps over all training documents. All tasks start a step from the same weights; Spark
  adds up how often each decision was taken and expected under each row, in two rounds, and the driver gets the
  sums, which are as large as the model. A weight moves by its gradient, taken less expected, over the
  logarithmic mean of the two (generalised iterative scaling): no step lowers the likelihood of the training
  texts, and the result does not depend on how the documents are dealt to tasks.
* Passes: Arrow cuts texts into words and looks these up; numpy works through the decisions in blocks, each a product
  of three rows. Counts of words too rare for the broadcast list, which is bounded by construction, come from a join
  with the distributed count table.

Defined results: null and empty texts are the end token alone; a null doc_id counts as held out; repeated
rows are scored alike, one result row each; without training documents every count is zero and N is 0; an
empty table gives an empty table; extra columns play no part.
"""

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .text import slices

FOLDS, HELD_OUT = 10, 0
SMOOTHING = 0.1
# A token is listed if it makes up 1 / LISTED of all tokens, so there are LISTED at most.
LISTED = 500_000
MIN_COUNT = 3
END = 0
# Ways at a node; children of the root below which a word is one, two or three decisions away. One is left for the tail.
WIDTH, NEAR = 32, (16, 11, 4)
ROWS_PER_ROOT, MAX_ROWS = 16, 1 << 20
# Shares of a step by feature: the word before, the two words before, the second word before.
SHARES = (0.4, 0.4, 0.2)
STEPS = 2
PRIOR = 10.0
# Tokens, or distinct decisions, worked on at a time; tokens among which equal decisions are found.
BLOCK, COMPARED = 4_096, 200_000
# A task of a step has this many tokens for each row at least, so that the sums it sends are small beside its texts.
TOKENS_PER_ROW = 64
CHARS_AT_ONCE = 2_000_000
BYTES_COUNTED = 50_000_000
# Single precision sums have this many tokens for each row before they join the others.
TOKENS_SUMMED = 4
# The sums travel in this many pieces.
PIECES = 64
_END_TOKEN = b""
_NO_CHANCE = np.float32(-1e4)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(True))


# --- tokens ----------------------------------------------------------------------


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    """Offset and texts of the parts of a batch."""
    texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
    for start, end in slices(pc.binary_length(texts).to_pylist(), CHARS_AT_ONCE):
        yield start, texts.slice(start, end - start)


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of some texts, and where each text starts. ASCII blanks are those at which `bytes.split()` cuts."""
    words = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    # What is behind a text's last blank is empty, like the end token.
    ended = pc.if_else(pc.equal(words, ""), words, pc.binary_join_element_wise(words, "", " "))
    tokens = pc.ascii_split_whitespace(ended)
    return tokens.values.cast(pa.binary()), tokens.offsets.to_numpy()[:-1].astype(np.int64)


def _places(tokens: pa.Array, listed: pa.Array) -> np.ndarray:
    """Places of tokens in the list, -1 for those not in it."""
    return pc.fill_null(pc.index_in(tokens, value_set=listed), -1).to_numpy().astype(np.int64)


def _ids(places: np.ndarray, rest: int) -> np.ndarray:
    return np.where((places < 0) | (places >= rest), rest, places)


# --- counts ----------------------------------------------------------------------


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []

    def flush():
        counts = pa.chunked_array(held, pa.binary()).value_counts()
        held.clear()
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["token", "c"])

    for batch in batches:
        for _, texts in _texts(batch):
            held.append(_tokens(texts)[0])
            if sum(tokens.nbytes for tokens in held) >= BYTES_COUNTED:
                yield from flush()
    if held:
        yield from flush()


def token_counts(training: DataFrame) -> DataFrame:
    """(token, c) of all words and of the end token, which is the empty string."""
    counted = training.select("text").mapInArrow(_count_batches, "token binary, c bigint")
    return counted.groupBy("token").agg(F.sum("c").alias("c"))


class Listed(NamedTuple):
    """The frequent tokens, the end token first, then by falling count; totals over all tokens."""

    tokens: tuple[bytes, ...]
    counts: tuple[int, ...]
    n: int
    distinct: int

    @property
    def base_mass(self) -> float:
        return self.n + SMOOTHING * (self.distinct + 1)

    @property
    def vocabulary(self) -> int:
        """How many listed tokens are in the tree; the end token always is."""
        return 1 + sum(c >= MIN_COUNT for c in self.counts[1:])

    @property
    def rest_mass(self) -> float:
        """Smoothed mass of the words outside the vocabulary of the model."""
        inside = self.vocabulary
        return self.n - sum(self.counts[:inside]) + SMOOTHING * (max(0, self.distinct - inside) + 1)


def listed_tokens(counts: DataFrame) -> Listed:
    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # LISTED rows at most, as the counts add up to n.
    rows = counts.where((F.col("c") * LISTED >= n) & (F.col("token") != F.lit(_END_TOKEN))).toArrow()
    pairs = sorted(zip(rows["token"].to_pylist(), rows["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    end = counts.where(F.col("token") == F.lit(_END_TOKEN)).first()
    pairs = [(_END_TOKEN, end["c"] if end else 0), *pairs]
    return Listed(tuple(t for t, _ in pairs), tuple(c for _, c in pairs), n, distinct)


# --- the model -------------------------------------------------------------------


def _paths(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nodes and children of all words' decisions, one word after the other; their numbers; how many nodes there are.

    The last word stands for all words outside the vocabulary.
    """
    root, tail, numbered = 0, 1, 2
    nodes = np.full((vocabulary + 1, 5), -1, dtype=np.int64)
    children = np.zeros((vocabulary + 1, 5), dtype=np.int64)
    nodes[:, 0] = root
    start = child = 0

    def layer(classes: int, at: int, child: int, depth: int) -> int:
        """The next words: the decision that takes one of so many classes from `child` on, and those below it."""
        nonlocal numbered
        words = np.arange(start, min(vocabulary, start + classes * WIDTH**depth))
        rank = words - start
        children[words, at] = child + rank // WIDTH**depth
        for d in range(depth, 0, -1):
            at += 1
            group = rank // WIDTH**d
            nodes[words, at] = numbered + group
            children[words, at] = rank // WIDTH ** (d - 1) % WIDTH
            numbered += int(group[-1]) + 1 if len(group) else 0
        return start + len(words)

    for depth, classes in enumerate(NEAR, 1):
        start = layer(classes, 0, child, depth)
        child += classes
    # The tail's last child is the class of all words outside.
    children[start:, 0], nodes[start:, 1] = child, tail
    start = layer(WIDTH - 1, 1, 0, 3)
    children[vocabulary, 1] = WIDTH - 1
    used = nodes >= 0
    return nodes[used], children[used], used.sum(axis=1), numbered


class Model:
    """The tree of classes, the frequencies at its nodes as fixed offsets, and `weights` (rows, WIDTH)."""

    def __init__(self, listed: Listed, weights: np.ndarray | None = None):
        self.rest = listed.vocabulary
        self.nodes, self.children, self.depth, n = _paths(self.rest)
        self.first = np.cumsum(self.depth) - self.depth
        mass = np.r_[np.array(listed.counts[: self.rest]) + SMOOTHING, listed.rest_mass]
        masses = np.bincount(self.nodes * WIDTH + self.children, np.repeat(mass, self.depth), n * WIDTH).reshape(n, WIDTH)
        total = masses.sum(axis=1)
        with np.errstate(divide="ignore"):
            self.offset = np.maximum(_NO_CHANCE, np.log(masses / np.maximum(total, 1e-300)[:, None])).astype(np.float32)
        # Each node has as many rows for each feature.
        wanted = min(MAX_ROWS, ROWS_PER_ROOT * listed.n**0.5) / len(SHARES)
        self.size = 1 + (wanted * total / total.sum()).astype(np.uint64)
        ends = np.cumsum(self.size) * np.uint64(len(SHARES))
        self.base = ends - self.size * np.uint64(len(SHARES))
        self.rows = int(ends[-1])
        self.node_of = np.repeat(np.arange(n), self.size.astype(np.int64) * len(SHARES))
        template = np.arange(self.rows, dtype=np.uint64) - self.base[self.node_of]
        self.share = np.array(SHARES)[(template // self.size[self.node_of]).astype(np.int64)]
        self.first_row = self.base[self.node_of] + self.size[self.node_of] > np.arange(self.rows, dtype=np.uint64)
        self.weights = np.zeros((self.rows, WIDTH), dtype=np.float32) if weights is None else weights

    @property
    def weights(self) -> np.ndarray:
        return self._weights

    @weights.setter
    def weights(self, weights: np.ndarray) -> None:
        self._weights, self._factors = weights, None

    @property
    def factors(self) -> np.ndarray:
        """The weights as factors of odds; those of the word before hold the frequencies at their node as well.

        A step moves a sum of weights by the logarithm of the tokens at most, so no product overflows.
        """
        if self._factors is None:
            self._factors = np.exp(self._weights)
            self._factors[self.first_row] *= np.exp(self.offset[self.node_of[self.first_row]])
        return self._factors

    def decisions(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens of some texts: rows (decisions, 3) and child of each decision, and its token."""
        return self._decided(ids, *histories(ids, starts, self.rest + 1))

    def blocks(self, ids: np.ndarray, starts: np.ndarray, size: int = BLOCK) -> Iterator[tuple]:
        """Blocks of tokens, each with its decisions."""
        before, second = histories(ids, starts, self.rest + 1)
        for at in range(0, len(ids), size):
            own = slice(at, at + size)
            yield own, *self._decided(ids[own], before[own], second[own])

    def _decided(self, ids: np.ndarray, before: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        depth = self.depth[ids]
        ends = np.cumsum(depth)
        token = np.repeat(np.arange(len(ids)), depth)
        at = np.repeat(self.first[ids] - (ends - depth), depth) + np.arange(len(token))
        node = self.nodes[at]
        size, base = self.size[node], self.base[node]
        # A column is read at a time.
        rows = np.empty((len(token), len(SHARES)), dtype=np.int64, order="F")
        for j, feature in enumerate((_hash(before), _hash(before, second), _hash(second))):
            rows[:, j] = base + ((feature[token] * size) >> np.uint64(32))
            base += size
        return rows, self.children[at], token

    def odds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each child's share at every decision, and the sum of the shares."""
        found = np.take(self.factors, rows[:, 0], axis=0, mode="clip")
        factor = np.empty_like(found)
        for j in range(1, rows.shape[1]):
            np.take(self.factors, rows[:, j], axis=0, out=factor, mode="clip")
            found *= factor
        return found, found.sum(axis=1)

    def step(self, taken: np.ndarray, expected: np.ndarray) -> np.ndarray:
        """The weights after a step: gradients over logarithmic means, each row with PRIOR decisions more, as expected."""
        uses = taken.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            prior = PRIOR * expected / uses
            move = np.log((taken + prior) / (expected + prior)) * self.share[:, None]
        return (self.weights + np.where(np.isfinite(move), move, 0.0)).astype(np.float32)


def _hash(*ids: np.ndarray) -> np.ndarray:
    """32 bits of each history."""
    value = np.full(len(ids[0]), len(ids), dtype=np.uint64)
    for x in ids:
        value += x.astype(np.uint64)
        value += np.uint64(1)
        value *= np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)


def histories(ids: np.ndarray, starts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the second word before each token; `starts` begin a text."""
    before = np.r_[start, ids[:-1]]
    before[starts] = start
    second = np.r_[start, before[:-1]]
    second[starts] = start
    return before, second


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of decisions, by their first, and how often each is met."""
    first, *others = rows.T
    # First, a hash of the others and the place in one number: numbers sort faster than an order is found.
    bits = len(rows).bit_length()
    key = _hash(*others) >> np.uint64(max(0, 32 - 43 + bits))
    key = (first.astype(np.uint64) << np.uint64(43)) | (key << np.uint64(bits)) | np.arange(len(rows), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    found = [(key >> np.uint64(43)).astype(np.int64), *(x[order] for x in others)]
    # Where hashes collide, a row comes more than once, which does no harm.
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for x in found:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return np.stack([x[at] for x in found]).T, np.diff(np.r_[at, len(rows)])


def log_chances(model: Model, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 P(token | history) by token; for words outside the vocabulary, of their class only."""
    found = np.empty(len(ids))
    for own, rows, child, token in model.blocks(ids, starts):
        odds, total = model.odds(rows)
        chance = odds[np.arange(len(rows)), child].astype(np.float64) / total
        found[own] = np.bincount(token, np.log10(np.maximum(chance, 1e-300)))
    return found


def add_taken(model: Model, sums: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
    """Count the decisions taken, by row and child."""
    for _, rows, child, _ in model.blocks(ids, starts):
        np.add.at(sums.reshape(-1), (rows * WIDTH + child[:, None]).ravel(), np.float32(1))


def add_expected(model: Model, sums: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
    """Add the chances of all children at the decisions met, by row."""
    # A complex number is two neighbours, added in one go.
    pairs, place = sums.reshape(-1).view(np.complex64), np.arange(WIDTH // 2)
    for _, rows, _, _ in model.blocks(ids, starts, COMPARED):
        rows, met = _distinct(rows)
        for at in range(0, len(rows), BLOCK):
            own = rows[at : at + BLOCK]
            chance, total = model.odds(own)
            chance *= (met[at : at + BLOCK] / total).astype(np.float32)[:, None]
            values = chance.view(np.complex64).ravel()
            for used in own.T:
                np.add.at(pairs, (used[:, None] * (WIDTH // 2) + place).ravel(), values)


# --- training ----------------------------------------------------------------------


def _sum_batches(batches: Iterator[pa.RecordBatch], shared, add, groups: int) -> Iterator[pa.RecordBatch]:
    """What `add` sums up over a task's documents, in pieces."""
    listed, weights = shared.value
    model = Model(listed, weights)
    inside = pa.array(listed.tokens[: model.rest], pa.binary())
    sums, fresh, since = None, None, 0
    for batch in batches:
        for _, texts in _texts(batch):
            if sums is None:
                sums, fresh = np.zeros((2, model.rows, WIDTH), dtype=np.float32)
            tokens, starts = _tokens(texts)
            add(model, fresh, _ids(_places(tokens, inside), model.rest), starts)
            since += len(tokens)
            if since >= TOKENS_SUMMED * model.rows:
                sums += fresh
                fresh[:], since = 0, 0
    if sums is not None:
        sums += fresh
        task = TaskContext.get().partitionId()
        for piece, part in enumerate(np.array_split(sums, PIECES)):
            columns = [pa.array([x], pa.int32()) for x in (piece, task % groups, task)]
            columns.append(pa.array([part.astype("<f4").tobytes()], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["piece", "part", "task", "sums"])


def _add_batches(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Adds up neighbouring rows of a piece and group, in their order; `kind` is that of the numbers taken in."""
    key, total = None, None

    def row():
        columns = [pa.array([x], pa.int32()) for x in (*key, 0)] + [pa.array([total.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["piece", "part", "task", "sums"])

    for batch in batches:
        for piece, part, sums in zip(*[batch.column(c) for c in ("piece", "part", "sums")], strict=True):
            own, value = (piece.as_py(), part.as_py()), np.frombuffer(sums.as_buffer(), dtype=kind)
            if own == key:
                total += value
            else:
                if key is not None:
                    yield row()
                key, total = own, value.astype("<f8")
    if key is not None:
        yield row()


def _summed(training: DataFrame, listed: Listed, model: Model, add) -> np.ndarray | None:
    """The sums of `add` over all training documents; None without any."""
    schema = "piece int, part int, task int, sums binary"
    # Weights that are all zero need not travel.
    shared = training.sparkSession.sparkContext.broadcast((listed, model.weights if model.weights.any() else None))
    tasks = 1 + listed.n // (TOKENS_PER_ROW * model.rows)
    # As many groups of tasks as tasks in a group, so that either round is small.
    sum_up = partial(_sum_batches, shared=shared, add=add, groups=math.isqrt(tasks - 1) + 1)
    added = training.select("text").coalesce(tasks).mapInArrow(sum_up, schema)
    for keys, kind in ((["piece", "part"], "<f4"), (["piece"], "<f8")):
        if keys == ["piece"]:
            added = added.select("piece", F.lit(0).alias("part"), F.col("part").alias("task"), "sums")
        ordered = added.repartition(*keys).sortWithinPartitions("piece", "part", "task")
        added = ordered.mapInArrow(partial(_add_batches, kind=kind), schema)
    # PIECES rows that are as large as the model.
    pieces = sorted((row["piece"], row["sums"]) for row in added.collect())
    return np.concatenate([np.frombuffer(x, dtype="<f8").reshape(-1, WIDTH) for _, x in pieces]) if pieces else None


def train(training: DataFrame, listed: Listed, steps: int = STEPS) -> np.ndarray:
    """The weights after some steps over all training documents."""
    model = Model(listed)
    taken = _summed(training, listed, model, add_taken)
    for k in range(steps if taken is not None else 0):
        if k == 0:
            # Without weights, what is expected follows from the frequencies alone.
            expected = taken.sum(axis=1, keepdims=True) * np.exp(model.offset[model.node_of])
        else:
            expected = _summed(training, listed, model, add_expected)
        model.weights = model.step(taken, expected)
    return model.weights


# --- scoring -----------------------------------------------------------------------

_SCORED = [
    ("key", "binary"), ("token", "binary"), ("tf", "bigint"), ("doc_id", "bigint"), ("held_out", "boolean"),
    ("n_tokens", "bigint"), ("n_listed", "bigint"), ("base", "double"), ("model", "double"),
]
_ARROW = {"binary": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A row for every document (its token is its key, behind a byte no text has) and for each unlisted word.

    `base` and `model` lack only the log10(c + 0.1) of the unlisted words.
    """
    listed, weights = shared.value
    inside = pa.array(listed.tokens, pa.binary())
    lm = Model(listed, weights)
    logs = np.log10(np.array(listed.counts) + SMOOTHING)
    known = np.array(listed.counts) > 0
    base_mass, rest_mass = np.log10(listed.base_mass), np.log10(listed.rest_mass)

    def rows(**columns) -> pa.RecordBatch:
        size = len(columns["key"])
        types = {name: _ARROW[kind] for name, kind in _SCORED}
        arrays = [pa.array(columns[name], of) if name in columns else pa.nulls(size, of) for name, of in types.items()]
        return pa.RecordBatch.from_arrays(arrays, list(types))

    for batch in batches:
        for offset, texts in _texts(batch):
            doc_ids, held = (batch.column(c).slice(offset, len(texts)) for c in ("doc_id", "held_out"))
            tokens, starts = _tokens(texts)
            lengths = np.diff(np.r_[starts, len(tokens)])
            places = _places(tokens, inside)
            ids = _ids(places, lm.rest)
            own = np.where(places >= 0, logs[places], 0.0)
            outside = np.where(ids == lm.rest, own - rest_mass, 0.0)
            pairs = zip(doc_ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True)
            keys = [xxhash.xxh3_128_digest(b"%s|%s" % (str(doc_id).encode(), text)) for doc_id, text in pairs]
            yield rows(
                key=keys,
                token=[b"\xff" + key for key in keys],
                tf=np.zeros(len(keys), dtype=np.int64),
                doc_id=doc_ids,
                held_out=held,
                n_tokens=lengths,
                n_listed=np.add.reduceat(((places >= 0) & known[places]).astype(np.int64), starts),
                base=np.add.reduceat(own - base_mass, starts),
                model=np.add.reduceat(log_chances(lm, ids, starts) + outside, starts),
            )
            # How often each text has each of its unlisted words.
            missing = np.flatnonzero(places < 0)
            rare = tokens.take(pa.array(missing)).dictionary_encode()
            distinct = max(1, len(rare.dictionary))
            doc = np.repeat(np.arange(len(texts)), lengths)[missing]
            found, tf = np.unique(doc * distinct + rare.indices.to_numpy(), return_counts=True)
            yield rows(
                key=pa.array(keys, pa.binary()).take(pa.array(found // distinct)),
                token=rare.dictionary.take(pa.array(found % distinct)),
                tf=tf,
            )


def score(docs: DataFrame, listed: Listed, weights: np.ndarray, counts: DataFrame) -> DataFrame:
    """One row per document with both scores."""
    shared = docs.sparkSession.sparkContext.broadcast((listed, weights))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    schema = ", ".join(f"{name} {kind}" for name, kind in _SCORED)
    found = rows.mapInArrow(partial(_score_batches, shared=shared), schema)
    joined = found.join(counts, "token", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    is_word = F.col("tf") > 0
    # Copies of a document share a key; they are counted and told apart again at the end.
    sums = joined.groupBy("key").agg(
        F.count_if(~is_word).alias("copies"),
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("n_listed").alias("n_listed"),
        F.max("base").alias("base"),
        F.max("model").alias("model"),
        F.sum(F.when(is_word, F.col("tf") * F.log10(c + SMOOTHING)).otherwise(0.0)).alias("rare"),
        F.sum(F.when(is_word & (c > 0), F.col("tf")).otherwise(0)).alias("n_rare"),
    )
    each = sums.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    rare = F.col("rare") / F.col("copies")
    return each.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_listed") + (F.col("n_rare") / F.col("copies")).cast("bigint")).alias("n_known"),
        F.lit(listed.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + rare).alias("base_score"),
        (F.col("model") + rare).alias("score"),
    )


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Learn from nine folds of the documents and score all."""
    training = docs.where(~held_out())
    counts = cut_lineage(token_counts(training))
    listed = listed_tokens(counts)
    return score(docs, listed, train(training, listed), counts)
