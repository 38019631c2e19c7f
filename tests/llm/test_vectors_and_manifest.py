"""Hard negatives, one-bit codes and the manifest against plain Python, on odd rows and in many blocks."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import blocks, hard_negatives, merkle_manifest, one_bit_codes

VECTORS = "vec_id bigint, embedding array<double>, label int"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _odd_vectors():
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)], i % 3) for i in range(60)]
    rows += [(100 * i, [draw.gauss(0, 1) for _ in range(6)], draw.randrange(3)) for i in range(1, 6)]
    rows += [
        (300, rows[5][1], 1), (300, rows[5][1], 1), (300, rows[5][1], 1),  # repeated rows, anchors among them
        (7, rows[0][1], 0), (9, rows[0][1], 2),  # ties
        (None, rows[0][1], 1), (None, None, None), (None, rows[3][1], 1),
        (800, None, 1), (900, rows[1][1], None), (1000, [], 1), (1100, [], 2), (61, [], 1),
        (62, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (63, [math.nan] + [0.0] * 5, 1), (64, [math.inf] + [0.0] * 5, 1),
        (1200, [0.0] * 6, 2), (65, [1e300, -1e300, 1.0, 0.0, 0.0, 0.0], 0), (1400, [1e300, 1e300, 0.0, 0.0, 0.0, 1.0], 0),
        (66, [300.0, 200.5, -400.25, 0.0, 0.0, 1e9], 1), (67, [1.0, 2.0], 1), (1500, [2.0, 1.0], 2), (68, [5e-324] * 6, 2),
        (-100, [3.0, 1.0, 0.5, 0.25, 0.125, 0.0], -4), (-700, [3.0, 1.0, 0.5, 0.25, 0.125, 0.0], 1),
    ]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    # Columns that clash with the names operators use or return.
    names = ("no", "copies", "dim", "data", "score", "rank", "query_id", "_cell")
    return spark.createDataFrame(_odd_vectors(), VECTORS).withColumns({name: F.lit(7) for name in names})


def _last(value):
    return (value is None, value or 0)


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def _negatives_by_hand(rows):
    taken = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x) for x in vector]
        moved = int(math.fmod(label + 1, 10)) if vec_id is not None and vec_id % 7 == 0 else label
        taken.append((vec_id, whole, moved))
    found = []
    for i, (anchor, a, label) in enumerate(taken):
        if anchor is None or anchor % 100:
            continue
        scored = []
        for j, (other, b, its) in enumerate(taken):
            if i != j and len(a) == len(b):
                product = sum(x * y for x, y in zip(a, b, strict=True))
                scored.append((max(-(2**63), min(2**63 - 1, product)), other, its == label))
        scored.sort(key=lambda s: (-s[0], _last(s[1])))
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            inside = [s for s in scored if not s[2] and 80 * p <= 100 * s[0] <= 100 * p][:5]
            found += [(anchor, positive, rank, n[1], p, n[0]) for rank, n in enumerate(inside, 1)]
    return _sorted(found)


def test_hard_negatives_by_hand(vectors):
    found = hard_negatives.hard_negatives(vectors)
    assert _sorted(map(tuple, found.collect())) == _negatives_by_hand(_odd_vectors())


def _nearest_by_hand(rows):
    taken = []
    for vec_id, vector, _ in rows:
        if vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            most = math.frexp(max(map(abs, vector)))[1]
            taken.append((vec_id, np.array([math.ldexp(x, -most) for x in vector])))
    found = []
    for i, (query, q) in enumerate(taken):
        if query is None or query % 50:
            continue
        near = []
        for j, (other, x) in enumerate(taken):
            if i != j and len(q) == len(x):
                near.append((round(float(q @ x / math.sqrt(q @ q) / math.sqrt(x @ x)), 12), other))
        near.sort(key=lambda s: (-s[0], _last(s[1])))
        found += [(query, rank, other, score) for rank, (score, other) in enumerate(near[:5], 1)]
    return _sorted(found)


def test_nearest_by_hand(vectors):
    found = [(*r[:3], round(r[3], 12)) for r in one_bit_codes.nearest(vectors).collect()]
    assert _sorted(found) == _nearest_by_hand(_odd_vectors())


@pytest.mark.parametrize("operator", [hard_negatives.hard_negatives, one_bit_codes.nearest])
def test_blocks_do_not_change_results(spark, folder, operator, monkeypatch):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    whole = _sorted(map(tuple, operator(table).collect()))
    assert whole
    for name, value in {"QUERIES": 2, "ROWS": 30}.items():
        monkeypatch.setattr(blocks, name, value)
    cut = _sorted(map(tuple, operator(table.repartition(5)).collect()))
    assert cut == whole


def test_tables_without_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    none = spark.createDataFrame([(1, [1.0], 1), (100, None, 1)], VECTORS)
    for table in (empty, none):
        assert hard_negatives.hard_negatives(table).collect() == []
        assert one_bit_codes.nearest(table).collect() == []


@pytest.mark.parametrize("dim", [1, 64, 300, 2_500])
@pytest.mark.parametrize("most", [3, 256, 1 << 31, 1 << 70])
def test_residue_products_are_exact(dim, most):
    draw = random.Random(dim)
    a, b = (np.array([[draw.randint(-most, most) for _ in range(dim)] for _ in range(3)], dtype=object) for _ in range(2))
    kind = object if most > 1 << 40 else np.int64
    wanted = np.clip(a @ b.T, -(2**63), 2**63 - 1).astype(np.int64)
    assert (hard_negatives.exact_products(a.astype(kind), b.astype(kind)) == wanted).all()


def test_moduli_stay_exact_in_float32():
    for dim in (1, 64, 1_000, 5_000):
        for bound in (1, 1 << 23, 1 << 61, 1 << 2_000):
            chosen, inner = hard_negatives.moduli(bound, dim)
            assert math.prod(chosen) > 2 * bound
            assert all(inner * (p // 2) ** 2 <= 1 << 24 for p in chosen)


def test_bounds_hold_and_spare_most_comparisons():
    draw = np.random.default_rng(5)
    points, asked = draw.standard_normal((20_000, 64)), draw.standard_normal((50, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    codes, correction = one_bit_codes.encode(points)
    estimate, reach = one_bit_codes.Queries(asked).bounds(slice(0, 50), codes, correction)
    cosine = asked @ points.T
    assert (np.abs(estimate - cosine) > reach).mean() < 2e-4
    assert abs((estimate - cosine).mean()) < 1e-3
    fifth = np.sort(cosine, axis=1)[:, -5]
    assert (estimate + reach >= fifth[:, None]).mean() < 0.1


def test_recall_of_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    wanted = {r[:3] for r in _nearest_by_hand([(r["vec_id"], r["embedding"], 0) for r in rows])}
    found = {tuple(r[:3]) for r in one_bit_codes.nearest(table).collect()}
    assert len(found & wanted) >= 0.99 * len(wanted)


# --- the manifest --------------------------------------------------------------------


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _paths(nodes):
    """The last node over `nodes`, and the siblings before and after each of them on its way up."""
    found, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(place):
            start = at // 16 * 16
            run = nodes[start : start + 16]
            found[i].append(("".join(run[: at - start]), "".join(run[at - start + 1 :])))
            place[i] = at // 16
        nodes = [_hash("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], found


def _manifest_by_hand(rows):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    sources = {}
    for doc_id, text, lang, source, n_chars in rows:
        other = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            other = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        head = field(doc_id) + field(source) + field(lang) + field(n_chars)
        sources.setdefault(source, []).append((doc_id, _hash(head + field(text)), _hash(head + field(other))))
    ordered = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in ordered:
        sources[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(_paths([r[1] for r in sources[source]]))
    if not trees:
        return []
    root, above = _paths([t[0] for t in trees])
    found = []
    for source, (subroot, below), upper in zip(ordered, trees, above, strict=True):
        for (doc_id, leaf, other), own in zip(sources[source], below, strict=True):
            path, at = own + upper, other
            for before, after in path:
                at = _hash(before + at + after)
            proof = _hash("".join(before + after for before, after in path))
            found.append((doc_id, leaf, subroot, root, proof, at, at == root))
    return _sorted(found)


ODD_DOCS = (
    [(1, None, None, None, None), (2, "", "en", "", 0), (None, "Xx", "en", "b", 2), (None, "Xx", "en", "b", 2)]
    + [(5, "CoPy", "en", "c", 4)] * 300
    + [(i, f"Text {i}", None, "d", i) for i in range(17)]
    + [(4, "Same", "en", "b", 4), (4, "Other", "en", "b", 4), (6, "Ö ß WORD " * 20_000, "de", "e", None)]
    + [(-i, "AB", "en", f"s{i}", 2) for i in range(300)]
)


@pytest.mark.parametrize("rows", [ODD_DOCS, ODD_DOCS[:1], ODD_DOCS[:3], ODD_DOCS[4:21], ODD_DOCS[4:20], []])
def test_manifest_by_hand(spark, rows, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "COPIES_AT_ONCE", 7)
    names = ("leaf", "root", "pos", "n", "hash", "path", "slot_0", "_source", "_copies")
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({name: F.lit(7) for name in names})
    assert _sorted(map(tuple, merkle_manifest.manifest(docs).collect())) == _manifest_by_hand(rows)


def test_manifest_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = merkle_manifest.manifest(docs)
    assert _sorted(map(tuple, found.collect())) == _manifest_by_hand(rows)
    assert found.where("not verified").count() > 0


def test_untouched_texts_verify(spark):
    docs = spark.createDataFrame(ODD_DOCS, DOCS)
    assert merkle_manifest.manifest(docs, F.col("text")).where("not verified").isEmpty()


def test_places_do_not_follow_a_hot_source(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("s"), "id")
    placed = merkle_manifest.numbered(rows.withColumn("_copies", F.lit(1).cast("bigint")), ["s"], [F.col("id")])
    found = {r["id"]: (r["pos"], r["n"]) for r in placed.where("s = 'hot'").collect()}
    hot = [i for i in range(5_000) if i % 3 > 0]
    assert found == {i: (k, len(hot)) for k, i in enumerate(hot)}
