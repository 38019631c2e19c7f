"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import table
from . import hard_negatives, language_id, maxent_lm, merkle_manifest, mixing, one_bit_codes, order_minhash, pii
from . import quality_classifier, quality_rules, sentencepiece_codec, simhash, warc_fixity

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(table(spark, folder, name))


def _replaced(docs: DataFrame) -> DataFrame:
    return pii.replace_entities(docs).select("doc_id", "text", "n_entities")


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": _on("documents", quality_rules.judged_ids),
        "op2_quality_classifier": _on("documents", quality_classifier.classify),
        "op3_mixing": _on("documents", mixing.mixed_sizes),
        "op4_language_id": _on("documents", language_id.language_id),
        "op5_pii": _on("documents", _replaced),
        "op6_order_minhash": _on("documents", order_minhash.edited_neighbours),
        "op7_maxent_lm": _on("documents", maxent_lm.language_model_scores),
        "op8_warc_fixity": _on("pages", warc_fixity.audit_of_damage),
        "op9_sentencepiece": _on("documents", sentencepiece_codec.encode_digests),
        "op10_simhash": _on("documents", simhash.classify),
        "op11_hard_negatives": _on("embeddings", hard_negatives.hard_negatives),
        "op12_merkle_manifest": _on("documents", merkle_manifest.manifest),
        "op13_one_bit_codes": _on("embeddings", one_bit_codes.nearest),
    }


# Written from the definition of a WARC record and of the audit, without a tree.
_WARC_AUDIT = r"""
WITH raw AS (
    SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, page_id // 1000 AS segment FROM pages
), replicas AS (
    SELECT 1 AS replica, page_id, url, html, segment FROM raw
    UNION ALL
    SELECT 2, page_id, url, CASE WHEN page_id % 97 = 13 THEN '?' || substr(html, 2) ELSE html END, segment
    FROM raw WHERE page_id % 1999 <> 5
), record AS (
    SELECT replica, page_id, segment,
        'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
        || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
        || 'WARC-Record-ID: <urn:md5:' || md5(page_id::VARCHAR || ' ' || url) || '>' || chr(13) || chr(10)
        || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || html AS content
    FROM replicas
), placed AS (
    SELECT replica, page_id, segment, strlen(content)::BIGINT AS length, sha256(content) AS digest,
        (row_number() OVER w - 1)::BIGINT AS seq,
        (sum(strlen(content) + 4) OVER w - strlen(content) - 4)::BIGINT AS "offset"
    FROM record
    WINDOW w AS (PARTITION BY replica, segment ORDER BY page_id ROWS UNBOUNDED PRECEDING)
)
SELECT a.segment::BIGINT AS segment, a.seq, a.page_id, 0::BIGINT AS copy, a."offset", a.length, a.digest,
    CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'changed'
        WHEN a."offset" <> b."offset" THEN 'shifted' ELSE 'intact' END AS status
FROM placed a LEFT JOIN placed b ON a.page_id = b.page_id AND b.replica = 2
WHERE a.replica = 1
"""


# All anchors against all rows, in whole numbers.
_HARD_NEGATIVES = r"""
WITH kept AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""

# All queries against all rows, without codes.
_NEAREST = r"""
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pair AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
    FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pair QUALIFY rank <= 5
"""

# Levels of sixteens that hold any table of SQL's size.
_LEVELS = 8


def _climbed(nodes: str, walkers: str, source: str) -> list[str]:
    """CTEs `nodes`1.. and `walkers`1..: a level's nodes, and each walker's place, hash and proof so far on it."""
    found = []
    for k in range(_LEVELS):
        below, walk = f"{nodes}{k}", f"{walkers}{k}"
        found.append(f"""{nodes}{k + 1} AS (
    SELECT {source}, pos // 16 AS pos, ceil(max(n) / 16)::BIGINT AS n,
        CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h
    FROM {below} GROUP BY {source}, pos // 16
)""")
        found.append(f"""{walkers}{k + 1} AS (
    SELECT w.row, w.{source}, w.pos // 16 AS pos,
        CASE WHEN max(s.n) > 1 THEN sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.cur ELSE s.h END, '' ORDER BY s.pos))
            ELSE max(w.cur) END AS cur,
        max(w.proof) || coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos <> w.pos), '') AS proof
    FROM {walk} w JOIN {below} s ON s.{source} = w.{source} AND s.pos // 16 = w.pos // 16
    GROUP BY w.row, w.{source}, w.pos
)""")
    return found


def _manifest() -> str:
    def leaf(text):
        parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 bit by bit: a byte goes in, then eight shifts (-1).
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"""xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, b:
        CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""
    steps = [
        f"""leaf AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce('+' || source, '') AS src, {leaf("text")} AS h,
        CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS cur
    FROM documents
)""",
        """a0 AS (
    SELECT row, doc_id, cur, src, h, count(*) OVER (PARTITION BY src) AS n,
        row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, h, cur) - 1 AS pos FROM leaf
)""",
        "b0 AS (SELECT row, src, pos, cur, '' AS proof FROM a0)",
        *_climbed("a", "b", "src"),
        f"""c0 AS (
    SELECT 0 AS everything, src, h, count(*) OVER () AS n, row_number() OVER (ORDER BY src) - 1 AS pos FROM a{_LEVELS}
)""",
        f"""d0 AS (
    SELECT b.row, 0 AS everything, c.pos, b.cur, b.proof FROM b{_LEVELS} b JOIN c0 c ON c.src = b.src
)""",
        *_climbed("c", "d", "everything"),
    ]
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(d.proof) AS proof_sha256, d.cur AS folded_root,
    d.cur = r.h AS verified
FROM leaf l JOIN c0 s ON s.src = l.src JOIN d{_LEVELS} d ON d.row = l.row CROSS JOIN c{_LEVELS} r
"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op8_warc_fixity": _WARC_AUDIT,
        "op11_hard_negatives": _HARD_NEGATIVES,
        "op12_merkle_manifest": _manifest(),
        "op13_one_bit_codes": _NEAREST,
    }
