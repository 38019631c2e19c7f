"""WARC records and a Merkle audit of their fixity.

Pages become WARC response records, laid out in segments. A replica's manifest has a leaf for each record:
its place, its offset range and the hash of its bytes. Above the leaves, `FAN` ordered neighbours share a
node, whose hash covers the ranges and hashes below it, up to one root. An audit compares the roots of two
replicas and descends only into nodes that differ, so that a healthy archive costs one comparison and a
damaged one a few more per damage.

Inside a segment, a record that is missing or of another length moves all records behind it: these are
`shifted`, their bytes are whole. The next segment starts anew, so damage never spreads beyond a segment.

Defined results: null url and html count as empty; a page without an id is filed by a hash of its content,
into one of `NO_ID_SEGMENTS` segments; copies of a page are records of their own, told apart by number; an
empty table gives an empty manifest, whose audit finds nothing; extra columns play no part.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage

FAN_BITS = 4
# Ids per segment; page_id is a key, so a segment has about as many records.
SEGMENT = 1_000
NO_ID_SEGMENTS = 4_096
RECORD_END = "\r\n\r\n"
LEAF = ["segment", "seq", "page_id", "copy", "offset", "length", "digest"]


# --- records -------------------------------------------------------------------------


def record_text() -> Column:
    """A page as a WARC response record, without the two line ends that close it."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    identity = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), url))
    return F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Record-ID: <urn:md5:"), identity, F.lit(">")),
        F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")),
        F.lit(""),
        html,
    )


def records(pages: DataFrame) -> DataFrame:
    """segment, page_id and record of every page."""
    content = F.pmod(F.xxhash64("url", "html"), F.lit(NO_ID_SEGMENTS))
    segment = F.coalesce(F.floor(F.col("page_id") / SEGMENT), -1 - content).cast("bigint")
    return pages.select(segment.alias("segment"), F.col("page_id").cast("bigint").alias("page_id"), record_text().alias("record"))


def write_warc(found: DataFrame, folder: str) -> None:
    """One WARC file per segment, records by page_id, written by the executors."""
    ordered = found.repartition("segment").sortWithinPartitions("segment", F.col("page_id").asc_nulls_last(), F.sha2("record", 256))
    ordered.select("segment", "record").write.partitionBy("segment").option("lineSep", RECORD_END).text(folder)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment, content in zip(batch.column("segment").to_pylist(), batch.column("content"), strict=True):
            data, at, found = content.as_py(), 0, []
            while at < len(data):
                head_end = data.find(b"\r\n\r\n", at)
                head = data[at : head_end if head_end >= 0 else len(data)]
                fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)
                size = fields.get(b"Content-Length", b"")
                end = head_end + 4 + int(size) if head_end >= 0 and size.isdigit() else len(data)
                found.append((segment, at, data[at:end].decode("utf-8", "replace")))
                at = end + len(RECORD_END)
            columns = [pa.array(list(column), kind) for column, kind in zip(zip(*found), (pa.int64(), pa.int64(), pa.string()))]
            if columns:
                yield pa.RecordBatch.from_arrays(columns, ["segment", "offset", "record"])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """segment, offset and record of all WARC files of a folder; a task holds one segment file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    segment = F.regexp_extract("path", r"segment=(-?\d+)", 1).cast("bigint").alias("segment")
    return files.select(segment, "content").mapInArrow(_parse_batches, "segment bigint, offset bigint, record string")


# --- the tree ------------------------------------------------------------------------


def manifest(found: DataFrame) -> DataFrame:
    """The leaves of a replica's records: place, offset range and hash of every record."""
    hashed = found.select(
        "segment", "page_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest")
    )
    in_segment = Window.partitionBy("segment").orderBy(F.col("page_id").asc_nulls_last(), "digest")
    so_far = F.sum(F.col("length") + len(RECORD_END)).over(in_segment.rowsBetween(Window.unboundedPreceding, 0))
    same_page = Window.partitionBy("segment", "page_id").orderBy("digest")
    return hashed.select(
        "segment",
        (F.row_number().over(in_segment) - 1).cast("bigint").alias("seq"),
        "page_id",
        (F.row_number().over(same_page) - 1).cast("bigint").alias("copy"),
        (so_far - F.col("length") - len(RECORD_END)).alias("offset"),
        "length",
        "digest",
    )


def _node(ordered: list[str]) -> list[Column]:
    """First and end offset, and the hash over the children in order; there are 2 ** FAN_BITS at most."""
    children = F.sort_array(F.collect_list(F.struct(*ordered, "start", "end", "hash")))
    line = F.transform(children, lambda c: F.concat_ws(" ", c["start"].cast("string"), c["end"].cast("string"), c["hash"]))
    return [F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(F.array_join(line, "\n"), 256).alias("hash")]


def heights(*manifests: DataFrame) -> list[bool]:
    """What the rounds from the leaves to the root join: True for neighbours in a segment, False for segments.

    Replicas are compared at equal heights, so the heights follow the larger one.
    """
    bounds = [m.agg(F.max("seq"), F.min("segment"), F.max("segment")).first() for m in manifests]
    known = [b for b in bounds if b[0] is not None] or [(0, 0, 0)]
    last, low, high = max(b[0] for b in known), min(b[1] for b in known), max(b[2] for b in known)
    rounds = []
    while last > 0:
        rounds.append(True)
        last >>= FAN_BITS
    # Segments of pages without an id are negative; they keep a root of their own beside the others.
    while low != high and (low, high) != (-1, 0):
        rounds.append(False)
        low, high = low >> FAN_BITS, high >> FAN_BITS
    return rounds


def tree(leaves: DataFrame, rounds: list[bool]) -> list[DataFrame]:
    """The levels from the leaves to the root; every level has (segment, seq, start, end, hash).

    Within segments, `seq` loses its last bits from level to level; above them, the segment does.
    """
    end = (F.col("offset") + F.col("length")).alias("end")
    levels = [leaves.select("segment", "seq", F.col("offset").alias("start"), end, F.col("digest").alias("hash"))]
    for inside in rounds:
        moved = "seq" if inside else "segment"
        up = levels[-1].withColumn("_parent", F.shiftright(moved, FAN_BITS))
        keys = ["segment", F.col("_parent").alias("seq")] if inside else [F.col("_parent").alias("segment"), "seq"]
        levels.append(cut_lineage(up.groupBy(*keys).agg(*_node([moved]))))
    return levels


def differing_leaves(one: list[DataFrame], other: list[DataFrame], rounds: list[bool]) -> DataFrame:
    """(segment, seq) of the leaf places that differ, found from the roots down."""
    suspects = None
    for k in range(len(one) - 1, -1, -1):
        a, b = one[k], other[k]
        if suspects is not None:
            parent = {"segment": F.col("segment"), "seq": F.col("seq")}
            moved = "seq" if rounds[k] else "segment"
            parent[moved] = F.shiftright(moved, FAN_BITS)
            keys = [column.alias(f"_{name}") for name, column in parent.items()]
            a = a.select("*", *keys).join(suspects, ["_segment", "_seq"], "left_semi")
            b = b.select("*", *keys).join(suspects, ["_segment", "_seq"], "left_semi")
        a = a.select("segment", "seq", F.struct("start", "end", "hash").alias("mine"))
        b = b.select("segment", "seq", F.struct("start", "end", "hash").alias("theirs"))
        both = a.join(b, ["segment", "seq"], "full")
        found = both.where(~F.col("mine").eqNullSafe(F.col("theirs"))).select("segment", "seq")
        if k == 0:
            return found
        suspects = cut_lineage(found.select(F.col("segment").alias("_segment"), F.col("seq").alias("_seq")))
        if suspects.isEmpty():
            break
    return suspects.select(F.col("_segment").alias("segment"), F.col("_seq").alias("seq"))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first manifest's leaves with a `status`, and the second's that the first lacks.

    intact: same place and bytes; shifted: same bytes at another offset; changed: other bytes; missing: only
    in the first; added: only in the second.
    """
    first, second = cut_lineage(first), cut_lineage(second)
    rounds = heights(first, second)
    wrong = cut_lineage(differing_leaves(tree(first, rounds), tree(second, rounds), rounds))
    one, other = (leaves.join(wrong, ["segment", "seq"], "left_semi") for leaves in (first, second))
    a = one.select("segment", "page_id", "copy", *[F.col(c).alias(f"a_{c}") for c in ("seq", "offset", "length", "digest")])
    b = other.select("segment", "page_id", "copy", *[F.col(c).alias(f"b_{c}") for c in ("seq", "offset", "length", "digest")])
    same = (
        (F.col("x.segment") == F.col("y.segment"))
        & F.col("x.page_id").eqNullSafe(F.col("y.page_id"))
        & (F.col("x.copy") == F.col("y.copy"))
    )
    pair = a.alias("x").join(b.alias("y"), same, "full")
    status = (
        F.when(F.col("b_digest").isNull(), "missing")
        .when(F.col("a_digest").isNull(), "added")
        .when(F.col("a_digest") != F.col("b_digest"), "changed")
        .when(F.col("a_offset") != F.col("b_offset"), "shifted")
        .otherwise("intact")
    )

    def either(name):
        return F.coalesce(f"a_{name}", f"b_{name}").alias(name)

    judged = pair.select(
        F.coalesce("x.segment", "y.segment").alias("segment"),
        either("seq"),
        F.coalesce("x.page_id", "y.page_id").alias("page_id"),
        F.coalesce("x.copy", "y.copy").alias("copy"),
        either("offset"),
        either("length"),
        either("digest"),
        status.alias("status"),
    )
    untouched = first.join(wrong, ["segment", "seq"], "left_anti").withColumn("status", F.lit("intact"))
    return untouched.select(*LEAF, "status").union(judged.select(*LEAF, "status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with damage at fixed places: first characters overwritten, and pages lost."""
    key = F.col("page_id")
    html = F.when(key % 97 == 13, F.concat(F.lit("?"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    return pages.where(~F.coalesce(key % 1999 == 5, F.lit(False))).withColumn("html", html)


def audit_of_damage(pages: DataFrame) -> DataFrame:
    """The audit of a damaged replica of the pages against the pages."""
    return audit(manifest(records(pages)), manifest(records(damaged(pages))))
