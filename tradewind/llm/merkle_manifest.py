"""Merkle manifest of a dataset, built and proved by slot pivots.

Every document is a leaf. Per source, the leaves ascend by id; `FANOUT` consecutive nodes have a parent, up to
the source's subroot, and the subroots of all sources have parents in the same way, up to the root.

A level is one grouping: conditional aggregates spread the children of a parent into `FANOUT` columns, one for
each slot. The columns in order, put together, hash to the parent. Without a child's own column they are its
siblings, so that the proofs come from the same rows, from the root down: a node's path is its own siblings,
then its parent's path. No leaf is ever joined with the nodes above its parent.

Places are counted without a window over a whole source: the leaves are range partitioned by source and id,
counted in each partition, and only these counts are added up. Equal leaves of the same id are one row until
they have their places.

Defined results: nulls are hashed as `-`; a null source is a source of its own, the first; a null id comes
before all others of its source and its row is never tampered with; equal ids are ordered by their leaves, so
repeated rows are neighbours, each with a place and a proof; a source of one document is its own subroot, one
source alone its own root, and a proof without siblings is the hash of the empty text; an empty table gives an
empty table; extra columns play no part.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .text import lower_ascii

FANOUT = 16
TAMPER_EVERY = 5
COPIES_AT_ONCE = 10_000
# A source as a group of nodes; a null source is told apart by the flag, and comes first by it.
GROUP = ["_named", "_source"]
SLOTS = [f"slot_{i}" for i in range(FANOUT)]
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of strings put together; nulls are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A value with its length in front, so that no two rows run together to the same text; `-` is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text))


def tampered_text() -> Column:
    """The text in lower case where the document's id is dealt to be tampered with."""
    dealt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    return F.when(F.coalesce(dealt, F.lit(False)), lower_ascii(F.col("text"))).otherwise(F.col("text"))


def leaves(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """Group, doc_id, leaf and, where the text `found` now hashes to another leaf, that one as `now`."""
    own, other = leaf_digest(F.col("text")), leaf_digest(F.col("text") if found is None else found)
    return docs.select(
        F.col("source").isNotNull().alias("_named"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        own.alias("leaf"),
        F.nullif(other, own).alias("now"),
    )


# --- places --------------------------------------------------------------------------


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """`rows`, distinct ones with their `_copies`, as often as counted, with `pos` in the group from 0 and its size `n`.

    Range partitions hold consecutive rows. A window numbers the rows of a partition, another adds up one
    count for each partition and group.
    """
    keys = [F.col(c) for c in group] + order
    placed = cut_lineage(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counted = placed.groupBy(*group, "_part").agg(F.sum("_copies").alias("_here"))
    whole = Window.partitionBy(*group)
    before = F.sum("_here").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_here")
    offsets = counted.select(*group, "_part", before.alias("_before"), F.sum("_here").over(whole).alias("n"))
    local = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    until = placed.withColumn("_until", F.sum("_copies").over(local)).join(offsets, [*group, "_part"])
    first = F.col("_before") + F.col("_until") - F.col("_copies")
    # A row with very many copies is spread over several tasks.
    zero = F.lit(0).cast("bigint")
    lots = until.select("*", first.alias("_first"), F.explode(F.sequence(zero, F.floor((F.col("_copies") - 1) / COPIES_AT_ONCE))).alias("_lot"))
    if group:
        lots = lots.repartition(*group, "_part", "_lot")
    here = F.least(F.lit(COPIES_AT_ONCE), F.col("_copies") - F.col("_lot") * COPIES_AT_ONCE) - 1
    each = lots.select("*", F.explode(F.sequence(zero, here)).alias("_copy"))
    pos = (F.col("_first") + F.col("_lot") * COPIES_AT_ONCE + F.col("_copy")).alias("pos")
    taken = [c for c in rows.columns if c != "_copies"]
    return each.select(*taken, pos, "n")


# --- the tree ------------------------------------------------------------------------


@dataclass
class Tree:
    """Levels from the bottom up. `nodes[k]` are the places of level k; `parents[k]` their pivoted parents.

    A group whose level k has one node ends there; `parents[k]` has the others.
    """

    nodes: list[DataFrame]
    parents: list[DataFrame]


def pivot(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One row for each parent of `nodes` (group, pos, n, hash): its slots' hashes, and carried columns slot by slot."""
    slot = F.col("pos") % FANOUT
    spread = [
        F.max(F.when(slot == i, F.col(c))).alias(name if c == "hash" else f"{name}_{c}")
        for c in ["hash", *carried]
        for i, name in enumerate(SLOTS)
    ]
    parent = F.floor(F.col("pos") / FANOUT).alias("pos")
    above = F.max(F.ceil(F.col("n") / FANOUT)).alias("n")
    found = nodes.where("n > 1").groupBy(*GROUP, parent).agg(above, *spread)
    return found.withColumn("hash", digest(*[F.col(s) for s in SLOTS]))


def climb(bottom: DataFrame, carried: list[str]) -> Tree:
    """The levels above `bottom`; only its own pivot has the carried columns."""
    most = bottom.agg(F.max("n")).first()[0] or 0
    tree = Tree([bottom], [])
    while most > 1:
        parents = cut_lineage(pivot(tree.nodes[-1], carried))
        tree.parents.append(parents)
        tree.nodes.append(parents.select(*GROUP, "pos", "n", "hash"))
        most, carried = -(-most // FANOUT), []
    return tree


def tops(tree: Tree) -> DataFrame:
    """Group and hash of the last node of every group."""
    ends = [level.where("n = 1").select(*GROUP, "hash") for level in tree.nodes]
    return reduce(DataFrame.union, ends)


def children(parents: DataFrame, carried: list[str]) -> DataFrame:
    """Group, parent, pos, hash, siblings and carried columns of every child, from its parent's pivoted row."""
    # Slots are filled from the first on.
    filled = F.filter(F.array(*SLOTS), lambda s: s.isNotNull()).alias("_slots")
    spread = [F.array(*[f"{s}_{c}" for s in SLOTS]).alias(f"_{c}s") for c in carried]
    row = parents.select(*GROUP, F.col("pos").alias("parent"), filled, *spread)
    at = F.col("_at")
    child = row.select("*", F.explode(F.sequence(F.lit(0), F.size("_slots") - 1)).alias("_at"))
    before = F.array_join(F.slice("_slots", F.lit(1), at), "")
    after = F.array_join(F.slice("_slots", at + 2, F.lit(FANOUT)), "")
    return child.select(
        *GROUP,
        "parent",
        (F.col("parent") * FANOUT + at).alias("pos"),
        F.get("_slots", at).alias("hash"),
        F.struct(before.alias("before"), after.alias("after")).alias("own"),
        *[F.get(f"_{c}s", at).alias(c) for c in carried],
    )


def paths(tree: Tree, top: DataFrame, carried: list[str]) -> DataFrame:
    """Every node of the bottom level with the `path` from it up, and what `top` (group, path, ..) says of its group.

    From the top level down: a child's path is its own siblings, then the path of its parent.
    """
    said = [c for c in top.columns if c not in (*GROUP, "path")]

    def ended(level):
        own = [c for c in (["hash", *carried] if level is tree.nodes[0] else [])]
        return level.where("n = 1").select(*GROUP, "pos", *own).join(top, GROUP)

    found = ended(tree.nodes[-1])
    for k in range(len(tree.parents) - 1, -1, -1):
        here = carried if k == 0 else []
        below = children(tree.parents[k], here)
        above = found.select(*GROUP, F.col("pos").alias("parent"), F.col("path").alias("_above"), *said)
        joined = below.join(above, [*GROUP, "parent"])
        own = ["hash", *here] if k == 0 else []
        whole = F.concat(F.array("own"), "_above").alias("path")
        down = joined.select(*GROUP, "pos", *own, whole, *said)
        found = down.unionByName(ended(tree.nodes[k]))
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path hash to."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


# --- the operator --------------------------------------------------------------------


def proofs(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """doc_id, leaf, now (the leaf of the text found, if another), path, subroot and root of every document."""
    rows = leaves(docs, found)
    # Once hashed, the texts are not needed any more.
    counted = cut_lineage(rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("now").asc_nulls_first()]
    placed = numbered(counted, GROUP, order).withColumnRenamed("leaf", "hash")
    sources = climb(cut_lineage(placed), ["doc_id", "now"])
    subroots = cut_lineage(tops(sources))

    # The sources are the leaves of one more tree, whose nodes are all of one group.
    listed = subroots.select(*[F.col(c).alias(f"of{c}") for c in GROUP], "hash", F.lit(1).cast("bigint").alias("_copies"))
    alone = [F.lit(True).alias("_named"), F.lit("").alias("_source")]
    by_source = [F.col(f"of{c}") for c in GROUP]
    upper = climb(cut_lineage(numbered(listed, [], by_source).select("*", *alone)), [f"of{c}" for c in GROUP])
    root = tops(upper).select(*GROUP, F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    of_sources = paths(upper, root, [f"of{c}" for c in GROUP])
    named = of_sources.select(*[F.col(f"of{c}").alias(c) for c in GROUP], F.col("hash").alias("subroot"), "path", "root")
    known = paths(sources, cut_lineage(named), ["doc_id", "now"])
    return known.select("doc_id", F.col("hash").alias("leaf"), "now", "path", "subroot", "root")


def manifest(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """The manifest of the documents and, for each, whether the text `found` still leads to the root.

    doc_id, leaf, subroot, root, proof_sha256, folded_root and verified; by default, some texts are tampered with.
    """
    known = proofs(docs, tampered_text() if found is None else found)
    back = folded(F.coalesce("now", "leaf"), F.col("path"))
    shown = known.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"), back.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
