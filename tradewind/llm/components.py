"""Connected components of a graph that no machine holds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from ..operators.skew import join_keyed

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node among it and its neighbours."""
    both = cut_lineage(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    # The root of a large component is a hot key.
    hung = join_keyed(both, least, ["u"], "n", both.agg(F.count("*")).scalar(), ["v"])
    return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; `u > v` in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hung = join_keyed(edges, least, ["u"], "n", edges.agg(F.count("*")).scalar(), ["v"])
    moved = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node of the component.

    Alternating large and small stars turn each component into a star around its smallest node. Self-loops
    and repeated edges do no harm; a node without an edge to another does not appear; no edges, no rows.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = cut_lineage(pairs.distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        marks = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")]
        found = tuple(current.agg(*marks).first())
        if found == state or not found[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = found
        stars = cut_lineage(_large_star(current).distinct())
        current = cut_lineage(_small_star(stars).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
