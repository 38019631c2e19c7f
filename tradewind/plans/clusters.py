"""Product groups found in descriptions.

The corpus is the invoice lines, but equal descriptions are one document with a weight, so term
statistics and clustering see each distinct description once.
"""

import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import kmeans
from ..operators.lineage import cut_lineage
from .pricing import MIN_LINES, price_elasticity, sold_by

MAX_TERMS = 500
CLUSTERS = 8


def description_vectors(
    lines: DataFrame, max_terms: int = MAX_TERMS, min_lines: int = MIN_LINES, items: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """Unit-length TF-IDF vectors (smoothed, plus one) of the distinct descriptions sold often enough.

    Returns the vectors with their line counts and the vocabulary: the most frequent terms over all
    lines. Only those terms and their document counts, at most `max_terms` rows, reach the driver.
    """
    documents = sold_by(lines, ["description"], items)
    documents = documents.select("description", F.col("lines").cast("double").alias("weight"))
    documents = documents.where(F.col("weight") >= min_lines)
    # Term statistics and every clustering read the documents again; the lines are read once.
    documents = cut_lineage(documents)
    words = Pipeline(
        stages=[
            RegexTokenizer(inputCol="description", outputCol="all_terms", pattern=r"\w\w+", gaps=False),
            StopWordsRemover(inputCol="all_terms", outputCol="terms"),
        ]
    )
    tokenized = words.fit(documents).transform(documents)
    occurrences = tokenized.select("weight", "terms", F.explode("terms").alias("term"))
    distinct_terms = tokenized.select("weight", F.explode(F.array_distinct("terms")).alias("term"))
    frequent = occurrences.groupBy("term").agg(F.sum("weight").alias("total"))
    spread = distinct_terms.groupBy("term").agg(F.sum("weight").alias("documents"))
    top = frequent.join(spread, "term").orderBy(F.desc("total"), "term").limit(max_terms).collect()
    if not top:
        raise ValueError("no term is left after removing stop words")

    n = documents.agg(F.sum("weight")).first()[0]
    vocabulary = [row["term"] for row in top]
    idf = [math.log((1 + n) / (1 + row["documents"])) + 1 for row in top]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="counts")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted")
    unit = Normalizer(inputCol="weighted", outputCol="features", p=2.0)
    vectors = unit.transform(scale.transform(counter.transform(tokenized)))
    return vectors.select("description", "weight", "features"), vocabulary


def _points(vectors: DataFrame, dimensions: int) -> DataFrame:
    """The vectors in sparse form, stored, as every step reads them."""
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    dense = vectors.select(F.col("description").alias("key"), "weight", vector_to_array("features").alias("_dense"))
    indices = F.filter(places, lambda i: F.get("_dense", i) != 0)
    found = dense.withColumn("indices", indices)
    values = F.transform("indices", lambda i: F.get("_dense", i))
    return cut_lineage(found.select("key", "weight", "indices", values.alias("values")))


def description_clusters(
    lines: DataFrame, k: int = CLUSTERS, terms: int = 3, min_lines: int = MIN_LINES, items: DataFrame | None = None
) -> DataFrame:
    """Cluster of every description, named by the heaviest terms of its centre."""
    vectors, vocabulary = description_vectors(lines, min_lines=min_lines, items=items)
    points = _points(vectors, len(vocabulary))
    centers = kmeans.fit(points, [k], len(vocabulary))[k]
    names = []
    for center in centers.round(kmeans.DIGITS):
        order = sorted(range(len(vocabulary)), key=lambda i: (-center[i], vocabulary[i]))
        names.append(" / ".join(vocabulary[i] for i in order[:terms] if center[i] > 0))
    # One name per cluster.
    titles = F.array(*[F.lit(name) for name in names])
    labeled = points.withColumn("cluster", kmeans.nearest(centers))
    return labeled.select(
        F.col("key").alias("description"),
        "cluster",
        F.get(titles, F.col("cluster").cast("int")).alias("category"),
        F.col("weight").cast("bigint").alias("lines"),
    )


def cluster_samples(clusters: DataFrame, n: int = 10) -> DataFrame:
    """The first descriptions of each cluster, for reading what it is about."""
    order = Window.partitionBy("cluster").orderBy("description")
    ranked = clusters.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
    return ranked.select("cluster", "category", F.col("position").cast("bigint").alias("position"), "description")


def elbow_wcss(
    lines: DataFrame, max_k: int = 14, min_lines: int = MIN_LINES, items: DataFrame | None = None
) -> DataFrame:
    """Within-cluster sum of squares for k = 1 .. max_k, all fitted in the same steps."""
    vectors, vocabulary = description_vectors(lines, min_lines=min_lines, items=items)
    points = _points(vectors, len(vocabulary))
    centers = kmeans.fit(points, list(range(1, max_k + 1)), len(vocabulary))
    return kmeans.costs(points, centers)


def category_elasticity(lines: DataFrame, k: int = CLUSTERS, items: DataFrame | None = None) -> DataFrame:
    """Mean elasticity of the descriptions in each cluster."""
    clusters = description_clusters(lines, k, items=items).select("description", "category")
    joined = price_elasticity(lines, items=items).join(clusters, "description", "left")
    return joined.where(F.col("category").isNotNull()).groupBy("category").agg(
        F.avg("price_elasticity").alias("price_elasticity"), F.count("*").alias("descriptions")
    )
