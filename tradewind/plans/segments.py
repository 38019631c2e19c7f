"""Feature building, principal components and k-means segments of the behaviour table."""

import json
import math
from collections.abc import Iterator
from functools import cached_property, partial
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import eigen, fixed_point, kmeans
from ..operators.lineage import cut_lineage

STANDARDIZED = ["visit_number", "time_on_site", "pageviews", "session_quality", "totals_revenue", "price"]
CATEGORICAL = ["main_category", "continent", "action"]
CYCLE = ["month_sin", "month_cos"]
IDS = ["users", "visit_id", "transaction_id"]
COMPONENTS = 5
SEGMENTS = 4


def feature_frame(behavior: DataFrame) -> DataFrame:
    """The cleaned behaviour columns used for segmentation, without nulls among the features.

    Missing amounts, prices and counts are zero, missing categories are `Other`.
    """
    main = F.coalesce(F.nullif(F.col("main_category"), F.lit("")), F.lit("Other"))
    return behavior.select(
        *IDS,
        "visit_number",
        F.coalesce("time_on_site", F.lit(0)).alias("time_on_site"),
        F.coalesce("pageviews", F.lit(0)).alias("pageviews"),
        F.coalesce("session_quality", F.lit(0)).alias("session_quality"),
        F.coalesce("totals_revenue", F.lit(0.0)).alias("totals_revenue"),
        F.coalesce("transactions", F.lit(0)).alias("transactions"),
        F.coalesce("price", F.lit(0.0)).alias("price"),
        F.coalesce("action", F.lit("Other")).alias("action"),
        F.coalesce("continent", F.lit("Other")).alias("continent"),
        main.alias("main_category"),
        F.month(F.to_date("date", "yyyyMMdd")).cast("bigint").alias("month"),
    )


def standardize(features: DataFrame, columns: list[str] = STANDARDIZED) -> DataFrame:
    """Z-scores with the population deviation; means and deviations come from one aggregate."""
    values = {c: F.col(c).cast("double") for c in columns}
    moments = [F.avg(v).alias(f"mean_{c}") for c, v in values.items()]
    moments += [F.stddev_pop(v).alias(f"std_{c}") for c, v in values.items()]
    stats = features.agg(F.struct(*moments)).scalar()
    # A constant column keeps its scale, so that it becomes zero instead of null.
    scores = {
        c: (v - F.col(f"stats.mean_{c}")) / F.coalesce(F.nullif(F.col(f"stats.std_{c}"), F.lit(0.0)), F.lit(1.0))
        for c, v in values.items()
    }
    return features.withColumn("stats", stats).withColumns(scores).drop("stats")


def cyclical_month(features: DataFrame) -> DataFrame:
    angle = F.col("month") * (2 * math.pi / 12)
    return features.withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def one_hot_stages(columns: list[str] = CATEGORICAL) -> list:
    """Dummies without the alphabetically first level: indexed last, so that dropLast drops it."""
    indexed = [f"{c}_index" for c in columns]
    encoded = [f"{c}_dummies" for c in columns]
    return [
        StringIndexer(inputCols=columns, outputCols=indexed, stringOrderType="alphabetDesc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
    ]


def dummy_names(indexer, columns: list[str] = CATEGORICAL) -> dict[str, list[str]]:
    """Levels behind each dummy vector, in vector order."""
    return {c: list(labels[:-1]) for c, labels in zip(columns, indexer.labelsArray)}


def one_hot_counts(features: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """Rows per dummy column, in long form."""
    features = cut_lineage(features.select(*columns))
    model = Pipeline(stages=one_hot_stages(columns)).fit(features)
    names = dummy_names(model.stages[0], columns)
    encoded = model.transform(features)
    sums = encoded.select(*[Summarizer.sum(F.col(f"{c}_dummies")).alias(c) for c in columns])
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(level).alias("level"),
            F.get(vector_to_array(F.col(c)), F.lit(i)).cast("bigint").alias("rows"),
        )
        for c in columns
        for i, level in enumerate(names[c])
    ]
    return sums.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def feature_covariance(features: DataFrame) -> DataFrame:
    """Population covariance of every pair of numeric features, from one aggregate: what the components rest on."""
    names = [*STANDARDIZED, "transactions", *CYCLE]
    pairs = list(combinations_with_replacement(names, 2))
    prepared = cyclical_month(standardize(features))
    found = prepared.agg(
        F.array(
            *[
                F.struct(F.lit(a).alias("feature"), F.lit(b).alias("other"), F.covar_pop(a, b).alias("covariance"))
                for a, b in pairs
            ]
        ).alias("cells")
    )
    return found.select(F.explode("cells").alias("cell")).select("cell.*")


def _moment_batches(batches: Iterator[pa.RecordBatch], numeric: list[str]) -> Iterator[pa.RecordBatch]:
    """Number of rows, sums and sums of products by combination of levels, over a task's rows; nulls add nothing."""
    first, second = np.array(list(combinations_with_replacement(range(len(numeric)), 2))).T
    sums: dict[tuple, list[np.ndarray]] = {}
    for batch in batches:
        levels = pa.Table.from_batches([batch.select(CATEGORICAL)])
        groups = levels.append_column("row", pa.array(np.arange(len(batch)))).group_by(CATEGORICAL).aggregate([("row", "list")])
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in numeric], axis=1)
        cells = np.nan_to_num(np.concatenate([np.ones((len(x), 1)), x, x[:, first] * x[:, second]], axis=1), nan=0.0)
        parts = fixed_point.split(cells)
        for group in groups.to_pylist():
            key = tuple(group[c] for c in CATEGORICAL)
            total = sums.setdefault(key, [np.zeros(cells.shape[1], dtype=np.int64) for _ in parts])
            for so_far, part in zip(total, parts, strict=True):
                so_far += part[group["row_list"]].sum(axis=0)
            fixed_point.carry(*total)
    for key, (whole, part) in sums.items():
        columns = [pa.array([level] * len(whole), pa.string()) for level in key]
        columns += [pa.array(np.arange(len(whole)), pa.int32()), pa.array(whole), pa.array(part)]
        yield pa.RecordBatch.from_arrays(columns, [*CATEGORICAL, "cell", "whole", "part"])


class Segmentation:
    """Components and segments of a feature frame, fitted when first asked for.

    The features are the numeric columns and a dummy for every level of the categories but the first. All
    second moments come from one aggregate by combination of levels, in exact sums, so that neither the components
    nor the segments depend on the partitioning. What the driver holds is one row per combination of levels.
    """

    def __init__(self, features: DataFrame, components: int = COMPONENTS):
        self.numeric = [*STANDARDIZED, "transactions", *CYCLE]
        self.components = components
        # Moments and every step of the clustering read the rows again.
        self.prepared = cyclical_month(standardize(cut_lineage(features)))

    @cached_property
    def _combinations(self) -> list[dict]:
        """Levels, number of rows, and sums of the numeric columns and of their products."""
        pairs = list(combinations_with_replacement(self.numeric, 2))
        names = ["rows", *self.numeric, *[f"{a}*{b}" for a, b in pairs]]
        rows = self.prepared.select(*CATEGORICAL, *[F.col(c).cast("double").alias(c) for c in self.numeric])
        levels = ", ".join(f"{c} string" for c in CATEGORICAL)
        sums = rows.mapInArrow(partial(_moment_batches, numeric=self.numeric), f"{levels}, cell int, whole bigint, part bigint")
        found = {}
        for r in fixed_point.totals(sums, [*CATEGORICAL, "cell"]):
            combination = found.setdefault(tuple(r[c] for c in CATEGORICAL), {c: r[c] for c in CATEGORICAL})
            combination[names[r["cell"]]] = fixed_point.number(r)
        return list(found.values())

    @cached_property
    def levels(self) -> dict[str, list[str]]:
        """Levels with a dummy: all but the first of a category, the last one first."""
        return {c: sorted({r[c] for r in self._combinations}, key=str.encode, reverse=True)[:-1] for c in CATEGORICAL}

    @property
    def feature_names(self) -> list[str]:
        return [*self.numeric, *[f"{c}={level}" for c in CATEGORICAL for level in self.levels[c]]]

    @cached_property
    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and rounded population covariances of all features."""
        at = {name: i for i, name in enumerate(self.feature_names)}
        p, q = len(at), len(self.numeric)
        first, second = np.zeros(p), np.zeros((p, p))
        # In a fixed order, so that the sums over combinations are the same every time.
        rows = sorted(self._combinations, key=lambda r: [r[c].encode() for c in CATEGORICAL])
        n = sum(r["rows"] for r in rows)
        pairs = list(combinations_with_replacement(range(q), 2))
        for r in rows:
            sums = np.array([r[c] for c in self.numeric])
            dummies = [at[name] for c in CATEGORICAL if (name := f"{c}={r[c]}") in at]
            first[:q] += sums
            first[dummies] += r["rows"]
            for i, j in pairs:
                second[i, j] += r[f"{self.numeric[i]}*{self.numeric[j]}"]
            for d in dummies:
                second[:q, d] += sums
                second[d, [e for e in dummies if e >= d]] += r["rows"]
        upper = np.triu(second)
        whole = upper + np.triu(second, 1).T
        mean = first / max(n, 1)
        return mean, np.round(whole / max(n, 1) - np.outer(mean, mean), kmeans.DIGITS) + 0.0

    @cached_property
    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the variance, largest first, and the components as columns."""
        covariance = self.moments[1]
        values, vectors = eigen.jacobi(covariance)
        total = np.trace(covariance)
        return values[: self.components] / (total or 1.0), vectors[:, : self.components]

    @property
    def rows(self) -> DataFrame:
        """The features with `scores`, the centred component scores."""
        return self.prepared.withColumn("scores", F.array(*self._scores()))

    def _scores(self) -> list[Column]:
        vectors = self.model[1]
        mean, q = self.moments[0], len(self.numeric)
        weights, start = {}, q
        for c in CATEGORICAL:
            end = start + len(self.levels[c])
            by_level = {level: row.tolist() for level, row in zip(self.levels[c], vectors[start:end], strict=True)}
            # Folded to one literal when the plan is optimized.
            weights[c] = F.try_element_at(F.from_json(F.lit(json.dumps(by_level)), "map<string,array<double>>"), F.col(c))
            start = end
        found = []
        for j in range(vectors.shape[1]):
            score = F.lit(-float(mean @ vectors[:, j]))
            for i, name in enumerate(self.numeric):
                score = score + F.col(name).cast("double") * float(vectors[i, j])
            for c in CATEGORICAL:
                score = score + F.coalesce(F.get(weights[c], F.lit(j)), F.lit(0.0))
            found.append(score)
        return found

    def loadings(self) -> DataFrame:
        """Component by feature, one row each; as many rows as the matrix has cells."""
        matrix = self.model[1]
        rows = [
            (f"PC{j + 1}", name, float(matrix[i, j]))
            for j in range(matrix.shape[1])
            for i, name in enumerate(self.feature_names)
        ]
        return self.prepared.sparkSession.createDataFrame(rows, "component string, feature string, loading double")

    def strong_loadings(self, threshold: float = 0.2) -> DataFrame:
        return self.loadings().where(F.abs("loading") > threshold)

    def explained(self) -> DataFrame:
        """Share of the variance per component and its running sum."""
        ratios = [float(x) for x in self.model[0]]
        rows = [(f"PC{i + 1}", r, sum(ratios[: i + 1])) for i, r in enumerate(ratios)]
        return self.prepared.sparkSession.createDataFrame(rows, "component string, ratio double, cumulative double")

    def _points(self, on: str) -> DataFrame:
        """Component scores, or with `on="features"` the first standardized columns, rounded to nine digits."""
        if on == "features":
            values = [F.col(c).cast("double") for c in self.numeric[:COMPONENTS]]
        else:
            values = self._scores()
        key = F.concat_ws("|", "users", "visit_id").alias("key")
        return self.prepared.select(
            "users",
            "visit_id",
            "action",
            key,
            F.lit(1.0).alias("weight"),
            F.array(*[F.lit(i) for i in range(len(values))]).alias("indices"),
            # Adding zero turns a negative zero into zero.
            F.array(*[F.round(v, kmeans.DIGITS) + 0.0 for v in values]).alias("values"),
        )

    def _clustering(self, on: str, k: int):
        # Every step reads the points again.
        points = cut_lineage(self._points(on))
        dimensions = COMPONENTS if on == "features" else self.model[1].shape[1]
        return kmeans.fit(points, [k], dimensions)[k], points

    def segments(self, on: str = "scores", k: int = SEGMENTS) -> DataFrame:
        """Segment of every row, by centred component scores or, with `on="features"`, by the
        first five standardized columns."""
        centers, points = self._clustering(on, k)
        return points.select("users", "visit_id", "action", kmeans.nearest(centers).alias("segment"))

    def centers(self, on: str = "scores", k: int = SEGMENTS) -> DataFrame:
        centers, points = self._clustering(on, k)
        cells = [
            (segment, f"PC{i + 1}" if on == "scores" else self.numeric[i], float(value))
            for segment, center in enumerate(centers)
            for i, value in enumerate(center)
        ]
        return points.sparkSession.createDataFrame(cells, "segment bigint, dimension string, value double")
