import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tradewind.operators import eigen, fixed_point, kmeans
from tradewind.plans import clusters, segments


@pytest.fixture(scope="module")
def fitted(spark, folder):
    return segments.Segmentation(entry.queries()["feature_frame"](spark, folder))


def test_scores_have_population_moments(spark, folder):
    frame = segments.standardize(entry.queries()["feature_frame"](spark, folder)).toPandas()
    for column in segments.STANDARDIZED:
        assert frame[column].mean() == pytest.approx(0, abs=1e-9)
        assert frame[column].std(ddof=0) == pytest.approx(1)


def _matrix(fitted):
    """The features row by row, dummies written out by hand."""
    frame = fitted.rows.toPandas()
    columns = [frame[c].astype(float) for c in fitted.numeric]
    columns += [(frame[c] == level).astype(float) for c in segments.CATEGORICAL for level in fitted.levels[c]]
    return np.array(columns).T, np.array(frame["scores"].tolist())


def test_loadings_equal_singular_vectors_up_to_sign(fitted):
    matrix, _ = _matrix(fitted)
    centred = matrix - matrix.mean(axis=0)
    _, singular, vectors = np.linalg.svd(centred, full_matrices=False)
    loadings = fitted.loadings().toPandas().pivot(index="component", columns="feature", values="loading")
    loadings = loadings[fitted.feature_names].to_numpy()
    for ours, theirs in zip(loadings, vectors):
        assert abs(float(ours @ theirs)) == pytest.approx(1, abs=1e-6)
    ratios = [r["ratio"] for r in fitted.explained().orderBy("component").collect()]
    assert ratios == pytest.approx((singular**2 / (singular**2).sum())[:5])


def test_moments_equal_those_of_the_rows(fitted):
    matrix, _ = _matrix(fitted)
    mean, covariance = fitted.moments
    assert mean == pytest.approx(matrix.mean(axis=0), abs=1e-9)
    assert covariance == pytest.approx(np.cov(matrix.T, ddof=0), abs=2e-9)


def test_scores_are_centred_projections(fitted):
    matrix, scores = _matrix(fitted)
    assert scores.mean(axis=0) == pytest.approx(np.zeros(5), abs=1e-8)
    assert scores == pytest.approx((matrix - matrix.mean(axis=0)) @ fitted.model[1], abs=1e-8)


@pytest.mark.parametrize("p", [0, 1, 2, 3, 8, 27, 40])
def test_jacobi(p):
    sample = np.random.default_rng(p).standard_normal((p + 2, p))
    matrix = sample.T @ sample
    values, vectors = eigen.jacobi(matrix)
    assert values == pytest.approx(np.linalg.eigvalsh(matrix)[::-1] if p else [])
    assert vectors.T @ vectors == pytest.approx(np.eye(p), abs=1e-10)
    assert matrix @ vectors == pytest.approx(vectors * values, abs=1e-9)


@pytest.mark.parametrize("p", [2, 3, 10, 27])
def test_a_sweep_pairs_all(p):
    rounds = [eigen.opponents(p, t) for t in range(p - 1 + p % 2)]
    assert all((other[other] == np.arange(p)).all() for other in rounds)
    assert len({(i, int(j)) for other in rounds for i, j in enumerate(other) if i < j}) == p * (p - 1) // 2


def test_equal_and_constant_features_have_components():
    values, vectors = eigen.jacobi(np.array([[2.0, 2.0, 0.0], [2.0, 2.0, 0.0], [0.0, 0.0, 0.0]]))
    assert values == pytest.approx([4, 0, 0])
    assert vectors[:, 0] == pytest.approx([0.5**0.5, 0.5**0.5, 0])


def test_first_level_is_dropped(fitted):
    names = fitted.feature_names
    assert "action=1" not in names and "action=2" in names
    assert "continent=AFRICA" not in names and "continent=AMERICA" in names


def test_segments_cover_all_rows(fitted):
    frame = fitted.segments()
    assert frame.count() == fitted.rows.count()
    assert {r["segment"] for r in frame.select("segment").distinct().collect()} == {0, 1, 2, 3}
    assert fitted.centers().count() == 4 * 5


def test_vectors_are_weighted_unit_vectors(spark, folder):
    lines = entry.queries()["pricing_base"](spark, folder)
    vectors, vocabulary = clusters.description_vectors(lines)
    got = vectors.select("weight", vector_to_array("features").alias("f")).collect()
    assert sum(r["weight"] for r in got) == lines.count() and min(r["weight"] for r in got) >= 10
    assert all(np.linalg.norm(r["f"]) == pytest.approx(1) for r in got)
    assert len(vocabulary) == len(got[0]["f"])


def test_wcss_falls_with_k(spark, folder):
    costs = [r["wcss"] for r in entry.queries()["elbow_wcss"](spark, folder).orderBy("k").collect()]
    assert len(costs) == 14 and costs[0] > costs[3] > costs[-1] >= 0


def test_wcss_of_one_cluster(spark):
    rows = [("red box",), ("red box",), ("blue box",), ("blue cup",)]
    lines = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "description string, quantity int, unit_price double")
    vectors, _ = clusters.description_vectors(lines, min_lines=1)
    data = vectors.select("weight", vector_to_array("features").alias("f")).collect()
    points = np.array([r["f"] for r in data for _ in range(int(r["weight"]))])
    expected = ((points - points.mean(axis=0)) ** 2).sum()
    assert clusters.elbow_wcss(lines, max_k=2, min_lines=1).orderBy("k").first()["wcss"] == pytest.approx(expected)


def _partitioned(spark, count, job):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalescing = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(count))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return sorted(map(repr, job().collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalescing)


@pytest.mark.parametrize("name", ["description_clusters", "kmeans_segments", "pca_loadings", "pca_explained_variance"])
def test_models_do_not_depend_on_the_partitioning(spark, folder, name):
    job = lambda: entry.queries()[name](spark, folder)
    assert _partitioned(spark, 3, job) == _partitioned(spark, 8, job) == _partitioned(spark, 50, job)


def test_missing_categories_and_amounts_do_not_stop_the_fit(spark, folder):
    behavior = entry.queries()["clean_behavior"](spark, folder)
    hole = F.col("start_time") % 3 == 0
    holes = {c: F.when(~hole, F.col(c)) for c in ("price", "continent", "action", "session_quality", "transactions")}
    features = segments.feature_frame(behavior.withColumns(holes))
    fitted = segments.Segmentation(features)
    assert fitted.segments().count() == features.count()
    assert "continent=Other" in fitted.feature_names and "action=Other" in fitted.feature_names


def _best_of_ten(points, weights, k):
    """Lowest cost of ten plain starts with draws by distance, each followed to its end."""
    draw, best = np.random.default_rng(42), float("inf")
    for _ in range(10):
        centers = points[draw.choice(len(points), p=weights / weights.sum())][None]
        while len(centers) < k:
            d = ((points[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1) * weights
            centers = np.vstack([centers, points[draw.choice(len(points), p=d / d.sum())]])
        for _ in range(100):
            d = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            moved = np.array([
                np.average(points[near == c], axis=0, weights=weights[near == c]) if (near == c).any() else centers[c]
                for c in range(k)
            ])
            if np.allclose(moved, centers):
                break
            centers = moved
        best = min(best, float((d.min(axis=1) * weights).sum()))
    return best


@pytest.mark.parametrize("k", [4, 8])
def test_one_start_of_several_is_about_as_good_as_ten(spark, fitted, k):
    points = fitted._points("scores")
    rows = points.groupBy("values").agg(F.sum("weight").alias("weight")).collect()
    data, weights = np.array([r["values"] for r in rows]), np.array([r["weight"] for r in rows])
    cost = kmeans.costs(points, kmeans.fit(points, [k], 5, steps=50)).first()["wcss"]
    assert cost <= 1.05 * _best_of_ten(data, weights, k)


def test_starts_are_nested_and_cheap(spark):
    schema = "key string, weight double, indices array<int>, values array<double>"
    corners = [(f"{x}{y}{i}", 1.0, [0, 1], [float(x), float(y)]) for x in (0, 100) for y in (0, 100) for i in range(20)]
    points = kmeans.distinct_points(spark.createDataFrame(corners, schema))
    assert points.count() == 4 and points.agg(F.sum("weight")).first()[0] == 80
    found = kmeans.seeds(points, [1, 2, 4, 9], 2)
    assert [len(found[k]) for k in (1, 2, 4, 9)] == [1, 2, 4, 4]
    assert {tuple(c) for c in found[4]} == {(x, y) for x in (0.0, 100.0) for y in (0.0, 100.0)}


def test_fewer_points_than_clusters(spark):
    schema = "key string, weight double, indices array<int>, values array<double>"
    rows = [("a", 1.0, [0], [1.0]), ("b", 2.0, [0], [1.0]), ("c", 1.0, [1], [3.0])]
    centers = kmeans.fit(spark.createDataFrame(rows, schema), [1, 4], 2)
    assert sorted(map(tuple, centers[4])) == [(0.0, 3.0), (1.0, 0.0)]
    assert centers[1].tolist() == [[0.75, 0.75]]
    none = spark.createDataFrame([], schema)
    assert len(kmeans.fit(none, [2], 2)[2]) == 0
    assert none.select(kmeans.nearest(np.zeros((0, 2)))).count() == 0


def test_few_bytes_of_points_are_still_spread_over_all_cores(spark):
    points = spark.range(5000).select(
        F.col("id").cast("string").alias("key"),
        F.lit(1.0).alias("weight"),
        F.array(F.lit(0)).alias("indices"),
        F.array(F.col("id").cast("double")).alias("values"),
    )
    coalescing = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        found = kmeans.distinct_points(points)
        assert found.count() == 5000
        assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", coalescing)


def test_draws_and_distances_of_the_tasks_are_those_of_the_columns(spark):
    draw = np.random.default_rng(5)
    rows = [(int(x), [0, 2, 3], [round(v, 9) for v in draw.normal(size=3).tolist()]) for x in draw.integers(0, 1 << 60, 50)]
    frame = spark.createDataFrame(rows, "h bigint, indices array<int>, `values` array<double>")
    centers = draw.normal(size=(3, 5))
    hashed = kmeans.key_hash(F.concat_ws("|", F.lit("3"), F.lit("1"), F.col("h").cast("string")))
    expected = frame.select(((hashed + 0.5) / float(1 << 60)).alias("unit"), kmeans.distances(centers).alias("d")).collect()
    batch = frame.toArrow().combine_chunks().to_batches()[0]
    keys = [b"%d" % r[0] for r in rows]
    assert kmeans._units(3, 1, keys).tolist() == [r["unit"] for r in expected]
    assert kmeans._distances(kmeans._cells(batch), len(batch), centers).tolist() == [r["d"] for r in expected]


def test_sums_of_the_tasks_are_exact():
    values = np.array([1e6, -1e6, 0.1, 0.2, -0.3, 1e-12, 123456.789] * 1000)
    orders = [values, values[::-1], np.sort(values)]
    found = set()
    for own in orders:
        whole, part = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for piece in np.array_split(own, 7):
            for total, share in zip((whole, part), fixed_point.split(piece), strict=True):
                total += share.sum()
            fixed_point.carry(whole, part)
        found.add(fixed_point.number({"whole": int(whole[0]), "part": int(part[0])}))
    assert found == {123456789.000000001}
