"""SQL twins of the clustering jobs: every step of the iteration is a statement of its own."""

from itertools import combinations_with_replacement

from .base import levels, retail, rounded
from .retail import BEHAVIOR, FEATURES, MARKET, PRICED

STEPS = 20
Z = ["visit_number", "time_on_site", "pageviews", "session_quality", "totals_revenue", "price"]
DIMENSIONS = Z[:5]

# All terms of the inputs fit the vocabulary, and none is a stop word.
VECTORS = r"""
spot AS (
  SELECT description AS pid, ('0x' || substr(md5(description), 1, 15))::BIGINT AS h, count(*) AS weight
  FROM priced GROUP BY description
),
term AS (
  SELECT pid, weight, i, count(*) AS tf
  FROM (SELECT pid, weight, unnest(regexp_extract_all(lower(pid), '\w\w+')) AS i FROM spot) GROUP BY ALL
),
heavy AS (
  SELECT pid, i, tf * (ln((1 + (SELECT sum(weight) FROM spot)) / (1 + sum(weight) OVER (PARTITION BY i))) + 1) AS v
  FROM term
),
cell AS (SELECT pid, i, v / sqrt(sum(v * v) OVER (PARTITION BY pid)) AS v FROM heavy)"""

_ROUNDED_Z = ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 9) + 0.0" for c in DIMENSIONS
)
FEATURE_POINTS = f"""
placed AS MATERIALIZED (SELECT users, visit_id, action, [{_ROUNDED_Z}] AS vec FROM features),
spot AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, vec) AS pid, h, weight, vec FROM (
    SELECT vec, min(('0x' || substr(md5(concat_ws('|', users, visit_id)), 1, 15))::BIGINT) AS h, count(*) AS weight
    FROM placed GROUP BY vec)
),
cell AS (SELECT pid, unnest(range({len(DIMENSIONS)})) AS i, unnest(vec) AS v FROM spot)"""


NUMERIC = [*Z, "transactions", "month_sin", "month_cos"]
DUMMIES = ["main_category", "continent", "action"]
SWEEPS = 10
COMPONENTS = 5


def _levels_of(block: int, name: str) -> str:
    return f"""SELECT {block} AS block, row_number() OVER (ORDER BY {name} DESC) AS spot, '{name}=' || {name} AS name
  FROM (SELECT DISTINCT {name} FROM numeric WHERE {name} <> (SELECT min({name}) FROM numeric))"""


PCA = f"""
numeric AS MATERIALIZED (
  SELECT row_number() OVER () AS row, users, visit_id,
    {", ".join(f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in Z)},
    CAST(transactions AS DOUBLE) AS transactions, sin(2 * pi() * month / 12) AS month_sin,
    cos(2 * pi() * month / 12) AS month_cos, {", ".join(DUMMIES)}
  FROM features
),
feature AS MATERIALIZED (
  SELECT name, CAST(row_number() OVER (ORDER BY block, spot) - 1 AS BIGINT) AS i FROM (
    SELECT 0 AS block, unnest(range({len(NUMERIC)})) AS spot, unnest({NUMERIC}) AS name
    UNION ALL {" UNION ALL ".join(_levels_of(b, c) for b, c in enumerate(DUMMIES, 1))})
),
value AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT row, i, {c} AS x FROM numeric JOIN feature ON name = '{c}'" for c in NUMERIC)}
  UNION ALL
  {" UNION ALL ".join(f"SELECT row, i, 1.0 AS x FROM numeric JOIN feature ON name = '{c}=' || {c}" for c in DUMMIES)}
),
size AS (SELECT count(*) AS n FROM numeric),
mean AS MATERIALIZED (SELECT i, sum(x) / (SELECT n FROM size) AS m FROM value GROUP BY i),
shared AS MATERIALIZED (
  SELECT one.i, two.i AS j, sum(one.x * two.x) / (SELECT n FROM size) AS s
  FROM value one JOIN value two ON one.row = two.row GROUP BY ALL
),
covariance AS MATERIALIZED (
  SELECT one.i, two.i AS j, round(COALESCE(s, 0) - one.m * two.m, 9) + 0.0 AS c
  FROM mean one CROSS JOIN mean two LEFT JOIN shared ON shared.i = one.i AND shared.j = two.i
),
jacobi AS MATERIALIZED (
  WITH RECURSIVE step AS (
    SELECT 0 AS t, p, p - 1 + p % 2 AS rounds, {SWEEPS} * (p - 1 + p % 2) AS steps, a,
      [CASE WHEN x // p = x % p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR x IN range(p * p)] AS v
    FROM (SELECT list(c ORDER BY i, j) AS a, (SELECT count(*) FROM feature) AS p FROM covariance)
    UNION ALL
    SELECT t, p, rounds, steps,
      [own[x // p + 1] * own[x % p + 1] * a[x + 1]
        + own[x // p + 1] * crossed[x % p + 1] * a[(x // p) * p + other[x % p + 1] + 1]
        + crossed[x // p + 1] * own[x % p + 1] * a[other[x // p + 1] * p + x % p + 1]
        + crossed[x // p + 1] * crossed[x % p + 1] * a[other[x // p + 1] * p + other[x % p + 1] + 1]
        FOR x IN range(p * p)] AS a,
      [own[x % p + 1] * v[x + 1] + crossed[x % p + 1] * v[(x // p) * p + other[x % p + 1] + 1] FOR x IN range(p * p)] AS v
    FROM (
      SELECT *, [CASE WHEN tangent[k + 1] IS NULL THEN 1.0 ELSE 1 / sqrt(tangent[k + 1] * tangent[k + 1] + 1) END FOR k IN range(p)] AS own,
        [CASE WHEN tangent[k + 1] IS NULL THEN 0.0
          ELSE (CASE WHEN k < other[k + 1] THEN -1 ELSE 1 END) * tangent[k + 1] / sqrt(tangent[k + 1] * tangent[k + 1] + 1) END
          FOR k IN range(p)] AS crossed
      FROM (
        SELECT *, [CASE WHEN theta[k + 1] IS NOT NULL
            THEN (CASE WHEN theta[k + 1] < 0 THEN -1 ELSE 1 END) / (abs(theta[k + 1]) + sqrt(theta[k + 1] * theta[k + 1] + 1)) END
          FOR k IN range(p)] AS tangent
        FROM (
          SELECT *, [CASE WHEN other[k + 1] <> k AND abs(a[least(k, other[k + 1]) * p + greatest(k, other[k + 1]) + 1]) > 1e-60
              THEN (a[greatest(k, other[k + 1]) * (p + 1) + 1] - a[least(k, other[k + 1]) * (p + 1) + 1])
                / (2 * a[least(k, other[k + 1]) * p + greatest(k, other[k + 1]) + 1]) END
            FOR k IN range(p)] AS theta
          FROM (
            SELECT t + 1 AS t, p, rounds, steps, a, v, [
                CASE WHEN k = p - 1 AND p % 2 = 0 THEN t % rounds
                  WHEN (2 * t - k + 2 * rounds) % rounds = k THEN (CASE WHEN p % 2 = 1 THEN k ELSE p - 1 END)
                  ELSE (2 * t - k + 2 * rounds) % rounds END
                FOR k IN range(p)] AS other
            FROM step WHERE t < steps))))
  )
  SELECT p, a, v FROM step ORDER BY t DESC LIMIT 1
),
component AS MATERIALIZED (
  SELECT k, row_number() OVER (ORDER BY value DESC, k) AS j, value FROM (
    SELECT unnest(range(p)) AS k, unnest([a[x * (p + 1) + 1] FOR x IN range(p)]) AS value FROM jacobi)
  QUALIFY j <= {COMPONENTS}
),
raw_loading AS MATERIALIZED (
  SELECT j, i, name, (SELECT v FROM jacobi)[i * (SELECT p FROM jacobi) + k + 1] AS x FROM component CROSS JOIN feature
),
direction AS MATERIALIZED (
  SELECT j, CASE WHEN x < 0 THEN -1 ELSE 1 END AS sign FROM raw_loading
  QUALIFY row_number() OVER (PARTITION BY j ORDER BY round(abs(x), 6) DESC, i) = 1
),
loading AS MATERIALIZED (SELECT j, i, name, x * sign AS x FROM raw_loading JOIN direction USING (j)),
ratio AS (
  SELECT j, value / (SELECT sum(c) FROM covariance WHERE i = j) AS ratio FROM component
)"""

SCORE_POINTS = """
score AS MATERIALIZED (
  SELECT row, j, round(sum(value.x * loading.x) - max(middle), 9) + 0.0 AS x
  FROM value JOIN loading USING (i)
  JOIN (SELECT j, sum(m * x) AS middle FROM mean JOIN loading USING (i) GROUP BY j) USING (j)
  GROUP BY row, j
),
placed AS MATERIALIZED (
  SELECT users, visit_id, action, vec
  FROM numeric JOIN (SELECT row, list(x ORDER BY j) AS vec FROM score GROUP BY row) USING (row)
),
spot AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, vec) AS pid, h, weight, vec FROM (
    SELECT vec, min(('0x' || substr(md5(concat_ws('|', users, visit_id)), 1, 15))::BIGINT) AS h, count(*) AS weight
    FROM placed GROUP BY vec)
),
cell AS (SELECT pid, unnest(range(len(vec))) AS i, unnest(vec) AS v FROM spot)"""


STARTS = 8


def seeding(ks: list[int]) -> list[str]:
    """Draws s<t> (start, pid) of every step, squared distances g<t> to the draws before, and start per k in `best`."""
    parts = [
        f"""
norm AS MATERIALIZED (SELECT pid, sum(v * v) AS n2 FROM cell GROUP BY pid),
g0 AS MATERIALIZED (SELECT pid, start, CAST(1 AS DOUBLE) AS d FROM spot CROSS JOIN (SELECT unnest(range({STARTS})) AS start))"""
    ]
    for t in range(max(ks)):
        nearer = "least(g.d, e.d)" if t else "e.d"
        parts.append(f"""
s{t} AS MATERIALIZED (
  SELECT start, pid FROM g{t} JOIN spot USING (pid) WHERE d > 0
  QUALIFY row_number() OVER (PARTITION BY start ORDER BY
    -ln((('0x' || substr(md5(concat_ws('|', start, {t}, h)), 1, 15))::BIGINT + 0.5) / 1152921504606846976.0) / (weight * d), pid) = 1
),
g{t + 1} AS MATERIALIZED (
  SELECT g.pid, g.start, COALESCE({nearer}, g.d) AS d
  FROM g{t} g LEFT JOIN (
    SELECT norm.pid, s.start, round(norm.n2 + own.n2 - 2 * COALESCE(shared, 0), 9) AS d
    FROM norm CROSS JOIN s{t} s JOIN norm own ON own.pid = s.pid
    LEFT JOIN (
      SELECT p.pid, q.pid AS seed, sum(p.v * q.v) AS shared
      FROM cell p JOIN cell q ON p.i = q.i WHERE q.pid IN (SELECT pid FROM s{t}) GROUP BY ALL
    ) dot ON dot.pid = norm.pid AND dot.seed = s.pid
  ) e ON e.pid = g.pid AND e.start = g.start
)""")
    chosen = " UNION ALL ".join(
        f"""SELECT {k} AS k, start FROM (
    SELECT start, round(CAST(sum(CAST(weight * d AS DECIMAL(28, 12))) AS DOUBLE), 6) AS cost
    FROM g{k} JOIN spot USING (pid) GROUP BY start)
  QUALIFY row_number() OVER (ORDER BY cost, start) = 1"""
        for k in ks
    )
    drawn = " UNION ALL ".join(f"SELECT CAST({t} AS BIGINT) AS cluster, start, pid FROM s{t}" for t in range(max(ks)))
    parts.append(f"""
best AS MATERIALIZED ({chosen}),
seed AS (SELECT k, cluster, pid FROM best JOIN ({drawn}) USING (start) WHERE cluster < k)""")
    return parts


def lloyd(ks: list[int], steps: int = STEPS) -> str:
    """Centres c<steps> (k, cluster, i, v) and nearest centres a<steps> (pid, k, cluster, d) of spot and cell."""
    parts = [
        *seeding(ks),
        """
c0 AS MATERIALIZED (
  SELECT s.k, s.cluster, d.i, COALESCE(c.v, 0) AS v
  FROM seed s CROSS JOIN (SELECT DISTINCT i FROM cell) d
  LEFT JOIN cell c ON c.pid = s.pid AND c.i = d.i
)""",
    ]
    for t in range(steps + 1):
        parts.append(
            f"""
a{t} AS MATERIALIZED (
  SELECT dot.pid, dot.k, dot.cluster, round(n2 + own - 2 * shared, 9) AS d
  FROM (SELECT p.pid, c.k, c.cluster, sum(p.v * c.v) AS shared FROM cell p JOIN c{t} c ON p.i = c.i GROUP BY ALL) dot
  JOIN (SELECT k, cluster, sum(v * v) AS own FROM c{t} GROUP BY ALL) o ON o.k = dot.k AND o.cluster = dot.cluster
  JOIN norm ON norm.pid = dot.pid
  QUALIFY row_number() OVER (PARTITION BY dot.pid, dot.k ORDER BY d, dot.cluster) = 1
)"""
        )
        if t < steps:
            parts.append(
                f"""
c{t + 1} AS MATERIALIZED (
  SELECT c.k, c.cluster, c.i,
    CASE WHEN w.total IS NULL THEN c.v ELSE COALESCE(CAST(s.total AS DOUBLE), 0) / w.total END AS v
  FROM c{t} c
  LEFT JOIN (SELECT k, cluster, sum(weight) AS total FROM a{t} JOIN spot ON spot.pid = a{t}.pid GROUP BY ALL) w
    ON w.k = c.k AND w.cluster = c.cluster
  LEFT JOIN (
    SELECT k, cluster, i, sum(CAST(weight * v AS DECIMAL(28, 12))) AS total
    FROM a{t} JOIN spot ON spot.pid = a{t}.pid JOIN cell ON cell.pid = a{t}.pid GROUP BY ALL
  ) s ON s.k = c.k AND s.cluster = c.cluster AND s.i = c.i
)"""
            )
    return ",".join(parts)


CLUSTERED = f"""
named AS (
  SELECT cluster, COALESCE(string_agg(i, ' / ' ORDER BY v DESC, i) FILTER (v > 0), '') AS category FROM (
    SELECT cluster, i, round(v, 9) AS v FROM c{STEPS}
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(v, 9) DESC, i) <= 3)
  GROUP BY cluster
),
clustered AS (
  SELECT a.pid AS description, a.cluster, category, weight AS lines
  FROM a{STEPS} a JOIN named USING (cluster) JOIN spot ON spot.pid = a.pid
)"""


def queries() -> dict[str, str]:
    eight, four = lloyd([8]), lloyd([4])
    scores = ", ".join(f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in Z)
    numeric = f"""
numeric AS (
  SELECT {scores}, transactions, sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos
  FROM features
)"""
    pairs = combinations_with_replacement([*Z, "transactions", "month_sin", "month_cos"], 2)
    covariances = "\nUNION ALL ".join(
        f"SELECT '{a}' AS feature, '{b}' AS other, covar_pop({a}, {b}) AS covariance FROM numeric" for a, b in pairs
    )
    return {
        "description_clusters": retail("SELECT * FROM clustered", PRICED, VECTORS, eight, CLUSTERED),
        "cluster_samples": retail(
            """SELECT cluster, category, row_number() OVER (PARTITION BY cluster ORDER BY description) AS position, description
FROM clustered QUALIFY position <= 10""",
            PRICED,
            VECTORS,
            eight,
            CLUSTERED,
        ),
        "elbow_wcss": rounded(
            retail(
                f"SELECT CAST(k AS BIGINT) AS k, CAST(sum(weight * d) AS DOUBLE) AS wcss FROM a{STEPS} JOIN spot USING (pid) GROUP BY k",
                PRICED,
                VECTORS,
                lloyd(list(range(1, 15))),
            ),
            "wcss",
            digits=4,
        ),
        "category_elasticity": rounded(
            retail(
                """SELECT category, avg(price_elasticity) AS price_elasticity, count(*) AS descriptions
FROM elastic JOIN clustered USING (description) GROUP BY category""",
                PRICED,
                MARKET,
                VECTORS,
                eight,
                CLUSTERED,
            ),
            "price_elasticity",
        ),
        "feature_covariance": rounded(levels(covariances, BEHAVIOR, FEATURES, numeric), "covariance"),
        "pca_loadings": rounded(
            levels("SELECT 'PC' || j AS component, name AS feature, x AS loading FROM loading", BEHAVIOR, FEATURES, PCA),
            "loading",
        ),
        "pca_strong_loadings": rounded(
            levels(
                "SELECT 'PC' || j AS component, name AS feature, x AS loading FROM loading WHERE abs(x) > 0.2",
                BEHAVIOR,
                FEATURES,
                PCA,
            ),
            "loading",
        ),
        "pca_explained_variance": rounded(
            levels(
                "SELECT 'PC' || j AS component, ratio, sum(ratio) OVER (ORDER BY j) AS cumulative FROM ratio",
                BEHAVIOR,
                FEATURES,
                PCA,
            ),
            "ratio",
            "cumulative",
        ),
        "kmeans_segments": levels(
            f"""SELECT users, visit_id, action, a.cluster AS segment
FROM placed JOIN spot USING (vec) JOIN a{STEPS} a ON a.pid = spot.pid""",
            BEHAVIOR,
            FEATURES,
            PCA,
            SCORE_POINTS,
            four,
        ),
        "cluster_centers": rounded(
            levels(
                f"SELECT cluster AS segment, 'PC' || (i + 1) AS dimension, v AS value FROM c{STEPS}",
                BEHAVIOR,
                FEATURES,
                PCA,
                SCORE_POINTS,
                four,
            ),
            "value",
        ),
        "kmeans_segments_on_features": levels(
            f"""SELECT users, visit_id, action, a.cluster AS segment
FROM placed JOIN spot USING (vec) JOIN a{STEPS} a ON a.pid = spot.pid""",
            BEHAVIOR,
            FEATURES,
            FEATURE_POINTS,
            four,
        ),
        "cluster_centers_on_features": rounded(
            levels(
                f"SELECT cluster AS segment, {DIMENSIONS}[i + 1] AS dimension, v AS value FROM c{STEPS}",
                BEHAVIOR,
                FEATURES,
                FEATURE_POINTS,
                four,
            ),
            "value",
        ),
    }
