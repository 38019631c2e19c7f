import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.operators import quantiles

PROBABILITIES = {"a": 0.0, "b": 0.25, "c": 0.33, "d": 0.5, "e": 0.66, "f": 0.75, "g": 1.0}


def numbers(kind):
    rng = random.Random(7)
    if kind == "spread":
        return [rng.uniform(-1e6, 1e6) for _ in range(5000)]
    if kind == "ties":
        return [float(rng.randint(0, 5)) for _ in range(4001)]
    if kind == "hot":  # a third of all values are equal
        return [5.0] * 2000 + [rng.gauss(0, 100) for _ in range(4000)]
    return [3.5]


def expected(values):
    return [float(np.percentile(values, p * 100)) for p in PROBABILITIES.values()]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "single"])
def test_equals_numpy(spark, kind):
    values = numbers(kind)
    row = quantiles.exact_quantiles(frame(spark, values), "x", PROBABILITIES).first()
    assert list(row) == pytest.approx(expected(values), rel=1e-12)


def test_bits_keep_the_order_of_doubles(spark):
    rng = random.Random(3)
    edges = [0.0, 5e-324, 1e-323, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf]
    edges += [math.ldexp(1.0, e) for e in range(-1074, 1024, 7)]
    edges += [math.nextafter(math.ldexp(1.0, e), side) for e in range(-1021, 1024, 13) for side in (0.0, math.inf)]
    drawn = [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(3000)]
    values = sorted({v for x in edges + drawn for v in (x, -x) if v == v})
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", quantiles.ordered_bits(F.col("x")).alias("b"))
    bits = [r["b"] for r in sorted(rows.collect(), key=lambda r: r["x"])]
    assert all(x < y for x, y in zip(bits, bits[1:]))
    # A double's own bits, mirrored for the negative ones.
    own = [struct.unpack(">q", struct.pack(">d", abs(v)))[0] * (-1 if v < 0 else 1) for v in values]
    assert bits == own


@pytest.mark.parametrize("kind", ["crowded", "close"])
def test_values_that_crowd_into_one_range(spark, kind):
    rng = random.Random(11)
    if kind == "crowded":  # one far value makes every equal-width range but one empty
        values = [rng.random() for _ in range(6000)] + [1e300]
    else:  # neighbours in the last bits
        values = [1.0 + rng.randrange(1 << 20) * 2.0**-52 for _ in range(6000)]
    row = quantiles.exact_quantiles(frame(spark, values), "x", PROBABILITIES).first()
    assert list(row) == pytest.approx(expected(values), rel=1e-15)


def test_windows_see_counters_only(spark, monkeypatch):
    # With few bits a pass, no window partition may hold more counters than the pass has digits.
    monkeypatch.setattr(quantiles, "SHIFTS", list(range(56, -1, -8)))
    monkeypatch.setattr(quantiles, "DIGIT", 8)
    seen = []
    chosen = quantiles._chosen

    def watched(digits, keys, targets):
        seen.append(digits.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0])
        return chosen(digits, keys, targets)

    monkeypatch.setattr(quantiles, "_chosen", watched)
    values = numbers("spread")
    row = quantiles.exact_quantiles(frame(spark, values), "x", PROBABILITIES).first()
    assert list(row) == pytest.approx(expected(values), rel=1e-12)
    assert len(seen) == 8 and max(seen) <= 256


def test_groups_of_which_one_holds_a_third(spark):
    rng = random.Random(5)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(4000)]
    rows += [(f"g{rng.randrange(40)}", rng.gauss(3, 9)) for _ in range(8000)] + [(None, 2.0), (None, 4.0), ("empty", None)]
    found = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "x", PROBABILITIES, by=["g"])
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    got = {r["g"]: list(r)[1:] for r in found.collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx(expected(values), rel=1e-12)


def test_weights_count_as_copies(spark):
    rows = [(1.5, 3), (2.5, 1), (-4.0, 7), (None, 5)]
    values = [v for v, n in rows if v is not None for _ in range(n)]
    weighted = spark.createDataFrame(rows, "x double, n int")
    assert list(quantiles.exact_quantiles(weighted, "x", PROBABILITIES, weight="n").first()) == pytest.approx(expected(values))
    assert quantiles.describe(weighted, ["x"], "n").first() == quantiles.describe(frame(spark, values), ["x"]).first()


def test_exact_over_many_magnitudes(spark):
    values = [float(f"{sign}1e{e}") for e in range(-300, 301, 3) for sign in ("", "-")] + [1.7e308, -1.7e308]
    row = quantiles.exact_quantiles(frame(spark, values), "x", {"a": 0.0, "d": 0.5, "g": 1.0}).first()
    assert (row["a"], row["g"]) == (-1.7e308, 1.7e308) and row["d"] == pytest.approx(0)


def test_no_values_give_null(spark):
    row = quantiles.exact_quantiles(frame(spark, []), "x", {"q": 0.5}).first()
    assert row["q"] is None


def test_describe(spark):
    values = numbers("ties")
    row = quantiles.describe(frame(spark, values), ["x"]).first()
    assert row["count"] == len(values) and row["std"] == pytest.approx(np.std(values, ddof=1))
    assert (row["q25"], row["median"], row["q75"]) == tuple(np.percentile(values, [25, 50, 75]))
