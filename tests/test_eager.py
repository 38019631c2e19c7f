"""Sums below a join, and several distinct counts in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from tradewind.operators.distinct import distinct_counts
from tradewind.operators.eager import sum_by


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, 9, None]), rng.choice("ab"), rng.choice([1, 2, None])) for _ in range(500)]
    return spark.createDataFrame(rows, "part_no int, shop string, quantity int")


@pytest.fixture(scope="module")
def items(spark):
    # Two items of one name, one without lines, lines without an item.
    return spark.createDataFrame([(1, "mug"), (2, "mug"), (3, None), (4, "box")], "part_no int, name string")


def same(one, other):
    one, other = (sorted(map(repr, frame.collect())) for frame in (one, other.select(*one.columns)))
    assert one == other


@pytest.mark.parametrize("keys", [["name"], ["name", "shop"], ["shop"], ["part_no", "name"], ["part_no", "shop"]])
def test_equals_a_join_of_all_lines(lines, items, keys):
    sums = {"quantity": F.col("quantity"), "lines": F.lit(1).cast("bigint")}
    want = lines.join(items, "part_no").groupBy(*keys).agg(F.sum("quantity").alias("quantity"), F.count("*").alias("lines"))
    same(sum_by(lines, keys, sums, items), want)


def test_without_items_it_is_a_grouping(lines):
    same(sum_by(lines, ["shop"], {"q": F.col("quantity")}), lines.groupBy("shop").agg(F.sum("quantity").alias("q")))


def test_a_hot_item_is_one_row_in_the_join(spark, items):
    hot = spark.range(100_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(2).alias("part_no"), F.lit(1).alias("quantity"))
    found = sum_by(hot, ["name"], {"quantity": F.col("quantity")}, items)
    assert found.collect()[0]["quantity"] == 100_000
    # Below the join there is a grouping by item.
    assert "HashAggregate" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [[], ["shop"]])
def test_counts_equal_plain_distinct_counts(lines, by):
    counted = {"parts": F.col("part_no"), "quantities": F.col("quantity"), "big": F.when(F.col("quantity") > 1, F.col("part_no"))}
    found = distinct_counts(lines, [F.col(c) for c in by], counted, {"sum": F.col("quantity"), "n": F.lit(1).cast("bigint")})
    plain = [F.countDistinct(c).alias(name) for name, c in counted.items()]
    want = lines.groupBy(*by).agg(*plain, F.sum("quantity").alias("sum"), F.count("*").alias("n"))
    same(found, want)


def test_no_rows(lines):
    none = lines.where("false")
    assert distinct_counts(none, [], {"parts": F.col("part_no")}, {"q": F.col("quantity")}).collect() == [(0, None)]
    assert distinct_counts(none, [F.col("shop")], {"parts": F.col("part_no")}).collect() == []
