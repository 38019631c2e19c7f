"""Hot keys: results on tables where single keys hold a third of all rows."""

import glob
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F
from tools.check_oracles import SKEW_SETTINGS, compare
from tools.make_skewed import make_skewed
from tradewind.operators.skew import join_keyed
from tradewind.plans import pricing

NAMES = [
    "monthly_churn_by_country", "cohort_retention_month", "impulsive_customers", "loyal_probability", "purchase_gaps",
    "stockout_rate", "weekly_series", "adjusted_price", "pricing_base", "channel_conversion_rate", "clean_behavior",
    "purchase_averages", "new_vs_returning", "customers_by_country", "country_stockout", "campaign_engagement_boxplot",
    "kpi_overview", "keyword_category", "profile_describe", "nested_session_metrics",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, folder):
    target = str(tmp_path_factory.mktemp("skew") / "sf")
    make_skewed(folder, target)
    connection = duckdb.connect()
    for path in glob.glob(f"{target}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return target, connection


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle only, with the skew handling on for small partitions too."""
    settings = {key.replace("__", "."): value for key, value in SKEW_SETTINGS.items()}
    settings["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql_on_skewed_tables(spark, shuffled, skewed, name):
    folder, connection = skewed
    message, same = compare(spark, connection, name, folder, entry.oracle_sql()[name])
    assert same, message


def test_join_keyed_equals_a_plain_join(spark, shuffled):
    rng = random.Random(1)
    rows = [(i, 1 if i % 3 == 0 else rng.randint(2, 3000)) for i in range(30000)]
    big = spark.createDataFrame([*rows, (-1, 4000)], "id bigint, k bigint")
    keyed = big.where("k < 3900").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    total = big.agg(F.count("*")).scalar()
    got = join_keyed(big, keyed, ["k"], "n", total, ["id"])
    want = big.join(keyed, "k")
    assert got.columns == ["id", "k", "n", "top"]
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == want.count()


def test_join_keyed_spreads_the_hot_key(spark, shuffled):
    big = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    keyed = big.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_keyed(big, keyed, ["k"], "n", big.agg(F.count("*")).scalar(), ["id"])
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20000 and max(sizes) < 20000 / 3


def test_pricing_base_spreads_equal_lines(spark, shuffled):
    hot = spark.range(30000).select(F.lit("mug").alias("description"), F.lit(2).alias("quantity"), F.lit(1.5).alias("unit_price"), "id")
    cold = spark.range(30000, 60000).select(
        F.concat(F.lit("item"), (F.col("id") % 2000).cast("string")), F.lit(1), F.lit(2.0), "id"
    )
    base = pricing.pricing_base(hot.union(cold), ["id"])
    assert base.columns == ["description", "quantity", "unit_price"]
    sizes = [r["count"] for r in base.where("description = 'mug'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30000 and len(sizes) > 3 and max(sizes) < 15000
