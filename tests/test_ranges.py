"""Nothing is cut off: events of any date, orders of any period."""

from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from tradewind.operators import retention
from tradewind.sources.web import event_hits, event_sessions


@pytest.fixture(scope="module")
def moved(spark, folder, tmp_path_factory):
    """Tables whose events lie partly before and partly after January 2024."""
    target = str(tmp_path_factory.mktemp("moved"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    days = F.when(F.col("event_id") % 3 == 0, -45).when(F.col("event_id") % 3 == 1, 40).otherwise(0)
    seconds = F.col("ts") + F.make_dt_interval(days)
    events.withColumn("ts", seconds.cast("timestamp_ntz")).write.parquet(f"{target}/events.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{target}/{name}.parquet")
    return target


def _sql(folder, text):
    return duckdb.sql(text.replace("EVENTS", f"'{folder}/events.parquet/*.parquet'")).fetchall()[0]


def test_all_events_are_hits_and_sessions(spark, moved):
    want = _sql(moved, "SELECT count(*), count(DISTINCT (user_id, ts::DATE)) FROM EVENTS")
    assert event_hits(spark, moved).count() == want[0]
    assert event_hits(spark, moved, session_totals=True).count() == want[0]
    sessions = event_sessions(spark, moved)
    assert sessions.count() == want[1]
    assert sessions.agg(F.sum("hit_count")).first()[0] == want[0]
    assert sessions.where("campaign is null or channel is null or full_visitor_id is null").isEmpty()


def test_a_range_bounds_hits_and_sessions_but_not_visit_numbers(spark, moved):
    bounds = ("20231201", "20240115")
    want = _sql(
        moved,
        "SELECT count(*), count(DISTINCT (user_id, ts::DATE)) FROM EVENTS"
        " WHERE ts::DATE BETWEEN DATE '2023-12-01' AND DATE '2024-01-15'",
    )
    hits = event_hits(spark, moved, *bounds, session_totals=True)
    sessions = event_sessions(spark, moved, *bounds)
    assert (hits.count(), sessions.count()) == want
    assert sessions.agg(F.min("date"), F.max("date")).first() >= ("20231201", "20231201")
    every = event_sessions(spark, moved, last_day="20240115").where("date >= '20231201'")
    keys = ["full_visitor_id", "visit_id", "date", "visit_number"]
    assert sessions.select(*keys).exceptAll(every.select(*keys)).isEmpty()


def test_the_period_matrix_has_every_period(spark):
    orders = spark.createDataFrame(
        [(1, 10, date(1993, 2, 1)), (1, 11, date(1993, 12, 31)), (2, 12, date(2003, 5, 5)), (None, 13, date(1980, 1, 1))],
        "customer_id bigint, order_id bigint, order_date date",
    )
    wide = retention.customer_period_matrix(orders, "quarter")
    assert wide.columns[1] == "p_1993_01" and wide.columns[-1] == "p_2003_10" and len(wide.columns) == 1 + 44
    rows = {r["customer_id"]: r.asDict() for r in wide.collect()}
    assert rows[1]["p_1993_01"] == rows[1]["p_1993_10"] == rows[2]["p_2003_04"] == 1
    assert sum(v for r in rows.values() for k, v in r.items() if k != "customer_id") == 3


def test_listed_periods_report_the_rest(spark):
    orders = spark.createDataFrame(
        [(1, 10, date(1993, 2, 1)), (1, 11, date(1999, 2, 1)), (2, 12, date(2003, 5, 5))],
        "customer_id bigint, order_id bigint, order_date date",
    )
    wide = retention.customer_period_matrix(orders, "quarter", [date(1999, 1, 1)])
    assert {tuple(r) for r in wide.collect()} == {(1, 1, 1), (2, 0, 1)}
    assert wide.columns == ["customer_id", "p_1999_01", "p_other"]


def test_no_orders_no_matrix_columns(spark):
    orders = spark.createDataFrame([], "customer_id bigint, order_id bigint, order_date date")
    assert retention.customer_period_matrix(orders, "quarter").columns == ["customer_id"]
