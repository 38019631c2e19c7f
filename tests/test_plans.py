"""Plan shapes that must hold: pruned scans, pushed filters, no cross joins, no Python workers."""

import pytest

import __spark_entry__ as entry
from tradewind.plans import sales
from tradewind.sources.retail import retail_lines
from tradewind.sources.web import event_hits, event_products, event_sessions

QUERIES = entry.queries()
# Models are fitted while the query is built, so there is no single plan to look at.
FITTED = ("pca", "kmeans", "cluster", "elbow", "description", "category_elasticity")


def plan(frame):
    return frame._jdf.queryExecution().toString()


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(FITTED)])
def test_no_cross_join_and_no_python(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text, operator


def test_retail_source_joins_only_what_is_read(spark, folder):
    text = physical(retail_lines(spark, folder, "stock_code", "quantity"))
    assert text.count("FileScan") == 1
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_returnflag:string>" in text


def test_date_range_reaches_the_scan(spark, folder):
    text = physical(event_hits(spark, folder, "20240105", "20240110"))
    assert "GreaterThanOrEqual(ts,2024-01-05" in text and "LessThan(ts,2024-01-11" in text
    # Visit numbers need all earlier sessions, so only the last day bounds the scan.
    text = physical(event_sessions(spark, folder, "20240105", "20240110"))
    assert "GreaterThanOrEqual(ts" not in text and "LessThan(ts,2024-01-11" in text


def test_unused_visit_numbers_cost_no_window(spark, folder):
    assert "Window" not in physical(sales.daily_revenue(event_sessions(spark, folder)))


def test_catalog_join_is_optional(spark, folder):
    hits = event_hits(spark, folder)
    assert "p_partkey" not in physical(event_products(hits, spark, folder, catalog=False))


def test_shares_reuse_the_shuffle_of_the_sums(spark, folder):
    frame = QUERIES["continent_share"](spark, folder)
    frame.collect()
    assert "ReusedExchange" in physical(frame)


# --- executed plans -----------------------------------------------------------------


def nodes(frame):
    """(name, executed plan node) of a frame that has run, reused exchanges not entered, scalar subqueries included."""

    def walk(node):
        name = node.nodeName()
        yield name, node
        if name == "AdaptiveSparkPlan":
            inner = [node.executedPlan()]
        elif name.endswith("QueryStage"):
            inner = [node.plan()]
        elif name == "ReusedExchange":
            inner = []
        else:
            children = node.children()
            inner = [children.apply(i) for i in range(children.size())]
            subqueries = node.subqueries()
            inner += [subqueries.apply(i) for i in range(subqueries.size())]
        for child in inner:
            yield from walk(child)

    return list(walk(frame._jdf.queryExecution().executedPlan()))


def metric(node, name):
    found = node.metrics().get(name)
    return found.get().value() if found.isDefined() else 0


def scans(frame, table):
    """How often a table is read."""
    return sum(f"/{table}.parquet" in node.simpleString(1000) for name, node in nodes(frame) if name.startswith("Scan"))


def shuffled(frame):
    return [metric(node, "shuffleRecordsWritten") for name, node in nodes(frame) if name == "Exchange"]


@pytest.mark.parametrize("name", ["keyword_category", "profile_describe", "adjusted_price", "price_points"])
def test_lines_are_added_up_below_the_join_with_items(spark, name):
    folder = "/root/testdata/sf0.01"
    frame = QUERIES[name](spark, folder)
    frame.collect()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert scans(frame, "lineitem") == 1
    joins = [node for kind, node in nodes(frame) if kind in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin")]
    assert joins
    # No join sees a line for each line read.
    assert max(metric(node, "numOutputRows") for node in joins) < lines
    assert max(shuffled(frame)) < lines


@pytest.mark.parametrize("name", ["stockout_rate", "country_stockout"])
def test_velocities_and_gaps_come_from_one_scan(spark, folder, name):
    frame = QUERIES[name](spark, folder)
    frame.collect()
    assert scans(frame, "lineitem") == 1


@pytest.mark.parametrize("name", ["kpi_overview", "period_activity_month", "channel_category_metrics", "channel_roi"])
def test_distinct_counts_copy_reduced_rows_only(spark, folder, name):
    frame = QUERIES[name](spark, folder)
    frame.collect()
    for kind, node in nodes(frame):
        if kind == "Expand":
            # What is copied was grouped and shuffled before.
            assert "Exchange" in node.toString() or "ShuffleQueryStage" in node.toString()


def test_quantiles_share_the_counted_values(spark, folder):
    frame = QUERIES["purchases_per_user_describe"](spark, folder)
    frame.collect()
    assert scans(frame, "events") == 1


@pytest.mark.parametrize("name", ["monthly_churn_by_country", "new_vs_returning", "campaign_info"])
def test_no_sort_of_raw_rows_for_extremes(spark, folder, name):
    frame = QUERIES[name](spark, folder)
    frame.collect()
    for kind, node in nodes(frame):
        if kind == "SortAggregate":
            # What is sorted was grouped and shuffled before.
            assert "Exchange" in node.child().toString() or "ShuffleQueryStage" in node.child().toString()
            inner = node.child().toString()
            assert "HashAggregate" in inner[: inner.index("FileScan")]
