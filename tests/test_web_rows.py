"""Hand-made nested sessions for the edges of the web jobs."""

import pytest
from pyspark.sql import functions as F

from tradewind.functions.categories import category_levels, main_category
from tradewind.plans import funnel, marketing, visitors
from tradewind.functions.fixed_values import SENSITIVITY_FIVE
from tradewind.sources import files, web
from tradewind.sources.schemas import WEB_SESSION

TOTALS = ["hits", "pageviews", "timeOnSite", "bounces", "newVisits", "transactions", "transactionRevenue", "totalTransactionRevenue", "sessionQualityDim"]


def product(category="Office", quantity=1, revenue=None, price=1_000_000, impression=None, click=None):
    return (category, quantity, revenue, price, impression, click)


def hit(action, products=(), transaction=(None, None)):
    return ((action,), transaction, list(products))


def session(visitor="v", visit=1, number=1, date="20160801", hits=(), channel="organic", campaign="(not set)", place=("Americas", "North", "US", "CA"), **totals):
    return (visitor, visit, number, date, 0, tuple(totals.get(t) for t in TOTALS), (channel, campaign), place, list(hits))


def nested(spark, *sessions):
    return spark.createDataFrame(list(sessions), WEB_SESSION)


def flat(spark, *sessions):
    frame = nested(spark, *sessions)
    hits = web.flat_hits(frame)
    return web.flat_sessions(frame), hits, web.flat_products(hits)


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def scan_schema(frame):
    return frame._jdf.queryExecution().sparkPlan().collectLeaves().apply(0).requiredSchema().simpleString()


@pytest.mark.parametrize(
    "path, expected",
    [
        # The trailing slash goes first, which leaves the bare root for the exact rule.
        ("Home/", ("", "Other", "Other")),
        ("Home", ("", "Other", "Other")),
        ("/Apparel//Men's-T-Shirts", ("Apparel", "Men's", "Men's-T-Shirts")),
        ("Home/Home/x", ("Home", "x", "Other")),
        ("a/b/c/d", ("a", "b", "c")),
        (None, ("Other", "Other", "Other")),
        ("", ("", "Other", "Other")),
        ("(not set)", ("Unavailable", "Other", "Other")),
        ("Drinkware/Mugs/", ("Accessories", "Drinkware", "Mugs and Cups")),
    ],
)
def test_category_levels(spark, path, expected):
    frame = spark.createDataFrame([(path,)], "c string")
    assert tuple(frame.select(*category_levels(F.col("c")).values()).first()) == expected


def test_blank_main_category_is_other_where_asked(spark):
    frame = spark.createDataFrame([("Home/",)], "c string")
    assert frame.select(main_category(F.col("c")), main_category(F.col("c"), blank_as_other=False)).first() == ("Other", "")


def test_null_actions_and_empty_products(spark):
    _, hits, products = flat(
        spark, session(hits=[hit(None, [product()]), hit("6", []), hit("2", [product(), product("Bags")]), hit("3", [product()])])
    )
    assert hits.count() == 4 and products.count() == 4
    got = rows(funnel.conversion_funnel(products), "action", "category", "users")
    assert got == [("Product detail views", "Bags", 1), ("Product detail views", "Office", 1)]
    assert rows(funnel.action_distribution(products), "action", "rows") == [(2, 2), (3, 1)]


def test_unnesting_reads_only_the_fields_in_use(spark, tmp_path):
    path = str(tmp_path / "sessions")
    files.write_web_sessions(nested(spark, session(), session(date="20160901", hits=[hit("2", [product()])])), path)
    read = files.read_web_sessions(spark, path, "20160815", "20160930", ["v2ProductCategory"])
    products = funnel.conversion_funnel(web.flat_products(web.flat_hits(read)))
    text = products._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in text
    # The printed plan abbreviates long schemas; the scan node holds the whole one.
    schema = scan_schema(products)
    assert "product:array<struct<v2ProductCategory:string>>" in schema
    assert "totals" not in schema and "geoNetwork" not in schema
    assert rows(products, "category", "users") == [("Office", 1)]


def test_visits_weigh_as_often_as_they_buy(spark):
    sessions, hits, _ = flat(
        spark,
        session("a", 1, 1, hits=[hit("6")] * 3, timeOnSite=10, pageviews=3),
        session("b", 1, 5, hits=[hit("6")], timeOnSite=50),
        session("c", 1, 2, hits=[hit("1")], pageviews=1),
    )
    got = rows(visitors.purchase_averages(sessions, hits), "visit_type", "average_visit_no", "avg_time", "avg_pgviews")
    assert got == [("No Purchase", 2.0, None, 1.0), ("Purchase", 2.0, 20.0, 3.0)]


@pytest.mark.parametrize(
    "average, segment",
    [(9.99, "Price-Sensitive"), (10, "Semi Price-Sensitive"), (20, "Semi Price-Sensitive"), (50, "Medium Price-Sensitive"),
     (100, "Semi-Low Price-Sensitive"), (100.01, "Low-Sensitivity"), (None, "Low-Sensitivity")],
)
def test_tier_bounds(spark, average, segment):
    revenue = None if average is None else round(average * 1_000_000)
    _, hits, _ = flat(spark, session(hits=[hit("6", [], ("T1", revenue))]))
    assert visitors.price_sensitivity(hits, SENSITIVITY_FIVE).first()["segment"] == segment


def test_visitor_bins(spark):
    sessions, _, _ = flat(spark, *[session(f"v{n}", 1, n) for n in (1, 2, 5, 6)])
    got = rows(visitors.visitor_frequency(sessions), "visitor_category", "total_transactions", "mean_revenue")
    assert got == [("First-time", 0, 0.0), ("Frequent", 0, 0.0), ("Occasional", 0, 0.0)]


def test_missing_values_keep_their_meaning(spark):
    sessions, _, _ = flat(
        spark,
        session("a", campaign="X", pageviews=4),
        session("b", campaign="X", transactions=None, bounces=1),
    )
    channel = marketing.channel_performance(sessions).first()
    assert (channel["total_transactions"], channel["avg_pageviews"], channel["avg_bounces"]) == (None, 4.0, 0.5)
    campaign = marketing.campaign_performance(sessions).first()
    assert (campaign["total_transactions"], campaign["avg_pageviews"], campaign["avg_order_value"]) == (0, 2.0, None)


def test_new_and_returning(spark):
    sessions, _, _ = flat(
        spark,
        session("a", 1, date="20160801", campaign="X"),
        session("a", 2, date="20160802", campaign="X"),
        session("b", 1, date="20160801", campaign="(not set)"),
        session("b", 2, date="20160803", campaign="Y"),
        session("c", 1, date="20160801", campaign="Z"),
        session("c", 2, date="20160801", campaign="Z"),
    )
    got = rows(marketing.new_vs_returning(sessions), "campaign", "new_customers", "returning_customers", "ratio")
    assert got == [("X", 1, 1, 1.0), ("Y", 0, 1, 0.0), ("Z", 1, 0, 0.0)]


def test_roi(spark):
    def sold(channel, category, revenue):
        return session(channel, channel=channel, hits=[hit("6", [product(category, revenue=revenue * 1_000_000)], ("T" + channel, 1))])

    _, _, products = flat(
        spark, sold("organic", "Office", 168000), sold("cpc", "Office", 9), sold("affiliate", "Office", 100), sold("cpm", "Office", 1),
        session("x", channel="cpc", hits=[hit("1", [product("Mystery")])]),
    )
    got = {r["channel"]: (r["revenue"], r["cost"], r["roi"]) for r in marketing.channel_roi(products).collect()}
    assert got["organic"] == (168000.0, 84000.0, 1.0)
    assert got["cpc"] == (9.0, 3.0, 2.0)
    assert got["affiliate"][1] == pytest.approx(6.0) and got["cpm"][1:] == (None, None)


def test_funnel_keeps_absent_stages(spark):
    _, _, products = flat(spark, session(hits=[hit("1", [product(), product()]), hit("5", [product()])]))
    got = {r["action"]: (r["users"], r["percentage"]) for r in funnel.product_funnel(products).collect()}
    assert got == {
        "Click through of product lists": (2, 100.0),
        "Product detail views": (0, 0.0),
        "Check out": (1, None),
        "Completed purchase": (0, 0.0),
    }


def test_shares_sum_to_hundred(spark, folder):
    import __spark_entry__ as entry

    for name, columns in [
        ("continent_share", ["transaction_percent", "revenue_percent"]),
        ("product_preference", ["transaction_percent", "revenue_percent"]),
        ("top5_other_revenue", ["percentage"]),
        ("campaign_revenue_share", ["percentage"]),
        ("subcontinent_rank", ["revenue_percent"]),
    ]:
        sums = entry.queries()[name](spark, folder).agg(*[F.sum(c) for c in columns]).first()
        assert list(sums) == pytest.approx([100.0] * len(columns)), name


def test_correlation_of_a_constant_is_null(spark):
    from tradewind.operators.shares import correlation_pairs

    frame = spark.createDataFrame([(1, 5, 2), (2, 5, None), (3, 5, 6)], "x int, flat int, gaps int")
    got = {(r["a"], r["b"]): r["correlation"] for r in correlation_pairs(frame, ["x", "flat", "gaps"]).collect()}
    assert got["x", "flat"] is None and got["flat", "flat"] is None
    assert got["x", "x"] == pytest.approx(1) and got["gaps", "x"] == pytest.approx(1)


def test_histogram_counts_every_known_value(spark):
    frame = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 10.0), ("b", 3.0), ("b", None)], "segment string, avg_order_value double")
    assert rows(visitors.order_value_histogram(frame, 2), "segment", "bin", "visitors") == [("a", 0, 1), ("a", 1, 2), ("b", 1, 1)]
