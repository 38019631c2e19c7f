"""Sessions folded from the events, written by day and read back."""

import pytest
from pyspark.sql import functions as F

from tradewind.plans import funnel
from tradewind.sources import files, web


@pytest.fixture(scope="module")
def stored(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nested") / "sessions")
    files.write_web_sessions(web.fold_sessions(spark, folder), path)
    return path


def same(one, other):
    assert sorted(map(repr, one.collect())) == sorted(map(repr, other.select(*one.columns).collect()))


def test_unfolding_gives_the_flat_shapes_back(spark, folder, stored):
    nested = files.read_web_sessions(spark, stored, "00010101", "99991231")
    same(web.flat_sessions(nested), web.event_sessions(spark, folder))
    hits = web.event_hits(spark, folder, session_totals=True).withColumnRenamed("channel", "channel")
    flat = web.flat_hits(nested)
    keys = [c for c in flat.columns if c not in ("product",)]
    same(flat.select(*keys), hits)
    products = web.event_products(web.event_hits(spark, folder), spark, folder)
    columns = ["full_visitor_id", "date", "action", "category", "product_quantity", "product_revenue", "product_price", "is_click"]
    same(web.flat_products(flat).select(*columns), products)


def test_long_visits_are_folded_into_several_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(web, "HITS_A_ROW", 1)
    nested = web.fold_sessions(spark, folder).cache()
    visits = web.event_sessions(spark, folder)
    assert nested.agg(F.max("part")).first()[0] > 0
    # A visit of three hits or fewer may well leave its first part empty here; real rows hold hundreds.
    flat = web.flat_hits(nested)
    assert flat.count() == web.event_hits(spark, folder).count()
    assert nested.select("fullVisitorId", "visitId").distinct().count() == visits.count()
    assert web.flat_sessions(nested).groupBy("full_visitor_id", "visit_id").count().where("count > 1").isEmpty()


def test_folders_and_fields_are_pruned(spark, stored):
    days = files.read_web_sessions(spark, stored, "20240103", "20240105", ["v2ProductCategory"])
    frame = funnel.conversion_funnel(web.flat_products(web.flat_hits(days)))
    frame.collect()
    scan = frame._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    assert scan.relation().location().rootPaths().size() == 1
    schema = scan.requiredSchema().catalogString()
    assert "product:array<struct<v2ProductCategory:string>>" in schema
    assert "totals" not in schema and "geoNetwork" not in schema
    assert "date" in scan.partitionFilters().toString()
    read = {r[0] for r in days.select(F.regexp_extract(F.input_file_name(), r"date=(\d+)", 1)).distinct().collect()}
    assert read == {"20240103", "20240104", "20240105"}


def test_csv_is_read_with_reasons(spark, tmp_path):
    names = files.BEHAVIOR_CSV.fieldNames()
    good = dict.fromkeys(names, "") | {"users": "u", "visit_id": "7", "date": "20240229", "start_time": "86401"}
    rows = [good, good | {"date": "20230229"}, good | {"date": "x", "price": "many"}, good | {"start_time": "n/a"}, good | {"date": ""}]
    path = tmp_path / "rows.csv"
    lines = [",".join(r[c] for c in names) for r in rows] + ["too,short"]
    path.write_text("\n".join([",".join(names), *lines]) + "\n")
    checked = files.read_behavior_csv(spark, str(path))
    assert {tuple(r) for r in files.refused_rows(checked).collect()} == {("bad date", 2), ("bad start_time", 1), ("malformed row", 1)}
    kept = files.accepted(checked)
    assert "refused" not in kept.columns
    assert kept.count() == 2
    found = [(str(r["date"]), str(r["start_time"])) for r in kept.orderBy("date").collect()]
    assert found == [("None", "1970-01-02 00:00:01"), ("2024-02-29", "1970-01-02 00:00:01")]
