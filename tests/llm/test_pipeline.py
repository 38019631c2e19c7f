"""The stages over a small table."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


def test_the_stages_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == names
        if k < 2:
            assert 0 < docs.count() <= before.count()
        if k == 2:
            assert docs.count() == before.count()
            assert not [r for r in docs.collect() if re.search(r"@mail\d\.example\.com|555-\d{4}", r["text"])]
    assert docs.where("not round_trip or n_pieces = 0").isEmpty() and docs.count() == before.count()
    assert docs.agg(F.countDistinct("source")).first()[0] > 10


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (None, "the same text again and again", "en", "b", 29),
    (4, "the same text again and again", "en", "b", 29),
    (4, "the same text again and again", "en", "b", 29),
    (5, "word " * 40_000, "en", None, 200_000),
    (6, "Mr. John Smith has the mail a@b.org or A@B.org and lives here since long ago with us all the time", None, "b", 99),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("rows", [ODD, [], ODD[:1], ODD[6:7]])
def test_stages_take_odd_rows_and_empty_tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        kept = found.collect()
        if k < 4:
            assert found.columns == docs.columns
        if k in (0, 1):
            # These stages only drop rows.
            left = [tuple(r) for r in docs.collect()]
            for row in kept:
                left.remove(tuple(row))
        if k == 2:
            assert len(kept) == len(rows) and not any("@b.org" in (r["text"] or "").lower() for r in kept)
        if k == 4:
            assert len(kept) == len(rows) and all(r["round_trip"] for r in kept if r["ids"])


def test_one_of_each_group_of_copies_stays(spark, folder):
    docs = spark.createDataFrame(ODD, SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, folder).collect()
    texts = [r["text"] for r in kept]
    assert texts.count("the same text again and again") == 1
    # Texts without words are alike.
    assert sorted(r["doc_id"] for r in kept) == [1, 4, 5, 6]
