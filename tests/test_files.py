import datetime as dt

from tradewind.plans.cleaning import clean_retail
from tradewind.sources import files


def test_retail_csv_to_clean_csv(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text(
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
        '536365,85123A,"WHITE, HEART",6,2010-12-01 08:26:00,2.55,17850.0,EIRE\n'
        "C536379,D,Discount,-1,2010-12-01 09:41:00,27.5,,France\n"
    )
    lines = files.read_retail_csv(spark, str(raw))
    assert lines.orderBy("invoice_no").first()["invoice_ts"] == dt.datetime(2010, 12, 1, 8, 26)
    files.write_csv(clean_retail(lines), str(tmp_path / "clean"))
    back = spark.read.option("header", True).csv(str(tmp_path / "clean")).orderBy("invoice_no").collect()
    assert [(r["country"], r["total_price"], r["customer_id"]) for r in back] == [("Ireland", "15.3", "17850"), ("France", "-27.5", None)]


def test_named_results(spark, tmp_path):
    files.write_results({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def test_listings_csv(spark, tmp_path):
    path = tmp_path / "listings.csv"
    names = [f.name for f in files.LISTING_CSV]
    path.write_text(",".join(names) + "\n" + ",".join(["x"] * len(names)) + "\n", encoding="utf-8")
    assert files.read_listings_csv(spark, str(path)).columns == names
