"""Dirty rows (FIXTURES F4): coercion, dates, keys, contracts, fallbacks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import raw_tables
from stocklens.functions import key_int, key_text, num0, parse_mixed_date
from stocklens.plans.retail import Retail
from stocklens.sources.tables import MissingColumnsError, check_columns, read_optional


def test_num0_and_keys(spark):
    df = spark.createDataFrame([("12.5", 200.0, "200"), ("x", None, None), (None, 7.0, "7.0")],
                               "n string, d double, s string")
    got = df.select(num0("n").alias("n"), key_text("d", None, T.DoubleType()).alias("d"),
                    key_text("s", "nan").alias("s"), key_int("s").alias("i")).collect()
    assert [tuple(r) for r in got] == [(12.5, "200", "200", 200), (0.0, None, "nan", None), (0.0, "7", "7", 7)]


def test_numeric_dates(spark):
    df = spark.createDataFrame([(45000.0,), (45000.5,), (60.0,), (1700000000.0,), (99999999999.0,), (None,)], "x double")
    got = [r[0] for r in df.select(parse_mixed_date("x", T.DoubleType())).collect()]
    assert got == [dt.datetime(2023, 3, 15), dt.datetime(2023, 3, 15, 12), None,
                   dt.datetime(2023, 11, 14, 22, 13, 20), None, None]


def test_text_dates(spark):
    texts = ["", "  ", "abc", None, "2024-01-02 03:04:05", "20240102", "2024-01", "03/04/2024",
             "13/02/2024", "Jan 5 2024", "45000"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(parse_mixed_date("s", T.StringType())).collect()]
    assert got == [None, None, None, None, dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2),
                   dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 4), dt.datetime(2024, 2, 13),
                   dt.datetime(2024, 1, 5), None]


def _retail(spark):
    prods = [("1", "stocked", "1", "2", "10", 1), ("2", "neg", "1", "2", "-1", 1), ("3", "unsold", "1", "2", "10", 1)]
    invs = [("10", "2024-06-01 08:00:00", "5", 1), ("11", "not a date", "5", 1), (None, "2024-06-01", "5", 1),
            ("12", "2024-05-01", "5", 1)]
    dets = [(1, "1", "10", "2", "4", "1", "2024-06-01 09:00:00"),   # sale at 09:00 on the as_of day
            (2, "2", "10", "5", "10", "1", None),                   # no own date: invoice date
            (3, "2", "11", "1", "10", "1", None),                   # no date anywhere: dropped
            (4, "9", "12", "5", "10", "1", "2024-05-01"),           # product in sales only
            (5, None, "12", "1", "1", "0", "2024-05-01")]           # null product id -> 'nan'
    return Retail(raw_tables(spark, prods, invs, dets), dt.date(2024, 6, 1))


def test_clean_and_flow(spark):
    r = _retail(spark)
    assert r.invoices.count() == 2  # null id and bad date dropped
    det = {d["detail_id"]: d for d in r.details.collect()}
    assert set(det) == {1, 2, 4, 5}
    assert det[2]["created_at"] == dt.datetime(2024, 6, 1, 8)
    assert det[5]["product_id"] == "nan"
    pf = {p["product_id"]: p for p in r.product_flow.collect()}
    assert "3" not in pf                                      # never sold (D3)
    assert pf["1"]["days_since_last_sale"] == -1              # later on the as_of day
    assert pf["2"]["efficiency"] == "N/A"                     # stock -1
    assert (pf["9"]["name"], pf["9"]["current_stock"], pf["9"]["efficiency"]) == ("Unknown Product", 0.0, "Undersupplied")
    assert pf["nan"]["name"] == "Unknown Product"
    assert r.stagnant.filter(F.col("product_id") == "1").count() == 0


def test_contracts(spark):
    bad = spark.createDataFrame([(1, "a")], "id long, name string")
    with pytest.raises(MissingColumnsError, match="buyPrice"):
        check_columns(bad, "products")
    empty = read_optional(spark, "/nonexistent/dir", "invoice_deferreds")
    assert empty.count() == 0 and "paid_amount" in empty.columns


def test_include_unsold(spark):
    from stocklens.operators.flow import product_flow
    r = _retail(spark)
    pf = {p["product_id"]: p for p in product_flow(r.details, r.products, r.as_of, include_unsold=True).collect()}
    assert pf["3"]["sales_quantity"] == 0.0 and pf["3"]["efficiency"] == "N/A"
    assert pf["3"]["days_since_last_sale"] == 99999


def test_days_mode_date(spark):
    r = _retail(spark)
    r.days_mode = "date"
    pf = {p["product_id"]: p for p in r.product_flow.collect()}
    assert pf["1"]["days_since_last_sale"] == 0


def test_tpch_products_adapter(spark):
    from stocklens.plans.retail import Retail
    r = Retail.from_tpch(spark, "/root/testdata/sf0.001")
    n_part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert r.products.count() == 5 * n_part
    assert r.products.select("client_id").distinct().count() == 5
