"""Sinks: a run of one client leaves the others alone; empty figures and guards in documents."""

import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF_185, raw_tables
from stocklens.operators import cleaning
from stocklens.operators import docs as D
from stocklens.plans.retail import Retail
from stocklens.sources import sinks, tables


def test_one_client_run_keeps_the_other_clients(spark):
    out = tempfile.mkdtemp(prefix="stocklens-sinks-")
    both = spark.createDataFrame([(1, 10.0), (2, 20.0)], "client_id long, v double")
    sinks.write_analytics({"t": both}, out)
    sinks.write_analytics({"t": spark.createDataFrame([(1, 11.0)], "client_id long, v double")}, out)
    got = {(r.client_id, r.v) for r in spark.read.parquet(f"{out}/t").collect()}
    assert got == {(1, 11.0), (2, 20.0)}
    rows = [(c, "fig1", la, 0, "[]") for c in (1, 2) for la in ("en", "ar")]
    docs = spark.createDataFrame(rows, "client_id long, figure string, lang string, page int, data string")
    sinks.write_chart_docs(docs, f"{out}/docs")
    sinks.write_chart_docs(docs.filter("client_id = 1 and lang = 'en'").withColumn("data", F.lit("[1]")), f"{out}/docs")
    got = {(r.client_id, r.lang, r.data) for r in spark.read.json(f"{out}/docs").collect()}
    assert got == {(1, "en", "[1]"), (1, "ar", "[]"), (2, "en", "[]"), (2, "ar", "[]")}


def test_missing_optional_table_is_empty_and_other_failures_raise(spark):
    src = tempfile.mkdtemp(prefix="stocklens-src-")
    assert tables.read_optional(spark, src, "invoice_deferreds").count() == 0
    spark.range(3).write.parquet(f"{src}/invoice_deferreds")
    with pytest.raises(tables.MissingColumnsError):
        tables.read_optional(spark, src, "invoice_deferreds")


@pytest.fixture(scope="module")
def one_product(spark):
    raw = raw_tables(spark, [("1", "only", "1", "2", "5", 7)], [("1.0", "2025-01-01", "9", 7)],
                     [(1, "1", "1", "3", "9", "1", "2025-01-02")])
    return Retail(raw, AS_OF_185)


def test_details_meet_their_invoice_by_normalised_id(one_product):
    assert one_product.product_flow.count() == 1


def test_every_figure_has_a_document(one_product):
    docs = {(r.figure, r.lang): r for r in D.chart_docs(one_product, forecasts=False).collect()}
    assert len(docs) == 32 and all(r.page == 0 for r in docs.values())
    assert docs["fig6", "en"].data == "[]" and docs["fig17", "ar"].data == "[]"
    assert docs["fig1", "en"].metadata.timestamp == "2025-04-27 00:00:00"


def test_guard_documents_and_notes(one_product):
    run_at = dt.datetime(2025, 5, 1, 12, 30)
    docs = {r.figure: r for r in D.chart_docs(one_product, ["en"], run_at, forecasts=False, guards=True).collect()}
    assert json.loads(docs["fig6"].data)["error"] is True and json.loads(docs["fig13"].data)["error"] is True
    assert json.loads(docs["fig1"].data) == [{"Product": "only", "Current Stock": 5.0, "Sales": 3.0}]
    plain = {r.figure: r for r in D.chart_docs(one_product, ["en"], run_at, forecasts=False).collect()}
    assert len(docs["fig1"].metadata.description) > len(plain["fig1"].metadata.description)     # a short sales period
    assert docs["fig1"].metadata.timestamp == "2025-05-01 12:30:00"


def test_pages_start_at_zero(one_product, spark):
    days = spark.range(25).select(F.lit(7).cast("long").alias("client_id"), F.lit("fig11").alias("figure"), F.lit("en").alias("lang"),
                                  (F.col("id") + 1).alias("seq"), F.col("id").cast("string").alias("record"))
    pages = {r.page: json.loads(r.data) for r in D._pages(days, 10).collect()}
    assert pages == {0: list(range(10)), 1: list(range(10, 20)), 2: list(range(20, 25))}


def test_no_valid_feature_date_is_an_error(spark):
    bad = spark.createDataFrame([(1, "x"), (2, None)], "invoice_id long, created_at string")
    with pytest.raises(ValueError):
        cleaning.require_feature_dates(bad)
    assert cleaning.require_feature_dates(bad.limit(0)).count() == 0
