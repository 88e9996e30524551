"""Snapshots, the document store, drop counters and nested files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from stocklens.operators import cleaning
from stocklens.operators.i18n import flatten_json, load_dictionaries
from stocklens.sources import sinks


def test_a_failed_refresh_leaves_the_last_snapshot(spark, tmp_path):
    root = f"{tmp_path}/pub"
    assert sinks.snapshot(spark, root) is None
    seen = []
    for i in range(4):
        sinks.publish_snapshot(spark, root, lambda to, i=i: spark.range(i + 1).write.parquet(f"{to}/t"), keep=2)
        seen.append(sinks.snapshot(spark, root))
        assert spark.read.parquet(f"{seen[-1]}/t").count() == i + 1

    def broken(to):
        spark.range(99).write.parquet(f"{to}/t")
        raise OSError("disk full")

    with pytest.raises(OSError):
        sinks.publish_snapshot(spark, root, broken)
    assert sinks.snapshot(spark, root) == seen[-1] and spark.read.parquet(f"{seen[-1]}/t").count() == 4
    assert spark.read.parquet(f"{seen[-2]}/t").count() == 3                    # a reader on the version before goes on
    assert not os.path.exists(seen[0]) and not os.path.exists(seen[1])
    sinks.publish_snapshot(spark, root, lambda to: spark.range(7).write.parquet(f"{to}/t"), keep=1)
    assert sorted(n for n in os.listdir(root) if not n.startswith(".")) == ["CURRENT", os.path.basename(sinks.snapshot(spark, root))]


def scanned_rows(df):
    df.collect()
    plan, todo, out = df._jdf.queryExecution().executedPlan(), [], 0
    todo.append(plan)
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        elif name.startswith("Scan parquet"):
            out += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_a_lookup_reads_the_row_groups_of_its_document(spark, tmp_path):
    docs = spark.range(4000).select(
        (F.col("id") % 500).alias("client_id"), F.concat(F.lit("fig"), (F.col("id") % 8).cast("string")).alias("figure"), F.lit("en").alias("lang"),
        F.floor(F.col("id") / 2000).cast("int").alias("page"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 40).alias("data"))
    docs = docs.unionByName(docs.filter("client_id = 7").withColumn("lang", F.lit("ar")))
    sinks.write_doc_store(docs, f"{tmp_path}/docs", group_bytes=64 << 10)
    want = {(r.client_id, r.figure, r.lang, r.page, r.data) for r in docs.collect()}
    for client, lang, got_lang in ((7, "AR", "ar"), (7, "fr", "en"), (499, "ar", "en"), (3, None, "en")):
        figure = f"fig{client % 4}"
        found = sinks.lookup_doc(spark, f"{tmp_path}/docs", client, figure, lang)
        got = [tuple(r) for r in found.collect()]
        assert set(got) == {w for w in want if w[:3] == (client, figure, got_lang)} and [g[3] for g in got] == sorted(g[3] for g in got)
        assert scanned_rows(sinks.lookup_doc(spark, f"{tmp_path}/docs", client, figure, lang)) < 200
    assert scanned_rows(sinks.lookup_doc(spark, f"{tmp_path}/docs", 10_000, "fig1")) < 200 and sinks.lookup_doc(spark, f"{tmp_path}/docs", 10_000, "fig1").count() == 0


def test_drops_are_counted_in_the_pass_and_an_empty_result_is_an_error(spark):
    rows = [("1", "2024-01-05", "5", 1), ("x", "2024-01-05", "5", 1), (None, None, None, 1), ("2", "45000", "5", 1)]
    raw = spark.createDataFrame(rows, "id string, created_at string, totalPrice string, client_id long")
    drops = cleaning.Drops()
    assert cleaning.clean_invoices(raw, drops).collect()[0].created_at == dt.datetime(2024, 1, 5)
    assert drops.counts("sale_invoices") == {"rows": 4, "no_invoice_id": 2, "no_date": 1, "kept": 1}
    drops.check("sale_invoices")
    bad = cleaning.Drops()
    cleaning.clean_invoices(raw.filter("id = '2'"), bad).collect()
    with pytest.raises(ValueError):
        bad.check("sale_invoices")
    none = cleaning.Drops()
    cleaning.clean_invoices(raw.limit(0), none).collect()
    none.check("sale_invoices")


def test_staging_without_a_valid_date_is_an_error(spark):
    from conftest import AS_OF_185, raw_tables
    from stocklens.plans.retail import Retail
    raw = raw_tables(spark, [("1", "a", "1", "2", "5", 7)], [("1", "never", "9", 7)], [(1, "1", "1", "3", "9", "1", None)])
    with pytest.raises(ValueError):
        Retail(raw, AS_OF_185).stage()


def test_nested_files_flatten_like_the_dictionaries(spark):
    from stocklens.operators import i18n
    folder = i18n.LOCALE_DIR
    files = [(la, open(f"{folder}/{la}.json", encoding="utf-8").read()) for la in ("en", "ar")]
    files += [("bad", "{not json"), ("list", "[1, 2]"), ("none", None), ("deep", '{"a":{"b":{"c":{"d":1}}},"e":null,"f":{}}')]
    df = spark.createDataFrame(files, "lang string, text string").withColumn("key", F.lit("clash"))
    got = {}
    for r in flatten_json(df).collect():
        got.setdefault(r.lang, {})[r.key] = r.text
    assert got["deep"] == {"a.b.c.d": "1", "e": None} and set(got) == {"en", "ar", "deep"}
    for la in ("en", "ar"):
        same = lambda d: {k: json.loads(v) if v.startswith("[") else v for k, v in d.items()}  # noqa: E731  lists are JSON text
        assert same(got[la]) == same(load_dictionaries()[la])
