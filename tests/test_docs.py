"""Chart documents (LOC, SNK): golden content, language fallback, write/read round trip."""

import json
import tempfile

from pyspark.sql import functions as F

from stocklens.operators import docs as D
from stocklens.operators.i18n import get_translation
from stocklens.sources import sinks


def test_translation_lookup():
    assert get_translation("EN", "fig1.title") == " Stock vs Sales (Top 20)"
    assert get_translation("fr", "fig1.title", "dflt") == "dflt"
    assert get_translation("en", "no.such.key", "x") == "x"


def test_metadata_threshold_and_fallback():
    m = D.metadata_rows("en", "fig9")
    assert "{threshold}" not in m["title"] and "10" in m["title"]
    assert m["frequency"] == "Weekly"
    assert D.metadata_rows("en", "fig14")["x_axis"]["title"] == "Columns"


def test_golden_docs_roundtrip(spark, golden):
    docs = D.chart_docs(golden).cache()
    en1 = docs.filter("figure = 'fig1' AND lang = 'en'").first()
    data = json.loads(en1["data"])
    assert data[0] == {"Product": "juice B", "Current Stock": 9.99, "Sales": 30.0}
    assert len(data) == 6 and en1["metadata"]["title"] == " Stock vs Sales (Top 20)"
    f2 = json.loads(docs.filter("figure = 'fig2' AND lang = 'en'").first()["data"])
    assert f2["values"] == [3, 3, 0, 0] and set(f2["labels"][:2]) == {"Undersupplied", "Oversupplied"}
    f16 = json.loads(docs.filter("figure = 'fig16' AND lang = 'en'").first()["data"])
    assert len(f16["revenue_data"]) == 6 and abs(sum(x["value"] for x in f16["revenue_data"]) - 2800.8) < 1e-6
    ar = docs.filter("figure = 'fig1' AND lang = 'ar'").first()
    assert ar["metadata"]["title"] != en1["metadata"]["title"]
    assert docs.select("figure").distinct().count() == 16

    path = tempfile.mkdtemp(prefix="stocklens-docs-")
    sinks.write_chart_docs(docs, path)
    back = sinks.read_chart_docs(spark, path)
    one = sinks.read_chart_doc(back, 185, "fig6", "fr").first()   # unknown language -> en
    assert one["lang"] == "en"
    rows = json.loads(one["data"])
    assert [r["percentage_category"] for r in rows] == ["30-40%", "60-70%", "70-80%"]
    weekly = sinks.docs_for_frequency(back, "weekly", "ar")
    assert sorted(r["figure"] for r in weekly.collect()) == ["fig1", "fig4", "fig9"]
    pages = sinks.read_chart_doc(back, 185, "fig7", "ar", merge=False).collect()
    assert [p["page"] for p in pages] == [0] and pages[0]["lang"] == "ar"
    clients = spark.createDataFrame([(185,), (999,)], "client_id long")
    st = {r["client_id"]: (r["figures_found"], r["nothing_found"])
          for r in sinks.bundle_status(back, "quarterly", clients).collect()}
    assert st == {185: (1, False), 999: (0, True)}
    docs.unpersist()


def test_paged_document_reassembles(spark):
    pages = spark.createDataFrame(
        [(1, "fig7", "en", 0, '[{"a":1},{"a":2}]'), (1, "fig7", "en", 1, '[{"a":3}]')],
        "client_id long, figure string, lang string, page int, data string").withColumn("metadata", F.lit(None))
    doc = sinks.read_chart_doc(pages, 1, "fig7", "en", merge=True).first()
    assert json.loads(doc["data"]) == [{"a": 1}, {"a": 2}, {"a": 3}]


def test_golden_records_by_figure(golden):
    """Records of client 185 with the saved documents' keys and values (FIXTURES F2;
    product names are English stand-ins)."""
    docs = D.chart_docs(golden, langs=["en"]).cache()
    data = {r["figure"]: json.loads(r["data"]) for r in docs.collect()}
    assert data["fig3"][0] == {"Product": "apple", "Revenue": 1770.0, "COGS": 1050.0, "Margin": 720.0}
    assert [(r["Efficiency Category"], round(r["Total Stock"], 2), r["Total Sales"]) for r in data["fig5"]] == [
        ("Undersupplied", 29.97, 64.0), ("Balanced", 0.0, 0.0), ("Oversupplied", 29.97, 20.0), ("N/A", 0.0, 0.0)]
    assert data["fig10"][0] == {"Product": "juice A", "Days Since Last Sale": 373, "Stagnancy Period": "> 1 year",
                                "Last Sale": "2024-04-18", "Stock": 9.99, "ID": "321"}
    assert [r["ID"] for r in data["fig10"]] == ["321", "323", "397", "438", "396", "398"]
    assert data["fig13"][0] == {"Product": "juice A", "Quantity Sold": 5.0}
    assert data["fig14"][0] == {"Quantity Sold": 5.0, "Number of Products": 1.0}
    assert data["fig17"] == [{"Supplier (ID)": "100", "Outstanding Amount": 1390.0}]
    assert [r["Current Stock"] for r in data["fig9"]] == [9.99] * 6
    docs.unpersist()
