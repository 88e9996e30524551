"""What must hold for tables that grow."""

import pytest

from stocklens.operators.i18n import flatten_json
from stocklens.plans.queries import QUERIES
from tests.test_plans import SF, plan


@pytest.mark.parametrize("name", ["product_flow", "restock"])
def test_growing_tables_are_not_broadcast(spark, name):
    p = plan(QUERIES[name](spark, SF))
    for side in p.split("BroadcastExchange")[1:]:
        scan = next(line for line in side.splitlines() if "FileScan" in line)
        assert "n_nationkey" in scan, scan


def test_nested_documents_beyond_the_recursion_row_limit(spark):
    docs = spark.range(300).selectExpr("id", """concat('{"a":1,"b":{"c":"x","d":{"e":', id, '}}}') AS text""")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "500")
    try:
        rows = flatten_json(docs, keep=("id",)).collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    assert sorted((r["id"], r["key"], r["text"]) for r in rows) == sorted(
        row for i in range(300) for row in ((i, "a", "1"), (i, "b.c", "x"), (i, "b.d.e", str(i))))


@pytest.mark.parametrize("name", ["chart_status", "customer_chart_status", "chart_records"])
def test_charts_read_the_details_once(spark, name):
    df = QUERIES[name](spark, SF)
    assert "l_shipdate" not in plan(df)
    assert any("stocklens-product_flow-" in f for f in df.inputFiles())


def test_guards_write_their_aggregates_one_after_the_other(spark):
    """The last plan holds the product flow's counts and small tables only, so the shuffles of the
    running sums, shares and series need not fit the disks together."""
    df = QUERIES["customer_chart_status"](spark, SF)
    assert "Window" not in plan(df)
    for name in ("clients", "pareto", "shares", "history", "days", "months", "debts", "outstanding"):
        assert any(f"stocklens-{name}-" in f for f in df.inputFiles()), name
    assert not any("stocklens-running-" in f or "stocklens-details-" in f for f in df.inputFiles())


def test_running_sums_write_no_derived_columns(spark, monkeypatch):
    from stocklens.operators import windows
    from stocklens.operators.analytics import pareto
    written, settle = [], windows.settle
    monkeypatch.setattr(windows, "settle", lambda df, name: written.append(df.columns) or settle(df, name))
    pf = spark.createDataFrame([(1, str(i), f"n{i}", float(i), 1.0) for i in range(9)] + [(None, "x", "y", 2.0, 3.0)],
                               "client_id long, product_id string, name string, sales_quantity double, current_stock double")
    whole, counted = pareto(pf), pareto(pf, carry=())
    assert written == [["client_id", "product_id", "name", "sales_quantity", "current_stock", "_blk"],
                       ["client_id", "product_id", "sales_quantity", "_blk"]]
    assert whole.columns == ["client_id", "product_id", "name", "sales_quantity", "current_stock", "rank", "cumulative_percentage"]
    rows = lambda df: sorted(tuple(r) for r in df.select("product_id", "rank", "cumulative_percentage").collect())
    assert rows(whole) == rows(counted) and [r[0] for r in rows(whole)] == ["5", "6", "7", "8"]
