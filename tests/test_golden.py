"""Client 185 golden figures (FIXTURES F2) and the Pareto edge goldens."""

from pyspark.sql import functions as F

from conftest import raw_tables
from stocklens.operators import charts


def by_id(df, *cols):
    return {r["product_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_efficiency_labels_and_totals(golden):
    eff = by_id(golden.product_flow, "efficiency")
    assert {k for k, v in eff.items() if v[0] == "Undersupplied"} == {"323", "396", "438"}
    assert {k for k, v in eff.items() if v[0] == "Oversupplied"} == {"321", "397", "398"}
    tot = {r["efficiency"]: (round(r["total_stock"], 2), r["total_sales"])
           for r in charts.efficiency_totals(golden.product_flow).collect()}
    assert tot == {"Undersupplied": (29.97, 64.0), "Oversupplied": (29.97, 20.0),
                   "Balanced": (0.0, 0.0), "N/A": (0.0, 0.0)}


def test_pareto_bands(golden):
    rows = charts.pareto_bands(golden.pareto).orderBy("rank").collect()
    assert [(r["name"], r["cumulative_pct"], r["percentage_category"]) for r in rows] == [
        ("juice B", 35.71, "30-40%"), ("apple", 60.71, "60-70%"), ("orange", 76.19, "70-80%")]


def test_cogs_margin(golden):
    got = {r["name"]: (round(r["cogs"], 2), round(r["margin"], 2))
           for r in charts.revenue_cogs(golden.product_flow).collect()}
    assert got == {"apple": (1050, 720), "juice B": (180, 465), "juice A": (25, 82.5),
                   "orange": (65, 39.65), "strawberry": (64, 37.2), "juice C": (28, 44.45)}


def test_days_since_and_stagnant(golden):
    days = by_id(golden.product_flow, "days_since_last_sale")
    assert [days[p][0] for p in ["321", "323", "396", "397", "398", "438"]] == [373, 373, 352, 360, 352, 360]
    lab = by_id(golden.stagnant, "days_category")
    assert lab["321"] == (">1 year",) and lab["323"] == (">1 year",)
    assert {lab[p][0] for p in ["396", "397", "398", "438"]} == {"6-12 months"}


def test_restock_histogram_debt(golden):
    assert charts.restock(golden.product_flow).count() == 6
    h = [(r["sales_quantity"], r["product_count"])
         for r in charts.sales_histogram(golden.product_flow).orderBy("rank").collect()]
    assert h == [(5.0, 1), (7.0, 1), (8.0, 1), (13.0, 1), (21.0, 1), (30.0, 1)]
    debt = [(r["user_id"], r["outstanding_amount"]) for r in golden.outstanding.collect()]
    assert debt == [("100", 1390.0)]


def _pf_fixture(spark, sold):
    prods = [(str(i), f"p{i}", "1", "2", "5", 1) for i in range(len(sold))]
    invs = [(str(i + 1), "2024-01-01", "1", 1) for i in range(len(sold))]
    dets = [(i, str(i), str(i + 1), str(q), "1", "0", "2024-01-01") for i, q in enumerate(sold)]
    from stocklens.plans.retail import Retail
    return Retail(raw_tables(spark, prods, invs, dets), "2024-06-01")


def test_pareto_edges(spark):
    # two products of 70: one row at exactly 50 -> band 40-50%
    r = _pf_fixture(spark, [70, 70])
    rows = charts.pareto_bands(r.pareto).collect()
    assert [(r_["cumulative_pct"], r_["percentage_category"]) for r_ in rows] == [(50.0, "40-50%")]
    # best seller above 80 %: empty (D2)
    assert _pf_fixture(spark, [90, 5, 5]).pareto.count() == 0


def test_pareto_does_not_depend_on_the_number_of_blocks(spark):
    sold = [(i * 7919) % 97 + 1 for i in range(300)]
    cols = ["product_id", "rank", "cumulative_percentage"]
    got = []
    for n in ("2", "7"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got.append(sorted(_pf_fixture(spark, sold).pareto.select(cols).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] and len(got[0]) > 10


def test_shares_add_up(golden):
    rows = golden.revenue_share.collect()
    total = golden.product_flow.agg(F.sum("sales_amount")).first()[0]
    assert abs(sum(r["value"] for r in rows) - total) < 1e-6
    assert all(r["name"] != "Other" for r in rows)  # only 6 products: no Other slice


def test_chart_status_golden_and_empty_client(spark, golden):
    from stocklens.operators import status as S
    st = {r["figure"]: (r["ok"], r["code"], r["note"]) for r in golden.chart_status.collect()}
    assert st["fig1"][0] and st["fig6"][0] and st["fig17"][0]
    assert st["fig13"] == (False, "insufficient_product_count", None)      # 6 sold products <= 10
    assert st["fig14"] == (True, None, "low_product_variety")
    assert st["fig11"][2] == "forecast_unavailable_data"                  # 1 day of history
    # a client with invoices but nothing else
    stats = spark.createDataFrame([(7,)], "client_id long")
    for c in S.STAT_COLUMNS:
        from pyspark.sql import functions as F
        stats = stats.withColumn(c, F.lit(0).cast("double"))
    empty = {r["figure"]: r["code"] for r in S.chart_status(stats).collect()}
    assert empty["fig2"] == "no_product_flow" and empty["fig17"] == "no_deferred_data"
    assert empty["fig11"] == "no_details_data" and empty["fig12"] == "no_ts_data"
