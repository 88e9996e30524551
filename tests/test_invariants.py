"""Invariants on the driver's tables: no gaps, shares add up, bounds
ordered, results independent of the partition count."""

from pyspark.sql import functions as F

from stocklens.plans.retail import Retail

SF = "/root/testdata/sf0.001"


def test_day_grid_has_no_gap(spark):
    d = Retail.from_tpch(spark, SF).daily_sales_actual
    rows = d.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"),
                                      (F.datediff(F.max("date"), F.min("date")) + 1).alias("span")).collect()
    assert rows and all(r["n"] == r["span"] for r in rows)


def test_shares_add_up_to_total(spark):
    r = Retail.from_tpch(spark, SF)
    shares = r.revenue_share.groupBy("client_id").agg(F.sum("value").alias("s"))
    totals = r.product_flow.groupBy("client_id").agg(F.sum("sales_amount").alias("t"))
    for row in shares.join(totals, "client_id").collect():
        assert abs(row["s"] - row["t"]) <= 1e-6 * row["t"]


def test_forecast_bounds_ordered(spark):
    fc = Retail.from_tpch(spark, SF).forecast_daily.collect()
    assert fc and all(0 <= r["lower_ci"] <= r["forecast"] <= r["upper_ci"] + 1e-9 for r in fc)


def test_independent_of_partition_count(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            r = Retail.from_tpch(spark, SF)
            out.append(sorted(r.product_flow.select("client_id", "product_id", "sales_amount", "net_profit")
                              .collect()))
            out.append(sorted(r.pareto.select("product_id", "cumulative_percentage").collect()))
        assert out[0] == out[2] and out[1] == out[3]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
