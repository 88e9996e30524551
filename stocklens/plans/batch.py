"""Query lifecycle A as one Spark application: read -> clean -> analyse -> forecast ->
write. Tables that several outputs read are written once and read back.

    python -m stocklens.plans.batch --src DIR --out DIR --as-of 2025-04-27 [--format parquet|csv]
    python -m stocklens.plans.batch --tpch /root/testdata/sf0.01 --out DIR
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from stocklens.operators import charts
from stocklens.operators.docs import chart_docs
from stocklens.plans.retail import TPCH_AS_OF, Retail
from stocklens.sources import sinks


def analytics_tables(r: Retail) -> dict:
    """SNK-01 content: every analysis table and both forecasts."""
    pf = r.product_flow
    return {
        "product_flow": pf, "pareto": r.pareto, "stagnant": r.stagnant, "outstanding": r.outstanding,
        "revenue_share": r.revenue_share, "profit_share": r.profit_share,
        "monthly_avg_invoice": r.monthly_avg_invoice, "daily_sales_actual": r.daily_sales_actual,
        "daily_profit": r.daily_profit, "efficiency_counts": charts.efficiency_counts(pf),
        "daily_features": r.daily_features, "monthly_features": r.monthly_features,
        "forecast_daily": r.forecast_daily, "forecast_monthly": r.forecast_monthly,
        "chart_status": r.chart_status,
    }


def run(r: Retail, out: str, mode: str = "overwrite", stage: bool = True) -> None:
    """Stage the cleaned and the shared tables once (one pass over the line items), then write
    everything from them."""
    if stage:
        r.stage()
    else:
        r.persist_core()
    try:
        sinks.write_analytics(analytics_tables(r), f"{out}/analytics", mode)
        sinks.write_chart_docs(chart_docs(r), f"{out}/docs", mode)
        sinks.write_forecast_csv(r.forecast_daily, f"{out}/forecast_daily_csv", mode)
    finally:
        r.unpersist()


def main(argv=None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--src")
    ap.add_argument("--tpch")
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--pattern", default="{table}", help="path of each table under --src, e.g. '{table}.csv'")
    ap.add_argument("--as-of")
    ap.add_argument("--clients", help="comma-separated client ids (tenant filter pushed to the scan)")
    ap.add_argument("--out", required=True)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("stocklens-batch").getOrCreate()
    from stocklens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    as_of = dt.date.fromisoformat(a.as_of) if a.as_of else None
    if a.tpch:
        r = Retail.from_tpch(spark, a.tpch, as_of or TPCH_AS_OF)
    else:
        clients = [int(x) for x in a.clients.split(",")] if a.clients else None
        r = Retail.from_source(spark, a.src, as_of or dt.date.today(), clients, a.format, pattern=a.pattern)
    run(r, a.out)


if __name__ == "__main__":
    main()
