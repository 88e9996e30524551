"""Headline-query timings. Prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through the ``noop`` sink (full execution, no
collect to the driver); every query runs once before timing (JIT, file listing, Python workers).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from stocklens.session import build_session
    shuffle = int(os.environ.get("BENCH_SHUFFLE", cpus))   # one partition per core locally
    spark = build_session(f"local[{cpus}]", shuffle_partitions=shuffle, app_name="stocklens-bench")

    from stocklens.operators.docs import records
    from stocklens.plans.retail import Retail

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def timed(fn) -> float:
        t = time.perf_counter()
        fn()
        return round(time.perf_counter() - t, 3)

    def features(name: str) -> None:
        rf = Retail.from_tpch(spark, sf_dir)
        run(getattr(rf, name))
        rf.unpersist()

    def all_charts() -> None:
        # every chart table (figures 1-17, both languages, actual rows of 11/12) as one
        # union written by one job, over a persisted product_flow
        rc = Retail.from_tpch(spark, sf_dir).persist_core()
        run(records(rc, forecasts=False))
        rc.unpersist()

    def forecast() -> None:
        rf = Retail.from_tpch(spark, sf_dir)
        run(rf.forecast_daily)
        rf.unpersist()

    headline = {
        "product_flow": lambda: run(Retail.from_tpch(spark, sf_dir).product_flow),
        "pareto": lambda: run(Retail.from_tpch(spark, sf_dir).pareto),
        "daily_features": lambda: features("daily_features"),
        "monthly_features": lambda: features("monthly_features"),
        "all_charts": all_charts,
        "forecast_daily": forecast,
    }
    # warm-up: every query once (JIT, file listing, Python workers); not reported
    for fn in headline.values():
        fn()
    times = {name: timed(fn) for name, fn in headline.items()}

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus, "shuffle_partitions": shuffle, "runs": "warm (each query run once before timing)",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
