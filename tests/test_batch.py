"""Lifecycle A end to end from spreadsheet-like CSV sources (SRC-01, SRC-04, SRC-06, SNK-01/02/04)."""

import os
import tempfile

from conftest import AS_OF_185, GOLDEN_185
from stocklens.plans import batch
from stocklens.plans.retail import Retail


def _write_csv(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def test_csv_sources_to_outputs(spark):
    src = tempfile.mkdtemp(prefix="stocklens-src-")
    _write_csv(os.path.join(src, "products.csv"), ["id", "name", "buyPrice", "salePrice", "quantity", "client_id"],
               [(p, n, b, s, st, 185) for p, n, b, s, st, *_ in GOLDEN_185] + [("1", "other client", 1, 2, 3, 7)])
    _write_csv(os.path.join(src, "sale_invoices.csv"), ["id", "created_at", "totalPrice", "client_id"],
               [(k + 1, g[7], g[6], 185) for k, g in enumerate(GOLDEN_185)] + [(99, "45000", 5, 7)])
    _write_csv(os.path.join(src, "sale_invoices_details.csv"),
               ["id", "product_id", "invoice_id", "quantity", "totalPrice", "buyPrice", "created_at"],
               [(k + 1, g[0], k + 1, g[5], g[6], 0, g[7]) for k, g in enumerate(GOLDEN_185)])
    # invoice_deferreds absent -> empty table, no error
    r = Retail.from_source(spark, src, AS_OF_185, client_ids=[185], fmt="csv", pattern="{table}.csv")
    assert r.invoices.count() == 6
    assert r.product_flow.count() == 6 and r.deferreds.count() == 0
    out = tempfile.mkdtemp(prefix="stocklens-out-")
    batch.run(r, out)
    assert os.path.isdir(os.path.join(out, "analytics", "product_flow", "client_id=185"))
    assert spark.read.parquet(os.path.join(out, "analytics", "pareto")).count() == 3
    assert os.path.isdir(os.path.join(out, "docs", "client_id=185", "lang=ar"))
    assert os.path.isdir(os.path.join(out, "forecast_daily_csv"))
    # staged copies live in the checkpoint folder and feed the outputs
    assert "stocklens-stage-" in r.staged_at and r.details.count() == 6
