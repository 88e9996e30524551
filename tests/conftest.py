import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from stocklens.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="stocklens-tests")
    yield s
    s.stop()


def raw_tables(spark, products, invoices, details, deferreds=None):
    """Raw retail tables with the source column names (all text, like a spreadsheet)."""
    p = spark.createDataFrame(products, "id string, name string, buyPrice string, salePrice string, "
                                        "quantity string, client_id long")
    i = spark.createDataFrame(invoices, "id string, created_at string, totalPrice string, client_id long")
    d = spark.createDataFrame(details, "id long, product_id string, invoice_id string, quantity string, "
                                       "totalPrice string, buyPrice string, created_at string")
    if deferreds is None:
        from stocklens.sources.tables import empty_like
        f = empty_like(spark, "invoice_deferreds")
    else:
        f = spark.createDataFrame(deferreds, "invoice_type string, status string, amount string, "
                                             "paid_amount string, user_id string, client_id long")
    return {"products": p, "sale_invoices": i, "sale_invoices_details": d, "invoice_deferreds": f}


# Golden client 185 (FIXTURES F2): product, name, buy, sale, stock, sold, amount, last sale
GOLDEN_185 = [
    ("321", "juice A", 5, 10, 9.99, 5, 107.50, "2024-04-18 10:00:00"),
    ("323", "juice B", 6, 10, 9.99, 30, 645.00, "2024-04-18 10:00:00"),
    ("396", "orange", 5, 7, 9.99, 13, 104.65, "2024-05-09 10:00:00"),
    ("397", "juice C", 4, 9, 9.99, 7, 72.45, "2024-05-01 10:00:00"),
    ("398", "strawberry", 8, 11, 9.99, 8, 101.20, "2024-05-09 10:00:00"),
    ("438", "apple", 50, 70, 9.99, 21, 1770.00, "2024-05-01 10:00:00"),
]
AS_OF_185 = dt.date(2025, 4, 27)


@pytest.fixture(scope="session")
def golden(spark):
    from stocklens.plans.retail import Retail
    prods = [(pid, name, str(b), str(s), str(st), 185) for pid, name, b, s, st, *_ in GOLDEN_185]
    invs = [(str(k + 1), last, str(amt), 185) for k, (_, _, _, _, _, _, amt, last) in enumerate(GOLDEN_185)]
    dets = [(k + 1, pid, str(k + 1), str(sold), str(amt), "0", last)
            for k, (pid, _, _, _, _, sold, amt, last) in enumerate(GOLDEN_185)]
    dfr = [("Stocks\\Models\\BuyInvoice", "0", "1390", "0", "100", 185),
           ("Stocks\\Models\\BuyInvoice", "1", "500", "0", "101", 185),
           ("Stocks\\Models\\SaleInvoice", "0", "700", "0", "102", 185)]
    return Retail(raw_tables(spark, prods, invs, dets, dfr), AS_OF_185)
