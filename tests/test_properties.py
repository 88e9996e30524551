"""Property tests against brute force on small fixtures (hypothesis)."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.functions import parse_mixed_date, round_half_even
from stocklens.operators.analytics import pareto

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _brute_pareto(pdf: pd.DataFrame) -> set:
    out = set()
    for cid, g in pdf[pdf.sales_quantity > 0].groupby("client_id"):
        g = g.sort_values(["sales_quantity", "product_id"], ascending=[False, True])
        cum = g.sales_quantity.cumsum() / g.sales_quantity.sum() * 100
        for (pid, c) in zip(g.product_id, cum):
            if c <= 80:
                out.add((cid, pid, round(c, 9)))
    return out


@SLOW
@given(st.lists(st.integers(min_value=0, max_value=40), min_size=30, max_size=200), st.integers(0, 2**16))
def test_pareto_matches_brute_force(spark, qty, seed):
    rng = np.random.default_rng(seed)
    # one hot client holds about 80 % of the products
    clients = np.where(rng.random(len(qty)) < 0.8, 1, rng.integers(2, 5, len(qty)))
    pdf = pd.DataFrame({"client_id": clients.astype("int64"),
                        "product_id": [f"p{i:04d}" for i in range(len(qty))],
                        "name": "x", "sales_quantity": np.array(qty, dtype=float), "current_stock": 1.0})
    df = spark.createDataFrame(pdf)
    got = {(r["client_id"], r["product_id"], round(r["cumulative_percentage"], 9)) for r in pareto(df).collect()}
    assert got == _brute_pareto(pdf)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=60))
def test_round_half_even_is_numpy_round(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    assert got == [float(np.round(x, 2)) for x in xs]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dates(min_value=dt.date(1950, 1, 1), max_value=dt.date(2090, 12, 31)), min_size=1, max_size=30))
def test_text_dates_round_trip(spark, days):
    rows = []
    for d in days:
        rows += [(d.isoformat(), d), (d.strftime("%Y%m%d"), d), (d.strftime("%m/%d/%Y"), d),
                 (d.strftime("%b ") + str(d.day) + d.strftime(" %Y"), d)]
        # dd/MM/yyyy is read month-first when the day could be a month (the contract's order)
        alt = dt.date(d.year, d.day, d.month) if d.day <= 12 else d
        rows.append((d.strftime("%d/%m/%Y"), alt))
    df = spark.createDataFrame(rows, "s string, want date")
    bad = df.filter(F.to_date(parse_mixed_date("s", T.StringType())) != F.col("want")).collect()
    assert bad == []
