"""Series fixtures (FIXTURES F5): gap fill, lags, monthly gate, forecasts, chart 11 window."""

import datetime as dt
import math

from pyspark.sql import functions as F

from stocklens.operators import features, forecast, serving
from stocklens.operators.analytics import fill_grid


def _daily(spark, days, client=1, start=dt.date(2024, 1, 1), value=lambda i: 10.0):
    rows = [(client, start + dt.timedelta(days=d), float(value(d))) for d in days]
    return spark.createDataFrame(rows, "client_id long, sale_date date, daily_sales double")


def test_gap_fill_and_lags(spark):
    s = _daily(spark, [0, 1, 4], value=lambda i: i + 1)
    filled = fill_grid(s, "sale_date", ["daily_sales"], "day")
    lagged = features.add_lags(filled, "daily_sales", [1, 2, 3, 7], "sales_lag_", "sale_date").orderBy("sale_date")
    rows = lagged.collect()
    assert [r["daily_sales"] for r in rows] == [1.0, 2.0, 0.0, 0.0, 5.0]
    assert rows[-1]["sales_lag_1"] == 0.0 and rows[-1]["sales_lag_3"] == 2.0
    assert all(r["sales_lag_7"] is None for r in rows)


def _monthly(spark, n, client=1):
    rows = []
    for i in range(n):
        y, m = 2020 + i // 12, i % 12 + 1
        rows.append((client, dt.date(y, m, 1), 100 + 2 * i + 10 * math.sin(math.pi * i / 6)))
    return spark.createDataFrame(rows, "client_id long, month_start date, avg_invoice_value double")


def test_monthly_gate_and_forecast(spark):
    ts = _monthly(spark, 36).unionByName(_monthly(spark, 35, client=2))
    feats = features.monthly_features(ts)
    counts = {r["client_id"]: r["count"] for r in feats.groupBy("client_id").count().collect()}
    assert counts == {1: 24, 2: 23}
    fc = forecast.forecast_monthly(feats).collect()
    assert {r["client_id"] for r in fc} == {1}            # 35 months: no forecast (D8)
    assert [r["date"] for r in sorted(fc, key=lambda r: r["date"])][:2] == ["2023-01", "2023-02"]
    for r in fc:
        assert 0 <= r["lower_ci"] <= r["forecast"] <= r["upper_ci"]


def _daily_features(spark, n, value):
    s = _daily(spark, range(n), value=value).withColumn("transaction_count", F.lit(1.0)) \
        .withColumn("total_items", F.lit(1.0))
    cal = features.calendar(s, "sale_date", None)
    return features.finalize_daily(features.add_lags(cal, "daily_sales", [1, 7], "sales_lag_", "sale_date"), [1, 7])


def test_daily_gate_constant_series(spark):
    short = _daily_features(spark, 359, lambda i: 5.0)
    assert forecast.forecast_daily(short).count() == 0
    const = _daily_features(spark, 400, lambda i: 5.0)
    fc = forecast.forecast_daily(const).collect()
    assert len(fc) == 14
    assert all(abs(r["forecast"] - 5.0) < 1e-6 for r in fc)


def test_seasonal_naive_exact(spark):
    s = _daily(spark, range(28), value=lambda i: float(i % 7))
    fc = forecast.seasonal_naive(s, "sale_date", "daily_sales", 7, 14).orderBy("horizon").collect()
    assert [r["forecast"] for r in fc] == [float(h % 7) for h in range(28, 42)]
    assert all(r["lower_ci"] == r["forecast"] == r["upper_ci"] for r in fc)   # perfect season: sigma 0


def test_chart11_window(spark):
    actual = _daily(spark, range(200)).withColumnRenamed("sale_date", "date").withColumnRenamed("daily_sales", "value")
    last = dt.date(2024, 1, 1) + dt.timedelta(days=199)
    fc = spark.createDataFrame([(1, last + dt.timedelta(days=h), 1.0, 0.5, 1.5) for h in range(1, 15)],
                               "client_id long, date date, forecast double, lower_ci double, upper_ci double")
    rows = serving.recent_actuals(serving.fig11_rows(actual, fc))
    got = {r["type"]: r["count"] for r in rows.groupBy("type").count().collect()}
    assert got == {"actual": 90, "forecast": 14}
    bridge = serving.forecast_bridge(serving.fig11_rows(actual, fc)).filter("segment = 'bridge'").collect()
    assert len(bridge) == 1 and bridge[0]["date"] == last


def test_holidays_rule_and_table(spark):
    s = _daily(spark, range(0, 60), start=dt.date(2023, 2, 1))
    rule = features.HolidayRule(2022, 2025)
    flagged = features.calendar(s, "sale_date", rule).filter("is_holiday = 1").collect()
    assert [r["sale_date"] for r in flagged] == [dt.date(2023, 2, 22)]
    table = spark.createDataFrame([(dt.date(2023, 3, 1), "user holiday")], "holiday_date date, name string")
    flagged = features.calendar(s, "sale_date", table).filter("is_holiday = 1").collect()
    assert [r["sale_date"] for r in flagged] == [dt.date(2023, 3, 1)]
    # outside the contract's year window nothing is flagged
    assert features.calendar(s, "sale_date", features.HolidayRule(2024, 2026)).filter("is_holiday = 1").count() == 0
    assert features.holiday_table(spark, 2022, 2023).count() == 4


def test_calendar_columns(spark):
    s = _daily(spark, [0], start=dt.date(2024, 3, 1))   # a Friday, first of the month
    r = features.calendar(s, "sale_date", None).first()
    assert (r["day_of_week"], r["is_weekend"], r["is_month_start"], r["is_month_end"], r["week_of_year"],
            r["quarter"], r["day_of_year"]) == (4, 1, 1, 0, 9, 1, 61)
