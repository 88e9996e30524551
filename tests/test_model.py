"""The trend-and-season forecast against numpy on generated series."""

import datetime as dt

import numpy as np

from stocklens.operators import forecast as fc


def test_trend_and_season_equal_least_squares(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for client in (1, 2):
        n, m = 60 + client, 7
        y = np.round(50 + client * np.arange(n) + 10 * np.sin(np.arange(n) * 2 * np.pi / m) + rng.normal(0, 3, n), 2)
        t = np.arange(n)
        b, a = np.polyfit(t, y, 1)
        r = y - a - b * t
        s = np.array([r[t % m == k].mean() for k in range(m)])
        sigma = np.sqrt(((r - s[t % m]) ** 2).sum() / (n - m - 1))
        ahead = n - 1 + np.arange(1, 15)
        f = a + b * ahead + s[ahead % m]
        want[client] = (f, f - fc.Z95 * sigma * np.sqrt(1 + 1 / n))
        rows += [(client, dt.date(2024, 1, 1) + dt.timedelta(days=int(i)), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "client_id long, sale_date date, daily_sales double")
    got = fc.trend_seasonal(df, "sale_date", "daily_sales", 7, 14, 14).orderBy("client_id", "date").collect()
    for client, (f, lower) in want.items():
        mine = [r for r in got if r["client_id"] == client]
        assert np.allclose([r["forecast"] for r in mine], np.maximum(f, 0), rtol=1e-6)
        assert np.allclose([r["lower_ci"] for r in mine], np.maximum(lower, 0), rtol=1e-4)


def test_pure_season_is_recovered(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7 + 1)) for i in range(70)]
    df = spark.createDataFrame(rows, "client_id long, sale_date date, daily_sales double")
    got = fc.trend_seasonal(df, "sale_date", "daily_sales", 7, 7, 14).orderBy("date").collect()
    # the line is fitted before the season, so it keeps a little of the season's tilt
    assert np.allclose([r["forecast"] for r in got], [1, 2, 3, 4, 5, 6, 7], atol=0.5)
    assert all(r["lower_ci"] <= r["forecast"] <= r["upper_ci"] and r["upper_ci"] - r["lower_ci"] < 2 for r in got)


def test_infinite_values_give_no_rows_and_large_ones_do(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1e15 if i == 5 else 1.0) for i in range(70)]
    rows += [(2, d, float("inf") if v > 1 else v) for _, d, v in rows] + [(3, d, 1.0) for _, d, _ in rows]
    df = spark.createDataFrame(rows, "client_id long, sale_date date, daily_sales double")
    assert {r["client_id"] for r in fc.trend_seasonal(df, "sale_date", "daily_sales", 7, 7, 14).collect()} == {1, 3}


def _least_squares(rows, future, names, sets):
    """Best set by corrected AIC with numpy's least squares: (model, forecasts, lower bounds)."""
    y = np.array([r[0] for r in rows])
    n, best = len(y), None
    for order, name in enumerate(names):
        x = np.array([[r[1][i] for i in sets[name]] for r in rows])
        mean = x.mean(axis=0)
        xc = x - mean
        scale = np.sqrt((xc ** 2).sum(axis=0))
        keep = []
        for k in range(x.shape[1]):                       # columns that the ones before do not explain
            if scale[k] > 0:
                col, left = xc[:, k] / scale[k], xc[:, keep] / scale[keep]
                rest = col - left @ np.linalg.lstsq(left, col, rcond=None)[0] if keep else col
                if (rest ** 2).sum() > 1e-9:
                    keep.append(k)
        beta = np.linalg.lstsq(xc[:, keep], y - y.mean(), rcond=None)[0]
        rss, p = ((y - y.mean() - xc[:, keep] @ beta) ** 2).sum(), len(keep)
        if n - p - 3 < 10:
            continue
        aic = n * np.log(max(rss / n, 1e-9)) + 2 * (p + 2) + 2 * (p + 2) * (p + 3) / (n - p - 3)
        if best is None or aic < best[0]:
            f = np.array([[r[i] for i in sets[name]] for r in future])[:, keep] - mean[keep]
            inverse = np.linalg.inv(xc[:, keep].T @ xc[:, keep])
            spread = 1 + 1 / n + np.einsum("ij,jk,ik->i", f, inverse, f)
            best = aic, name, y.mean() + f @ beta, fc.Z95 * np.sqrt(rss / (n - p - 1) * spread)
    return best[1:]


def test_regression_equals_numpy_and_picks_by_aic(spark):
    rng = np.random.default_rng(11)
    rows, future, want, models = [], [], {}, set()
    start = dt.date(2024, 1, 1)
    names, sets = fc._candidates(7, {"calendar": ["a", "b"], "lags": ["c"]})
    for client in range(1, 7):
        n = 90 + client
        t = np.arange(n + 14)
        a, b, c = rng.normal(0, 1, n + 14), t * 2.0 + 1, rng.normal(5, 2, n + 14)     # b repeats the trend
        y = 50 + 0.3 * t + (4 * np.sin(t * 2 * np.pi / 7) if client > 1 else 0) + (6 * a if client in (3, 5) else 0) + (3 * c if client > 3 else 0)
        y = y + rng.normal(0, 1, n + 14)
        z = [[float(k), *[float(k % 7 == j) for j in range(1, 7)], a[k], b[k], c[k]] for k in t]
        want[client] = _least_squares([(y[k], z[k]) for k in range(n)], z[n:], names, sets)
        models.add(want[client][0])
        for k in t:
            row = (client, start + dt.timedelta(days=int(k)), float(a[k]), float(b[k]), float(c[k]))
            (rows if k < n else future).append((*row, float(y[k])) if k < n else row)
    cols = "client_id long, sale_date date, a double, b double, c double"
    rows += [(99, start + dt.timedelta(days=i), 1.0, 1.0, 1.0, float("inf") if i == 3 else 1.0) for i in range(60)]
    future += [(99, start + dt.timedelta(days=60), 1.0, 1.0, 1.0)]
    got = fc.regression(spark.createDataFrame(rows, cols + ", daily_sales double"), spark.createDataFrame(future, cols), "sale_date", "daily_sales",
                        {"calendar": ["a", "b"], "lags": ["c"]}, 7, 14).orderBy("client_id", "date").collect()
    assert len(models) > 2 and {r.client_id for r in got} == set(want)
    for client, (model, f, half) in want.items():
        mine = [r for r in got if r.client_id == client]
        assert {r.model for r in mine} == {model} and len(mine) == 14
        assert np.allclose([r.forecast for r in mine], f, rtol=1e-7)
        assert np.allclose([r.upper_ci for r in mine], f + half, rtol=1e-7)


def test_regressors_with_missing_and_infinite_values_count_as_zero(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if i < 5 else float("inf") if i == 6 else float(i * i % 13), 7, float(i % 7 + i % 3)) for i in range(80)]
    df = spark.createDataFrame(rows, "client_id long, sale_date date, a double, transaction_count int, daily_sales double")
    future = spark.createDataFrame([(1, dt.date(2024, 3, 21), None)], "client_id long, sale_date date, a double")
    got = fc.regression(df, future, "sale_date", "daily_sales", {"other": ["a"]}, 7, 14).collect()
    assert len(got) == 1 and 0 <= got[0].lower_ci <= got[0].forecast <= got[0].upper_ci
