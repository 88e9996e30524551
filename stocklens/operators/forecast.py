"""FCS-01..07: forecast every client's series with 95 % bounds in one Spark job.

* ``forecastable``: the contract's gates (daily >= 360 rows; monthly >= 12 raw months
  and >= 24 rows after lags, so 36 months in effect).
* ``seasonal_naive``: value m steps back, bounds from seasonal differences. Pure
  DataFrame code; the exact baseline every model is checked against.
* ``regression``: least squares on trend, season and the feature table's regressors; sets of
  regressors compete by AIC.
* ``trend_seasonal``: a per-client trend line plus seasonal means with residual bounds,
  in plain DataFrame code (all clients in one job). It stands in for the contract's
  SARIMAX fits; gates, horizons, clipping and shapes follow the contract.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stocklens import params
from stocklens.functions import exact_squares, exact_sum
from stocklens.functions.arrays import add, add_outer, dot, let, subtract, sweep, zeros
from stocklens.operators import features as fe
from stocklens.operators.cleaning import clean_regressors

Z95 = 1.959963984540054  # two-sided 95 % normal quantile

FORECAST_SCHEMA = "client_id long, date date, forecast double, lower_ci double, upper_ci double"


# --- gates ----------------------------------------------------------------------

def forecastable(series: DataFrame, min_obs: int, keys: Sequence[str] = ("client_id",)) -> DataFrame:
    """FCS-01: keep series with at least ``min_obs`` rows (a per-client count joined back)."""
    n = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return series.join(n.filter(F.col("_n") >= min_obs), list(keys), "left_semi")


def clip_bounds(df: DataFrame) -> DataFrame:
    """FCS-04: negatives to 0; when lower was clipped, upper = max(lower, upper)."""
    clipped = F.col("lower_ci") < 0
    return df.withColumns({
        "forecast": F.greatest(F.col("forecast"), F.lit(0.0)),
        "upper_ci": F.when(clipped, F.greatest(F.lit(0.0), F.col("upper_ci"))).otherwise(F.col("upper_ci")),
        "lower_ci": F.greatest(F.col("lower_ci"), F.lit(0.0))})


# --- seasonal naive (FCS-07) -------------------------------------------------------

def _ahead(step: str):
    """Date of horizon ``h`` after ``last``."""
    h = F.col("h").cast("int")
    return F.date_add("last", h) if step == "day" else F.add_months("last", h)


def seasonal_naive(series: DataFrame, date_col: str, value_col: str, m: int, horizon: int,
                   step: str = "day") -> DataFrame:
    """y(T+h) = y(T+h-m*ceil(h/m)); sigma^2 = mean squared seasonal difference (an order-free
    sum); bounds +-1.96 sigma sqrt(ceil(h/m)). Needs >= 2m rows per client. A client with an
    infinite or missing value has no rows. One pass: the series' window and one aggregate,
    which keeps the last m values."""
    y, by_date = F.col(value_col).cast("double"), Window.partitionBy("client_id").orderBy(date_col)
    from_end = F.row_number().over(Window.partitionBy("client_id").orderBy(F.col(date_col).desc()))
    s = series.select("client_id", F.col(date_col).alias("d"), y.alias("y"), (y - F.lag(y, m).over(by_date)).alias("diff"), from_end.alias("rn"))
    c = (s.groupBy("client_id").agg(
            F.count(F.lit(1)).alias("n"), F.count("diff").alias("k"), F.max("d").alias("last"), exact_squares("diff").alias("ss"),
            F.map_from_entries(F.collect_list(F.when(F.col("rn") <= m, F.struct("rn", "y")))).alias("tail"))
          .filter((F.col("n") >= max(2 * m, 10)) & (F.col("k") == F.col("n") - m) & (F.col("ss") < F.lit(float("inf")))))
    h = c.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    half = F.lit(Z95) * F.sqrt(F.col("ss") / F.col("k")) * F.sqrt(F.ceil(F.col("h") / F.lit(m)))
    value = F.element_at("tail", (F.lit(m) - (F.col("h") - 1) % m).cast("int"))
    return clip_bounds(h.select("client_id", _ahead(step).alias("date"), F.col("h").cast("int").alias("horizon"), value.alias("forecast"),
                                (value - half).alias("lower_ci"), (value + half).alias("upper_ci")))


# --- trend and season (FCS-02..06) ------------------------------------------------

def trend_seasonal(series: DataFrame, date_col: str, value_col: str, m: int, horizon: int,
                   min_obs: int, step: str = "day") -> DataFrame:
    """Least-squares line plus the mean deviation from it in each of the m seasons, for every
    client at once. With t = 0 .. n-1 along the gap-free grid:

        y(t) = a + b t + s(t mod m) + e,   bounds: forecast +- 1.96 sigma sqrt(1 + 1/n),

    sigma^2 = sum e^2 / (n - m - 1). One pass: order-free sums of y, t, ty, tt and yy per client
    and season give line, seasons and residuals, so the series is read once and its window's
    partitioning serves both aggregates. Series below ``min_obs`` (or 2m, or 10) rows, or with
    an infinite or missing value, get no rows."""
    by_date = Window.partitionBy("client_id").orderBy(date_col)
    s = series.select("client_id", F.col(date_col).alias("d"), F.col(value_col).cast("double").alias("y"),
                      (F.row_number().over(by_date) - 1).cast("long").alias("t")).withColumn("k", (F.col("t") % m).cast("int"))
    y, t = F.col("y"), F.col("t")
    season = s.groupBy("client_id", "k").agg(
        F.count(F.lit(1)).alias("c"), F.count("y").alias("held"), F.max("d").alias("last"), exact_sum(y).alias("y"), exact_squares(y).alias("yy"),
        exact_sum(y * t).alias("ty"), F.sum("t").cast("double").alias("t"), F.sum(t * t).cast("double").alias("tt"))
    total = lambda c: F.aggregate(f"seasons.{c}", F.lit(0.0), lambda a, x: a + x)
    client = (season.groupBy("client_id").agg(F.sum("c").alias("n"), F.sum("held").alias("held"), F.max("last").alias("last"),
                                              F.array_sort(F.collect_list(F.struct("k", "c", "y", "yy", "ty", "t", "tt"))).alias("seasons"))
              .filter((F.col("n") >= max(min_obs, 2 * m, 10)) & (F.col("held") == F.col("n"))))
    n, st, sy = F.col("n"), total("t"), total("y")
    client = client.withColumn("b", (n * total("ty") - st * sy) / (n * total("tt") - st * st)).withColumn("a", (sy - F.col("b") * st) / n)
    b = F.col("b")
    within = F.aggregate("seasons", F.lit(0.0), lambda e, x: e + (x["yy"] - x["y"] * x["y"] / x["c"])       # the deviations from each season's mean
                         - 2.0 * b * (x["ty"] - x["t"] * x["y"] / x["c"]) + b * b * (x["tt"] - x["t"] * x["t"] / x["c"]))
    client = client.withColumn("var", F.greatest(F.lit(0.0), within) / (n - m - 1)).filter(F.col("var") < F.lit(float("inf")))
    h = client.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    x = F.get("seasons", ((n - 1 + F.col("h")) % m).cast("int"))
    shift = x["y"] / x["c"] - F.col("a") - b * (x["t"] / x["c"])
    value = F.col("a") + b * (n - 1 + F.col("h")) + shift
    half = F.lit(Z95) * F.sqrt("var") * F.sqrt(1.0 + 1.0 / n)
    return clip_bounds(h.select("client_id", _ahead(step).alias("date"), value.alias("forecast"),
                                (value - half).alias("lower_ci"), (value + half).alias("upper_ci")))


def forecast_daily(features: DataFrame, horizon: int = params.FORECAST_HORIZON_DAILY, m: int = params.SEASON_DAILY) -> DataFrame:
    """FCS-05: daily forecast; >= 360 days required."""
    return trend_seasonal(features, "sale_date", "daily_sales", m, horizon, params.MIN_DAILY_OBS)


def forecast_monthly(features: DataFrame, horizon: int = params.FORECAST_HORIZON_MONTHLY, m: int = params.SEASON_MONTHLY) -> DataFrame:
    """FCS-06: monthly forecast; 24 rows after lags required (36 months in effect, D8).
    Dates are returned as ``yyyy-MM`` text."""
    out = trend_seasonal(features, "month_start", "avg_invoice_value", m, horizon, 2 * params.MIN_MONTHLY_OBS, "month")
    return out.withColumn("date", F.date_format("date", "yyyy-MM"))


# --- regressors (FCS-02..04 with CLN-11/12, FEA-09/10) ------------------------------

PIVOT = 1e-9        # a regressor that the others explain up to this share of its variance is left out

# Regressor columns of the feature tables, in their order.
DAILY_REGRESSORS = {"calendar": fe.CALENDAR_COLUMNS, "lags": fe.daily_lag_columns()}
MONTHLY_REGRESSORS = {"calendar": ["month", "quarter", "year"], "lags": fe.monthly_lag_columns()}


def _candidates(m: int, regressors: dict[str, Sequence[str]]) -> tuple[list[str], dict[str, list[int]]]:
    """Sets of regressors that compete, as positions: trend, then t mod m, then columns."""
    blocks, at = {"trend": [0], "season": list(range(1, m))}, m
    for name, cols in regressors.items():
        blocks[name] = list(range(at, at + len(cols)))
        at += len(cols)
    names = ["trend", "trend+season", *(f"trend+season+{b}" for b in regressors), "trend+season+" + "+".join(regressors)]
    names = list(dict.fromkeys(names))                     # with one block, the last two are the same
    return names, {n: [i for b in n.split("+") for i in blocks[b]] for n in names}


def _used(matrix: Column) -> Column:
    """1 for each swept column, else 0."""
    return F.transform(matrix, lambda row, i: F.when(F.get(row, i) < 0, 1.0).otherwise(0.0))


def regression(series: DataFrame, future: DataFrame, date_col: str, value_col: str, regressors: dict[str, Sequence[str]],
               m: int, min_obs: int, step: str = "day") -> DataFrame:
    """Least squares for every client at once on t, the season t mod m, and blocks of regressor
    columns; the set of blocks with the least corrected AIC forecasts the client's ``future``
    rows (whose lags are frozen), with bounds forecast +- 1.96 sigma sqrt(1 + 1/n + x'Cx).

    Regressors are cleaned first (infinite, missing or non-numeric values 0; leakage columns
    dropped). One aggregate gathers a client's calendar-bounded series; its centred
    cross-product matrix is swept block by block, so every competing set is read off the same
    matrix, and a column that the ones before it explain is left out. A client has no rows if
    its series is shorter than ``min_obs`` (or 2m, or 10), holds an infinite or missing value,
    or leaves fewer than ten degrees of freedom even to the trend alone."""
    cols = [c for block in regressors.values() for c in block]
    names, sets = _candidates(m, regressors)
    size = m + len(cols) + 1                                # with the value as the last entry
    season = lambda t: [F.when(t % m == k, 1.0).otherwise(0.0) for k in range(1, m)]
    vector = lambda t: [t.cast("double"), *season(t), *[F.col(c).cast("double") for c in cols]]
    t = F.row_number().over(Window.partitionBy("client_id").orderBy(date_col)) - 1
    s = clean_regressors(series, cols).select("client_id", F.col(date_col).alias("d"), F.col(value_col).cast("double").alias("y"), t.alias("t"), *cols)
    s = s.select("client_id", "d", "y", "t", F.array(*vector(F.col("t")), F.col("y")).alias("z"))
    finite = F.count(F.when(F.abs(F.col("y")) < F.lit(float("inf")), 1))
    c = (s.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), finite.alias("fit"), F.max("d").alias("last"),
                                    F.array_sort(F.collect_list(F.struct("t", "z"))).alias("rows"))
          .filter((F.col("n") >= max(min_obs, 2 * m, 10)) & (F.col("fit") == F.col("n"))))
    sums = F.aggregate("rows", zeros(size), lambda a, r: add(a, r["z"]))
    c = c.withColumn("means", let(F.struct(sums.alias("s"), F.col("n").alias("n")), lambda v: F.transform(v["s"], lambda x: x / v["n"])))
    gram = let(F.col("means"), lambda mean: F.aggregate("rows", F.array_repeat(zeros(size), size), lambda a, r: let(
        subtract(r["z"], mean), lambda v: add_outer(a, v))))

    def swept(matrix: Column, diagonal: Column, pivots: list[int]) -> Column:
        return F.aggregate(F.array(*[F.lit(p) for p in pivots]), matrix, lambda a, k: F.when(
            F.get(F.get(a, k), k) > PIVOT * F.get(diagonal, k), sweep(a, k)).otherwise(a))

    def score(order: int, v: Column) -> Column:
        p = F.aggregate(_used(v), F.lit(0.0), lambda a, x: a + x)
        rss = F.greatest(F.get(F.get(v, size - 1), size - 1), F.lit(0.0))
        return let(F.struct(p.alias("p"), rss.alias("rss")), lambda q: F.struct(
            (F.col("n") * F.log(F.greatest(q["rss"] / F.col("n"), F.lit(1e-9))) + 2.0 * (q["p"] + 2.0)
             + 2.0 * (q["p"] + 2.0) * (q["p"] + 3.0) / (F.col("n") - q["p"] - 3.0)).alias("aic"),
            F.lit(order).alias("order"), F.lit(names[order]).alias("model"), q["p"].alias("p"), q["rss"].alias("rss"), v.alias("m")))

    def compete(diagonal: Column, fitted: dict[str, Column]) -> Column:
        """The best set: fits one set after the other, each from the longest one that it extends."""
        if len(fitted) <= len(names):
            name = names[len(fitted) - 1]
            base = max((d for d in fitted if name.startswith(d) and set(sets.get(d, [])) <= set(sets[name])), key=len)
            new = swept(fitted[base], diagonal, [i for i in sets[name] if i not in sets.get(base, [])])
            return let(new, lambda v: compete(diagonal, {**fitted, name: v}))
        tried = F.array(*[score(order, fitted[name]) for order, name in enumerate(names)])
        return F.get(F.array_sort(F.filter(tried, lambda x: F.col("n") - x["p"] - 3.0 >= 10.0)), 0)

    # one expression whose parts are bound, so that no plan rewrite can compute a matrix twice
    best = let(gram, lambda g: let(F.transform(g, lambda row, i: F.get(row, i)), lambda diagonal: compete(diagonal, {"": g})))
    c = c.select("client_id", "n", "last", "means", best.alias("best"))
    steps = F.datediff(F.col(date_col), F.col("last")) if step == "day" else F.months_between(F.col(date_col), F.col("last")).cast("int")
    x = clean_regressors(future, cols).join(c, "client_id").withColumn("t", F.col("n") - 1 + steps)
    x = x.withColumn("x", subtract(F.array(*vector(F.col("t")), F.lit(0.0)), F.transform("means", lambda v, i: F.when(i < size - 1, v).otherwise(0.0))))
    x = x.withColumn("x", F.zip_with("x", _used(F.col("best.m")), lambda a, u: a * u))       # regressors left out have no part
    value = F.get("means", F.lit(size - 1)) + dot(F.col("x"), F.transform("best.m", lambda row: F.get(row, F.lit(size - 1))))
    spread = -dot(F.col("x"), F.transform("best.m", lambda row: dot(row, F.col("x"))))
    half = F.lit(Z95) * F.sqrt(F.col("best.rss") / (F.col("n") - F.col("best.p") - 1.0) * F.greatest(F.lit(1.0), 1.0 + 1.0 / F.col("n") + spread))
    x = x.select("client_id", F.col(date_col).alias("date"), value.alias("forecast"), half.alias("half"), "best.model", "best.p")
    return clip_bounds(x.filter(F.abs("forecast") < F.lit(float("inf"))).select(
        "client_id", "date", "forecast", (F.col("forecast") - F.col("half")).alias("lower_ci"), (F.col("forecast") + F.col("half")).alias("upper_ci"),
        "model", F.col("p").cast("int").alias("n_regressors")))


def regression_daily(features: DataFrame, holidays=None, horizon: int = params.FORECAST_HORIZON_DAILY, m: int = params.SEASON_DAILY) -> DataFrame:
    """FCS-02..05 on the daily feature table and its future rows (FEA-09)."""
    return regression(features, fe.future_daily(features, horizon, holidays), "sale_date", "daily_sales", DAILY_REGRESSORS, m, params.MIN_DAILY_OBS)


def regression_monthly(features: DataFrame, horizon: int = params.FORECAST_HORIZON_MONTHLY, m: int = params.SEASON_MONTHLY) -> DataFrame:
    """FCS-02..06 on the monthly feature table and its future rows (FEA-10)."""
    return regression(features, fe.future_monthly(features, horizon), "month_start", "avg_invoice_value", MONTHLY_REGRESSORS, m,
                      2 * params.MIN_MONTHLY_OBS, "month")
