"""FEA-01..11: daily and monthly feature tables and future regressor rows.

Series are keyed by (client_id, date). Per-client windows here run over a
calendar-bounded series (one row per day or month), never over raw sales rows.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stocklens import params
from stocklens.functions import limbs, recombine
from stocklens.functions.hijri import hijri, hijri_date
from stocklens.operators.analytics import fill_grid
from stocklens.operators.cleaning import ffill_bfill0

CALENDAR_COLUMNS = ["day_of_week", "is_weekend", "month", "quarter", "day_of_month", "week_of_year",
                    "is_holiday", "is_month_start", "is_month_end", "day_of_year", "year"]
DAILY_BASE = ["sale_date", "daily_sales", "transaction_count", "total_items"]


def daily_lag_columns(lags: Sequence[int] = params.DAILY_LAGS) -> list[str]:
    return [f"sales_lag_{k}" for k in lags]


def monthly_lag_columns(max_lag: int = params.MONTHLY_MAX_LAG) -> list[str]:
    return [f"avg_invoice_lag_{k}" for k in range(1, max_lag + 1)]


# --- holidays ------------------------------------------------------------------

# Public holidays of the contract's calendar. Fixed-date ones by month, day and
# first year observed; movable ones by month, first day and number of days of the Islamic year.
FIXED_HOLIDAYS = [(2, 22, 2022, "Founding Day"), (9, 23, 1930, "National Day")]
MOVABLE_HOLIDAYS = [(10, 1, 4, "Eid al-Fitr"), (12, 9, 1, "Arafat Day"), (12, 10, 3, "Eid al-Adha")]
FIRST_HOLIDAY_YEAR = 2020


def holiday_years(as_of, floor: int = FIRST_HOLIDAY_YEAR) -> tuple[int, int]:
    """The contract's window: from max(``floor``, year-3) to year+2."""
    year = as_of.year if isinstance(as_of, (_dt.date, _dt.datetime)) else int(str(as_of)[:4])
    return max(floor, year - 3), year + 2


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``(holiday_date date, name string)`` of the holidays of the years, from the rules to the
    dates, built JVM-side; size bounded by construction (years x fixed lists)."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    rows = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(since).alias("since"),
                              F.lit(name).alias("name")) for (m, d, since, name) in FIXED_HOLIDAYS])
    fixed = (years.select("y", F.explode(rows).alias("h"))
                  .filter(F.col("y") >= F.col("h.since"))
                  .select(F.make_date("y", "h.m", "h.d").alias("holiday_date"), F.col("h.name").alias("name")))
    # an Islamic year starts about 11 days earlier each year: all that overlap the window
    first, last = (hijri(F.make_date(F.lit(y), F.lit(m), F.lit(d)))["year"] for y, m, d in ((first_year, 1, 1), (last_year, 12, 31)))
    rows = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("n"), F.lit(name).alias("name"))
                     for (m, d, n, name) in MOVABLE_HOLIDAYS])
    movable = (spark.range(1).select(F.explode(F.sequence(first, last)).alias("y"))
                    .select("y", F.explode(rows).alias("h"))
                    .select(F.explode(F.sequence(F.lit(0), F.col("h.n") - 1)).alias("k"), "y", "h")
                    .select(hijri_date(F.col("y"), F.col("h.m"), F.col("h.d") + F.col("k")).alias("holiday_date"), F.col("h.name").alias("name"))
                    .filter(F.year("holiday_date").between(first_year, last_year)))
    return fixed.unionByName(movable)


class HolidayRule:
    """The default calendar as an expression (no join): the holidays of the years in
    ``[first_year, last_year]``, from the date to the rules."""

    def __init__(self, first_year: int, last_year: int):
        self.first_year, self.last_year = first_year, last_year

    def name(self, date: Column) -> Column:
        """The holiday's name, null on other days."""
        day, islamic = F.month(date) * 100 + F.dayofmonth(date), hijri(date)
        of = F.lit(None).cast("string")
        for m, d, since, name in reversed(FIXED_HOLIDAYS):
            of = F.when((day == m * 100 + d) & (F.year(date) >= since), name).otherwise(of)
        for m, d, n, name in reversed(MOVABLE_HOLIDAYS):
            of = F.when((islamic["month"] == m) & islamic["day"].between(d, d + n - 1), name).otherwise(of)
        return F.when(F.year(date).between(self.first_year, self.last_year), of)

    def flag(self, date: Column) -> Column:
        return self.name(date).isNotNull().cast("int")


def flag_holidays(df: DataFrame, date_col: str, holidays) -> DataFrame:
    """FEA-04: ``is_holiday`` from the default rule (an expression) or from a holiday
    table given by the user (equi-join on the date; Spark broadcasts it when small)."""
    if holidays is None:
        return df.withColumn("is_holiday", F.lit(0))
    if isinstance(holidays, HolidayRule):
        return df.withColumn("is_holiday", holidays.flag(F.col(date_col)))
    h = holidays.select(F.col("holiday_date").cast("date").alias("_hd")).distinct() \
                .withColumn("_h", F.lit(1))
    return (df.join(h, df[date_col] == h["_hd"], "left")
              .withColumn("is_holiday", F.coalesce("_h", F.lit(0)))
              .drop("_hd", "_h"))


# --- calendar ------------------------------------------------------------------

def calendar_exprs(d: str) -> list[str]:
    """FEA-03 as SQL expressions over date column ``d`` (one JVM call builds them all)."""
    return [f"weekday({d}) AS day_of_week",
            f"CAST(weekday({d}) IN (4, 5) AS INT) AS is_weekend",
            f"month({d}) AS month",
            f"quarter({d}) AS quarter",
            f"dayofmonth({d}) AS day_of_month",
            f"weekofyear({d}) AS week_of_year",
            f"CAST(dayofmonth({d}) = 1 AS INT) AS is_month_start",
            f"CAST(last_day({d}) = {d} AS INT) AS is_month_end",
            f"dayofyear({d}) AS day_of_year",
            f"year({d}) AS year"]


def calendar(df: DataFrame, date_col: str = "sale_date", holidays=None) -> DataFrame:
    """FEA-03: Monday=0 weekday, Fri/Sat weekend, ISO week, month start/end, etc."""
    return flag_holidays(df.selectExpr("*", *calendar_exprs(date_col)), date_col, holidays)


def add_lags(df: DataFrame, value_col: str, lags: Sequence[int], prefix: str, order_col: str,
             keys: Sequence[str] = ("client_id",)) -> DataFrame:
    """FEA-05/08: ``lag(value, k)`` per client in date order (null when k >= length)."""
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {order_col})"
    return df.selectExpr("*", *[f"lag({value_col}, {k}) {over} AS {prefix}{k}" for k in lags])


# --- daily ---------------------------------------------------------------------

def daily_sales_features(details: DataFrame) -> DataFrame:
    """FEA-01: per invoice day: sum amount, distinct invoices, sum quantity.

    Details carry their invoice's day, so nothing is joined: rows are reduced to one per
    invoice (map-side partial aggregation), then to one per day."""
    sums = {"amt": "total_price", "qty": "quantity"}
    parts = {n: [f"{n}{i}" for i in range(len(limbs(c)))] for n, c in sums.items()}
    per = details.filter(F.col("invoice_day").isNotNull()).groupBy("client_id", F.col("invoice_day").alias("sale_date"), "invoice_id").agg(
        *[F.sum(x).alias(p) for n, c in sums.items() for p, x in zip(parts[n], limbs(c), strict=True)])
    total = lambda n: recombine([F.sum(p) for p in parts[n]])
    return per.groupBy("client_id", "sale_date").agg(
        total("amt").alias("daily_sales"), F.count(F.lit(1)).alias("transaction_count"), total("qty").alias("total_items"))


def finalize_daily(df: DataFrame, lags: Sequence[int] = params.DAILY_LAGS) -> DataFrame:
    """FEA-06: final columns and narrow types (float sales/lags, int calendar)."""
    exprs = ["client_id", "sale_date", "CAST(daily_sales AS FLOAT) AS daily_sales",
             "CAST(transaction_count AS INT) AS transaction_count", "CAST(total_items AS FLOAT) AS total_items"]
    exprs += [f"CAST(coalesce({c}, 0) AS INT) AS {c}" for c in CALENDAR_COLUMNS]
    exprs += [f"CAST({c} AS FLOAT) AS {c}" for c in daily_lag_columns(lags)]
    return df.filter("daily_sales IS NOT NULL").selectExpr(*exprs)


def daily_features(details: DataFrame, holidays: DataFrame | None = None,
                   lags: Sequence[int] = params.DAILY_LAGS) -> DataFrame:
    """FEA-07: daily sales -> day grid (gaps 0) -> calendar -> holidays -> lags -> types."""
    daily = daily_sales_features(details)
    filled = fill_grid(daily, "sale_date", ["daily_sales", "transaction_count", "total_items"], "day")
    filled = filled.withColumn("daily_sales", F.col("daily_sales").cast("float"))
    cal = calendar(filled, "sale_date", holidays)
    return finalize_daily(add_lags(cal, "daily_sales", lags, "sales_lag_", "sale_date"), lags)


# --- monthly -------------------------------------------------------------------

def monthly_features(ts: DataFrame, max_lag: int = params.MONTHLY_MAX_LAG) -> DataFrame:
    """FEA-08: month, quarter, year and lags 1..max_lag of the mean invoice; rows with
    any null lag dropped (so a client needs more than max_lag months)."""
    ts = ffill_bfill0(ts, ["avg_invoice_value"], "month_start")
    ts = ts.withColumn("avg_invoice_value", F.col("avg_invoice_value").cast("float"))
    lagged = add_lags(ts, "avg_invoice_value", range(1, max_lag + 1), "avg_invoice_lag_", "month_start")
    lag_cols = monthly_lag_columns(max_lag)
    return (lagged.dropna(subset=lag_cols)
            .select("client_id", "month_start", "avg_invoice_value",
                    F.month("month_start").alias("month"),
                    F.quarter("month_start").alias("quarter"),
                    F.year("month_start").alias("year"),
                    *[F.col(c).cast("float").alias(c) for c in lag_cols]))


# --- future regressor rows ----------------------------------------------------

def _last_values(series: DataFrame, date_col: str, value_col: str, lags: Sequence[int],
                 prefix: str) -> DataFrame:
    """Per client: last date and the k-th value from the end for each lag (0 if too short).
    Only the last max(lags) rows of each client are kept before the pivot."""
    w = Window.partitionBy("client_id").orderBy(F.col(date_col).desc())
    kmax = max(lags)
    tail = series.select("client_id", date_col, value_col, F.row_number().over(w).alias("_rn")) \
                 .filter(F.col("_rn") <= kmax)
    aggs = [F.max(date_col).alias("_last")]
    aggs += [F.coalesce(F.max(F.when(F.col("_rn") == k, F.col(value_col))), F.lit(0.0))
             .cast("float").alias(f"{prefix}{k}") for k in lags]
    return tail.groupBy("client_id").agg(*aggs)


def future_daily(features: DataFrame, horizon: int = params.FORECAST_HORIZON_DAILY,
                 holidays: DataFrame | None = None,
                 lags: Sequence[int] = params.DAILY_LAGS) -> DataFrame:
    """FEA-09: next ``horizon`` days per client with calendar, holidays and lags frozen
    at the k-th last observed value."""
    last = _last_values(features, "sale_date", "daily_sales", lags, "sales_lag_")
    days = last.select("*", F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon)))
                       .alias("sale_date"))
    cal = calendar(days, "sale_date", holidays)
    return cal.selectExpr("client_id", "sale_date", *[f"CAST({c} AS INT) AS {c}" for c in CALENDAR_COLUMNS],
                          *daily_lag_columns(lags))


def future_monthly(features: DataFrame, horizon: int = params.FORECAST_HORIZON_MONTHLY,
                   max_lag: int = params.MONTHLY_MAX_LAG) -> DataFrame:
    """FEA-10: next ``horizon`` month starts per client; month/quarter/year; frozen lags."""
    lags = list(range(1, max_lag + 1))
    last = _last_values(features, "month_start", "avg_invoice_value", lags, "avg_invoice_lag_")
    months = last.select("*", F.explode(F.sequence(F.add_months("_last", 1), F.add_months("_last", horizon),
                                                   F.expr("interval 1 month"))).alias("month_start"))
    return months.select("client_id", "month_start",
                         F.month("month_start").alias("month"),
                         F.quarter("month_start").alias("quarter"),
                         F.year("month_start").alias("year"),
                         *monthly_lag_columns(max_lag))
