"""FIG-11/12 tables and SRV-01..04 serving reshapes, for all clients at once.

Per-client maxima are computed as small grouped tables joined back, not as
client-wide windows, so no task holds a whole client."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stocklens import params
from stocklens.functions import round_half_even


def fig11_rows(actual: DataFrame, forecast: DataFrame | None) -> DataFrame:
    """FIG-11: actual daily rows and forecast rows with type and bounds, rounded 2.
    Without a forecast (``None``) only the actual rows."""
    a = actual.select("client_id", "date", round_half_even("value", 2).alias("value"), F.lit("actual").alias("type"),
                      F.lit(None).cast("double").alias("lower_ci"), F.lit(None).cast("double").alias("upper_ci"))
    if forecast is None:
        return a
    f = forecast.select("client_id", "date", round_half_even("forecast", 2).alias("value"), F.lit("forecast").alias("type"),
                        round_half_even("lower_ci", 2).alias("lower_ci"), round_half_even("upper_ci", 2).alias("upper_ci"))
    return a.unionByName(f)


def fig12_rows(actual_monthly: DataFrame, forecast_monthly: DataFrame | None) -> DataFrame:
    """FIG-12: actual monthly means and the monthly forecast, month as ``yyyy-MM``.
    Without a forecast (``None``) only the actual rows."""
    a = actual_monthly.select("client_id", F.date_format("month_start", "yyyy-MM").alias("date"),
                              round_half_even("avg_invoice_value", 2).alias("value"), F.lit("actual").alias("type"),
                              F.lit(None).cast("double").alias("lower_ci"),
                              F.lit(None).cast("double").alias("upper_ci"))
    if forecast_monthly is None:
        return a
    f = forecast_monthly.select("client_id", F.col("date").cast("string").alias("date"),
                                round_half_even("forecast", 2).alias("value"), F.lit("forecast").alias("type"),
                                round_half_even("lower_ci", 2).alias("lower_ci"), round_half_even("upper_ci", 2).alias("upper_ci"))
    return a.unionByName(f)


def recent_actuals(rows: DataFrame, days: int = params.RECENT_DAYS) -> DataFrame:
    """SRV-01: all forecast rows plus actual rows of the last ``days`` days (date >= latest
    actual - (days-1)); bad dates skipped; a client without valid actuals keeps all rows."""
    d = F.col("date").cast("date")
    latest = (rows.filter((F.col("type") == "actual") & d.isNotNull())
                  .groupBy("client_id").agg(F.max(d).alias("_latest")))
    j = rows.join(latest, "client_id", "left")
    keep = ((F.col("type") != "actual") | F.col("_latest").isNull() |
            (d.isNotNull() & (d >= F.date_sub("_latest", days - 1))))
    return j.filter(keep).drop("_latest")


def forecast_bridge(rows: DataFrame) -> DataFrame:
    """SRV-02: the forecast trace with the last actual repeated at its head (bounds null)."""
    actual = rows.filter(F.col("type") == "actual")
    last = actual.groupBy("client_id").agg(F.max_by(F.struct("date", "value"), "date").alias("_l"))
    has_fc = rows.filter(F.col("type") == "forecast").select("client_id").distinct()
    bridge = (last.join(has_fc, "client_id", "left_semi")
                  .select("client_id", F.col("_l.date").alias("date"), F.col("_l.value").alias("value"),
                          F.lit(None).cast("double").alias("lower_ci"), F.lit(None).cast("double").alias("upper_ci"),
                          F.lit("bridge").alias("segment")))
    fc = rows.filter(F.col("type") == "forecast").select(
        "client_id", "date", "value", "lower_ci", "upper_ci", F.lit("forecast").alias("segment"))
    return bridge.unionByName(fc)


def confidence_band(rows: DataFrame) -> DataFrame:
    """SRV-03: forecast rows with both bounds (input of the confidence polygon)."""
    return rows.filter((F.col("type") == "forecast") & F.col("lower_ci").isNotNull() & F.col("upper_ci").isNotNull())


def pareto_segments(bands: DataFrame) -> DataFrame:
    """SRV-04: each band's rows plus the previous band's last row, so drawn segments
    connect. Band boundaries come from a small (client, band) table."""
    stats = bands.groupBy("client_id", "percentage_category").agg(
        F.min("rank").alias("_lo"), F.max("rank").alias("_hi"))
    w = Window.partitionBy("client_id").orderBy("_lo")
    prev = stats.select("client_id", "percentage_category", F.lag("_hi").over(w).alias("_prev_hi")) \
                .filter(F.col("_prev_hi").isNotNull())
    carried = (bands.drop("percentage_category")
               .join(prev, (bands["client_id"] == prev["client_id"]) & (bands["rank"] == prev["_prev_hi"]))
               .drop(prev["client_id"]).drop("_prev_hi")
               .withColumn("carried", F.lit(True)))
    own = bands.withColumn("carried", F.lit(False))
    return own.unionByName(carried.select(*own.columns))
