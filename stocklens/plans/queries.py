"""Registered queries: one per operator (or tight group) of the survey's inventory.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's whole tables;
``ORACLE[name]`` is the DuckDB twin. Queries without an oracle are checked by
row count only (and by brute-force tests in ``tests/``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stocklens import params
from stocklens.plans import oracle
from stocklens.plans.retail import Retail

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def naive_timestamps(df: DataFrame) -> DataFrame:
    """Return timestamps as ``timestamp_ntz`` (the same wall clock), like the source
    tables, so results compare the same way whatever the reader's time zone."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    ts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ts}) if ts else df


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return naive_timestamps(fn(spark, sf_dir))
        query.__name__, query.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r(spark: SparkSession, sf_dir: str) -> Retail:
    return Retail.from_tpch(spark, sf_dir)


PF_COLS = ("client_id, product_id, sales_quantity, sales_amount, net_profit, name, buy_price, "
           "sale_price, current_stock, last_sale_date, efficiency_ratio, efficiency, days_since_last_sale")


@register("product_flow", oracle.q(f"SELECT {PF_COLS} FROM pf"))
def q_product_flow(spark, sf_dir):
    return _r(spark, sf_dir).product_flow


@register("list_clients", oracle.q(
    "SELECT CAST(client_id AS VARCHAR) AS client_id FROM (SELECT DISTINCT client_id FROM inv WHERE client_id IS NOT NULL)"))
def q_list_clients(spark, sf_dir):
    from stocklens.sources import list_clients
    return list_clients(_r(spark, sf_dir).raw["sale_invoices"])


@register("clean_invoices", oracle.q(
    "SELECT client_id, invoice_id, created_at, total_price, year_month, day FROM inv"))
def q_clean_invoices(spark, sf_dir):
    return _r(spark, sf_dir).invoices


@register("clean_details", oracle.q(
    "SELECT client_id, detail_id, product_id, invoice_id, quantity, total_price, buy_price, "
    "created_at, net_profit, day FROM det"))
def q_clean_details(spark, sf_dir):
    return _r(spark, sf_dir).details.drop("invoice_day")


@register("product_sales", oracle.q(
    "SELECT client_id, product_id, sales_quantity, sales_amount, net_profit, last_sale_date FROM sales"))
def q_product_sales(spark, sf_dir):
    from stocklens.operators.flow import product_sales
    return product_sales(_r(spark, sf_dir).details)


@register("efficiency_counts", oracle.q("""
SELECT c.client_id, l.efficiency, l.label_order, CAST(COALESCE(x.n, 0) AS BIGINT) AS product_count
FROM (SELECT DISTINCT client_id FROM pf) c CROSS JOIN labels l
LEFT JOIN (SELECT client_id, efficiency, COUNT(*) AS n FROM pf GROUP BY client_id, efficiency) x
  ON x.client_id = c.client_id AND x.efficiency = l.efficiency"""))
def q_efficiency_counts(spark, sf_dir):
    from stocklens.operators.charts import efficiency_counts
    return efficiency_counts(_r(spark, sf_dir).product_flow)


@register("efficiency_totals", oracle.q("""
SELECT c.client_id, l.efficiency, l.label_order,
       COALESCE(x.total_stock, 0.0) AS total_stock, COALESCE(x.total_sales, 0.0) AS total_sales
FROM (SELECT DISTINCT client_id FROM pf) c CROSS JOIN labels l
LEFT JOIN (SELECT client_id, efficiency,
                  CAST(CAST(SUM(CAST(current_stock * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS total_stock,
                  CAST(CAST(SUM(CAST(sales_quantity * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS total_sales
           FROM pf WHERE efficiency IN ('Undersupplied', 'Balanced', 'Oversupplied')
           GROUP BY client_id, efficiency) x
  ON x.client_id = c.client_id AND x.efficiency = l.efficiency"""))
def q_efficiency_totals(spark, sf_dir):
    from stocklens.operators.charts import efficiency_totals
    return efficiency_totals(_r(spark, sf_dir).product_flow)


@register("pareto", oracle.q(
    "SELECT client_id, product_id, name, sales_quantity, current_stock, rank, cumulative_percentage FROM pareto"))
def q_pareto(spark, sf_dir):
    return _r(spark, sf_dir).pareto


@register("pareto_bands", oracle.q("""
SELECT client_id, rank, product_id, name, sales_quantity, (round_even(CAST(cumulative_percentage AS DOUBLE) * 100, 0) / 100) AS cumulative_pct,
       CASE WHEN cumulative_percentage >= 0 AND cumulative_percentage <= 80 THEN
            CAST((k - 1) * 10 AS VARCHAR) || '-' || CAST(k * 10 AS VARCHAR) || '%' ELSE 'Other' END AS percentage_category
FROM (SELECT *, CAST(GREATEST(CEIL(cumulative_percentage / 10.0), 1) AS INTEGER) AS k FROM pareto)"""))
def q_pareto_bands(spark, sf_dir):
    from stocklens.operators.charts import pareto_bands
    return pareto_bands(_r(spark, sf_dir).pareto)


@register("revenue_share", oracle.top_share("sales_amount"))
def q_revenue_share(spark, sf_dir):
    return _r(spark, sf_dir).revenue_share


@register("profit_share", oracle.top_share("net_profit"))
def q_profit_share(spark, sf_dir):
    return _r(spark, sf_dir).profit_share


@register("share_table", oracle.SHARE_TABLE)
def q_share_table(spark, sf_dir):
    from stocklens.operators.charts import share_table
    r = _r(spark, sf_dir)
    return share_table(r.revenue_share, r.profit_share)


@register("stagnant", oracle.q(
    "SELECT client_id, product_id, name, current_stock, days_since_last_sale, days_category, last_sale_date_str FROM stag"))
def q_stagnant(spark, sf_dir):
    return _r(spark, sf_dir).stagnant


@register("outstanding", oracle.q("SELECT client_id, user_id, outstanding_amount FROM owed"))
def q_outstanding(spark, sf_dir):
    return _r(spark, sf_dir).outstanding


@register("outstanding_total", oracle.q("""
SELECT client_id, CAST(CAST(SUM(CAST(outstanding_amount * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS shown_outstanding_total,
       COUNT(*) AS shown_suppliers
FROM top_owed GROUP BY client_id"""))
def q_outstanding_total(spark, sf_dir):
    from stocklens.operators.charts import top_suppliers, top_suppliers_total
    return top_suppliers_total(top_suppliers(_r(spark, sf_dir).outstanding))


@register("top_suppliers", oracle.q("SELECT client_id, rank, user_id, outstanding_amount FROM top_owed"))
def q_top_suppliers(spark, sf_dir):
    from stocklens.operators.charts import top_suppliers
    return top_suppliers(_r(spark, sf_dir).outstanding)


@register("monthly_avg_invoice", oracle.q("SELECT client_id, month_start, avg_invoice_value FROM monthly"))
def q_monthly_avg_invoice(spark, sf_dir):
    return _r(spark, sf_dir).monthly_avg_invoice


@register("daily_sales_actual", oracle.q("SELECT client_id, date, value FROM dsales"))
def q_daily_sales_actual(spark, sf_dir):
    return _r(spark, sf_dir).daily_sales_actual


@register("daily_profit", oracle.q("SELECT client_id, date, value FROM dprofit"))
def q_daily_profit(spark, sf_dir):
    return _r(spark, sf_dir).daily_profit


@register("stock_table", oracle.q(
    "SELECT client_id, product_id, name, current_stock AS stock FROM prod"))
def q_stock_table(spark, sf_dir):
    return _r(spark, sf_dir).stock_table


@register("top_products", oracle.q("""
SELECT client_id, CAST(ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY sales_quantity DESC, product_id) AS INTEGER) AS rank,
       product_id, name, current_stock, sales_quantity
FROM pf QUALIFY rank <= 20"""))
def q_top_products(spark, sf_dir):
    from stocklens.operators.charts import top_products
    return top_products(_r(spark, sf_dir).product_flow)


@register("revenue_cogs", oracle.q("""
SELECT client_id, CAST(ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY sales_amount DESC, product_id) AS INTEGER) AS rank,
       product_id, name, sales_amount, sales_quantity * buy_price AS cogs, sales_amount - sales_quantity * buy_price AS margin
FROM pf QUALIFY rank <= 20"""))
def q_revenue_cogs(spark, sf_dir):
    from stocklens.operators.charts import revenue_cogs
    return revenue_cogs(_r(spark, sf_dir).product_flow)


@register("price_quantity", oracle.q("""
SELECT client_id, product_id, name, sale_price, sales_quantity FROM pf WHERE sale_price > 0 AND sales_quantity > 0"""))
def q_price_quantity(spark, sf_dir):
    from stocklens.operators.charts import price_quantity
    return price_quantity(_r(spark, sf_dir).product_flow)


@register("restock", oracle.q("""
SELECT client_id, product_id, name, current_stock, sales_quantity FROM pf WHERE current_stock <= 10"""))
def q_restock(spark, sf_dir):
    from stocklens.operators.charts import restock
    return restock(_r(spark, sf_dir).product_flow)


@register("bottom_products", oracle.q("""
SELECT client_id, CAST(ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY sales_quantity ASC, product_id) AS INTEGER) AS rank,
       product_id, name, sales_quantity
FROM pf WHERE sales_quantity > 0 QUALIFY rank <= 10"""))
def q_bottom_products(spark, sf_dir):
    from stocklens.operators.charts import bottom_products
    return bottom_products(_r(spark, sf_dir).product_flow)


@register("top_sellers", oracle.q("""
SELECT client_id, CAST(ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY sales_quantity DESC, product_id) AS INTEGER) AS rank,
       product_id, name, sales_quantity
FROM pf WHERE sales_quantity > 0 QUALIFY rank <= 10"""))
def q_top_sellers(spark, sf_dir):
    from stocklens.operators.charts import top_sellers
    return top_sellers(_r(spark, sf_dir).product_flow)


@register("sales_histogram", oracle.q("""
SELECT client_id, CAST(ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY sales_quantity ASC) AS INTEGER) AS rank,
       sales_quantity, product_count
FROM (SELECT client_id, sales_quantity, COUNT(*) AS product_count FROM pf WHERE sales_quantity > 0
      GROUP BY client_id, sales_quantity)
QUALIFY rank <= 15"""))
def q_sales_histogram(spark, sf_dir):
    from stocklens.operators.charts import sales_histogram
    return sales_histogram(_r(spark, sf_dir).product_flow)


# --- features (FEA) -----------------------------------------------------------

DAILY_COLS = ("client_id, sale_date, daily_sales, transaction_count, total_items, day_of_week, is_weekend, month, "
              "quarter, day_of_month, week_of_year, is_holiday, is_month_start, is_month_end, day_of_year, year, "
              "sales_lag_1, sales_lag_2, sales_lag_3, sales_lag_7, sales_lag_14, sales_lag_21, sales_lag_28, sales_lag_30, sales_lag_60, sales_lag_90")
MONTHLY_COLS = "client_id, month_start, avg_invoice_value, month, quarter, year, avg_invoice_lag_1, avg_invoice_lag_2, avg_invoice_lag_3, avg_invoice_lag_4, avg_invoice_lag_5, avg_invoice_lag_6, avg_invoice_lag_7, avg_invoice_lag_8, avg_invoice_lag_9, avg_invoice_lag_10, avg_invoice_lag_11, avg_invoice_lag_12"


@register("daily_features", oracle.q(oracle.FEATURES + f"SELECT {DAILY_COLS} FROM feat"))
def q_daily_features(spark, sf_dir):
    return _r(spark, sf_dir).daily_features


@register("calendar", oracle.q(
    "SELECT client_id, date, " + oracle.cal("date") + " FROM dsales"))
def q_calendar(spark, sf_dir):
    from stocklens.operators.features import calendar
    r = _r(spark, sf_dir)
    return calendar(r.daily_sales_actual, "date", r.holidays).drop("value")


def _since_1900(spark, sf_dir) -> Retail:
    """The driver's sales end in 2001: the holiday window's first year is lowered to reach them."""
    return Retail.from_tpch(spark, sf_dir, first_holiday_year=1900)


@register("holidays_movable", oracle.q(oracle.HOLIDAYS + """
SELECT d.client_id, d.date, CAST(m.y AS INTEGER) AS hijri_year, CAST(m.m AS INTEGER) AS hijri_month,
       CAST(d.date - m.start + 1 AS INTEGER) AS hijri_day, CAST(h.name IS NOT NULL AS INTEGER) AS is_holiday, h.name AS holiday
FROM dsales d ASOF JOIN hmonths m ON d.date >= m.start LEFT JOIN hdates h ON d.date = h.date"""))
def q_holidays_movable(spark, sf_dir):
    """FEA-04: Islamic date and holiday of every day of the sales series."""
    from pyspark.sql import functions as F
    from stocklens.functions.hijri import hijri
    r = _since_1900(spark, sf_dir)
    day, islamic = F.col("date"), hijri(F.col("date"))
    return r.daily_sales_actual.select(
        "client_id", "date", *[islamic[p].alias(f"hijri_{p}") for p in ("year", "month", "day")],
        r.holidays.flag(day).alias("is_holiday"), r.holidays.name(day).alias("holiday"))


@register("daily_features_holidays", oracle.q(oracle.HOLIDAYS + oracle.FEATURES + f"""
SELECT {DAILY_COLS.replace("is_holiday", "CAST(h.name IS NOT NULL AS INTEGER) AS is_holiday")}
FROM feat LEFT JOIN hdates h ON feat.sale_date = h.date"""))
def q_daily_features_holidays(spark, sf_dir):
    return _since_1900(spark, sf_dir).daily_features


@register("lag_features", oracle.q(
    "SELECT client_id, date, value, " +
    ", ".join(f"LAG(value, {k}) OVER (PARTITION BY client_id ORDER BY date) AS sales_lag_{k}"
              for k in [1, 2, 3, 7, 14, 21, 28, 30, 60, 90]) + " FROM dsales"))
def q_lag_features(spark, sf_dir):
    from stocklens import params
    from stocklens.operators.features import add_lags
    return add_lags(_r(spark, sf_dir).daily_sales_actual, "value", params.DAILY_LAGS, "sales_lag_", "date")


@register("monthly_features", oracle.q(oracle.FEATURES + f"SELECT {MONTHLY_COLS} FROM mfeat"))
def q_monthly_features(spark, sf_dir):
    return _r(spark, sf_dir).monthly_features


@register("future_daily", oracle.q(oracle.FEATURES + oracle.FUTURE_DAILY + """
SELECT client_id, sale_date, """ + oracle.cal("sale_date") + ", sales_lag_1, sales_lag_2, sales_lag_3, sales_lag_7, sales_lag_14, sales_lag_21, sales_lag_28, sales_lag_30, sales_lag_60, sales_lag_90 FROM fdays"))
def q_future_daily(spark, sf_dir):
    from stocklens.operators.features import future_daily
    r = _r(spark, sf_dir)
    return future_daily(r.daily_features, holidays=r.holidays)


@register("future_monthly", oracle.q(oracle.FEATURES + oracle.FUTURE_MONTHLY + """
SELECT client_id, month_start, CAST(month(month_start) AS INTEGER) AS month,
       CAST(quarter(month_start) AS INTEGER) AS quarter, CAST(year(month_start) AS INTEGER) AS year,
       avg_invoice_lag_1, avg_invoice_lag_2, avg_invoice_lag_3, avg_invoice_lag_4, avg_invoice_lag_5, avg_invoice_lag_6, avg_invoice_lag_7, avg_invoice_lag_8, avg_invoice_lag_9, avg_invoice_lag_10, avg_invoice_lag_11, avg_invoice_lag_12
FROM mdays"""))
def q_future_monthly(spark, sf_dir):
    from stocklens.operators.features import future_monthly
    return future_monthly(_r(spark, sf_dir).monthly_features)


# --- cleaning checks on derived dirty inputs (CLN-03, CLN-10) -------------------------

@register("mixed_dates", oracle.q(r"""
, dd AS (
  SELECT client_id, invoice_id,
         CASE invoice_id % 5 WHEN 0 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S')
                             WHEN 1 THEN strftime(created_at, '%Y%m%d')
                             WHEN 2 THEN strftime(created_at, '%m/%d/%Y')
                             WHEN 3 THEN strftime(created_at, '%d/%m/%Y')
                             ELSE strftime(created_at, '%b %-d %Y') END AS date_text,
         CAST(date_diff('day', DATE '1899-12-30', CAST(created_at AS DATE)) AS DOUBLE)
           + CAST(invoice_id % 24 AS DOUBLE) / 24.0 AS date_serial
  FROM inv
)
SELECT client_id, invoice_id, date_text, date_serial,
       CASE WHEN date_text IS NULL OR trim(date_text) = '' THEN NULL
            WHEN regexp_full_match(trim(date_text), '[0-9]+') THEN
                 CASE WHEN length(trim(date_text)) = 8 THEN try_strptime(trim(date_text), '%Y%m%d')
                      WHEN length(trim(date_text)) = 4 THEN try_strptime(trim(date_text), '%Y') END
            ELSE COALESCE(TRY_CAST(trim(date_text) AS TIMESTAMP),
                          try_strptime(trim(date_text), '%m/%d/%Y'),
                          try_strptime(trim(date_text), '%d/%m/%Y'),
                          try_strptime(trim(date_text), '%b %d %Y')) END AS parsed_text,
       CASE WHEN date_serial > 1 AND date_serial < 2958466 AND date_serial <> 60
            THEN make_timestamp(CAST(ROUND((date_serial - 25569) * 86400000000) AS BIGINT)) END AS parsed_serial
FROM dd"""))
def q_mixed_dates(spark, sf_dir):
    from pyspark.sql import functions as F
    from stocklens.functions import parse_mixed_date
    from stocklens.operators.cleaning import dirty_dates
    d = dirty_dates(_r(spark, sf_dir).invoices)
    return d.select("*",
                    parse_mixed_date("date_text", d.schema["date_text"].dataType).alias("parsed_text"),
                    parse_mixed_date("date_serial", d.schema["date_serial"].dataType).alias("parsed_serial"))


@register("ffill", oracle.q("""
, itot AS (
  SELECT client_id, day, CAST(CAST(SUM(CAST(total_price * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS total FROM inv GROUP BY client_id, day
),
igrid AS (
  SELECT client_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT client_id, MIN(day) AS lo, MAX(day) AS hi FROM itot GROUP BY client_id)
),
ig AS (SELECT g.client_id, g.day, t.total FROM igrid g LEFT JOIN itot t ON g.client_id = t.client_id AND g.day = t.day)
SELECT client_id, day,
       COALESCE(LAST_VALUE(total IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY day
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                FIRST_VALUE(total IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY day
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS total
FROM ig"""))
def q_ffill(spark, sf_dir):
    from pyspark.sql import functions as F
    from stocklens.functions import exact_sum
    from stocklens.operators.analytics import fill_grid
    from stocklens.operators.cleaning import ffill_bfill0
    per_day = _r(spark, sf_dir).invoices.groupBy("client_id", "day").agg(exact_sum("total_price").alias("total"))
    gapped = fill_grid(per_day, "day", [], "day")
    return ffill_bfill0(gapped, ["total"], "day")


# --- forecasting (FCS) and serving (SRV) ----------------------------------------------

FC_COLS = "client_id, date, horizon, forecast, lower_ci, upper_ci"


@register("seasonal_naive", oracle.q(oracle.FEATURES + oracle.SN_DAILY + f"SELECT {FC_COLS} FROM snd"))
def q_seasonal_naive(spark, sf_dir):
    return _r(spark, sf_dir).naive_daily


@register("seasonal_naive_monthly", oracle.q(oracle.FEATURES + oracle.SN_MONTHLY + f"SELECT {FC_COLS} FROM snm"))
def q_seasonal_naive_monthly(spark, sf_dir):
    return _r(spark, sf_dir).naive_monthly


@register("recent_actuals", oracle.q(oracle.FEATURES + oracle.SN_DAILY + oracle.FIG11 + """
, lat AS (SELECT client_id, MAX(date) AS latest FROM f11 WHERE type = 'actual' GROUP BY client_id)
SELECT f.client_id, f.date, f.value, f.type, f.lower_ci, f.upper_ci
FROM f11 f LEFT JOIN lat l ON f.client_id = l.client_id
WHERE f.type <> 'actual' OR l.latest IS NULL OR f.date >= l.latest - 89"""))
def q_recent_actuals(spark, sf_dir):
    from stocklens.operators.serving import recent_actuals
    return recent_actuals(_r(spark, sf_dir).fig11_naive)


@register("forecast_bridge", oracle.q(oracle.FEATURES + oracle.SN_DAILY + oracle.FIG11 + """
SELECT client_id, arg_max(date, date) AS date, arg_max(value, date) AS value,
       CAST(NULL AS DOUBLE) AS lower_ci, CAST(NULL AS DOUBLE) AS upper_ci, 'bridge' AS segment
FROM f11 WHERE type = 'actual' AND client_id IN (SELECT client_id FROM f11 WHERE type = 'forecast')
GROUP BY client_id
UNION ALL
SELECT client_id, date, value, lower_ci, upper_ci, 'forecast' FROM f11 WHERE type = 'forecast'"""))
def q_forecast_bridge(spark, sf_dir):
    from stocklens.operators.serving import forecast_bridge
    return forecast_bridge(_r(spark, sf_dir).fig11_naive)


@register("confidence_band", oracle.q(oracle.FEATURES + oracle.SN_DAILY + oracle.FIG11 + """
SELECT client_id, date, value, type, lower_ci, upper_ci FROM f11
WHERE type = 'forecast' AND lower_ci IS NOT NULL AND upper_ci IS NOT NULL"""))
def q_confidence_band(spark, sf_dir):
    from stocklens.operators.serving import confidence_band
    return confidence_band(_r(spark, sf_dir).fig11_naive)


@register("pareto_segments", oracle.q(oracle.PARETO_BANDS + """
, st AS (SELECT client_id, percentage_category, MIN(rank) AS lo, MAX(rank) AS hi FROM pb GROUP BY client_id, percentage_category),
pv AS (SELECT client_id, percentage_category, LAG(hi) OVER (PARTITION BY client_id ORDER BY lo) AS prev_hi FROM st)
SELECT client_id, rank, product_id, name, sales_quantity, cumulative_pct, percentage_category, false AS carried FROM pb
UNION ALL
SELECT pb.client_id, pb.rank, pb.product_id, pb.name, pb.sales_quantity, pb.cumulative_pct, pv.percentage_category, true
FROM pb JOIN pv ON pb.client_id = pv.client_id AND pb.rank = pv.prev_hi"""))
def q_pareto_segments(spark, sf_dir):
    from stocklens.operators.charts import pareto_bands
    from stocklens.operators.serving import pareto_segments
    return pareto_segments(pareto_bands(_r(spark, sf_dir).pareto))


@register("monthly_chart", oracle.q(oracle.FEATURES + oracle.SN_MONTHLY + """
SELECT client_id, strftime(month_start, '%Y-%m') AS date, (round_even(CAST(avg_invoice_value AS DOUBLE) * 100, 0) / 100) AS value, 'actual' AS type,
       CAST(NULL AS DOUBLE) AS lower_ci, CAST(NULL AS DOUBLE) AS upper_ci FROM monthly
UNION ALL
SELECT client_id, strftime(date, '%Y-%m'), (round_even(CAST(forecast AS DOUBLE) * 100, 0) / 100), 'forecast', (round_even(CAST(lower_ci AS DOUBLE) * 100, 0) / 100), (round_even(CAST(upper_ci AS DOUBLE) * 100, 0) / 100) FROM snm"""))
def q_monthly_chart(spark, sf_dir):
    from pyspark.sql import functions as F
    from stocklens.operators.serving import fig12_rows
    r = _r(spark, sf_dir)
    return fig12_rows(r.monthly_avg_invoice, r.naive_monthly.withColumn("date", F.date_format("date", "yyyy-MM")))


_FC_ROUNDED = ", ".join(f"(round_even(CAST({c} AS DOUBLE) * 100, 0) / 100) AS {c}" for c in ("forecast", "lower_ci", "upper_ci"))


def _rounded_forecast(df):
    from stocklens.functions import round_half_even
    return df.withColumns({c: round_half_even(c, 2) for c in ("forecast", "lower_ci", "upper_ci")})


@register("forecast_daily", oracle.q(oracle.FEATURES + oracle.FC_DAILY + f"SELECT client_id, date, {_FC_ROUNDED} FROM fcd"))
def q_forecast_daily(spark, sf_dir):
    return _rounded_forecast(_r(spark, sf_dir).forecast_daily)


@register("forecast_monthly", oracle.q(oracle.FEATURES + oracle.FC_MONTHLY
                                       + f"SELECT client_id, strftime(date, '%Y-%m') AS date, {_FC_ROUNDED} FROM fcm"))
def q_forecast_monthly(spark, sf_dir):
    return _rounded_forecast(_r(spark, sf_dir).forecast_monthly)


_FR_ROUNDED = _FC_ROUNDED + ", model, CAST(p AS INTEGER) AS n_regressors"


@register("forecast_regressors", oracle.q(oracle.FEATURES + oracle.FUTURE_DAILY + oracle.FR_DAILY
                                          + f"SELECT client_id, date, {_FR_ROUNDED} FROM frd").replace("WITH inv", "WITH RECURSIVE inv", 1))
def q_forecast_regressors(spark, sf_dir):
    return _rounded_forecast(_r(spark, sf_dir).regression_daily)


@register("forecast_regressors_monthly", oracle.q(oracle.FEATURES + oracle.FUTURE_MONTHLY + oracle.FR_MONTHLY
                                                  + f"SELECT client_id, date, {_FR_ROUNDED} FROM frm").replace("WITH inv", "WITH RECURSIVE inv", 1))
def q_forecast_regressors_monthly(spark, sf_dir):
    return _rounded_forecast(_r(spark, sf_dir).regression_monthly)


# --- eligibility guards (GRD) ----------------------------------------------------------

def _status_sql() -> str:
    from stocklens.operators.status import RULES
    parts = []
    for fig, checks, note in RULES:
        case = "CASE " + " ".join(f"WHEN {c} THEN '{code}'" for c, code in checks) + " END"
        note_sql = f"CASE WHEN {note[0]} THEN '{note[1]}' END" if note else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT client_id, '{fig}' AS figure, ({case}) IS NULL AS ok, {case} AS code, {note_sql} AS note FROM stats")
    return oracle.q(oracle.FEATURES + oracle.share_ctes("sales_amount", "r") + oracle.share_ctes("net_profit", "p") + """
, clients AS (SELECT DISTINCT client_id FROM inv UNION SELECT DISTINCT client_id FROM prod),
pf_s AS (
  SELECT client_id, COUNT(*) AS n_pf,
         CAST(CAST(SUM(CAST(sales_quantity * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS sold_total,
         COUNT(CASE WHEN sales_quantity > 0 THEN 1 END) AS n_sold,
         COUNT(CASE WHEN efficiency <> 'N/A' THEN 1 END) AS n_valid_eff,
         CAST(CAST(SUM(CAST(sales_amount * pow(2, 70) AS HUGEINT)) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS revenue,
         COUNT(buy_price) AS n_cost,
         CAST(CAST(SUM(CASE WHEN efficiency IN ('Undersupplied', 'Balanced', 'Oversupplied')
                            THEN CAST((current_stock + sales_quantity) * pow(2, 70) AS HUGEINT) END) AS VARCHAR) AS DOUBLE) / pow(2, 70) AS eff_total,
         COUNT(CASE WHEN sale_price > 0 AND sales_quantity > 0 THEN 1 END) AS n_scatter,
         COUNT(CASE WHEN current_stock <= 10 THEN 1 END) AS n_restock,
         COUNT(CASE WHEN days_since_last_sale >= 90 AND days_since_last_sale < 99999 THEN 1 END) AS n_stagnant,
         CAST(FLOOR((epoch_us(MAX(last_sale_date)) - epoch_us(MIN(last_sale_date))) / 86400000000.0) AS BIGINT) AS last_span_days
  FROM pf GROUP BY client_id
),
det_s AS (
  SELECT client_id, COUNT(*) AS n_details,
         CAST(FLOOR((epoch_us(MAX(created_at)) - epoch_us(MIN(created_at))) / 86400000000.0) AS BIGINT) AS detail_span_days,
         CAST(date_diff('day', MIN(day), MAX(day)) + 1 AS BIGINT) AS n_days
  FROM det GROUP BY client_id
),
stats AS (
  SELECT c.client_id,
         COALESCE(n_pf, 0) AS n_pf, COALESCE(sold_total, 0) AS sold_total, COALESCE(n_sold, 0) AS n_sold,
         COALESCE(n_valid_eff, 0) AS n_valid_eff, COALESCE(revenue, 0) AS revenue, COALESCE(n_cost, 0) AS n_cost,
         COALESCE(eff_total, 0) AS eff_total, COALESCE(n_scatter, 0) AS n_scatter, COALESCE(n_restock, 0) AS n_restock,
         COALESCE(n_stagnant, 0) AS n_stagnant, last_span_days,
         COALESCE((SELECT COUNT(*) FROM pareto x WHERE x.client_id = c.client_id), 0) AS n_pareto,
         COALESCE((SELECT COUNT(*) FROM r_shares x WHERE x.client_id = c.client_id AND x.value > 1e-6), 0)
           + COALESCE((SELECT COUNT(*) FROM p_shares x WHERE x.client_id = c.client_id AND x.value > 1e-6), 0) AS n_shares,
         COALESCE(n_details, 0) AS n_details, detail_span_days, COALESCE(n_days, 0) AS n_days,
         COALESCE((SELECT COUNT(*) FROM feat x WHERE x.client_id = c.client_id), 0) AS n_feature_days,
         COALESCE((SELECT COUNT(*) FROM monthly x WHERE x.client_id = c.client_id), 0) AS n_months,
         COALESCE((SELECT COUNT(*) FROM dfr x WHERE x.client_id = c.client_id), 0) AS n_deferred,
         COALESCE((SELECT COUNT(*) FROM owed x WHERE x.client_id = c.client_id), 0) AS n_outstanding
  FROM clients c LEFT JOIN pf_s USING (client_id) LEFT JOIN det_s USING (client_id)
)
""" + "\nUNION ALL\n".join(parts))


@register("chart_status", _status_sql())
def q_chart_status(spark, sf_dir):
    return _r(spark, sf_dir).chart_status


# --- documents, localisation and sinks (LOC, SNK) --------------------------------------

@register("chart_docs")
def q_chart_docs(spark, sf_dir):
    from stocklens.operators.docs import chart_docs
    return chart_docs(_r(spark, sf_dir))


@register("chart_records")
def q_chart_records(spark, sf_dir):
    """Localised data records of every list-shaped figure (before paging)."""
    from stocklens.operators.docs import records
    return records(_r(spark, sf_dir))


def _record_values_sql() -> str:
    from stocklens.operators.i18n import load_dictionaries
    return oracle.record_values({la: load_dictionaries()[la] for la in ("en", "ar")})


@register("chart_record_values", _record_values_sql())
def q_chart_record_values(spark, sf_dir):
    """LOC-03/05/06: the records of every list-shaped figure in both languages, parsed back from
    their JSON: each localised key with its number or text."""
    from pyspark.sql import functions as F
    from stocklens.operators.docs import records
    parsed = records(_r(spark, sf_dir)).select("client_id", "figure", "lang", "seq", F.explode(F.from_json("record", "map<string,string>")).alias("key", "value"))
    number = F.col("value").try_cast("double")
    return parsed.select("client_id", "figure", "lang", "seq", "key", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


def _labels_sql() -> str:
    from stocklens.operators.i18n import load_dictionaries
    words = [(lang, k.split(".", 1)[1], v) for lang in ("en", "ar") for k, v in sorted(load_dictionaries()[lang].items())
             if k.startswith("efficiency_labels.")]
    rows = ", ".join("('" + "', '".join(x.replace("'", "''") for x in w) + "')" for w in words)
    return oracle.q(f"""
, tr(lang, efficiency, text) AS (VALUES {rows}),
l AS (SELECT *, CASE CAST(product_id AS BIGINT) % 4 WHEN 0 THEN 'AR' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE 'ar' END AS lang,
        CASE WHEN CAST(product_id AS BIGINT) % 5 = 0 THEN efficiency || '?' ELSE efficiency END AS word FROM pf)
SELECT l.client_id, l.product_id, l.efficiency, l.lang, COALESCE(t.text, 'no ' || l.efficiency) AS label
FROM l LEFT JOIN tr t ON lower(l.lang) = t.lang AND l.word = t.efficiency""")


@register("translated_labels", _labels_sql())
def q_translated_labels(spark, sf_dir):
    """LOC-02: product efficiency labels translated through the (lang, key, text) table: two
    languages, one unknown language, some missing keys."""
    from pyspark.sql import functions as F
    from stocklens.operators.i18n import translate, translations
    pf = _r(spark, sf_dir).product_flow.select("client_id", "product_id", "efficiency")
    n = F.col("product_id").cast("long")
    lang = F.when(n % 4 == 0, "AR").when(n % 4 == 1, "en").when(n % 4 == 2, "fr").otherwise("ar")
    word = F.when(n % 5 == 0, F.concat("efficiency", F.lit("?"))).otherwise(F.col("efficiency"))
    return translate(pf.withColumn("lang", lang), F.concat(F.lit("efficiency_labels."), word), F.col("lang"),
                     translations(spark), F.concat(F.lit("no "), F.col("efficiency")), out="label")


# --- remaining cleaning operators and the V2 day count ----------------------------------

@register("clean_products", oracle.q(
    "SELECT client_id, product_id, name, buy_price, sale_price, current_stock FROM prod"))
def q_clean_products(spark, sf_dir):
    return _r(spark, sf_dir).products


@register("clean_deferreds", oracle.q(
    "SELECT client_id, invoice_type, status, amount, paid_amount, user_id FROM dfr"))
def q_clean_deferreds(spark, sf_dir):
    return _r(spark, sf_dir).deferreds


@register("days_since_by_date", oracle.q("""
SELECT client_id, product_id, last_sale_date,
       COALESCE(CAST(date_diff('day', CAST(last_sale_date AS DATE), DATE '2001-12-31') AS INTEGER), 99999) AS days_since_last_sale
FROM sales"""))
def q_days_since_by_date(spark, sf_dir):
    """ANL-06 with mode="date" (plain date difference, the V2 variant)."""
    from stocklens.plans.retail import TPCH_AS_OF
    r = Retail(_r(spark, sf_dir).raw, TPCH_AS_OF, days_mode="date")
    return r.product_flow.select("client_id", "product_id", "last_sale_date", "days_since_last_sale")


@register("feature_dates", oracle.q(
    "SELECT client_id, invoice_id, CAST(created_at AS DATE) AS sale_date FROM inv"))
def q_feature_dates(spark, sf_dir):
    """CLN-09: strict date column for the feature table (unparsable dates dropped)."""
    from stocklens.operators.cleaning import feature_dates
    inv = _r(spark, sf_dir).raw["sale_invoices"]
    return feature_dates(inv.withColumnRenamed("id", "invoice_id")).select("client_id", "invoice_id", "sale_date")


# --- customers as clients: small clients, on which every guard fires ---------------------

def _customer_retail(spark, sf_dir, faults: bool = False) -> Retail:
    """The driver's tables with every customer as a client of its own: its orders, the parts
    it bought as its catalogue. With ``faults``, by client id modulo 5: 0 sold no quantity, 1
    lists no prices, 2 took no money, 3 has no sales at all, 4 sold within a few days."""
    import os
    from pyspark.sql import functions as F
    from stocklens.plans.retail import TPCH_AS_OF
    raw = _r(spark, sf_dir).raw
    orders = spark.read.parquet(os.path.join(sf_dir, "orders.parquet"))
    who = orders.select(F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").cast("long").alias("client_id"))
    invoices = raw["sale_invoices"].drop("client_id").join(who, F.col("id") == F.col("invoice_id")).drop("invoice_id")
    details = raw["sale_invoices_details"]
    part = spark.read.parquet(os.path.join(sf_dir, "part.parquet"))
    bought = details.join(who, "invoice_id").select("client_id", F.col("product_id").alias("p_partkey")).distinct()
    stock = ((F.col("p_partkey") * 37 + F.col("client_id") * 101) % 400).cast("double")
    products = bought.join(part, "p_partkey").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_retailprice") * 0.6).alias("buyPrice"),
        F.col("p_retailprice").alias("salePrice"), stock.alias("quantity"), "client_id")
    if faults:
        kind, own = F.col("client_id") % 5, details.columns
        details = details.join(who, "invoice_id").filter(kind != 3).withColumns({
            "quantity": F.when(kind == 0, 0.0).otherwise(F.col("quantity")), "totalPrice": F.when(kind == 2, 0.0).otherwise(F.col("totalPrice")),
            "created_at": F.when(kind == 4, F.date_add(F.lit("2001-06-01").cast("date"), (F.col("id") % 100).cast("int")).cast("timestamp"))
                           .otherwise(F.col("created_at").cast("timestamp"))}).select(*own)
        products = products.withColumn("salePrice", F.when(kind == 1, 0.0).otherwise(F.col("salePrice")))
    lineitem = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    returned = lineitem.filter("l_returnflag = 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    deferreds = returned.select(
        F.lit(params.BUY_INVOICE_TYPE).alias("invoice_type"),
        F.when(F.col("o_orderstatus") == "O", 0.0).when(F.col("o_orderstatus") == "P", 2.0).otherwise(1.0).alias("status"),
        F.col("l_extendedprice").alias("amount"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid_amount"),
        F.col("l_suppkey").alias("user_id"), F.col("o_custkey").cast("long").alias("client_id"))
    return Retail({"products": products, "sale_invoices": invoices, "sale_invoices_details": details,
                   "invoice_deferreds": deferreds}, TPCH_AS_OF)


def _customer_status_sql() -> str:
    """Written out by hand, independent of the rule table."""
    base = _status_sql().split("\nSELECT client_id, 'fig1'")[0]
    base = base.replace("CAST(n.n_regionkey AS BIGINT) AS client_id", "CAST(o.o_custkey AS BIGINT) AS client_id")
    base = base.replace("""  SELECT CAST(r.r_regionkey AS BIGINT) AS client_id, CAST(p.p_partkey AS VARCHAR) AS product_id,""",
                        """  SELECT DISTINCT i.client_id, CAST(p.p_partkey AS VARCHAR) AS product_id,""")
    base = base.replace("CAST((p.p_partkey * 37 + r.r_regionkey * 101) % 400 AS DOUBLE)", "CAST((p.p_partkey * 37 + i.client_id * 101) % 400 AS DOUBLE)")
    base = base.replace("FROM part p CROSS JOIN region r", "FROM lineitem l JOIN inv i ON l.l_orderkey = i.invoice_id JOIN part p ON l.l_partkey = p.p_partkey")
    base = base.replace("""         CAST(l.l_suppkey AS VARCHAR) AS user_id
  FROM lineitem l JOIN inv i ON l.l_orderkey = i.invoice_id
""", """         CAST(l.l_suppkey AS VARCHAR) AS user_id
  FROM lineitem l JOIN inv i ON l.l_orderkey = i.invoice_id WHERE l.l_returnflag = 'R'
""")
    return base + """
SELECT client_id, figure, code IS NULL AS ok, code, note FROM (
  SELECT client_id, unnest([
    {'figure': 'fig1', 'code': CASE WHEN n_pf < 1 THEN 'no_product_flow' WHEN NOT sold_total > 0 THEN 'no_sales' END, 'note': CASE WHEN last_span_days <= 29 THEN 'short_sales_period' END},
    {'figure': 'fig2', 'code': CASE WHEN n_pf < 1 THEN 'no_product_flow' WHEN n_valid_eff < 1 THEN 'no_efficiency_data' END, 'note': NULL},
    {'figure': 'fig3', 'code': CASE WHEN n_pf < 1 THEN 'no_product_flow' WHEN NOT revenue > 0 THEN 'no_sales' WHEN n_cost < 1 THEN 'missing_cost_data' END, 'note': NULL},
    {'figure': 'fig4', 'code': CASE WHEN n_pf < 1 THEN 'no_product_flow' WHEN NOT sold_total > 0 THEN 'no_sales' END, 'note': CASE WHEN last_span_days <= 29 THEN 'short_sales_period' END},
    {'figure': 'fig5', 'code': CASE WHEN n_pf < 1 THEN 'no_product_flow' WHEN NOT eff_total > 0 THEN 'no_efficiency_data' END, 'note': NULL},
    {'figure': 'fig6', 'code': CASE WHEN n_pareto < 1 THEN 'no_pareto_data' END, 'note': NULL},
    {'figure': 'fig7', 'code': CASE WHEN n_scatter < 1 THEN 'no_scatter_points' END, 'note': NULL},
    {'figure': 'fig9', 'code': CASE WHEN n_pf < 1 THEN 'no_product_flow' WHEN n_restock < 1 THEN 'no_restock_needed' END, 'note': NULL},
    {'figure': 'fig10', 'code': CASE WHEN n_details >= 1 AND detail_span_days <= 89 THEN 'insufficient_history' WHEN n_stagnant < 1 THEN 'no_stagnant_found' END, 'note': NULL},
    {'figure': 'fig11', 'code': CASE WHEN n_details < 1 THEN 'no_details_data' WHEN n_days < 1 THEN 'no_actual_sales' END, 'note': CASE WHEN n_feature_days <= 359 THEN 'forecast_unavailable_data' END},
    {'figure': 'fig12', 'code': CASE WHEN n_months < 1 THEN 'no_ts_data' WHEN n_months = 1 THEN 'insufficient_actual_months' END, 'note': CASE WHEN n_months <= 11 THEN 'short_monthly_history' END},
    {'figure': 'fig13', 'code': CASE WHEN n_sold < 1 THEN 'no_sold_products' WHEN n_sold < 11 THEN 'insufficient_product_count' END, 'note': NULL},
    {'figure': 'fig14', 'code': CASE WHEN n_sold < 1 THEN 'no_sales_found' END, 'note': CASE WHEN n_sold <= 19 THEN 'low_product_variety' END},
    {'figure': 'fig15', 'code': CASE WHEN n_sold < 1 THEN 'no_sold_products' WHEN n_sold < 11 THEN 'insufficient_product_count' END, 'note': NULL},
    {'figure': 'fig16', 'code': CASE WHEN n_shares < 1 THEN 'no_valid_data' END, 'note': CASE WHEN n_pf <= 9 THEN 'few_products' END},
    {'figure': 'fig17', 'code': CASE WHEN n_deferred < 1 THEN 'no_deferred_data' WHEN n_outstanding < 1 THEN 'no_outstanding_found' END, 'note': NULL}
  ], recursive := true) FROM stats)
"""


@register("customer_chart_status", _customer_status_sql())
def q_customer_chart_status(spark, sf_dir):
    return _customer_retail(spark, sf_dir).chart_status


def _faulty_status_sql() -> str:
    sql = _customer_status_sql()
    for old, new in (
        ("l.l_quantity AS quantity, l.l_extendedprice AS total_price,",
         "CASE WHEN i.client_id % 5 = 0 THEN 0.0 ELSE l.l_quantity END AS quantity, CASE WHEN i.client_id % 5 = 2 THEN 0.0 ELSE l.l_extendedprice END AS total_price,"),
        ("l.l_extendedprice - (p.p_retailprice * 0.6) * l.l_quantity AS net_profit",
         "CASE WHEN i.client_id % 5 = 2 THEN 0.0 ELSE l.l_extendedprice END - (p.p_retailprice * 0.6) * CASE WHEN i.client_id % 5 = 0 THEN 0.0 ELSE l.l_quantity END AS net_profit"),
        ("CAST(l.l_shipdate AS TIMESTAMP) AS created_at, CAST(l.l_shipdate AS DATE) AS day",
         "CAST(CASE WHEN i.client_id % 5 = 4 THEN DATE '2001-06-01' + CAST(l.l_linenumber AS INTEGER) ELSE CAST(l.l_shipdate AS DATE) END AS TIMESTAMP) AS created_at, "
         "CASE WHEN i.client_id % 5 = 4 THEN DATE '2001-06-01' + CAST(l.l_linenumber AS INTEGER) ELSE CAST(l.l_shipdate AS DATE) END AS day"),
        ("  JOIN part p ON l.l_partkey = p.p_partkey\n),", "  JOIN part p ON l.l_partkey = p.p_partkey WHERE i.client_id % 5 <> 3\n),"),
        ("p.p_retailprice AS sale_price,", "CASE WHEN i.client_id % 5 = 1 THEN 0.0 ELSE p.p_retailprice END AS sale_price,"),
    ):
        assert old in sql, old
        sql = sql.replace(old, new, 1)
    return sql


@register("faulty_chart_status", _faulty_status_sql())
def q_faulty_chart_status(spark, sf_dir):
    """GRD-01..11 on clients without sales, quantities, prices, income or history: every condition
    that data can show fires."""
    return _customer_retail(spark, sf_dir, faults=True).chart_status


@register("forecast_gates", oracle.q(oracle.FEATURES + """
, d AS (SELECT client_id, sale_date, ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY sale_date) AS t FROM feat),
m AS (SELECT client_id, month_start, ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY month_start) AS t FROM monthly)
SELECT client_id * 10 + 1 AS client_id, 'daily' AS series, strftime(sale_date + CAST(h AS INTEGER), '%Y-%m-%d') AS date FROM d, range(1, 15) g(h) WHERE t = 360
UNION ALL
SELECT client_id * 10 + 1, 'monthly', strftime(CAST(month_start + to_months(CAST(h AS INTEGER)) AS DATE), '%Y-%m') FROM m, range(1, 7) g(h) WHERE t = 36"""))
def q_forecast_gates(spark, sf_dir):
    """FCS-01: every client's series cut to 359 and 360 days, and to 35 and 36 months; only the longer
    ones are forecast."""
    from pyspark.sql import Window, functions as F
    from stocklens.operators import forecast
    from stocklens.operators.features import monthly_features
    r = _r(spark, sf_dir)

    def cut(df, date, n):
        t = F.row_number().over(Window.partitionBy("client_id").orderBy(date))
        both = df.withColumn("_t", t).withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1))))
        return both.filter(F.col("_t") < n + F.col("_k")).withColumn("client_id", F.col("client_id") * 10 + F.col("_k")).drop("_t", "_k")

    daily = forecast.forecast_daily(cut(r.daily_features, "sale_date", 360))
    monthly = forecast.forecast_monthly(monthly_features(cut(r.monthly_avg_invoice, "month_start", 36)))
    return (daily.select("client_id", F.lit("daily").alias("series"), F.date_format("date", "yyyy-MM-dd").alias("date"))
            .unionByName(monthly.select("client_id", F.lit("monthly").alias("series"), "date")))


# --- dirty text derived from the whole tables (CLN-01..03, money) -----------------------

@register("dirty_numbers", """
SELECT l_orderkey, l_linenumber, v AS value, inf AS infinite,
       CASE WHEN bool_or(inf) OVER (PARTITION BY l_orderkey) THEN NULL
            ELSE CAST(ROUND(SUM(CAST(v AS DECIMAL(30,8))) OVER (PARTITION BY l_orderkey), 0) AS BIGINT) END AS order_total
FROM (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 7 = 2 AS inf,
        CASE (l_orderkey + l_linenumber) % 7 WHEN 1 THEN l_quantity WHEN 3 THEN 0.00004 WHEN 4 THEN 1e15 ELSE 0.0 END AS v FROM lineitem)
""")
def q_dirty_numbers(spark, sf_dir):
    """CLN-01 and exact sums on text: '12d', padded numbers, 'inf', 0.00004, 1e15, blanks, nulls."""
    import os
    from pyspark.sql import functions as F
    from stocklens.functions import exact_sum, num0
    li = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    k, qty = (F.col("l_orderkey") + F.col("l_linenumber")) % 7, F.col("l_quantity").cast("string")
    text = (F.when(k == 0, F.concat(qty, F.lit("d"))).when(k == 1, F.concat(F.lit("  "), qty, F.lit(" "))).when(k == 2, "inf")
            .when(k == 3, "0.00004").when(k == 4, "1e15").when(k == 5, " "))
    rows = li.select("l_orderkey", "l_linenumber", num0(text).alias("v"))
    total = rows.groupBy("l_orderkey").agg(exact_sum("v").alias("t"))
    inf = lambda c: F.col(c) == F.lit(float("inf"))
    return rows.join(total, "l_orderkey").select(
        "l_orderkey", "l_linenumber", F.when(inf("v"), 0.0).otherwise(F.col("v")).alias("value"), inf("v").alias("infinite"),
        F.when(~inf("t"), F.round(F.col("t")).cast("long")).alias("order_total"))


@register("dirty_keys", """
SELECT o_orderkey,
  CASE o_orderkey % 6 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey WHEN 2 THEN 9007199254740993 + o_orderkey
                      WHEN 3 THEN NULL WHEN 4 THEN o_orderkey * 1000 ELSE NULL END AS key_number,
  CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey AS VARCHAR)
                      WHEN 2 THEN CAST(9007199254740993 + o_orderkey AS VARCHAR) WHEN 3 THEN o_orderkey || 'd'
                      WHEN 4 THEN o_orderkey || 'e3' ELSE 'nan' END AS key_name,
  (SELECT COUNT(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND o.o_orderkey % 6 < 2) AS n_details
FROM orders o""")
def q_dirty_keys(spark, sf_dir):
    """CLN-02 and SRC-02 on text ids: '12.0', padded, 17 digits, '12d', '12e3', null; details meet
    their invoice by normalised id."""
    import os
    from pyspark.sql import functions as F
    from stocklens.functions import key_int, key_text
    from stocklens.sources.tables import scope_details
    o = spark.read.parquet(os.path.join(sf_dir, "orders.parquet")).select("o_orderkey")
    k, s = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    text = (F.when(k == 0, F.concat(s, F.lit(".0"))).when(k == 1, F.concat(F.lit(" "), s))
            .when(k == 2, (F.col("o_orderkey") + F.lit(9007199254740993)).cast("string"))
            .when(k == 3, F.concat(s, F.lit("d"))).when(k == 4, F.concat(s, F.lit("e3"))))
    keyed = o.withColumn("text", text)
    invoices = keyed.filter(F.col("o_orderkey") % 6 < 2).select(F.col("text").alias("id"), F.lit(1).cast("long").alias("client_id"), F.lit(None).cast("string").alias("created_at"))
    details = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet")).select(F.col("l_orderkey").cast("double").cast("string").alias("invoice_id"))
    n = (scope_details(details, invoices).groupBy(key_int("invoice_id").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n")))
    return keyed.join(n, "o_orderkey", "left").select(
        "o_orderkey", key_int("text").alias("key_number"), key_text("text", params.NULL_PRODUCT_KEY).alias("key_name"),
        F.coalesce("n", F.lit(0)).alias("n_details"))


@register("dirty_dates", """
SELECT o_orderkey, CASE WHEN s <= 1 THEN DATE '1970-01-01' WHEN s BETWEEN 2 AND 106751 AND s <> 60 THEN DATE '1899-12-30' + CAST(s AS INTEGER) END AS from_serial,
  CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN NULL
                      WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS from_text
FROM (SELECT *, (o_orderkey * 37) % 150000 AS s FROM orders)""")
def q_dirty_dates(spark, sf_dir):
    """CLN-03: serials up to and beyond the last timestamp (106751); ISO, yyyyMMdd and month-name
    text, dates after 2262, numeric text."""
    import os
    from pyspark.sql import functions as F, types as T
    from stocklens.functions import parse_mixed_date
    o = spark.read.parquet(os.path.join(sf_dir, "orders.parquet"))
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyyMMdd")).when(k == 2, "2262-04-12")
            .when(k == 3, "45000").otherwise(F.date_format(day, "MMM d yyyy")))
    rows = o.select("o_orderkey", ((F.col("o_orderkey") * 37) % 150000).cast("double").alias("serial"), text.alias("text"))
    return rows.select("o_orderkey", F.to_date(parse_mixed_date("serial", T.DoubleType())).alias("from_serial"),
                       F.to_date(parse_mixed_date("text", T.StringType())).alias("from_text"))


# --- sources and sinks: a round trip through files (SRC-01..04, SNK-01) ------------------

@register("xlsx_round_trip", oracle.q("""
SELECT d.client_id, d.detail_id, d.product_id, d.invoice_id, d.quantity, d.total_price, d.buy_price, d.created_at, d.net_profit, d.day FROM det d"""))
def q_xlsx_round_trip(spark, sf_dir):
    """SRC-06: invoices and details written as workbooks, read back by row ranges and cleaned."""
    import uuid
    from stocklens.operators.cleaning import clean_details
    from stocklens.session import ensure_checkpoint_dir
    from stocklens.sources import xlsx
    from stocklens.sources.tables import read_spreadsheet, scope_details
    raw = _r(spark, sf_dir).raw
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/workbooks-{uuid.uuid4().hex[:12]}"
    xlsx.register(spark)
    for name in ("sale_invoices", "sale_invoices_details"):
        raw[name].write.format("xlsx").mode("append").save(f"{root}/{name}")
    invoices, details = (read_spreadsheet(spark, f"{root}/{name}", name, {"rows": 5_000}) for name in ("sale_invoices", "sale_invoices_details"))
    return clean_details(scope_details(details, invoices)).drop("invoice_day")


@register("source_round_trip", oracle.q(f"SELECT {PF_COLS} FROM pf WHERE client_id IN (1, 3)"))
def q_source_round_trip(spark, sf_dir):
    """The raw tables written as Parquet, read back for two clients (the debts are missing), and
    the product flow written per client and read again."""
    import uuid
    from pyspark.sql import functions as F
    from stocklens.plans.retail import TPCH_AS_OF
    from stocklens.session import ensure_checkpoint_dir
    from stocklens.sources import sinks
    raw = _r(spark, sf_dir).raw
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/round-trip-{uuid.uuid4().hex[:12]}"
    for name in ("products", "sale_invoices", "sale_invoices_details"):
        raw[name].write.parquet(f"{root}/src/{name}")
    flows = [Retail.from_source(spark, f"{root}/src", TPCH_AS_OF, client_ids=[c]).product_flow for c in (1, 3)]
    for pf in flows:                              # the second run leaves the first client's files alone
        sinks.write_analytics({"product_flow": pf}, f"{root}/out")
    back = spark.read.parquet(f"{root}/out/product_flow")
    return back.withColumn("client_id", F.col("client_id").cast("long")).select(*flows[0].columns)


# --- drop counters, document store, snapshots, nested files -------------------------------

@register("drop_counts", """
WITH inv AS (
  SELECT o_orderkey, o_orderkey % 6 IN (3, 5) AS no_id, o_orderkey % 5 IN (2, 3) AS no_date FROM orders),
det AS (
  SELECT i.no_date AND (l_orderkey + l_linenumber) % 3 <> 2 AS no_date FROM lineitem l JOIN inv i ON l.l_orderkey = i.o_orderkey WHERE NOT i.no_id)
SELECT 'sale_invoices' AS table_name, reason, n FROM (
  SELECT unnest(['rows', 'no_invoice_id', 'no_date', 'kept']) AS reason,
         unnest([COUNT(*), COUNT(*) FILTER (no_id), COUNT(*) FILTER (no_date AND NOT no_id), COUNT(*) FILTER (NOT no_date AND NOT no_id)]) AS n FROM inv)
UNION ALL
SELECT 'sale_invoices_details', reason, n FROM (
  SELECT unnest(['rows', 'no_invoice_id', 'no_date', 'kept']) AS reason,
         unnest([COUNT(*), 0, COUNT(*) FILTER (no_date), COUNT(*) FILTER (NOT no_date)]) AS n FROM det)""")
def q_drop_counts(spark, sf_dir):
    """CLN-05/06/09: rows dropped by reason, counted in the pass that cleans dirty invoices and
    details derived from the whole tables."""
    import os
    from pyspark.sql import functions as F
    from stocklens.operators.cleaning import Drops, clean_details, clean_invoices
    from stocklens.sources.tables import scope_details
    orders = spark.read.parquet(os.path.join(sf_dir, "orders.parquet"))
    lines = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    invoices = orders.select(
        F.when(key % 6 == 3, F.concat(text, F.lit("d"))).when(key % 6 == 5, None).otherwise(text).alias("id"), F.lit(1).cast("long").alias("client_id"),
        F.when(key % 5 == 2, "2262-04-12").when(key % 5 == 3, "45000").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("created_at"),
        F.col("o_totalprice").alias("totalPrice"))
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 3
    details = lines.select(
        F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("product_id"), F.col("l_orderkey").cast("string").alias("invoice_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("totalPrice"), F.lit(1.0).alias("buyPrice"),
        F.when(kind == 1, "junk").when(kind == 2, F.date_format("l_shipdate", "yyyyMMdd")).alias("created_at"))
    drops = Drops()
    for cleaned in (clean_invoices(invoices, drops), clean_details(scope_details(details, invoices), drops)):
        cleaned.write.format("noop").mode("overwrite").save()
    return drops.table(spark)


@register("document_lookup", oracle.q("""
, recs AS (SELECT client_id, product_id, current_stock, ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY current_stock, product_id) - 1 AS seq
           FROM pf WHERE current_stock <= 10)
SELECT client_id, 'fig9' AS figure, CASE WHEN client_id % 2 = 0 THEN 'ar' ELSE 'en' END AS lang, CAST(seq // 5 AS INTEGER) AS page,
       CAST(COUNT(*) AS INTEGER) AS n_records, MIN_BY(product_id, seq) AS first_product FROM recs GROUP BY ALL"""))
def q_document_lookup(spark, sf_dir):
    """SNK-03: documents of every client written to a store, then looked up by key: Arabic for even
    clients, an unknown language (so English) for the others."""
    import uuid
    from functools import reduce
    from pyspark.sql import Window, functions as F
    from stocklens.operators.charts import restock
    from stocklens.operators.docs import _pages
    from stocklens.session import ensure_checkpoint_dir
    from stocklens.sources import sinks
    by_stock = Window.partitionBy("client_id").orderBy("current_stock", "product_id")
    rows = restock(_r(spark, sf_dir).product_flow).withColumn("seq", F.row_number().over(by_stock)).select(
        "client_id", F.lit("fig9").alias("figure"), F.explode(F.array(F.lit("en"), F.lit("ar"))).alias("lang"),
        F.struct("product_id", "current_stock").alias("r"), "seq")
    docs = _pages(rows.select("client_id", "figure", "lang", "seq", F.to_json("r").alias("record")), 5)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex[:12]}"
    sinks.write_doc_store(docs, path)
    found = reduce(lambda a, b: a.unionByName(b), [sinks.lookup_doc(spark, path, c, "fig9", "AR" if c % 2 == 0 else "fr") for c in range(5)])
    return found.select("client_id", "figure", "lang", "page", F.json_array_length("data").alias("n_records"),
                        F.get_json_object("data", "$[0].product_id").alias("first_product"))


@register("snapshot_publish", oracle.q(f"SELECT {PF_COLS} FROM pf"))
def q_snapshot_publish(spark, sf_dir):
    """SNK-02/05: two refreshes published one after the other and one that fails half way; a reader
    sees the last whole one."""
    import uuid
    from stocklens.session import ensure_checkpoint_dir
    from stocklens.sources import sinks
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex[:12]}"
    pf = _r(spark, sf_dir).product_flow

    def refresh(df, fails=False):
        def write(folder):
            df.write.parquet(f"{folder}/product_flow")
            if fails:
                raise RuntimeError("the run ends here")
        return write

    sinks.publish_snapshot(spark, root, refresh(pf.filter("client_id = 1")))
    sinks.publish_snapshot(spark, root, refresh(pf))
    try:
        sinks.publish_snapshot(spark, root, refresh(pf.filter("client_id = 2"), fails=True))
    except RuntimeError:
        pass
    return spark.read.parquet(f"{sinks.snapshot(spark, root)}/product_flow")


@register("translations_flat", """
SELECT c_custkey, substr(t.fullkey, 3) AS key, t.value ->> '$' AS text
FROM (SELECT c_custkey, json_object('name', c_name, 'note', CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END, 'tags', json_array('a', c_mktsegment),
             'none', json_object(), 'nation', json_object('name', n_name, 'region', json_object('name', r_name, 'key', r_regionkey))) AS doc
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) d, json_tree(d.doc) t
WHERE t.type <> 'OBJECT' AND NOT contains(t.fullkey, '[')""")
def q_translations_flat(spark, sf_dir):
    """LOC-01: a nested document for every customer, flattened to dotted keys."""
    import os
    from pyspark.sql import functions as F
    from stocklens.operators.i18n import flatten_json
    customer, nation, region = (spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    doc = F.struct(
        F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("note"), F.array(F.lit("a"), "c_mktsegment").alias("tags"),
        F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")).alias("region")).alias("nation"))
    text = F.to_json(doc, {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"none":{},'), F.substring(text, 2, 1 << 30))
    return flatten_json(rows.select("c_custkey", text.alias("text")), keep=("c_custkey",))
