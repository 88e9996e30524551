"""GRD-01..15: per-client, per-figure eligibility ``(client_id, figure, ok, code, note)``.

One small per-client aggregate per source (product flow, Pareto, details, series,
debts), joined on client_id (one row per client each), then one condition chain per
figure, exploded to rows. Nothing here scales with more than the client count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from stocklens import params
from stocklens.functions import exact_sum

# Figure rules as (figure, [(condition, code), ...], (condition, note)).
# Conditions read the per-client counts below; the first true condition gives the code.
# missing_cost_data cannot fire, as in the contract: missing cost prices are filled with 0.
RULES = [
    ("fig1", [("n_pf = 0", "no_product_flow"), ("sold_total <= 0", "no_sales")],
     ("last_span_days < 30", "short_sales_period")),
    ("fig2", [("n_pf = 0", "no_product_flow"), ("n_valid_eff = 0", "no_efficiency_data")], None),
    ("fig3", [("n_pf = 0", "no_product_flow"), ("revenue <= 0", "no_sales"), ("n_cost = 0", "missing_cost_data")], None),
    ("fig4", [("n_pf = 0", "no_product_flow"), ("sold_total <= 0", "no_sales")],
     ("last_span_days < 30", "short_sales_period")),
    ("fig5", [("n_pf = 0", "no_product_flow"), ("eff_total <= 0", "no_efficiency_data")], None),
    ("fig6", [("n_pareto = 0", "no_pareto_data")], None),
    ("fig7", [("n_scatter = 0", "no_scatter_points")], None),
    ("fig9", [("n_pf = 0", "no_product_flow"), ("n_restock = 0", "no_restock_needed")], None),
    ("fig10", [("n_details > 0 AND detail_span_days < 90", "insufficient_history"),
               ("n_stagnant = 0", "no_stagnant_found")], None),
    ("fig11", [("n_details = 0", "no_details_data"), ("n_days = 0", "no_actual_sales")],
     ("n_feature_days < 360", "forecast_unavailable_data")),
    ("fig12", [("n_months = 0", "no_ts_data"), ("n_months < 2", "insufficient_actual_months")],
     ("n_months < 12", "short_monthly_history")),
    ("fig13", [("n_sold = 0", "no_sold_products"), ("n_sold <= 10", "insufficient_product_count")], None),
    ("fig14", [("n_sold = 0", "no_sales_found")], ("n_sold < 20", "low_product_variety")),
    ("fig15", [("n_sold = 0", "no_sold_products"), ("n_sold <= 10", "insufficient_product_count")], None),
    ("fig16", [("n_shares = 0", "no_valid_data")], ("n_pf < 10", "few_products")),
    ("fig17", [("n_deferred = 0", "no_deferred_data"), ("n_outstanding = 0", "no_outstanding_found")], None),
]

STAT_COLUMNS = ["n_pf", "sold_total", "n_sold", "n_valid_eff", "revenue", "n_cost", "eff_total", "n_scatter",
                "n_restock", "n_stagnant", "last_span_days", "n_pareto", "n_shares", "n_details",
                "detail_span_days", "n_days", "n_feature_days", "n_months", "n_deferred", "n_outstanding"]


def _span_days(lo, hi):
    from stocklens.functions.labels import whole_days_between
    return whole_days_between(lo, hi)


def client_stats(clients: DataFrame, pf: DataFrame, pareto: DataFrame, shares: DataFrame,
                 details: DataFrame, daily_features: DataFrame, monthly: DataFrame,
                 deferreds: DataFrame, outstanding: DataFrame,
                 keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """One row per client. ``keep`` is given every aggregate but the product flow's with a name:
    written one after the other, their shuffles need not fit the disks together."""
    qty, stock = F.col("sales_quantity"), F.col("current_stock")
    cnt = lambda cond: F.count(F.when(cond, F.lit(1)))
    days = F.col("days_since_last_sale")
    pf_s = pf.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_pf"),
        exact_sum("sales_quantity").alias("sold_total"),
        cnt(qty > 0).alias("n_sold"),
        cnt(F.col("efficiency") != params.EFFICIENCY_NA).alias("n_valid_eff"),
        exact_sum("sales_amount").alias("revenue"),
        F.count("buy_price").alias("n_cost"),
        exact_sum(F.when(F.col("efficiency").isin(params.EFFICIENCY_LABELS), stock + qty)).alias("eff_total"),
        cnt((F.col("sale_price") > 0) & (qty > 0)).alias("n_scatter"),
        cnt(stock <= params.RESTOCK_THRESHOLD).alias("n_restock"),
        cnt((days >= params.STAGNANT_BINS[0]) & (days < params.NO_SALE_DAYS)).alias("n_stagnant"),
        _span_days(F.min("last_sale_date"), F.max("last_sale_date")).alias("last_span_days"))
    par = pareto.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_pareto"))
    sh = shares.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_shares"))
    det = details.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_details"),
        _span_days(F.min("created_at"), F.max("created_at")).alias("detail_span_days"),
        (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("n_days"))
    fd = daily_features.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_feature_days"))
    mo = monthly.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_months"))
    de = deferreds.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_deferred"))
    ou = outstanding.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_outstanding"))
    out = keep(clients, "clients")
    parts = {"pareto": par, "shares": sh, "history": det, "days": fd, "months": mo, "debts": de, "outstanding": ou}
    for t in (pf_s, *(keep(t, name) for name, t in parts.items())):
        out = out.join(t, "client_id", "left")
    fills = {c: 0 for c in STAT_COLUMNS if c not in ("last_span_days", "detail_span_days")}
    return out.fillna(fills)


def chart_status(stats: DataFrame) -> DataFrame:
    """Explode the rule table over the per-client stats."""
    rows = []
    for fig, checks, note in RULES:
        code = None
        for cond, c in checks:
            code = F.when(F.expr(cond), F.lit(c)) if code is None else code.when(F.expr(cond), F.lit(c))
        note_col = F.when(F.expr(note[0]), F.lit(note[1])) if note else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(fig).alias("figure"), code.alias("code"), note_col.alias("note")))
    return (stats.select("client_id", F.explode(F.array(*rows)).alias("_s"))
                 .select("client_id", "_s.figure", F.col("_s.code").isNull().alias("ok"), "_s.code", "_s.note"))
