"""ANL-07..17: Pareto, shares, stagnant stock, supplier debt, series, stock table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stocklens import params
from stocklens.functions import exact_sum, limbs, recombine, round_half_even, stagnant_bucket
from stocklens.operators.windows import running_sum, top_k

def _BY_QTY_DESC():
    return [F.col("sales_quantity").desc(), F.col("product_id").asc()]


def pareto(pf: DataFrame, threshold: float = params.PARETO_THRESHOLD,
           carry: Sequence[str] = ("name", "sales_quantity", "current_stock")) -> DataFrame:
    """ANL-07/08: sold products by quantity desc (ties: product id), running share of
    the client's total in %, kept while <= threshold (D2: may be empty). ``carry`` names the
    columns that come along with the keys."""
    sold = pf.filter(F.col("sales_quantity") > 0).select(
        "client_id", "product_id", *dict.fromkeys((*carry, "sales_quantity")))
    parts = {f"_q{i}": x for i, x in enumerate(limbs("sales_quantity"))}
    run = running_sum(sold, {**parts, "rank": F.lit(1)}, _BY_QTY_DESC(), totals=list(parts))
    so_far, total = recombine([F.col(p) for p in parts]), recombine([F.col(f"{p}_total") for p in parts])
    out = run.withColumns({"cumulative_percentage": so_far / total * 100.0, "rank": F.col("rank").cast("int")})
    return out.filter(F.col("cumulative_percentage") <= threshold).select(
        "client_id", "product_id", *carry, "rank", "cumulative_percentage")


def pareto_band(cum: str = "cumulative_percentage"):
    """FIG-06 band: right-closed tens from 0 to 80, lowest included, else Other."""
    c = F.col(cum)
    k = F.greatest(F.ceil(c / 10.0), F.lit(1)).cast("int")
    return (F.when((c >= 0) & (c <= params.PARETO_THRESHOLD),
                   F.format_string("%d-%d%%", (k - 1) * 10, k * 10))
             .otherwise(F.lit(params.OTHER_LABEL)))


def top_share(pf: DataFrame, measure: str, k: int = params.TOP_SHARE_N) -> DataFrame:
    """ANL-09/10: top k by ``measure`` plus ``Other`` = max(0, total - top k) when > 1e-6;
    slices <= 1e-6 dropped. Columns: client_id, rank, product_id, name, value."""
    top = top_k(pf.select("client_id", "product_id", "name", measure), k,
                [F.col(measure).desc(), F.col("product_id").asc()])
    # totals stay exact digits until the subtraction
    parts = range(len(limbs(measure)))
    top_sum = top.groupBy("client_id").agg(*[F.sum(x).alias(f"_top{i}") for i, x in enumerate(limbs(measure))])
    all_sum = pf.groupBy("client_id").agg(*[F.sum(x).alias(f"_all{i}") for i, x in enumerate(limbs(measure))])
    rest = recombine([F.col(f"_all{i}") - F.col(f"_top{i}") for i in parts])
    other = (all_sum.join(top_sum, "client_id")
             .select("client_id",
                     F.lit(k + 1).alias("rank"),
                     F.lit(None).cast("string").alias("product_id"),
                     F.lit(params.OTHER_LABEL).alias("name"),
                     F.greatest(F.lit(0.0), rest).alias("value")))
    rows = top.select("client_id", F.col("rank").cast("int").alias("rank"), "product_id", "name",
                      F.col(measure).alias("value"))
    return rows.unionByName(other.withColumn("rank", F.col("rank").cast("int"))) \
               .filter(F.col("value") > params.EPS)


def stagnant(pf: DataFrame) -> DataFrame:
    """ANL-11: 90 <= days < 99999 with a period label and the last sale as text."""
    lo = params.STAGNANT_BINS[0]
    return (pf.filter((F.col("days_since_last_sale") >= lo) &
                      (F.col("days_since_last_sale") < params.NO_SALE_DAYS))
              .select("client_id", "product_id", "name", "current_stock", "days_since_last_sale",
                      stagnant_bucket("days_since_last_sale").alias("days_category"),
                      F.coalesce(F.date_format("last_sale_date", "yyyy-MM-dd"), F.lit("N/A"))
                       .alias("last_sale_date_str")))


def outstanding(deferreds: DataFrame) -> DataFrame:
    """ANL-12: open purchase invoices; sum(amount - paid) per supplier, kept when > 1e-6."""
    f = deferreds.filter((F.col("invoice_type") == F.lit(params.BUY_INVOICE_TYPE)) &
                         F.col("status").isin(params.OPEN_STATUSES))
    return (f.groupBy("client_id", "user_id")
             .agg(exact_sum(F.col("amount") - F.col("paid_amount")).alias("outstanding_amount"))
             .filter(F.col("outstanding_amount") > params.EPS))


def fill_grid(series: DataFrame, date_col: str, value_cols: list[str], step: str = "day") -> DataFrame:
    """ANL-14/15, FEA-02/11: every step from the client's first to last date. Each row
    covers the gap up to the next observed date: its own date keeps the values, the
    gap rows get 0 for ``value_cols`` and null for any other column. One pass, one
    window per client over a calendar-bounded series, no self-join."""
    w = Window.partitionBy("client_id").orderBy(date_col)
    nxt = F.lead(date_col).over(w)
    if step == "day":
        until = F.when(nxt.isNull(), F.col(date_col)).otherwise(F.date_sub(nxt, 1))
    else:
        until = F.when(nxt.isNull(), F.col(date_col)).otherwise(F.add_months(nxt, -1))
    others = [c for c in series.columns if c not in ("client_id", date_col)]
    spans = (series.select("*", F.col(date_col).alias("_obs"), until.alias("_until"))
                   .select("*", F.explode(F.sequence(F.col("_obs"), F.col("_until"),
                                                     F.expr(f"interval 1 {step}"))).alias("_d")))
    own = F.col("_d") == F.col("_obs")
    cols = [F.col("client_id"), F.col("_d").alias(date_col)]
    for c in others:
        gap = F.lit(0.0) if c in value_cols else F.lit(None)
        cols.append(F.when(own, F.col(c)).otherwise(gap.cast(series.schema[c].dataType)).alias(c))
    return spans.select(*cols)


def monthly_avg_invoice(invoices: DataFrame) -> DataFrame:
    """ANL-13/14: mean invoice total per month, full month grid, gaps 0."""
    m = (invoices.groupBy("client_id", "year_month")
         .agg(exact_sum("total_price").alias("_s"), F.count(F.lit(1)).alias("_n"))
         .select("client_id",
                 F.to_date(F.concat("year_month", F.lit("-01"))).alias("month_start"),
                 (F.col("_s") / F.col("_n")).alias("avg_invoice_value")))
    return fill_grid(m, "month_start", ["avg_invoice_value"], "month")


def daily_sum(details: DataFrame, value: str, out: str) -> DataFrame:
    """ANL-15/16: daily sum of ``value`` by detail date, full day grid, gaps 0, round 2."""
    d = (details.groupBy("client_id", F.col("day").alias("date"))
         .agg(round_half_even(exact_sum(value), 2).alias(out)))
    return fill_grid(d, "date", [out], "day")


def daily_sales_actual(details: DataFrame) -> DataFrame:
    return daily_sum(details, "total_price", "value")


def daily_profit(details: DataFrame) -> DataFrame:
    return daily_sum(details, "net_profit", "value")


def stock_table(products: DataFrame) -> DataFrame:
    """ANL-17: id, name, stock; shown by stock desc (ties: product id)."""
    return (products.select("client_id", "product_id", "name", F.col("current_stock").alias("stock"))
            .orderBy("client_id", F.col("stock").desc(), "product_id"))
