"""FIG-01..17: tidy chart tables ``(client_id, rank, ...)`` for all clients at once.

Localisation and JSON are applied later (``i18n``, ``sinks``); these stay typed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stocklens import params
from stocklens.functions import exact_sum, round_half_even
from stocklens.operators import analytics
from stocklens.operators.windows import top_k

def _QTY_DESC():
    return [F.col("sales_quantity").desc(), F.col("product_id").asc()]
def _QTY_ASC():
    return [F.col("sales_quantity").asc(), F.col("product_id").asc()]



def efficiency_labels(clients: DataFrame) -> DataFrame:
    """The 4-label dimension per client, made by exploding constants (no join fan-out)."""
    labels = params.EFFICIENCY_LABELS + [params.EFFICIENCY_NA]
    arr = F.array(*[F.struct(F.lit(i).alias("label_order"), F.lit(x).alias("efficiency"))
                    for i, x in enumerate(labels)])
    return clients.select("client_id", F.explode(arr).alias("_l")).select("client_id", "_l.*")


def top_products(pf: DataFrame, k: int = params.TOP_N) -> DataFrame:
    """FIG-01/04: top k by quantity sold: name, stock, sold."""
    return top_k(pf, k, _QTY_DESC()).select(
        "client_id", "rank", "product_id", "name", "current_stock", "sales_quantity")


def efficiency_counts(pf: DataFrame) -> DataFrame:
    """FIG-02: products per efficiency label, zero counts included, count desc."""
    counts = pf.groupBy("client_id", "efficiency").agg(F.count(F.lit(1)).alias("product_count"))
    dim = efficiency_labels(pf.select("client_id").distinct())
    return (dim.join(counts, ["client_id", "efficiency"], "left")
               .select("client_id", "efficiency", "label_order",
                       F.coalesce("product_count", F.lit(0)).cast("long").alias("product_count")))


def revenue_cogs(pf: DataFrame, k: int = params.TOP_N) -> DataFrame:
    """FIG-03: top k by amount; COGS = sold x catalogue buy price; margin = amount - COGS."""
    t = top_k(pf, k, [F.col("sales_amount").desc(), F.col("product_id").asc()])
    cogs = F.col("sales_quantity") * F.col("buy_price")
    return t.select("client_id", "rank", "product_id", "name", "sales_amount",
                    cogs.alias("cogs"), (F.col("sales_amount") - cogs).alias("margin"))


def efficiency_totals(pf: DataFrame) -> DataFrame:
    """FIG-05: stock and sold per label; all four labels appear, N/A always 0."""
    valid = pf.filter(F.col("efficiency").isin(params.EFFICIENCY_LABELS))
    sums = valid.groupBy("client_id", "efficiency").agg(
        exact_sum("current_stock").alias("total_stock"),
        exact_sum("sales_quantity").alias("total_sales"))
    dim = efficiency_labels(pf.select("client_id").distinct())
    return (dim.join(sums, ["client_id", "efficiency"], "left")
               .select("client_id", "efficiency", "label_order",
                       F.coalesce("total_stock", F.lit(0.0)).alias("total_stock"),
                       F.coalesce("total_sales", F.lit(0.0)).alias("total_sales")))


def pareto_bands(pareto: DataFrame) -> DataFrame:
    """FIG-06: Pareto rows with the band label and the share rounded to 2."""
    return pareto.select("client_id", "rank", "product_id", "name", "sales_quantity",
                         round_half_even("cumulative_percentage", 2).alias("cumulative_pct"),
                         analytics.pareto_band().alias("percentage_category"))


def price_quantity(pf: DataFrame) -> DataFrame:
    """FIG-07: sale price against quantity sold, both > 0."""
    return (pf.filter((F.col("sale_price") > 0) & (F.col("sales_quantity") > 0))
              .select("client_id", "product_id", "name", "sale_price", "sales_quantity"))


def restock(pf: DataFrame, threshold: float = params.RESTOCK_THRESHOLD) -> DataFrame:
    """FIG-09: stock <= threshold, stock ascending, no limit."""
    return (pf.filter(F.col("current_stock") <= threshold)
              .select("client_id", "product_id", "name", "current_stock", "sales_quantity"))


def stagnant_rows(stagnant: DataFrame) -> DataFrame:
    """FIG-10: stagnant products with label, last sale text and stock (days desc)."""
    return stagnant.select("client_id", "product_id", "name", "days_since_last_sale",
                           "days_category", "last_sale_date_str", "current_stock")


def bottom_products(pf: DataFrame, k: int = params.BOTTOM_N) -> DataFrame:
    """FIG-13: the k least sold among products sold > 0."""
    return top_k(pf.filter(F.col("sales_quantity") > 0), k, _QTY_ASC()).select(
        "client_id", "rank", "product_id", "name", "sales_quantity")


def top_sellers(pf: DataFrame, k: int = params.TOP_SHARE_N) -> DataFrame:
    """FIG-15: the k most sold among products sold > 0."""
    return top_k(pf.filter(F.col("sales_quantity") > 0), k, _QTY_DESC()).select(
        "client_id", "rank", "product_id", "name", "sales_quantity")


def sales_histogram(pf: DataFrame, k: int = params.HISTOGRAM_N) -> DataFrame:
    """FIG-14: number of products per total quantity sold (> 0), quantity asc, first k.
    Products are counted per (client, quantity) with partial aggregation first."""
    h = (pf.filter(F.col("sales_quantity") > 0)
           .groupBy("client_id", "sales_quantity").agg(F.count(F.lit(1)).alias("product_count")))
    return top_k(h, k, [F.col("sales_quantity").asc()]).select(
        "client_id", "rank", "sales_quantity", "product_count")


def share_table(revenue: DataFrame, profit: DataFrame) -> DataFrame:
    """FIG-16: revenue and profit shares as (measure, rank, label, value)."""
    return (revenue.withColumn("measure", F.lit("revenue"))
            .unionByName(profit.withColumn("measure", F.lit("profit"))))


def top_suppliers(outstanding: DataFrame, k: int = params.TOP_SUPPLIERS_N) -> DataFrame:
    """FIG-17: top k suppliers by outstanding debt."""
    return top_k(outstanding, k, [F.col("outstanding_amount").desc(), F.col("user_id").asc()]).select(
        "client_id", "rank", "user_id", "outstanding_amount")


def top_suppliers_total(top: DataFrame) -> DataFrame:
    """FIG-17b: total of the shown debts."""
    return top.groupBy("client_id").agg(
        exact_sum("outstanding_amount").alias("shown_outstanding_total"),
        F.count(F.lit(1)).alias("shown_suppliers"))
