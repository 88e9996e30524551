"""ANL-01..06: sales per product and the product_flow table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stocklens import params
from stocklens.functions import days_since, efficiency_bucket, exact_sum


def product_sales(details: DataFrame) -> DataFrame:
    """ANL-01 + ANL-05 in one aggregate: quantity, amount, net profit, last sale.

    Partial (map-side) aggregation runs before the shuffle on (client, product)."""
    return details.groupBy("client_id", "product_id").agg(
        exact_sum("quantity").alias("sales_quantity"),
        exact_sum("total_price").alias("sales_amount"),
        exact_sum("net_profit").alias("net_profit"),
        F.max("created_at").alias("last_sale_date"),
    )


def product_flow(details: DataFrame, products: DataFrame, as_of,
                 days_mode: str = "floor", include_unsold: bool = False) -> DataFrame:
    """ANL-02..06: sales joined with the catalogue after the aggregate.

    Unknown products get ``Unknown Product`` and zeros; ``efficiency_ratio`` is
    stock / sold when sold > 1e-6; days since the last sale to midnight of ``as_of``.
    ``include_unsold`` adds catalogue products never sold (D3 keeps them out)."""
    sales = product_sales(details)
    cat = products.select("client_id", "product_id", "name", "buy_price", "sale_price", "current_stock")
    how = "full" if include_unsold else "left"
    # merged: a catalogue exploded per client looks small to the planner, and copying it whole to
    # the driver and every executor grows with it; the sales already lie by (client, product)
    pf = sales.join(cat.hint("merge"), ["client_id", "product_id"], how)
    pf = pf.select(
        "client_id", "product_id",
        F.coalesce("sales_quantity", F.lit(0.0)).alias("sales_quantity"),
        F.coalesce("sales_amount", F.lit(0.0)).alias("sales_amount"),
        F.coalesce("net_profit", F.lit(0.0)).alias("net_profit"),
        F.coalesce("name", F.lit(params.UNKNOWN_PRODUCT)).alias("name"),
        F.coalesce("buy_price", F.lit(0.0)).alias("buy_price"),
        F.coalesce("sale_price", F.lit(0.0)).alias("sale_price"),
        F.coalesce("current_stock", F.lit(0.0)).alias("current_stock"),
        "last_sale_date",
    )
    ratio = F.when(F.col("sales_quantity") > params.EPS, F.col("current_stock") / F.col("sales_quantity"))
    return pf.withColumns({"efficiency_ratio": ratio,
                           "efficiency": efficiency_bucket(ratio),
                           "days_since_last_sale": days_since("last_sale_date", as_of, days_mode)})
