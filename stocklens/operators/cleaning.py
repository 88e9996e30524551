"""CLN-04..12: clean raw tables into typed tables; fills for series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from stocklens import params
from stocklens.functions import key_int, key_text, num0, num_or_null, parse_mixed_date


def _date_expr(df: DataFrame, name: str):
    return parse_mixed_date(F.col(name), df.schema[name].dataType)


def _typed(df: DataFrame):
    """Bind the coercion functions to the input column types (typed input skips text paths)."""
    t = {f.name: f.dataType for f in df.schema.fields}
    return (lambda c: num0(c, t.get(c)), lambda c, n=None: key_text(c, n, t.get(c)),
            lambda c: key_int(c, t.get(c)), lambda c: num_or_null(c, t.get(c)))


class Drops:
    """Rows that cleaning drops, counted by reason in the pass that cleans them.

    ``watch`` hooks counters (``DataFrame.observe``) onto a table; after an action over the
    cleaned table ``counts`` tells them, without a job of its own. A row counts under the first
    reason that fits. ``check`` raises CLN-09's error if a table had rows and kept none."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, table: str, reasons: dict[str, Column]) -> DataFrame:
        seen = self._seen[table] = Observation()
        counters, open_ = [F.count(F.lit(1)).alias("rows")], F.lit(True)
        for name, fails in reasons.items():
            counters.append(F.count(F.when(open_ & fails, 1)).alias(name))
            open_ = open_ & ~fails
        return df.observe(seen, *counters, F.count(F.when(open_, 1)).alias("kept"))

    def counts(self, table: str) -> dict[str, int]:
        """Waits for the action over the cleaned table."""
        return {k: int(v) for k, v in self._seen[table].get.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(table_name, reason, n) of all watched tables: a few rows."""
        rows = [(t, reason, n) for t in self._seen for reason, n in self.counts(t).items()]
        return spark.createDataFrame(rows, "table_name string, reason string, n long")

    def check(self, table: str) -> None:
        seen = self.counts(table)
        if seen["rows"] and not seen["kept"]:
            raise ValueError(f"no valid rows left in {table}: {seen}")


def clean_products(products: DataFrame) -> DataFrame:
    """CLN-04: keys as text, numbers coerced (bad gives 0)."""
    num0, key_text, _, _ = _typed(products)
    return products.select(
        F.col("client_id").cast("long").alias("client_id"),
        key_text("id", params.NULL_PRODUCT_KEY).alias("product_id"),
        F.col("name").cast("string").alias("name"),
        num0("buyPrice").alias("buy_price"),
        num0("salePrice").alias("sale_price"),
        num0("quantity").alias("current_stock"),
    )


def clean_invoices(invoices: DataFrame, drops: Drops | None = None) -> DataFrame:
    """CLN-05: drop null id and unparsable date; add ``year_month`` and ``day``."""
    num0, _, key_int, _ = _typed(invoices)
    typed = invoices.select(
        F.col("client_id").cast("long").alias("client_id"),
        key_int("id").alias("invoice_id"),
        _date_expr(invoices, "created_at").alias("created_at"),
        num0("totalPrice").alias("total_price"))
    if drops is not None:
        typed = drops.watch(typed, "sale_invoices", {"no_invoice_id": F.col("invoice_id").isNull(), "no_date": F.col("created_at").isNull()})
    return (typed.filter(F.col("invoice_id").isNotNull() & F.col("created_at").isNotNull())
            .withColumns({"year_month": F.date_format("created_at", "yyyy-MM"),
                          "day": F.to_date("created_at")}))


def clean_details(scoped_details: DataFrame, drops: Drops | None = None) -> DataFrame:
    """CLN-06/07 on details scoped by ``scope_details`` (which adds client_id and the
    invoice's raw date): own date first, else the invoice date; rows without a date
    or invoice id are dropped; ``net_profit = total - buy_price * quantity``."""
    d = scoped_details
    num0, key_text, key_int, _ = _typed(d)
    created = F.coalesce(_date_expr(d, "created_at"), _date_expr(d, "invoice_created_at"))
    out = d.select(
                F.col("client_id").cast("long").alias("client_id"),
                key_int("id").alias("detail_id"),
                key_text("product_id", params.NULL_PRODUCT_KEY).alias("product_id"),
                key_int("invoice_id").alias("invoice_id"),
                num0("quantity").alias("quantity"),
                num0("totalPrice").alias("total_price"),
                num0("buyPrice").alias("buy_price"),
                created.alias("created_at"),
                F.to_date(_date_expr(d, "invoice_created_at")).alias("invoice_day"))
    if drops is not None:
        out = drops.watch(out, "sale_invoices_details", {"no_invoice_id": F.col("invoice_id").isNull(), "no_date": F.col("created_at").isNull()})
    out = out.filter(F.col("created_at").isNotNull() & F.col("invoice_id").isNotNull())
    return out.withColumns({"net_profit": F.col("total_price") - F.col("buy_price") * F.col("quantity"),
                            "day": F.to_date("created_at")})


def clean_deferreds(deferreds: DataFrame) -> DataFrame:
    """CLN-08: numbers (bad gives 0), status numeric or null, user id as text.
    A table lacking a required column is skipped (empty result)."""
    need = ["invoice_type", "status", "amount", "paid_amount", "user_id"]
    if any(c not in deferreds.columns for c in need):
        deferreds = deferreds.limit(0)
        for c in need:
            if c not in deferreds.columns:
                deferreds = deferreds.withColumn(c, F.lit(None).cast("string"))
    num0, key_text, _, num_or_null = _typed(deferreds)
    client = F.col("client_id").cast("long") if "client_id" in deferreds.columns else F.lit(None).cast("long")
    return deferreds.select(
        client.alias("client_id"),
        F.col("invoice_type").cast("string").alias("invoice_type"),
        num_or_null("status").alias("status"),
        num0("amount").alias("amount"),
        num0("paid_amount").alias("paid_amount"),
        key_text("user_id").alias("user_id"),
    )


def feature_dates(invoices: DataFrame, date_col: str = "created_at") -> DataFrame:
    """CLN-09: strict date column for features; unparsable rows are dropped."""
    return (invoices.withColumn("sale_date", F.to_date(_date_expr(invoices, date_col)))
            .filter(F.col("sale_date").isNotNull()))


def require_feature_dates(invoices: DataFrame, date_col: str = "created_at") -> DataFrame:
    """CLN-09 with its error: raises if there are rows but none has a valid date (one job)."""
    out = feature_dates(invoices, date_col)
    if out.isEmpty() and not invoices.isEmpty():
        raise ValueError(f"no valid dates left in {date_col!r}")
    return out


def ffill_bfill0(df: DataFrame, cols: Sequence[str], order_col: str,
                 keys: Sequence[str] = ("client_id",)) -> DataFrame:
    """CLN-10: forward fill, then backward fill, then 0, in ``order_col`` order.

    Series are per client and bounded by the calendar (days or months), so a window
    per client is the right size of task."""
    w = Window.partitionBy(*keys).orderBy(order_col)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back),
                                         F.first(c, ignorenulls=True).over(fwd),
                                         F.lit(0.0)) for c in cols})


LEAKAGE_COLUMNS = ("transaction_count", "total_items")


def clean_regressors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN-11/12: infinities and NaN become null, then 0; text regressors coerced;
    leakage columns dropped."""
    df = df.drop(*[c for c in LEAKAGE_COLUMNS if c in df.columns])
    fixed = {}
    for c in cols:
        if c not in df.columns:
            continue
        v = num_or_null(F.col(c), df.schema[c].dataType)
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        fixed[c] = F.when(bad, F.lit(0.0)).otherwise(v)
    return df.withColumns(fixed) if fixed else df


def dirty_dates(invoices: DataFrame) -> DataFrame:
    """Mixed-quality date inputs derived from clean invoices (for CLN-03 checks): every
    invoice date written as text in one of five layouts, and as a spreadsheet serial
    with an hour fraction. All rows are kept; the layout is picked by invoice id."""
    ts = F.col("created_at")
    layout = F.col("invoice_id") % 5
    text = (F.when(layout == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(layout == 1, F.date_format(ts, "yyyyMMdd"))
            .when(layout == 2, F.date_format(ts, "MM/dd/yyyy"))
            .when(layout == 3, F.date_format(ts, "dd/MM/yyyy"))
            .otherwise(F.date_format(ts, "MMM d yyyy")))
    serial = (F.datediff(F.to_date(ts), F.lit("1899-12-30").cast("date")).cast("double")
              + (F.col("invoice_id") % 24).cast("double") / 24.0)
    return invoices.select("client_id", "invoice_id", text.alias("date_text"), serial.alias("date_serial"))
