"""SRC-01..06: read the four retail tables, check their contract, list clients.

Raw tables keep the source column names (``id``, ``buyPrice``...); cleaning
(``stocklens.operators.cleaning``) turns them into typed snake_case tables.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from stocklens import params
from stocklens.functions import key_int, parse_mixed_date
from stocklens.sources import xlsx

# Raw schema used when an optional table is missing (SRC-04).
RAW_SCHEMAS = {
    "invoice_deferreds": T.StructType([
        T.StructField("invoice_type", T.StringType()),
        T.StructField("status", T.DoubleType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("paid_amount", T.DoubleType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("client_id", T.LongType()),
    ]),
}

# Tables read with the tenant filter; details are scoped through their invoices.
_CLIENT_TABLES = ("products", "sale_invoices", "invoice_deferreds")
_OPTIONAL = ("invoice_deferreds",)


class MissingColumnsError(ValueError):
    pass


def check_columns(df: DataFrame, table: str) -> DataFrame:
    """SRC-05: raise naming every missing required column. Schema-only, no job."""
    required = params.REQUIRED_COLUMNS[table]
    missing = [c for c in required if c not in df.columns]
    # details get client_id from their invoice, so it is not required there
    if missing:
        raise MissingColumnsError(f"{table}: missing required columns {missing}")
    return df


def empty_like(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], RAW_SCHEMAS[table])


def _reader(spark: SparkSession, src: str, table: str, fmt: str, options: dict | None,
            pattern: str = "{table}"):
    """Read one table. Paths are ``{src}/{pattern}`` (default: a directory or file named
    after the table, e.g. ``s3://bucket/retail/products``); JDBC reads ``dbtable``."""
    if fmt == "jdbc":
        opts = dict(options or {})
        opts.setdefault("dbtable", table)
        return spark.read.format("jdbc").options(**opts).load()
    path = f"{src.rstrip('/')}/{pattern.format(table=table)}"
    if fmt == "xlsx":
        return read_spreadsheet(spark, path, table, options)
    if fmt == "csv":
        # SRC-06: spreadsheet exports; every column arrives as text and is coerced by cleaning.
        return spark.read.options(**(options or {})).option("header", True).csv(path)
    return spark.read.format(fmt).options(**(options or {})).load(path)


def read_spreadsheet(spark: SparkSession, path: str, table: str, options: dict | None = None) -> DataFrame:
    """SRC-06: a workbook, or a folder of them, pruned to the contract's columns. Columns are text
    and are coerced by cleaning; a date cell without a date format is a bare number there, so
    ``created_at`` is parsed here, as a number first."""
    xlsx.register(spark)
    if not xlsx.workbooks(path):
        raise FileNotFoundError(f"no .xlsx file at {path}")
    wanted = ",".join(params.REQUIRED_COLUMNS.get(table, []))
    df = spark.read.format("xlsx").options(**({"columns": wanted} if wanted else {}), **(options or {})).load(path)
    if "created_at" not in df.columns:
        return df
    number = F.when(~F.col("created_at").rlike(r"^\s*\d+-"), F.col("created_at").try_cast("double"))   # casting a date's text costs an exception a row
    day = F.coalesce(parse_mixed_date(number, T.DoubleType()), parse_mixed_date("created_at", T.StringType()))
    return df.withColumn("created_at", day)


def read_optional(spark: SparkSession, src: str, table: str, fmt: str = "parquet",
                  options: dict | None = None, pattern: str = "{table}") -> DataFrame:
    """SRC-04: a missing optional table becomes an empty table; any other failure (access,
    network, a table without its columns) is raised."""
    try:
        return check_columns(_reader(spark, src, table, fmt, options, pattern), table)
    except FileNotFoundError:
        return empty_like(spark, table)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            return empty_like(spark, table)
        raise


def read_tables(spark: SparkSession, src: str, client_ids: Iterable[int] | None = None,
                fmt: str = "parquet", options: dict | None = None,
                pattern: str = "{table}") -> dict[str, DataFrame]:
    """SRC-01: read products, invoices, details (scoped, SRC-02) and deferreds.

    ``client_ids`` becomes an ``isin`` filter that Spark pushes into the scan (and
    prunes partitions when the tables are written partitioned by client)."""
    out: dict[str, DataFrame] = {}
    for table in ("products", "sale_invoices", "sale_invoices_details", "invoice_deferreds"):
        if table in _OPTIONAL:
            df = read_optional(spark, src, table, fmt, options, pattern)
        else:
            df = check_columns(_reader(spark, src, table, fmt, options, pattern), table)
        if client_ids is not None and table in _CLIENT_TABLES:
            df = df.filter(F.col("client_id").isin(list(client_ids)))
        out[table] = df
    return out


def scope_details(details: DataFrame, invoices: DataFrame) -> DataFrame:
    """SRC-02: details of the selected clients, via an inner join with their invoices.

    Adds ``client_id`` and the invoice's raw date (``invoice_created_at``), which
    detail cleaning uses as the fallback date, so one join serves both."""
    inv = invoices.select(
        key_int("id", invoices.schema["id"].dataType).alias("_inv_id"),
        F.col("client_id"),
        F.col("created_at").alias("invoice_created_at"),
    )
    d = details.drop("client_id") if "client_id" in details.columns else details
    own = key_int(d["invoice_id"], d.schema["invoice_id"].dataType)     # '1.0' meets '1'
    return d.withColumn("_own_id", own).join(inv, F.col("_own_id") == F.col("_inv_id")).drop("_inv_id", "_own_id")


def list_clients(invoices: DataFrame) -> DataFrame:
    """SRC-03: sorted distinct non-null clients, as text."""
    return (invoices.select(F.col("client_id").cast("long").alias("cid"))
            .dropna().distinct()
            .orderBy("cid")
            .select(F.col("cid").cast("string").alias("client_id")))


# --- adapter: the driver's TPC-H style tables as raw retail tables (FIXTURES F3) -----

_DIM_ROWS_MAX = 10_000  # region/nation are fixed dimensions; refuse anything larger


def _dimension_keys(df: DataFrame, col: str, name: str) -> list:
    """Keys of a small fixed dimension (region: 5 rows). The size is checked before the
    keys are taken (at most ``_DIM_ROWS_MAX``), so this never grows with the data."""
    keys = [r[0] for r in df.select(col).distinct().limit(_DIM_ROWS_MAX + 1).collect()]
    if len(keys) > _DIM_ROWS_MAX:
        raise ValueError(f"{name} has more than {_DIM_ROWS_MAX} keys; it is not a small dimension")
    return sorted(keys)


def tpch_retail_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw retail tables over the driver's tables: client = region of the customer's
    nation, invoices = orders, details = lineitem, products = part per region,
    deferreds = lineitem by supplier. Only the region keys are read when this is built.
    Customers and parts grow with the data, so they are merged, never broadcast."""
    rd = lambda t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet"))
    region = rd("region").select("r_regionkey")
    nation = rd("nation").select("n_nationkey", "n_regionkey")
    customer = rd("customer").select("c_custkey", "c_nationkey")
    orders = rd("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    lineitem = rd("lineitem")
    part = rd("part").select("p_partkey", "p_name", "p_retailprice")

    cust_client = (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
                   .select("c_custkey", F.col("n_regionkey").cast("long").alias("client_id")))
    order_client = orders.join(cust_client.hint("merge"), orders.o_custkey == cust_client.c_custkey)

    invoices = order_client.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("totalPrice"),
        "client_id",
    )
    details = (lineitem.join(part.hint("merge"), lineitem.l_partkey == part.p_partkey)
               .select(
                   (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
                   F.col("l_partkey").alias("product_id"),
                   F.col("l_orderkey").alias("invoice_id"),
                   F.col("l_quantity").alias("quantity"),
                   F.col("l_extendedprice").alias("totalPrice"),
                   (F.col("p_retailprice") * 0.6).alias("buyPrice"),
                   F.col("l_shipdate").alias("created_at"),
               ))
    # products: every part is listed by every client; the client keys come from the
    # (checked, tiny) region dimension and are exploded per part (no join, no shuffle)
    regions = _dimension_keys(region, "r_regionkey", "region")
    products = (part.select("*", F.explode(F.array(*[F.lit(k) for k in regions])).alias("r_regionkey"))
                .select(
                    F.col("p_partkey").alias("id"),
                    F.col("p_name").alias("name"),
                    (F.col("p_retailprice") * 0.6).alias("buyPrice"),
                    F.col("p_retailprice").alias("salePrice"),
                    ((F.col("p_partkey") * 37 + F.col("r_regionkey") * 101) % 400).cast("double").alias("quantity"),
                    F.col("r_regionkey").cast("long").alias("client_id"),
                ))
    deferreds = (lineitem.select("l_orderkey", "l_returnflag", "l_extendedprice", "l_discount", "l_suppkey")
                 .join(order_client.select("o_orderkey", "o_orderstatus", "client_id"),
                       F.col("l_orderkey") == F.col("o_orderkey"))
                 .select(
                     F.when(F.col("l_returnflag") == "R", F.lit(params.BUY_INVOICE_TYPE))
                      .otherwise(F.lit("Stocks\\Models\\SaleInvoice")).alias("invoice_type"),
                     F.when(F.col("o_orderstatus") == "O", 0.0)
                      .when(F.col("o_orderstatus") == "P", 2.0).otherwise(1.0).alias("status"),
                     F.col("l_extendedprice").alias("amount"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid_amount"),
                     F.col("l_suppkey").alias("user_id"),
                     "client_id",
                 ))
    return {"products": products, "sale_invoices": invoices,
            "sale_invoices_details": details, "invoice_deferreds": deferreds}
