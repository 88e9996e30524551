"""SNK-01..05: write analysis tables and documents; read documents back.

Writes are the only actions of a batch run. Tables are partitioned by client, so a
reader for one client prunes to its own files."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stocklens import params


def client_layout(df: DataFrame, n: int | None = None) -> DataFrame:
    """Range-partition on (client, row hash) before a client-partitioned write: each
    task holds a contiguous run of clients, so the output has about tasks + clients
    files instead of tasks x clients, and a hot client still spreads over many tasks."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, F.col("client_id"), F.xxhash64(*df.columns))


def write_analytics(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> list[str]:
    """SNK-01: each table as Parquet under ``path/<name>``, partitioned by client. An
    overwrite replaces the clients of this run only; those of other runs stay."""
    written = []
    for name, df in tables.items():
        if "client_id" in df.columns:
            (client_layout(df).write.mode(mode).option("partitionOverwriteMode", "dynamic")
             .partitionBy("client_id").parquet(f"{path.rstrip('/')}/{name}"))
        else:
            df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
        written.append(name)
    return written


def write_chart_docs(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-02: documents as JSON lines partitioned by client and language. Null metadata
    fields are omitted (Spark's JSON writer drops null fields)."""
    (client_layout(docs).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("client_id", "lang").json(path))


# --- point lookup (SNK-03) ---------------------------------------------------------------

def _doc_key(client, figure, lang) -> Column:
    return F.concat_ws("/", client, figure, lang)


def write_doc_store(docs: DataFrame, path: str, mode: str = "overwrite", group_bytes: int = 1 << 20) -> None:
    """Documents as Parquet for lookups by (client, figure, language): sorted by the key, in small
    row groups with a bloom filter on it, so that a lookup reads the row groups of its document."""
    keyed = docs.withColumn("doc_key", _doc_key(F.col("client_id"), F.col("figure"), F.col("lang")))
    (keyed.repartitionByRange("doc_key", "page").sortWithinPartitions("doc_key", "page").write.mode(mode)
     .option("parquet.bloom.filter.enabled#doc_key", "true").option("parquet.block.size", group_bytes)
     .option("parquet.page.size.row.check.min", 10).option("parquet.block.size.row.check.min", 10).parquet(path))


def lookup_doc(spark: SparkSession, path: str, client_id, figure: str, lang: str | None = None) -> DataFrame:
    """SNK-03 on a document store: pages of the document in the wanted language, else in ``en``.
    The filter is an equality on the key, pushed to statistics and bloom filters."""
    want = (lang or params.DEFAULT_LANGUAGE).lower()
    keys = list(dict.fromkeys(f"{client_id}/{figure}/{la}" for la in (want, params.DEFAULT_LANGUAGE)))
    d = spark.read.parquet(path).filter(F.col("doc_key").isin(keys))
    best = F.min(F.when(F.col("lang") == want, 0).otherwise(1)).over(Window.partitionBy("client_id", "figure"))
    d = d.withColumn("_best", best).filter(F.col("_best") == F.when(F.col("lang") == want, 0).otherwise(1))
    return d.drop("_best", "doc_key").orderBy("page")


# --- snapshots (SNK-02, SNK-05) ------------------------------------------------------------

def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish_snapshot(spark: SparkSession, root: str, write, keep: int = 2) -> str:
    """Publish a refresh at once: ``write(folder)`` writes any number of tables into a version's own
    folder; then one rename switches the manifest to it. A run that fails before leaves the
    last version readable, and readers never see half a refresh. Of older versions the last
    ``keep`` - 1 stay for readers that are still on them; their data and that of failed runs
    before them go. One publisher at a time."""
    root = root.rstrip("/")
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    write(f"{root}/{version}")
    fs, _ = _hadoop(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fresh = path(f"{root}/CURRENT-{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(path(f"{root}/CURRENT")), over)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(path(root)) if s.isDirectory() and s.getPath().getName().startswith("v"))
    for old in versions[:max(0, versions.index(version) + 1 - keep)]:
        fs.delete(path(f"{root}/{old}"), True)
    return version


def snapshot(spark: SparkSession, root: str) -> str | None:
    """Folder of the published version, None before the first."""
    fs, manifest = _hadoop(spark, f"{root.rstrip('/')}/CURRENT")
    if not fs.exists(manifest):
        return None
    return f"{root.rstrip('/')}/{spark.read.text(manifest.toString()).first()[0].strip()}"


def read_chart_docs(spark: SparkSession, path: str) -> DataFrame:
    schema = ("figure string, page int, data string, metadata struct<timestamp:string, description:string, "
              "frequency:string, title:string, chart_type:string, x_axis:struct<name:string,type:string,title:string>, "
              "y_axis:struct<name:string,type:string,title:string>, "
              "series:array<struct<name:string,color:string,type:string>>>, client_id long, lang string")
    return spark.read.schema(schema).json(path)


def read_chart_doc(docs: DataFrame, client_id, figure: str, lang: str | None,
                   merge: bool = False) -> DataFrame:
    """SNK-03: one document in the requested language, else in ``en``, as its pages in
    order (partition-pruned when read from disk). ``merge=True`` joins the pages into one
    string, for documents known to be small."""
    want = (lang or params.DEFAULT_LANGUAGE).lower()
    d = docs.filter((F.col("client_id") == F.lit(client_id)) & (F.col("figure") == figure) &
                    F.col("lang").isin(want, params.DEFAULT_LANGUAGE))
    d = d.withColumn("_pref", F.when(F.col("lang") == want, 0).otherwise(1))
    best = d.groupBy("client_id", "figure").agg(F.min("_pref").alias("_pref"))
    d = d.join(best, ["client_id", "figure", "_pref"])
    if not merge:
        return d.select("client_id", "figure", "lang", "page", "metadata", "data").orderBy("page")
    g = d.groupBy("client_id", "figure", "lang").agg(
        F.first("metadata").alias("metadata"),
        F.array_sort(F.collect_list(F.struct("page", "data"))).alias("_p"))
    # a list document is the concatenation of its pages' arrays; an object has one page
    inner = F.transform("_p", lambda x: F.regexp_replace(x["data"], r"^\[|\]$", ""))
    merged = F.when(F.size("_p") == 1, F.col("_p")[0]["data"]).otherwise(
        F.concat(F.lit("["), F.array_join(F.filter(inner, lambda s: s != ""), ","), F.lit("]")))
    return g.select("client_id", "figure", "lang", "metadata", merged.alias("data"))


def write_forecast_csv(forecast: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-04: forecast as CSV with a header, no index column."""
    forecast.write.mode(mode).option("header", True).csv(path)


def frequency_dimension(spark: SparkSession) -> DataFrame:
    """The 16-row refresh-group dimension (figure -> frequency)."""
    rows = [(fig, freq) for freq, figs in params.REFRESH_GROUPS.items() for fig in figs]
    return spark.createDataFrame(rows, "figure string, frequency_group string")


def docs_for_frequency(docs: DataFrame, frequency: str, lang: str | None = None) -> DataFrame:
    """SNK-05: the documents of one refresh group (daily, weekly, monthly, quarterly),
    in one language (falling back to ``en``). An empty result is the "nothing found" case."""
    spark = docs.sparkSession
    dim = F.broadcast(frequency_dimension(spark).filter(F.col("frequency_group") == frequency.lower()))
    d = docs.join(dim, "figure", "left_semi")
    if lang is None:
        return d
    want = lang.lower()
    d = d.filter(F.col("lang").isin(want, params.DEFAULT_LANGUAGE)) \
         .withColumn("_pref", F.when(F.col("lang") == want, 0).otherwise(1))
    best = d.groupBy("client_id", "figure").agg(F.min("_pref").alias("_pref"))
    return d.join(best, ["client_id", "figure", "_pref"]).drop("_pref")


def bundle_status(docs: DataFrame, frequency: str, clients: DataFrame) -> DataFrame:
    """SNK-05 status per client: how many of the group's figures exist, and the
    "nothing found" case when none does."""
    spark = docs.sparkSession
    dim = frequency_dimension(spark).filter(F.col("frequency_group") == frequency.lower())
    found = (docs.select("client_id", "figure").distinct()
                 .join(F.broadcast(dim), "figure", "left_semi")
                 .groupBy("client_id").agg(F.count(F.lit(1)).alias("figures_found")))
    expected = len(params.REFRESH_GROUPS.get(frequency.lower(), []))
    return (clients.select("client_id").distinct().join(found, "client_id", "left")
            .select("client_id", F.lit(frequency.lower()).alias("frequency"),
                    F.coalesce("figures_found", F.lit(0)).alias("figures_found"),
                    F.lit(expected).alias("figures_expected"),
                    (F.coalesce("figures_found", F.lit(0)) == 0).alias("nothing_found")))
