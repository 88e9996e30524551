"""Registered queries of this package: ``opN_<name>`` with production parameters over whole
tables. ``ORACLE`` holds the DuckDB twin where SQL can express the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stocklens.llm.common import crc_mod, table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op2_language_id")
def q_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import langid
    docs = table(spark, sf_dir, "documents").withColumn("__held", crc_mod("doc_id", 5) == 0)
    model = langid.train(docs.filter(~F.col("__held")))
    out = langid.detect(docs, model, keep=("doc_id", "__held"))
    return out.select("doc_id", F.col("__held").alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@register("op3_decontaminate")
def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import decontaminate as op
    found = op.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_ids", "n_items", "similarity")


@register("op7_token_counts")
def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import token_counts as op
    return op.count_tokens(table(spark, sf_dir, "documents"))


URL_SQL = """
WITH p AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END AS raw_host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
h AS (SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
rules(verdict, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
  ('allow','com','/fr/'), ('block','com','/de/')),
names(name) AS (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')),
domains(domain) AS (VALUES ('example.com'), ('example.net'), ('example.org')),
blocked AS (SELECT name || '.' || domain AS b FROM names, domains),
j AS (
  SELECT h.page_id, h.host, h.path,
    (SELECT max(struct_pack(n := length(rhost || rpath), r := rhost || rpath, v := verdict)) FROM rules
     WHERE (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath)) AS m,
    (SELECT max(b) FROM blocked WHERE h.host = b OR ends_with(h.host, '.' || b)) AS listed
  FROM h)
SELECT page_id, host, path, m.r AS rule,
  CASE WHEN m IS NOT NULL THEN m.v WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, listed FROM j
"""


@register("op9_url_filter", URL_SQL)
def q_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import url_filter as op
    return op.filter_urls(table(spark, sf_dir, "pages"))


@register("op6_near_dedup")
def q_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import near_dedup as op
    return op.near_duplicates(table(spark, sf_dir, "documents"))


@register("op8_mix_sources")
def q_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import mixing as op
    docs = table(spark, sf_dir, "documents")
    return op.mixture(docs, op.make_plan(docs))


@register("op1_lm_scoring")
def q_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import lm_scoring as op
    from stocklens.llm.common import text_of
    docs = table(spark, sf_dir, "documents").withColumn("__held", crc_mod("doc_id", 7) == 2)
    trained = op.train(docs.filter(~F.col("__held")).select(text_of().alias("text")))
    out = op.score(docs, trained, keep=("doc_id", "__held"))
    return out.select("doc_id", F.col("__held").alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


@register("op4_fingerprints")
def q_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import fingerprints as op
    return op.fingerprint_pairs(table(spark, sf_dir, "documents"))


@register("op5_license_scan")
def q_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import licenses as op
    docs = table(spark, sf_dir, "documents")
    lines = op.document_vectors(docs)
    return op.scan(docs, op.train(docs, lines=lines), lines=lines)


@register("op10_html_extract")
def q_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import html_extract as op
    return op.main_text(table(spark, sf_dir, "pages"))


@register("op12_periodic_runs")
def q_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stocklens.llm import runs as op
    from stocklens.llm.common import text_of
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", op.planted(text_of(), number).alias("text"))
    out = op.find_runs(docs).withColumn("best", op.strongest(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(op.listing(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@register("op11_chat_format")
def q_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are of whole conversations, so only here one row gathers a conversation."""
    from stocklens.llm import chat as op
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    read = op.read_turns(op.chat_windows(rows.unionByName(added)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    convs = read.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("bigint").alias("n_turns"), F.sum(F.length("text")).cast("bigint").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"), F.sum("n_repeated").alias("n_repeated"),
        F.array_sort(F.collect_list(F.struct("first_turn", F.array_join(said, "").alias("said"), F.array_join("learnt", "").alias("learnt")))).alias("w"))
    learnt = F.array_join(F.col("w.learnt"), "")
    return convs.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("w.said"), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows", "n_repeated")


@register("op13_repair_turns")
def q_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit and the digest are of whole conversations, so only here one row gathers one."""
    from stocklens.llm import repair as op
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    faults = lambda name: F.size(F.filter("rows", lambda r: r["fault"] == name))
    lines = F.transform(op.repaired(F.col("rows"), F.col("edits")), lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    parts = op.repair(op.damaged(rows)).select(
        "conv_id", "segment", "illegal", *[faults(f).alias(f) for f in ("blank", "duplicate", "truncated")],
        op.edit_cost(F.col("rows"), F.col("edits")).alias("cost"), F.array_join("edits.edit", "").alias("audit"), lines.alias("lines"),
        F.array_min("rows.turn").alias("first"), F.array_max("rows.turn").alias("last"), "n_turns")
    convs = parts.groupBy("conv_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        (F.max("last") - F.min("first") + 1 - F.sum("n_turns")).alias("gaps"),
        F.array_sort(F.collect_list(F.struct("segment", "audit", "lines"))).alias("s"))
    convs = convs.select(F.col("conv_id").alias("__conv"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                         F.array_join("s.audit", "").alias("audit"), F.array_join(F.flatten("s.lines"), "\n").alias("repaired"))
    out = rows.select("conv_id").distinct().join(convs, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))
