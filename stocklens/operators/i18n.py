"""LOC-01..07: translations as a (lang, key, text) table and lookups.

The language files are small configuration (a few hundred keys per language); they
are read once on the driver and used as a broadcast table or as literal maps inside
expressions. Nothing data-sized passes through the driver.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stocklens import params

LOCALE_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "locales")


def _flatten(d: dict, prefix: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in d.items():
        key = f"{prefix}{k}"
        if isinstance(v, dict):
            out.update(_flatten(v, key + "."))
        elif isinstance(v, list):
            out[key] = json.dumps(v, ensure_ascii=False)
        elif v is not None:
            out[key] = str(v)
    return out


@lru_cache(maxsize=8)
def load_dictionaries(locale_dir: str = LOCALE_DIR) -> dict[str, dict[str, str]]:
    """LOC-01: {lang: {dotted key: text}} for every ``{lang}.json`` in the directory."""
    out = {}
    for name in sorted(os.listdir(locale_dir)):
        if name.endswith(".json"):
            with open(os.path.join(locale_dir, name), encoding="utf-8") as f:
                out[name[:-5].lower()] = _flatten(json.load(f))
    return out


def translations(spark: SparkSession, locale_dir: str = LOCALE_DIR) -> DataFrame:
    """LOC-01 as a table ``(lang, key, text)``."""
    rows = [(lang, k, v) for lang, d in load_dictionaries(locale_dir).items() for k, v in d.items()]
    return spark.createDataFrame(rows, "lang string, key string, text string")


def get_translation(lang: str, key: str, default: str = "", locale_dir: str = LOCALE_DIR) -> str:
    """Dotted key lookup; language lower-cased; default when the language or key is absent."""
    return load_dictionaries(locale_dir).get((lang or "").lower(), {}).get(key, default)


def dictionary(spark: SparkSession, lang: str, locale_dir: str = LOCALE_DIR) -> DataFrame:
    """LOC-07: the whole dictionary of one language."""
    return translations(spark, locale_dir).filter(F.col("lang") == (lang or "").lower())


def flatten_json(files: DataFrame, text: str = "text", keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """LOC-01 on executors: (``keep``, key, text) for every leaf of nested JSON objects, keys joined
    by dots. Objects are opened level by level in a recursive query over VARIANT values, so any
    number of documents, of any depth, is flattened where it lies. Lists are leaves, as JSON
    text; a null leaf has a null text; a document that is no JSON object gives no rows. ``LIMIT
    ALL`` lifts Spark's bound on the rows of a recursion."""
    view = f"nested_{uuid.uuid4().hex}"
    files.select(*keep, F.col(text).alias("__text")).createOrReplaceTempView(view)
    own, cols = ", ".join(f"`{k}`" for k in keep), "".join(f"t.`{k}`, " for k in keep)
    return files.sparkSession.sql(f"""
WITH RECURSIVE t AS (
  SELECT {own}, CAST(NULL AS STRING) AS key, try_parse_json(__text) AS v FROM {view}
  UNION ALL
  SELECT {cols} concat_ws('.', t.key, e.key), e.value FROM t, LATERAL variant_explode(t.v) e WHERE schema_of_variant(t.v) LIKE 'OBJECT%')
SELECT {own}, key, CAST(v AS STRING) AS text FROM t WHERE key IS NOT NULL AND schema_of_variant(v) NOT LIKE 'OBJECT%' LIMIT ALL""")


def translate(df: DataFrame, key: Column, lang: Column, table: DataFrame, default: Column,
              out: str = "text") -> DataFrame:
    """LOC-02 on a DataFrame: left join with the (small, broadcast) translation table;
    a missing key keeps ``default``."""
    t = F.broadcast(table.select(F.col("lang").alias("_tl"), F.col("key").alias("_tk"),
                                 F.col("text").alias("_tt")))
    j = df.join(t, (F.lower(lang) == t["_tl"]) & (key == t["_tk"]), "left")
    return j.withColumn(out, F.coalesce(F.col("_tt"), default)).drop("_tl", "_tk", "_tt")


def label_map(lang: str, prefix: str) -> Column:
    """Literal map of one label family (e.g. ``efficiency_labels``) for use inside
    expressions: ``element_at(map, label)``."""
    d = load_dictionaries().get(lang, {})
    pairs = [(k[len(prefix) + 1:], v) for k, v in d.items() if k.startswith(prefix + ".")]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def localize_label(c: Column, lang: str, prefix: str) -> Column:
    """Translated label, or the label itself when there is no translation."""
    return F.coalesce(F.element_at(label_map(lang, prefix), c), c)


def fallback_title(name: str) -> str:
    """LOC-03 fallback: internal name, ``_`` to space, title case."""
    return name.replace("_", " ").title()


def languages() -> list[str]:
    langs = list(load_dictionaries())
    return [lang for lang in params.LANGUAGES if lang in langs] + [lang for lang in langs if lang not in params.LANGUAGES]
