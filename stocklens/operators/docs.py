"""LOC-03..06 + SNK-02 input: localised chart documents for every client, figure and
language.

A document is ``metadata`` (one small struct per figure x language) plus ``data``.
Records are serialised per row with localised keys, then grouped into pages of at
most ``PAGE_ROWS`` records, so no group ever holds a whole large client. Figures
with at most a few dozen rows (top-k, labels, months) always fit one page.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stocklens import params
from stocklens.operators import charts, serving
from stocklens.operators.i18n import fallback_title, get_translation, languages, localize_label
from stocklens.operators.windows import running_sum

PAGE_ROWS = 5000   # records per page; a parameter of ``chart_docs``

# Per figure, the chart type, axes (internal name, axis type key), the
# series (translation key, colour, line type) and the record keys (column, translation
# key, default key text).
SPECS = {
    "fig1": ("bar", ("name", "category"), ("value", "number"),
             [("stock", "rgb(55, 83, 109)", None), ("sales", "rgb(26, 118, 255)", None)],
             [("name", "x_axis.title", "Product"), ("current_stock", "series.stock", "Current Stock"),
              ("sales_quantity", "series.sales", "Sales")]),
    "fig2": ("pie", ("category", "category"), ("value", "number"),
             [("Oversupplied", "#d62728", None), ("Undersupplied", "#ff7f0e", None),
              ("Balanced", "#2ca02c", None), ("N/A", "grey", None)], []),
    "fig3": ("bar", ("name", "category"), ("value", "number"),
             [("revenue", "rgb(26, 118, 255)", None), ("cogs", "rgb(255, 127, 14)", None),
              ("margin", "rgb(44, 160, 44)", None)],
             [("name", "x_axis.title", "Product"), ("sales_amount", "series.revenue", "Revenue"),
              ("cogs", "series.cogs", "COGS"), ("margin", "series.margin", "Margin")]),
    "fig4": ("combo", ("name", "category"), ("value", "number"),
             [("stock", "lightblue", "bar"), ("sales", "orange", "line")],
             [("name", "x_axis.title", "Product"), ("current_stock", "series.stock", "Current Stock"),
              ("sales_quantity", "series.sales", "Sales")]),
    "fig5": ("bar", ("efficiency_category_translated", "category"), ("value", "number"),
             [("stock", "rgb(55, 83, 109)", None), ("sales", "rgb(26, 118, 255)", None)],
             [("efficiency", "x_axis.title", "Efficiency Category"), ("total_stock", "series.stock", "Total Stock"),
              ("total_sales", "series.sales", "Total Sales")]),
    "fig6": ("combo", ("name", "category"), ("sales_quantity", "number"),
             [("sales", "cornflowerblue", "bar"), ("cumulative", "red", "line")],
             [("name", "x_axis.title", "Product"), ("sales_quantity", "series.sales", "Sales Quantity"),
              ("cumulative_pct", "series.cumulative", "Cumulative %"),
              ("percentage_category", None, "percentage_category")]),
    "fig7": ("scatter", ("salePrice", "number"), ("sales_quantity", "number"),
             [("products", "blue", None)],
             [("name", "@common.product_name", "Product Name"), ("sale_price", "x_axis.title", "Sale Price"),
              ("sales_quantity", "y_axis.title", "Quantity Sold")]),
    "fig9": ("bar", ("name", "category"), ("current_stock", "number"),
             [("stock", "red", None)],
             [("name", "x_axis.title", "Product"), ("current_stock", "y_axis.title", "Current Stock")]),
    "fig10": ("bar", ("name", "category"), ("days_since_last_sale", "number"),
              [("category", None, None)],
              [("name", "x_axis.title", "Product"), ("days_since_last_sale", "y_axis.title", "Days Since Last Sale"),
               ("days_category", "data_keys.category", "Stagnancy Period"),
               ("last_sale_date_str", "@common.last_sale_date", "Last Sale"),
               ("current_stock", "@common.current_stock", "Stock"), ("product_id", "@common.product_id", "ID")]),
    "fig11": ("line", ("date", "date"), ("value", "number"),
              [("actual", "blue", None), ("forecast", "red", None), ("ci", "rgba(255, 0, 0, 0.15)", None)],
              [("date", None, "date"), ("value", None, "value"), ("type", None, "type"),
               ("lower_ci", None, "lower_ci"), ("upper_ci", None, "upper_ci")]),
    "fig12": ("line", ("date", "category"), ("value", "number"),
              [("actual", "royalblue", None), ("forecast", "firebrick", None),
               ("ci", "rgba(255, 100, 100, 0.15)", None)],
              [("date", None, "date"), ("value", None, "value"), ("type", None, "type"),
               ("lower_ci", None, "lower_ci"), ("upper_ci", None, "upper_ci")]),
    "fig13": ("bar", ("sales_quantity", "number"), ("name", "category"),
              [("sales", "value-based", None)],
              [("name", "y_axis.title", "Product"), ("sales_quantity", "x_axis.title", "Quantity Sold")]),
    "fig14": ("table", ("Columns", "category"), ("Rows", "number"), [],
              [("sales_quantity", "columns.quantity", "Quantity Sold"),
               ("product_count", "columns.num_products", "Number of Products")]),
    "fig15": ("bar", ("sales_quantity", "number"), ("name", "category"),
              [("sales", "value-based", None)],
              [("name", "y_axis.title", "Product"), ("sales_quantity", "x_axis.title", "Quantity Sold")]),
    "fig16": ("pie", ("label", "category"), ("value", "number"),
              [("revenue", None, None), ("profit", None, None)], []),
    "fig17": ("bar", ("user_id", "category"), ("outstanding_amount", "number"),
              [("amount", "value-based", None)],
              [("user_id", "x_axis.title", "Supplier (ID)"), ("outstanding_amount", "y_axis.title", "Outstanding Amount")]),
}

FIG_FREQUENCY = {fig: freq for freq, figs in params.REFRESH_GROUPS.items() for fig in figs}


def _text(lang: str, key: str, default: str) -> str:
    return get_translation(lang, key, default)


def _key_name(fig: str, lang: str, key: str | None, default: str) -> str:
    if key is None:
        return default
    if key.startswith("@"):
        return _text(lang, key[1:], default)
    return _text(lang, f"{fig}.{key}", default)


def metadata_rows(lang: str, fig: str) -> dict:
    """LOC-03/04: localised metadata of one figure (threshold substituted)."""
    chart_type, (xn, xt), (yn, yt), series, _ = SPECS[fig]
    thr = str(params.RESTOCK_THRESHOLD)
    freq_key = _text(lang, f"{fig}.frequency", FIG_FREQUENCY.get(fig, "N/A"))
    ser = []
    for key, color, kind in series:
        if fig == "fig2":
            name = _text(lang, f"efficiency_labels.{key}", key)
        else:
            name = _text(lang, f"{fig}.series.{key}", fallback_title(key))
        ser.append({"name": name, "color": color, "type": kind})
    return {
        "figure": fig, "lang": lang,
        "title": _text(lang, f"{fig}.title", f"{fig.upper()} Title").replace("{threshold}", thr),
        "description": _text(lang, f"{fig}.description", f"{fig.upper()} Description").replace("{threshold}", thr),
        "frequency": _text(lang, f"frequencies.{freq_key}", freq_key.capitalize()),
        "chart_type": chart_type,
        "x_axis": {"name": xn, "type": _text(lang, f"axis_types.{xt}", xt),
                   "title": _text(lang, f"{fig}.x_axis.title", fallback_title(xn))},
        "y_axis": {"name": yn, "type": _text(lang, f"axis_types.{yt}", yt),
                   "title": _text(lang, f"{fig}.y_axis.title", fallback_title(yn))},
        "series": ser,
    }


METADATA_SCHEMA = ("figure string, lang string, title string, description string, frequency string, "
                   "chart_type string, x_axis struct<name:string,type:string,title:string>, "
                   "y_axis struct<name:string,type:string,title:string>, "
                   "series array<struct<name:string,color:string,type:string>>")


def metadata(spark: SparkSession, langs: list[str] | None = None) -> DataFrame:
    """Figure x language metadata table (32 rows for 16 figures and 2 languages)."""
    langs = langs or languages()
    rows = [metadata_rows(lang, fig) for lang in langs for fig in SPECS]
    return spark.createDataFrame(rows, METADATA_SCHEMA)


def _record_json(fig: str, lang: str, cols: list[tuple[str, str | None, str]]) -> Column:
    fields = []
    for col, key, default in cols:
        c = F.col(col)
        if col == "efficiency":
            c = localize_label(c, lang, "efficiency_labels")
        elif col == "days_category":
            c = localize_label(c, lang, "stagnant_labels")
        fields.append(c.alias(_key_name(fig, lang, key, default)))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _records(df: DataFrame, fig: str, seq: Column, langs: list[str]) -> DataFrame:
    """(client_id, figure, lang, seq, record) for every language in one pass."""
    cols = SPECS[fig][4]
    per_lang = F.array(*[F.struct(F.lit(lang).alias("lang"), _record_json(fig, lang, cols).alias("record"))
                         for lang in langs])
    return df.select("client_id", F.lit(fig).alias("figure"), seq.cast("long").alias("seq"),
                     F.explode(per_lang).alias("_r")).select("client_id", "figure", "_r.lang", "seq", "_r.record")


def _ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Position of each row in its client's document, without a client-wide sort."""
    return running_sum(df, {"_seq": F.lit(1)}, order)


def _by_date(df: DataFrame) -> DataFrame:
    """Position of each row of a calendar-bounded series in its client's document."""
    return df.withColumn("_seq", F.row_number().over(Window.partitionBy("client_id").orderBy("date", "type")))


def records(r, langs: list[str] | None = None, forecasts: bool = True) -> DataFrame:
    """All list-shaped figures of a ``Retail`` job as localised records, in one DataFrame
    (one job writes every chart). ``forecasts=False`` keeps only the actual rows in
    charts 11 and 12 (no model fit)."""
    langs = langs or languages()
    pf = r.pin("details", "product_flow").product_flow
    parts = [
        _records(charts.top_products(pf), "fig1", F.col("rank"), langs),
        _records(charts.revenue_cogs(pf), "fig3", F.col("rank"), langs),
        _records(charts.top_products(pf), "fig4", F.col("rank"), langs),
        _records(charts.efficiency_totals(pf), "fig5", F.col("label_order") + 1, langs),
        _records(charts.pareto_bands(r.pareto), "fig6", F.col("rank"), langs),
        _records(_ordered(charts.price_quantity(pf), [F.col("product_id")]), "fig7", F.col("_seq"), langs),
        _records(_ordered(charts.restock(pf), [F.col("current_stock"), F.col("product_id")]),
                 "fig9", F.col("_seq"), langs),
        _records(_ordered(charts.stagnant_rows(r.stagnant),
                          [F.col("days_since_last_sale").desc(), F.col("product_id")]),
                 "fig10", F.col("_seq"), langs),
        _records(_by_date((r.fig11 if forecasts else serving.fig11_rows(r.daily_sales_actual, None))
                          .withColumn("date", F.col("date").cast("string"))), "fig11", F.col("_seq"), langs),
        _records(_by_date(r.fig12 if forecasts else serving.fig12_rows(r.monthly_avg_invoice, None)), "fig12",
                 F.col("_seq"), langs),
        _records(charts.bottom_products(pf), "fig13", F.col("rank"), langs),
        _records(charts.sales_histogram(pf).withColumn("product_count", F.col("product_count").cast("double")),
                 "fig14", F.col("rank"), langs),   # counts are written as numbers with a fraction
        _records(charts.top_sellers(pf), "fig15", F.col("rank"), langs),
        _records(charts.top_suppliers(r.outstanding), "fig17", F.col("rank"), langs),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pages(recs: DataFrame, page_rows: int) -> DataFrame:
    """Bounded groups: at most ``page_rows`` records per (client, figure, lang, page); rows
    are numbered from 1, so pages start at 0."""
    g = (recs.withColumn("page", F.floor((F.col("seq") - 1) / page_rows).cast("int"))
             .groupBy("client_id", "figure", "lang", "page")
             .agg(F.array_sort(F.collect_list(F.struct("seq", "record"))).alias("_rs")))
    return g.select("client_id", "figure", "lang", "page",
                    F.concat(F.lit("["), F.array_join(F.transform("_rs", lambda x: x["record"]), ","),
                             F.lit("]")).alias("data"))


def dict_docs(r, langs: list[str]) -> DataFrame:
    """Figures whose data is an object: fig2 (labels/values/colors) and fig16 (shares)."""
    colors = {k: c for k, c, _ in SPECS["fig2"][3]}
    color_map = F.create_map(*[F.lit(x) for kv in colors.items() for x in kv])
    counts = charts.efficiency_counts(r.product_flow)
    out = []
    for lang in langs:
        lab = localize_label(F.col("efficiency"), lang, "efficiency_labels")
        f2 = (counts.groupBy("client_id")
              .agg(F.array_sort(F.collect_list(F.struct((-F.col("product_count")).alias("k"),
                                                         F.col("label_order").alias("o"),
                                                         lab.alias("label"), F.col("product_count").alias("value"),
                                                         F.element_at(color_map, F.col("efficiency")).alias("color"))))
                   .alias("_l"))
              .select("client_id", F.lit("fig2").alias("figure"), F.lit(lang).alias("lang"), F.lit(0).alias("page"),
                      F.to_json(F.struct(F.transform("_l", lambda x: x["label"]).alias("labels"),
                                         F.transform("_l", lambda x: x["value"]).alias("values"),
                                         F.transform("_l", lambda x: x["color"]).alias("colors"))).alias("data")))
        other = _text(lang, "common.other", params.OTHER_LABEL)
        shares = charts.share_table(r.revenue_share, r.profit_share).withColumn(
            "label", F.when(F.col("product_id").isNull(), F.lit(other)).otherwise(F.col("name")))
        per = (shares.groupBy("client_id", "measure")
               .agg(F.array_sort(F.collect_list(F.struct("rank", "label", "value"))).alias("_l"))
               .groupBy("client_id")
               .agg(F.map_from_entries(F.collect_list(F.struct(
                   F.concat("measure", F.lit("_data")),
                   F.transform("_l", lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))))))
                   .alias("_m")))
        f16 = per.select("client_id", F.lit("fig16").alias("figure"), F.lit(lang).alias("lang"),
                         F.lit(0).alias("page"), F.to_json("_m").alias("data"))
        out += [f2, f16]
    res = out[0]
    for d in out[1:]:
        res = res.unionByName(d)
    return res


def _guarded(body: DataFrame, r, langs: list[str]) -> DataFrame:
    """Replace the data of figures that are not eligible by an error object (one page), and
    add the note of the others, from ``chart_status``."""
    message = F.create_map(*[x for lang in langs for fig, code, text in guard_texts(lang)
                             for x in (F.lit(f"{lang}/{fig}/{code}"), F.lit(text))])
    text = lambda code: F.coalesce(F.element_at(message, F.concat_ws("/", "lang", "figure", code)), F.col(code))
    error = F.to_json(F.struct(F.lit(True).alias("error"), text("code").alias("message")))
    out = body.join(r.chart_status.select("client_id", "figure", "ok", "code", "note"), ["client_id", "figure"], "left")
    out = out.filter(F.coalesce("ok", F.lit(True)) | (F.col("page") == 0))
    return out.withColumns({"data": F.when(~F.coalesce("ok", F.lit(True)), error).otherwise(F.col("data")),
                            "note": F.when(F.col("note").isNotNull(), text("note"))}).drop("ok", "code")


def guard_texts(lang: str) -> list[tuple[str, str, str]]:
    """(figure, code, message): the translated guard message, else the code in words."""
    from stocklens.operators.status import RULES
    out = []
    for fig, checks, note in RULES:
        for code in [c for _, c in checks] + ([note[1]] if note else []):
            out.append((fig, code, _text(lang, f"{fig}.errors.{code}", fallback_title(code))))
    return out


def chart_docs(r, langs: list[str] | None = None, run_at: dt.datetime | None = None, forecasts: bool = True,
               guards: bool = False, page_rows: int = PAGE_ROWS) -> DataFrame:
    """LOC-06: every figure x every language for every client:
    ``(client_id, figure, lang, page, metadata, data)``; data is a JSON array (or object),
    ``[]`` where a figure has no rows. ``run_at`` is the timestamp written into the
    metadata (default: midnight of the job's ``as_of``). ``guards=True`` writes the
    eligibility error instead of the data, and appends notes to the description."""
    langs = langs or languages()
    spark = r.pin("details", "product_flow").product_flow.sparkSession
    body = _pages(records(r, langs, forecasts), page_rows).unionByName(dict_docs(r, langs))
    every = F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), F.lit(la).alias("lang"))
                                for f in SPECS for la in langs])).alias("_e")
    slots = r.clients.filter("client_id IS NOT NULL").select("client_id", every).select("client_id", "_e.figure", "_e.lang")
    body = slots.join(body, ["client_id", "figure", "lang"], "left").select(
        "client_id", "figure", "lang", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("data", F.lit("[]")).alias("data"))
    body = _guarded(body, r, langs) if guards else body.withColumn("note", F.lit(None).cast("string"))
    if run_at is None:
        day = r.as_of if isinstance(r.as_of, dt.date) else dt.date.fromisoformat(str(r.as_of)[:10])
        run_at = dt.datetime(day.year, day.month, day.day)
    meta = metadata(spark, langs)
    out = body.join(F.broadcast(meta), ["figure", "lang"])
    described = F.concat_ws(" ", "description", "note")
    return out.select("client_id", "figure", "lang", "page", F.struct(
        F.lit(run_at.strftime("%Y-%m-%d %H:%M:%S")).alias("timestamp"), described.alias("description"),
        "frequency", "title", "chart_type", "x_axis", "y_axis", "series").alias("metadata"), "data")
