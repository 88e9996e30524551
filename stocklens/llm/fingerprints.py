"""Document fingerprints: I-Match over an idf band with randomised lexicons, all native.

Terms are runs of letters and digits, lower case. The lexicon is the band of terms whose
document frequency lies between ``LOW`` and ``HIGH`` of all documents; it holds at most
(mean distinct terms per document) / LOW terms, whatever the number of documents, and is
broadcast. Each of ``len(RATES)`` randomised lexicons keeps a term with probability
2^-rate, by a hash. A text's fingerprint has one 32-bit hash per lexicon, of the sorted
distinct terms that the lexicon keeps (0: none). Likeness of two fingerprints is the share
of equal parts among the lexicons that keep a term of either text. The graded rates make
some lexicons hold only a few terms of a text, whether it is short or long.

A text without any term in the band has one part instead, the hash of all its sorted
distinct terms, so that equal texts stay alike (likeness 1) and others do not (0).

Defined cases: null texts count as empty; empty texts share one fingerprint; equal texts
have equal fingerprints; in the order of ids equal rows (id and text) count as one
document and each gets its result, equal ids are ordered by a hash, null ids come last; the
only document is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stocklens.llm.common import let, staged, text_of

LOW, HIGH = 0.001, 0.1
RATES = [0, 1, 1, 2, 2, 3, 3, 3] + [4] * 5 + [5] * 7 + [6] * 9 + [7] * 10 + [8] * 10 + [9] * 10
ROWS_PER_BLOCK = 20_000    # rows of one block of the id order
MAX_BLOCKS = 2_000


def terms(text: Column) -> Column:
    """Sorted distinct terms of a text. (``sort_array`` compares natively; ``array_sort`` would
    evaluate a lambda for each comparison.)"""
    return F.sort_array(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")))


def lexicon(df: DataFrame, text: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, mask): the band's terms; bit k of the mask says that lexicon k keeps the term."""
    n = df.count()
    freq = df.select(F.explode(terms(text_of(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = freq.filter((F.col("df") >= low * n) & (F.col("df") <= max(1.0, high * n)))
    rates = f"array({', '.join(map(str, RATES))})"
    mask = F.expr(f"aggregate(sequence(0, {len(RATES) - 1}), 0L, (acc, k) -> acc | "
                  f"if(pmod(xxhash64(term, k), shiftleft(1L, {rates}[k])) = 0, shiftleft(1L, k), 0L))")
    return staged(band.select("term", mask.alias("mask")), "lexicon")


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), text_of(text))


def nonzero(items: Column) -> Column:
    """A 32-bit hash that is never 0."""
    return F.coalesce(F.nullif(F.shiftright(F.xxhash64(F.array_join(items, " ")), 32).cast("int"), F.lit(0)), F.lit(1))


def likeness(a: Column, b: Column) -> Column:
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    same = F.size(F.filter(pairs, lambda x: (x["a"] == x["b"]) & (x["a"] != 0)))
    either = F.size(F.filter(pairs, lambda x: (x["a"] != 0) | (x["b"] != 0)))
    return F.when(either > 0, same / either).otherwise(F.lit(0.0))


def rendered(p: Column) -> Column:
    return F.array_join(F.transform(p, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def successors(ids: DataFrame) -> DataFrame:
    """(row, doc_id, n_chars, copies, next): each row's next in descending order of id, after the last
    the first. Ids are cut into blocks by quantiles; only block heads meet in one window,
    and there are at most MAX_BLOCKS of them."""
    n = ids.count()
    blocks = max(1, min(MAX_BLOCKS, n // ROWS_PER_BLOCK))
    cuts = []
    if blocks > 1:
        cuts = ids.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)])).first()[0] or []
    cuts = sorted(set(cuts))
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    rows = ids.withColumn("block", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(block))
    order = [F.desc_nulls_last("doc_id"), F.asc("row")]
    w = Window.partitionBy("block").orderBy(*order)
    led = rows.withColumns({"after": F.lead("row").over(w), "rank": F.row_number().over(w)})
    led = staged(led, "order")
    heads = led.filter("rank = 1").select("block", F.col("row").alias("head"))
    all_heads = Window.orderBy(F.desc("block"))
    heads = heads.withColumn("below", F.coalesce(F.lead("head").over(all_heads), F.first("head").over(all_heads)))
    return led.join(F.broadcast(heads.select("block", "below")), "block").select(
        "row", "doc_id", "n_chars", "copies", F.coalesce("after", "below").alias("next"))


def fingerprint_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      low: float = LOW, high: float = HIGH) -> DataFrame:
    """For every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next."""
    lex = F.broadcast(lexicon(df, text, low, high))
    docs = df.select(row_key(doc_id, text).alias("row"), text_of(text).alias("text"))
    ids = staged(df.select(row_key(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"),
                           F.length(text_of(text)).cast("long").alias("n_chars"))
                 .groupBy("row", "doc_id", "n_chars").agg(F.count(F.lit(1)).cast("int").alias("copies")), "ids")
    chain = staged(successors(ids), "chain")

    cut = lambda n: F.floor(F.col(n) / 3)
    givers = chain.select(F.col("next").alias("row"), F.col("row").alias("taker"), cut("n_chars").alias("take"))
    heads = (docs.join(givers, "row").select(F.col("taker").alias("row"), F.expr("substring(text, 1, int(take))").alias("head"))
             .dropDuplicates(["row"]))
    body = docs.join(chain.select("row", "doc_id", "n_chars", "copies", "next"), "row").join(heads, "row")
    edited = F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 3)))"), F.col("head"))

    # one array of (side, term) pairs per row, and one element that carries what the row keeps;
    # grouping by row again needs no further shuffle
    tagged = body.withColumn("edited", edited).withColumns({"own": terms(F.col("text")), "new": terms(F.col("edited"))})
    kept = F.struct("doc_id", "n_chars", "copies", "next", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
                    nonzero(F.col("own")).alias("h_own"), nonzero(F.col("new")).alias("h_new"))
    tagged = tagged.select("row", "own", "new", kept.alias("kept"))
    none = F.lit(None).cast(tagged.schema["kept"].dataType)
    element = lambda s, t, k: F.struct(F.lit(s).alias("side"), t.alias("term"), k.alias("kept"))
    flat = tagged.select("row", F.explode(F.concat(
        F.transform("own", lambda t: element(0, t, none)), F.transform("new", lambda t: element(1, t, none)),
        F.array(element(2, F.lit(None).cast("string"), F.col("kept"))))).alias("x")).select("row", "x.*")
    found = flat.join(lex, "term", "left").filter((F.col("side") == 2) | F.col("mask").isNotNull())
    pick = lambda s: F.sort_array(F.collect_set(F.when(F.col("side") == s, F.struct("term", "mask"))))
    grouped = found.groupBy("row").agg(F.first("kept", ignorenulls=True).alias("kept"), pick(0).alias("own"), pick(1).alias("new"))
    signed = staged(grouped.select("row", "kept.*", parts_of("own", "kept.h_own").alias("fp"),
                                   parts_of("new", "kept.h_new").alias("efp")).drop("h_own", "h_new"), "prints")
    following = signed.select(F.col("row").alias("next"), F.col("fp").alias("nfp"))
    out = signed.join(following, "next").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "n_chars", "edited_sha256", rendered(F.col("fp")).alias("fingerprint"),
                      rendered(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
                      likeness(F.col("fp"), F.col("nfp")).alias("near_next"))


def _tier(low: int, high: int) -> int:
    """Mask of the lexicons whose rate is within the bounds."""
    return sum(1 << k for k, rate in enumerate(RATES) if low <= rate <= high)


def parts_of(kept: str, whole: str) -> Column:
    """The parts from the sorted (term, mask) pairs; ``whole``: hash of all terms. Sparse
    lexicons look at the pairs that any lexicon of their tier keeps."""
    def tier(among: Column, low: int, high: int) -> Column:
        def one(bit: Column) -> Column:
            own = F.filter(among, lambda x: x["mask"].bitwiseAND(bit) != 0)
            return let(own, lambda o: F.when(F.size(o) > 0, nonzero(F.transform(o, lambda x: x["term"]))).otherwise(F.lit(0)))
        return F.transform(F.array(*[F.lit(1 << k).cast("long") for k, rate in enumerate(RATES) if low <= rate <= high]), one)

    def band(pairs: Column) -> Column:
        some = lambda low, high: let(
            F.filter(pairs, lambda x: x["mask"].bitwiseAND(F.lit(_tier(low, high))) != 0), lambda few: tier(few, low, high))
        return F.concat(tier(pairs, 0, 3), some(4, 6), some(7, 99), F.array(F.lit(0)))

    bare = F.array(*[F.lit(0)] * len(RATES), F.col(whole))
    return F.when(F.size(F.col(kept)) > 0, let(F.col(kept), band)).otherwise(bare)
