"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Documents are weighed in tokens and fall into cells (source, language, topic). Target
shares are given, or derived, for each of the three marginals. Raking scales the cells'
keep probabilities to one marginal after the other, never above 1, until the expected kept
tokens meet all of them (a class with less than its target is kept whole, the others share what
it cannot give); then each document is kept with its cell's probability, by a hash
of its id and text.

Topics come from spherical k-means over hashed word frequencies, fitted on all documents: one
pass makes their vectors, which rest as Parquet, and every step of the fit is a pass over them that
returns at most TOPICS x WIDTH sums. Vectors and centroids are rounded to integers, so sums and
products are exact and the model does not depend on the order or the partitions of the rows.

The cell table is bounded: at most ``max_classes`` sources and languages are named (the
largest by tokens). The others share one class, ``other``, whose target is the sum of theirs, so
they are kept at one common rate and none is left out; topics number ``TOPICS``.

Defined cases: a null source or language is the class ``(null)``; null and empty texts have
0 tokens, topic 0 and the probability of their cell; equal rows (same id and text) share one
decision; an empty table gives an empty result; extra columns are kept as they are. With
targets that the cells cannot meet exactly the closest raking is used.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import Shared, WordIds, draw, map_batches, staged, text_of, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOPICS = 8
WIDTH = 512                # hashed word features
LOG_STEPS = 2_048          # log frequencies are kept in steps of 1 / LOG_STEPS
UNIT = 32_767              # entries of unit vectors are kept in steps of 1 / UNIT
MAX_CLASSES = 4_096        # named sources, and named languages
BUDGET = 0.5               # share of all tokens to keep, if classes with a target have that many
# Default targets: token shares to this power. A class that has less than its share is kept whole.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.9}
DIMS = ("source", "lang", "topic")
NULL, OTHER = "(null)", "other"


def frequencies(ids: np.ndarray) -> bytes:
    """Hashed word counts of a text: log(1 + count) in LOG_STEPS, 16 bits each."""
    counts = np.bincount((ids & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
    return np.rint(np.log1p(counts) * LOG_STEPS).astype("<u2").tobytes()


def matrix(rows: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), WIDTH).astype(np.float64)


class TopicModel:
    """idf weights and unit centroids over hashed word features."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray):
        self.idf, self.centroids = idf, np.rint(centroids * UNIT)

    def units(self, logs: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of ``frequencies``, in UNIT steps; zero where there are no words."""
        v = logs * self.idf
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.rint(v / np.where(n, n, 1) * UNIT)

    def nearest(self, units: np.ndarray) -> np.ndarray:
        return (units @ self.centroids.T).argmax(axis=1)

    def topics(self, rows: list[bytes]) -> list[int]:
        return [k for i in range(0, len(rows), 1024) for k in self.nearest(self.units(matrix(rows[i:i + 1024], "<u2"))).tolist()]


def word_rows(df: DataFrame, schema: str, *keep) -> DataFrame:
    """``keep`` columns, the number of words and the ``frequencies`` of every text."""
    def counter():
        words = WordIds()

        def step(cols):
            ids = [words.of(words_of(t)) for t in cols.pop("text")]
            return cols | {"tokens": [len(i) for i in ids], "v": [frequencies(i) for i in ids]}
        return step

    return map_batches(df.select(*keep), counter, f"{schema}, tokens long, v binary")


def _sums(rows: DataFrame, name: str, kind: str, fn) -> np.ndarray:
    """TOPICS x WIDTH sums of ``fn`` (rows of one batch -> sums in whole numbers) over all batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TOPICS, WIDTH))
        for batch in batches:
            held = batch.column(0).to_pylist()
            for i in range(0, len(held), 1024):
                total += fn(matrix(held[i:i + 1024], kind))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], names=["at", "n"])

    out = np.zeros(TOPICS * WIDTH)
    for r in rows.select(name).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(TOPICS, WIDTH)


def _farthest(x: DataFrame, chosen: np.ndarray) -> np.ndarray:
    """The vector least similar to its most similar chosen one (of equal ones the smallest h)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            hs, held = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i in range(0, len(held), 1024):
                near = (matrix(held[i:i + 1024], "<i2") @ chosen.T).max(axis=1)
                k = int(np.lexsort((hs[i:i + 1024], near))[0])
                found = (int(near[k]), int(hs[i + k]), held[i + k])
                best = found if best is None else min(best, found)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in best], names=["near", "h", "x"])

    return matrix([x.select("h", "x").mapInArrow(run, "near long, h long, x binary").orderBy("near", "h").first()["x"]], "<i2")


def fit_topics(rows: DataFrame, rounds: int = 20) -> TopicModel:
    """Spherical k-means over all rows (h, v) with deterministic farthest-point starts; it ends
    when no centroid moves. Rows of equal h count once."""
    once = staged(rows.select("h", "v").dropDuplicates(["h"]), "frequencies")
    n = once.count()

    def holding(logs):
        out = np.zeros((TOPICS, WIDTH))
        out[0] = (logs > 0).sum(axis=0)
        return out

    idf = np.log((1 + n) / (1 + _sums(once, "v", "<u2", holding)[0])) + 0.1
    plain = TopicModel(idf, np.eye(TOPICS, WIDTH))

    def unit():
        def step(cols):
            kept = [(h, u) for i in range(0, len(cols["h"]), 1024) for h, u in zip(
                cols["h"][i:i + 1024], plain.units(matrix(cols["v"][i:i + 1024], "<u2")).astype("<i2")) if u.any()]
            return {"h": [h for h, _ in kept], "x": [u.tobytes() for _, u in kept]}
        return step

    x = staged(map_batches(once, unit, "h long, x binary"), "units")
    first = x.orderBy("h").first()
    if first is None:
        return plain
    c = matrix([first["x"]], "<i2")
    while len(c) < TOPICS:
        c = np.concatenate([c, _farthest(x, c)])
    model = TopicModel(idf, c / UNIT)
    for _ in range(rounds):
        def members(units, model=model):
            return np.eye(TOPICS)[model.nearest(units)].T @ units

        m = _sums(x, "x", "<i2", members)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        new = TopicModel(idf, np.where(size > 0, m / np.where(size > 0, size, 1), model.centroids / UNIT))
        if (new.centroids == model.centroids).all():
            break
        model = new
    return model


def quotas(have: np.ndarray, want: np.ndarray, size: float) -> np.ndarray:
    """Tokens that each class gives to a kept set of ``size``: in proportion to ``want``, but no
    more than it has; what scarce classes cannot give is shared by the others."""
    use = want > 0
    order = np.flatnonzero(use)[np.argsort(have[use] / want[use], kind="stable")]      # scarcest first
    out = np.zeros(len(want))
    if not len(order):
        return out
    h, w = have[order], want[order]
    given, left = np.cumsum(h) - h, np.cumsum(w[::-1])[::-1]
    scale = (size - given) / left                       # if all scarcer classes give everything
    whole = int(np.argmax(np.append(scale * w < h, True)))      # the first class that need not
    out[order[:whole]] = h[:whole]
    if whole < len(order):
        out[order[whole:]] = scale[whole] * w[whole:]
    return out


def rake(tokens: np.ndarray, labels: list[np.ndarray], targets: list[np.ndarray], budget: float = BUDGET,
         rounds: int = 2_000, tolerance: float = 1e-9) -> np.ndarray:
    """Keep probability of each cell. ``labels[d][i]`` is the class of cell i in dimension d,
    ``targets[d]`` the share of kept tokens wanted for each class. A class that has less than
    its share is kept whole, and the other classes share the rest."""
    total = tokens.sum()
    if not total:
        return np.ones(len(tokens))
    have = [np.bincount(lab, weights=tokens, minlength=len(want)) for lab, want in zip(labels, targets)]
    size = min(budget * total, *(float(h[want > 0].sum()) for h, want in zip(have, targets)))
    goal = [quotas(h, want, size) for h, want in zip(have, targets)]
    p = np.full(len(tokens), min(1.0, size / total))
    for _ in range(rounds):
        worst = 0.0
        for lab, quota in zip(labels, goal):
            got = np.bincount(lab, weights=tokens * p, minlength=len(quota))
            ratio = np.divide(quota, got, out=np.ones(len(quota)), where=got > 0)
            ratio[quota == 0] = 0.0
            p = np.minimum(1.0, p * ratio[lab])
            worst = max(worst, float((np.abs(got - quota) / np.where(quota > 0, quota, 1)).max()))
        if worst < tolerance:
            break
    return np.where(p > 1 - 1e-6, 1.0, p)


def _class(name: str, named: list[str]):
    c = F.coalesce(F.col(name).cast("string"), F.lit(NULL))
    return F.when(c.isin(named), c).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


class Plan:
    """What the sampling pass needs: topics, named classes, cell probabilities."""

    def __init__(self, topics: TopicModel, named: dict[str, set[str]], prob: dict[tuple[str, str, int], float],
                 targets: dict[str, dict]):
        self.topics, self.named, self.prob, self.targets = topics, named, prob, targets

    def cell(self, source, lang, topic: int) -> tuple[str, str, int]:
        s, la = (NULL if v is None else str(v) for v in (source, lang))
        return (s if s in self.named["source"] else OTHER, la if la in self.named["lang"] else OTHER, topic)


def make_plan(df: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET,
              doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
              max_classes: int = MAX_CLASSES) -> Plan:
    """Count the tokens of all documents by cell and rake them to the targets (by default the
    token shares, tempered)."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    seen = staged(word_rows(df, "h long, source string, lang string", F.xxhash64(F.col(doc_id).cast("string"), text_of(text)).alias("h"),
                            key(source).alias("source"), key(lang).alias("lang"), text_of(text).alias("text")), "words")
    topics = fit_topics(seen)
    sent = Shared(df.sparkSession, topics)

    def assign():
        model = sent.value

        def step(cols):
            return cols | {"topic": model.topics(cols.pop("v"))}
        return step

    rows = map_batches(seen.select("source", "lang", "tokens", "v"), assign, "source string, lang string, topic long, tokens long")
    cells = staged(rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "cells")
    named = {d: [r[d] for r in cells.groupBy(d).agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), d)
                 .limit(max_classes).collect()] for d in ("source", "lang")}
    table = (cells.groupBy(_class("source", named["source"]).alias("source"), _class("lang", named["lang"]).alias("lang"),
                           "topic").agg(F.sum("tokens").alias("tokens")).collect())
    tokens = np.array([r["tokens"] for r in table], dtype=np.float64)
    labels, wanted, used = [], [], {}
    for d in DIMS:
        names = sorted({r[d] for r in table})
        at = {v: k for k, v in enumerate(names)}
        lab = np.array([at[r[d]] for r in table], dtype=np.int64)
        have = np.bincount(lab, weights=tokens, minlength=len(names)) if len(table) else np.zeros(0)
        if targets and d in targets:
            own = {str(k): float(v) for k, v in targets[d].items()}
            rest = sum(v for k, v in own.items() if k not in named[d]) if d in named else 0.0     # of the classes without a name
            want = np.array([rest if v == OTHER and d in named and v not in named[d] else own.get(str(v), 0.0) for v in names])
        else:
            want = np.where(have > 0, have, 0.0) ** TEMPER[d] * (have > 0)
        want = want / want.sum() if want.sum() else want
        labels.append(lab)
        wanted.append(want)
        used[d] = dict(zip(names, want.tolist()))
    prob = rake(tokens, labels, wanted, budget)
    cell = {(r["source"], r["lang"], r["topic"]): float(p) for r, p in zip(table, prob)}
    return Plan(topics, {d: set(v) for d, v in named.items()}, cell, used)


def _decide(plan: Plan, words: WordIds, texts, sources, langs):
    """Topic, token count and keep probability of each row."""
    ids = [words.of(words_of(t or "")) for t in texts]
    topic = plan.topics.topics([frequencies(i) for i in ids])
    p = [plan.prob.get(plan.cell(s, la, t), 0.0) for s, la, t in zip(sources, langs, topic)]
    return topic, [len(i) for i in ids], p


def mixture(df: DataFrame, plan: Plan, doc_id: str = "doc_id", text: str = "text", source: str = "source",
            lang: str = "lang") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept for every row."""
    sent = Shared(df.sparkSession, plan)

    def decide():
        plan_, words = sent.value, WordIds()

        def step(cols):
            topic, n, p = _decide(plan_, words, cols.pop("text"), cols["source"], cols["lang"])
            return cols | {"topic": topic, "n_tokens": n, "probability": p}
        return step

    types = dict(df.dtypes)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                     F.col(lang).cast("string").alias("lang"), draw("keep", F.col(doc_id).cast("string"), text_of(text)).alias("u"), text_of(text).alias("text"))
    out = map_batches(rows, decide, f"doc_id {types[doc_id]}, source string, lang string, topic long, n_tokens long, "
                                    "probability double, u double")
    return out.withColumn("kept", F.col("u") < F.col("probability")).drop("u")


def sample_rows(df: DataFrame, plan: Plan, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                lang: str = "lang") -> DataFrame:
    """The kept rows, all columns as they were: one pass, nothing joined or shuffled."""
    sent = Shared(df.sparkSession, plan)
    name = "__draw"
    while name in df.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_, words = sent.value, WordIds()
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            _, _, p = _decide(plan_, words, col(text), col(source), col(lang))
            yield batch.filter(pa.array([u < q for u, q in zip(col(name), p)], type=pa.bool_()))

    drawn = df.withColumn(name, draw("keep", F.col(doc_id).cast("string"), text_of(text)))
    return drawn.mapInArrow(run, drawn.schema).drop(name)
