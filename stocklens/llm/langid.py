"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays.

A text is folded to lower-case letters with single spaces between words. For each language
an interpolated Kneser-Ney model of ``ORDER`` characters is trained; the n-grams of all
languages share one sorted array of 64-bit hashes per order, with one column of log
probabilities (and of back-off weights) per language. A text gets the language of lowest
cross-entropy per character. ``score`` is the calibrated posterior of that language;
``rejected`` marks texts whose cross-entropy no training language explains.

Models are fitted on about ``docs_per_lang`` whole labelled texts per language, drawn by a
hash of their id; a quarter of these only calibrates. Prediction covers every
row and reads nothing but the text.

Defined cases: null, empty and letterless texts get ``und``, score 0, rejected; ties go to
the first language in order of name; repeated rows and extra columns change nothing; an
empty table gives an empty result; without a labelled row every text is ``und``.
"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import MASK64, Shared, draw, map_batches, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4
DOCS_PER_LANG = 1_200
MAX_LANGS = 1_000          # a bound on the models that are broadcast
UND = "und"
SLACK = 1.5                # a text is rejected above this multiple of the highest calibration entropy;
                           # a mixture of two known languages stays below it, another script far above
_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 18           # characters scored at once

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)),
                                   dtype=bool, count=0x110000))
    return _LETTER[0]


def folded(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, one space between words and at both ends;
    empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return codes[:0]
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]           # the first non-letter after a letter is the space
    codes = codes[keep]
    space = np.full(1, 32, dtype=np.uint32)
    return np.concatenate([space, codes] if codes[-1] == 32 else [space, codes, space])


def gram_key(codes) -> int:
    """Hash of an n-gram of code points; ``keys_at`` gives the same, vectorised."""
    h = 0
    for c in codes:
        h = (h * _BASE + int(c) + 1) & MASK64
    return h


def keys_at(padded: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that end at each position from ORDER - 1 on."""
    m = len(padded) - (ORDER - 1)
    h = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            start = ORDER - n + j
            h = h * np.uint64(_BASE) + padded[start:start + m].astype(np.uint64) + np.uint64(1)
    return h


class Model:
    """langs; per order n the sorted keys with log probabilities [K, L], and the sorted
    contexts with log back-off weights [C, L]; ``floor`` is the log probability of a
    character that no language has."""

    def __init__(self, langs, grams, contexts, floor):
        self.langs, self.grams, self.contexts, self.floor = langs, grams, contexts, floor
        self.sharpness, self.ceiling = 1.0, np.full(len(langs), np.inf)

    def log_probs(self, padded: np.ndarray) -> np.ndarray:
        """Log probability of each character after the first ORDER - 1, per language."""
        m, n_langs = len(padded) - (ORDER - 1), len(self.langs)
        out = np.zeros((m, n_langs), dtype=np.float32)
        left = np.arange(m)
        for n in range(ORDER, 0, -1):
            keys, table = self.grams[n]
            h = keys_at(padded, n)[left]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[left[hit]] += table[at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if n > 1:
                keys, table = self.contexts[n]
                first = np.array([gram_key(padded[ORDER - n:ORDER - 1])], dtype=np.uint64)
                c = np.concatenate([first, keys_at(padded[:-1], n - 1)])[left]   # the n - 1 characters before
                at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                hit = keys[at] == c
                out[left[hit]] += table[at[hit]]
        out[left] += self.floor
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters and cross-entropy per character (nats) of each text, per language."""
        pad = np.full(ORDER - 1, 32, dtype=np.uint32)
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        parts, owners, held = [], [], 0

        def flush():
            nonlocal held
            if parts:
                padded, who = np.concatenate(parts), np.concatenate(owners)
                lp = self.log_probs(padded)
                # the pads at the seams belong to no text
                for k in range(len(self.langs)):
                    s = np.bincount(who[ORDER - 1:] + 1, weights=lp[:, k], minlength=len(texts) + 1)
                    sums[:, k] += s[1:]
                parts.clear()
                owners.clear()
                held = 0

        for i, text in enumerate(texts):
            codes = folded(text)
            sizes[i] = len(codes)
            for a in range(0, len(codes), _SLICE):
                piece = codes[a:a + _SLICE]
                parts += [pad if a == 0 else codes[a - ORDER + 1:a], piece]
                owners += [np.full(ORDER - 1, -1), np.full(len(piece), i)]
                held += len(piece)
                if held >= _SLICE:
                    flush()
        flush()
        return sizes, -sums / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[str]):
        """Language index (-1: und), score, cross-entropy and rejection of each text."""
        sizes, h = self.entropies(texts)
        best = h.argmin(axis=1)
        top = h[np.arange(len(h)), best]
        p = 1.0 / np.exp(-self.sharpness * (h - top[:, None])).sum(axis=1)
        none = sizes == 0
        return (np.where(none, -1, best), np.where(none, 0.0, p), np.where(none, 0.0, top),
                none | (top > self.ceiling[best]))


def kneser_ney(counts: dict[str, int]):
    """Interpolated Kneser-Ney from counts of ORDER-grams: per order n, gram -> probability
    and context -> back-off weight. Orders below the highest use continuation counts."""
    by_order: dict[int, dict[str, int]] = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        lower: Counter[str] = Counter(g[1:] for g in by_order[n + 1])
        by_order[n] = lower
    probs: dict[int, dict[str, float]] = {}
    weights: dict[int, dict[str, float]] = {}
    uniform = 1.0 / (len(by_order[1]) + 1)
    for n in range(1, ORDER + 1):
        table = by_order[n]
        seen = Counter(table.values())
        d = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] else 0.5
        total: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for g, c in table.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        weights[n] = {ctx: d * kinds[ctx] / total[ctx] for ctx in total}
        probs[n] = {g: (c - d) / total[g[:-1]] + weights[n][g[:-1]] * (probs[n - 1][g[1:]] if n > 1 else uniform)
                    for g, c in table.items()}
    return probs, weights, uniform


def build_model(counts: dict[str, dict[str, int]]) -> Model:
    """One shared set of sorted arrays from each language's ORDER-gram counts."""
    langs = sorted(counts)
    parts = [kneser_ney(counts[lang]) for lang in langs]

    def prob(k: int, n: int, g: str) -> float:
        probs, weights, uniform = parts[k]
        if n == 0:
            return uniform
        if g in probs[n]:
            return probs[n][g]
        return weights[n].get(g[:-1], 1.0) * prob(k, n - 1, g[1:])

    def array(rows: dict[str, list[float]]):
        keys = np.array([gram_key(map(ord, g)) for g in rows], dtype=np.uint64)
        order = np.argsort(keys)
        return keys[order], np.log(np.array(list(rows.values()), dtype=np.float64))[order].astype(np.float32)

    grams, contexts = {}, {}
    for n in range(1, ORDER + 1):
        union = set().union(*(p[0][n] for p in parts))
        grams[n] = array({g: [prob(k, n, g) for k in range(len(langs))] for g in sorted(union)})
        if n > 1:
            union = set().union(*(p[1][n] for p in parts))
            contexts[n] = array({c: [p[1][n].get(c, 1.0) for p in parts] for c in sorted(union)})
    floor = np.log(np.array([parts[k][1][1][""] * parts[k][2] for k in range(len(langs))])).astype(np.float32)
    return Model(langs, grams, contexts, floor)


def _sample(df: DataFrame, doc_id: str, text: str, lang: str, docs_per_lang: int) -> DataFrame:
    """(lang, text, part): about ``docs_per_lang`` labelled rows of each language, by a hash of
    the id; part 3 calibrates. Only counts are gathered, nothing is ranked."""
    own = F.col(doc_id).cast("string")
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), draw("language", own, F.col(text)).alias("u"), F.xxhash64(own, F.col(text)).alias("key"),
        F.pmod(F.xxhash64(own, F.lit("part")), F.lit(4)).alias("part"), F.col(text).cast("string").alias("text"))
    counts = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages; their models are bounded")
    within = F.lit(False)
    for r in counts:
        within = within | ((F.col("lang") == r["lang"]) & (F.col("u") < docs_per_lang / r["count"]))
    return rows.filter(within).dropDuplicates(["key"]).select("lang", "text", "part")    # copies count once


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          docs_per_lang: int = DOCS_PER_LANG) -> Model | None:
    """Fit and calibrate on labelled rows; None without any."""
    rows = _sample(df, doc_id, text, lang, docs_per_lang)

    def count():
        def step(cols):
            out: dict[str, Counter[str]] = defaultdict(Counter)
            for la, t in zip(cols["lang"], cols["text"]):
                codes = folded(t)
                if len(codes):
                    s = " " * (ORDER - 1) + codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    out[la].update(s[i:i + ORDER] for i in range(len(s) - ORDER + 1))
            flat = [(la, g, n) for la, c in out.items() for g, n in c.items()]
            return {"lang": [x[0] for x in flat], "gram": [x[1] for x in flat], "n": [x[2] for x in flat]}
        return step

    def counts_of(part) -> dict[str, dict[str, int]]:
        got: dict[str, dict[str, int]] = defaultdict(dict)
        for r in (map_batches(rows.filter(part).select("lang", "text"), count, "lang string, gram string, n long")
                  .groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()):
            got[r["lang"]][r["gram"]] = r["n"]
        return got

    counts = counts_of(F.col("part") != 3) or counts_of(F.lit(True))
    if not counts:
        return None
    model = build_model(counts)
    calibrate(model, rows.filter(F.col("part") == 3))
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Set the posterior's sharpness (least log loss) and each language's entropy ceiling."""
    sent = Shared(rows.sparkSession, model)

    def score():
        m = sent.value

        def step(cols):
            sizes, h = m.entropies(cols["text"])
            return {"lang": cols["lang"], "n": sizes, "h": list(h)}
        return step

    got = [r for r in map_batches(rows.select("lang", "text"), score, "lang string, n long, h array<double>").collect()
           if r["n"] and r["lang"] in model.langs]
    if not got:
        return
    h, true = np.array([r["h"] for r in got]), np.array([model.langs.index(r["lang"]) for r in got])

    def loss(s: float) -> float:
        z = -s * h
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), true]))

    model.sharpness = min((0.5, 1, 2, 5, 10, 20, 50, 100), key=loss)
    own = h[np.arange(len(h)), true]
    for k in range(len(model.langs)):
        if (true == k).any():
            model.ceiling[k] = own[true == k].max() * SLACK


def detect(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus lang_pred, score, cross_entropy and rejected."""
    types = dict(df.dtypes)
    sent = Shared(df.sparkSession, model)

    def predictor():
        m = sent.value

        def step(cols):
            texts = cols.pop("__text")
            if m is None:
                n = len(texts)
                return cols | {"lang_pred": [UND] * n, "score": [0.0] * n, "cross_entropy": [0.0] * n, "rejected": [True] * n}
            best, p, h, rejected = m.predict(texts)
            return cols | {"lang_pred": [m.langs[b] if b >= 0 else UND for b in best], "score": p,
                           "cross_entropy": h, "rejected": rejected}
        return step

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep),
                        "lang_pred string, score double, cross_entropy double, rejected boolean"])
    return map_batches(df.select(*keep, text_of(text).alias("__text")), predictor, schema)


def accepted_rows(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is known, all columns kept; nothing is shuffled."""
    sent = Shared(df.sparkSession, model)

    def run(batches):
        import pyarrow as pa
        m = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            rejected = m.predict(texts)[3] if m is not None else np.ones(len(texts), dtype=bool)
            yield batch.filter(pa.array(~rejected))

    return df.mapInArrow(run, df.schema)
