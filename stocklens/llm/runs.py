"""Periodic run detection: Lyndon arrays by phase one of a grouping suffix sorter, roots extended to runs.

A run of a word sequence is a stretch with smallest period q, of at least ``max(least,
exponent * q)`` words, that no neighbouring word extends. Per document:

1. Links. Inside such a run every pair of adjacent words occurs at least ``exponent - 1``
   times. A link between two words that occurs less often cannot lie in a run, so it cuts the
   sequence; hashed counts can only be too high, so no run is cut. Shorter pieces go.
2. Grouping (Baier's phase one) of each piece, under the order of the word numbers and its
   reverse: suffixes start in one group per first word; from the highest group down, each
   member hands its word to the nearest suffix on its left in a lower group, which moves to a
   new group right above its old one. In the end a suffix's context is the longest Lyndon
   word that starts there, and equal contexts share a group: no suffix array is built.
3. Runs. Two neighbouring equal contexts are a square of a Lyndon root; common extension to
   both sides gives the run, once for each period and place. Every run of exponent three or
   more holds two whole roots in a row under one of the two orders.

Each document is one row and independent of the others; work and memory are linear in its
words, whatever their repetition.

Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed text;
very long texts are taken whole; repeated rows give repeated results; an empty table gives an
empty result; other columns are not read, and only ``keep`` columns are returned (a clash of
a kept name with a result column is an error).
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from stocklens.llm.common import let, map_batches, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 6                # words of the shortest run
EXPONENT = 4             # a run repeats its period at least so often
CHUNK = 1 << 18          # words that a task numbers at a time
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
WORD = r"[^\x20\x09-\x0D]+"


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int]]:
    """Length of the longest Lyndon word at each place of ``s``, and its group (equal words,
    equal group)."""
    n = len(s)
    number = {v: g for g, v in enumerate(sorted(set(s)))}
    group = [number[v] for v in s]
    members: list[list[int]] = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    lower = list(range(-1, len(number) - 1))
    upper = [*range(1, len(number)), -1]
    length = [1] * n
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))     # places not grouped for good
    g = len(number) - 1
    while g >= 0:
        takers: dict[int, int] = {}
        size = 0
        for i in members[g]:                     # by place; who has moved on is skipped
            if group[i] == g:
                p, r = left[i], right[i]
                size = length[i]
                if r < n:
                    left[r] = p
                if p >= 0:
                    right[p] = r
                    takers[p] = takers.get(p, 0) + 1
        fresh: dict[tuple[int, int], int] = {}
        many = takers.items()
        if len(takers) > 1 and max(takers.values()) > 1:
            many = sorted(many, key=lambda x: -x[1])     # more copies of the word: a higher group
        for p, times in many:
            old = group[p]
            new = fresh.get((old, times))
            if new is None:
                new = fresh[old, times] = len(members)
                above = upper[old]
                members.append([])
                lower.append(old)
                upper.append(above)
                upper[old] = new
                if above >= 0:
                    lower[above] = new
            group[p] = new
            length[p] += times * size
            members[new].append(p)
        g = lower[g]
    return length, group


def runs_of(s: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``s``, sorted by start, then period."""
    n, found = len(s), set()
    for order in (s, [-v for v in s]):
        length, group = lyndon_groups(order)
        reached: dict[int, int] = {}             # period -> end of its last run
        for i, q in enumerate(length):
            j = i + q
            if j < n and group[i] == group[j] and reached.get(q, 0) < j + q:
                start, end = i, j + q
                while end < n and s[end] == s[end - q]:
                    end += 1
                while start and s[start - 1] == s[start - 1 + q]:
                    start -= 1
                reached[q] = end
                if end - start >= max(least, exponent * q):
                    found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def pieces(ids: np.ndarray, owner: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Borders of the stretches of at least ``least`` words whose every link occurs often
    enough to lie in a run. ``owner`` numbers the documents; links never join two of them."""
    at, part = np.arange(len(ids)), owner.astype(np.uint64)
    ids = ids.astype(np.uint64)
    while len(at) >= least:
        joined = (at[1:] == at[:-1] + 1) & (part[1:] == part[:-1])
        with np.errstate(over="ignore"):
            key = (ids[at[:-1]] * np.uint64(0x9E3779B97F4A7C15) + ids[at[1:]] * np.uint64(0xC2B2AE3D27D4EB4F)
                   + part[1:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        bits = max(8, len(at).bit_length() + 2)
        key = (key >> np.uint64(64 - bits)).astype(np.int64)
        joined &= np.bincount(key[joined], minlength=1 << bits)[key] >= exponent - 1
        first = np.concatenate([[0], np.flatnonzero(~joined) + 1])
        size = np.diff(np.append(first, len(at)))
        long_ = size >= least
        if size[long_].sum() == len(at) and len(first) == len(np.unique(part)):
            break
        piece = np.repeat(np.arange(len(first)), size)
        keep = long_[piece]
        at, part = at[keep], piece[keep].astype(np.uint64)
    else:
        return []
    return list(zip(at[first].tolist(), (at[first] + size).tolist(), strict=True))


class Numbers(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def runs_of_texts(texts: list[str], least: int, exponent: int):
    """For each text: words, runs and the collapsed text."""
    docs = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = [len(d) for d in docs]
    numbers = Numbers()
    ids = np.fromiter((numbers[w] for d in docs for w in d), dtype=np.int64, count=sum(sizes))
    owner = np.repeat(np.arange(len(docs)), sizes)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for start, end in pieces(ids, owner, least, exponent):
        d = int(owner[start])
        shift = start - int(offset[d])
        runs[d] += [(b + shift, m, q) for b, m, q in runs_of(ids[start:end].tolist(), least, exponent)]
    collapsed = []
    for words, found in zip(docs, runs, strict=True):
        if found:
            stays = bytearray(b"\x01") * len(words)
            for b, m, q in found:
                stays[b + q:b + m] = bytes(m - q)
            words = [w for w, k in zip(words, stays, strict=True) if k]
        collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return sizes, runs, collapsed


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT,
              keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_words, runs (start, length, period; by start, then period) and
    collapsed: the text without the words that a run repeats, joined by one space."""
    if exponent < 3:
        raise ValueError("runs are found from an exponent of 3")
    types = dict(df.dtypes)

    def finder():
        def step(cols):
            texts = cols.pop("__text")
            sizes, runs, collapsed, at = [], [], [], 0
            while at < len(texts):
                upto, letters = at, 0
                while upto < len(texts) and letters < CHUNK * 6:
                    letters += len(texts[upto])
                    upto += 1
                for out, more in zip((sizes, runs, collapsed), runs_of_texts(texts[at:upto], least, exponent), strict=True):
                    out += more
                at = upto
            runs = [[{"start": b, "length": m, "period": q} for b, m, q in r] for r in runs]
            return cols | {"n_words": sizes, "runs": runs, "collapsed": collapsed}
        return step

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "n_words bigint", f"runs {RUNS}", "collapsed string"])
    return map_batches(df.select(*keep, text_of(text).alias("__text")), finder, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length/period; ties: smallest start, then period (the order
    of ``runs``). Null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def listing(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))


def planted(text: Column, number: Column) -> Column:
    """Texts with periods planted by rule: where ``number`` % 10 is 0, the words from place
    a = g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them, with g = number / 10."""
    g = F.floor(number / F.lit(10)).cast("bigint")

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % F.lit(8)))).cast("int")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.concat_ws(" ", F.transform(
            words, lambda w, i: F.when(i >= v["a"], F.get(words, v["a"] + (i - v["a"]) % v["p"])).otherwise(w))))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(number % F.lit(10) == 0, let(words, repeat)).otherwise(text)
