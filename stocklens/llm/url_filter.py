"""URL filter: a sorted array of 64-bit xxhash digests, memory-mapped by the workers.

Entries are ``host + path prefix`` strings. A url's candidates are every suffix of its host
(whole labels) with every prefix length of path that any entry has; their digests are probed
with one vectorised binary search, and a hit counts only if the stored string is equal. The
longest entry wins. The file is written once into ``spark.checkpoint.dir`` and sent to the
executors with ``addFile``; workers of one machine share its pages.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no entry
and gets the default verdict; rows are independent; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame

from stocklens.llm.common import map_batches, publish

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The file stays below this many entries (a proven bound on what is sent to executors).
MAX_ENTRIES = 50_000_000
ALLOW, BLOCK, LISTED = 0, 1, 2

# Rules of the production query (fixed values): (verdict, host, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Names of hosts that the block list holds below each domain (fixed values)
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_DOMAINS = ["example.com", "example.net", "example.org"]
LISTED_HOSTS = [f"{n}.{d}" for d in LISTED_DOMAINS for n in LISTED_NAMES]

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_AZ), path[:stop]


def build_array(entries: Iterable[tuple[str, int]]) -> bytes:
    """The file: entry count, sorted digests, string offsets, codes, strings. For equal
    strings the first entry counts."""
    codes: dict[str, int] = {}
    for name, code in entries:
        codes.setdefault(name, code)
    if len(codes) > MAX_ENTRIES:
        raise ValueError(f"{len(codes)} entries; the array is bounded at {MAX_ENTRIES}")
    names = [n.encode() for n in codes]
    keys = np.array([xxhash.xxh64_intdigest(n) for n in names], dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    names = [names[i] for i in order]
    offsets = np.concatenate([[0], np.cumsum([len(n) for n in names])]).astype(np.int64)
    kinds = np.array(list(codes.values()), dtype=np.uint8)[order]
    return b"".join([np.int64(len(names)).tobytes(), keys[order].tobytes(), offsets.tobytes(),
                     kinds.tobytes(), *names])


class DigestArray:
    """The memory-mapped file; ``find`` gives the index of each string's entry or -1."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view(np.int64)[0])
        a, b, c = 8 + 8 * n, 16 + 16 * n, 16 + 17 * n
        self.keys, self.offsets = raw[8:a].view(np.uint64), raw[a:b].view(np.int64)
        self.codes, self.blob = raw[b:c], raw[c:]

    def find(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        out = np.full(len(raw), -1, dtype=np.int64)
        if not len(self.keys) or not raw:
            return out
        h = np.fromiter(map(xxhash.xxh64_intdigest, raw), dtype=np.uint64, count=len(raw))
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        for i in np.flatnonzero(self.keys[at] == h):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == h[i]:     # entries may share a digest
                if self.blob[self.offsets[k]:self.offsets[k + 1]].tobytes() == raw[i]:
                    out[i] = k
                    break
                k += 1
        return out


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]] = RULES,
                listed: Iterable[str] = LISTED_HOSTS, url: str = "url",
                keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns plus host, path, rule, verdict and listed (the block-list host that
    the url fell under, if any). The longest rule decides; without a rule a listed host is
    blocked and anything else allowed. Host rules hold for all subdomains."""
    spark = df.sparkSession
    code = {"allow": ALLOW, "block": BLOCK}
    data = build_array([*((h + p, code[v]) for v, h, p in rules), *((f"{h}", LISTED) for h in listed)])
    lengths = sorted({len(p) for _, _, p in rules} | {0}, reverse=True)
    name = publish(spark, "url-digests", [data])
    types = dict(df.dtypes)

    def judge():
        array = DigestArray(SparkFiles.get(name))
        suffixes: dict[str, list[str]] = {}

        def of_host(host: str) -> list[str]:
            if host not in suffixes:
                if len(suffixes) > 100_000:
                    suffixes.clear()
                labels = host.split(".")
                suffixes[host] = [".".join(labels[i:]) for i in range(len(labels))] if host else []
            return suffixes[host]

        def step(cols):
            split = [split_url(u) for u in cols.pop("__url")]
            texts, owner = [], []
            for i, (host, path) in enumerate(split):
                heads = [path[:n] for n in lengths if n <= len(path)]
                for s in of_host(host):
                    texts += [s + h for h in heads]
                    owner += [i] * len(heads)
            found = array.find(texts)
            rule, verdict, hit = [None] * len(split), [None] * len(split), [None] * len(split)
            for j in np.flatnonzero(found >= 0):
                i, t, kind = owner[j], texts[j], array.codes[found[j]]
                if kind == LISTED:
                    hit[i] = max(hit[i] or "", t, key=len)
                elif rule[i] is None or len(t) > len(rule[i]):
                    rule[i], verdict[i] = t, "allow" if kind == ALLOW else "block"
            verdict = [v or ("block" if h else "allow") for v, h in zip(verdict, hit)]
            return cols | {"host": [h for h, _ in split], "path": [p for _, p in split], "rule": rule,
                           "verdict": verdict, "listed": hit}
        return step

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "host string", "path string", "rule string",
                        "verdict string", "listed string"])
    return map_batches(df.select(*keep, df[url].cast("string").alias("__url")), judge, schema)
