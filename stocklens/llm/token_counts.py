"""Token counts: map-side two-tier lookup of pre-token lengths, no pre-token shuffle.

A byte-level BPE never merges across pre-tokens, so the length of a text in tokens is the
sum over its pre-tokens. Tier 1 is a broadcast table of the most frequent pre-tokens with
their lengths (at most ``table_size`` entries, chosen on a bounded sample; it changes the
speed only). Tier 2 is a bounded cache in each worker that encodes what tier 1 misses.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a
text are single tokens, as the library does by default; rows are independent, so repeated
rows and extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import sys
from collections import Counter

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import map_batches, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "byte_bpe_50k.json"   # default file of the installed public_tokenizers package
SAMPLE_ROWS = 2_000               # rows that choose the table's entries
TABLE_SIZE = 1 << 15              # entries of the broadcast table
CACHE_SIZE = 1 << 18              # pre-tokens that a worker remembers

# The byte-level pre-token pattern of the public tokenizer files (fixed value), for the
# ``regex`` module, whose \s is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_json(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    conf = json.loads(text)
    pre = conf.get("pre_tokenizer") or {}
    if conf.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("the two-tier lookup needs a byte-level BPE without normalizer or prefix space")
    return text


class Pieces(dict):
    """pre-token -> length in tokens: tier 1 entries stay, others fill a bounded cache."""

    def __init__(self, conf: str, table: dict[str, int], cache_size: int):
        super().__init__(table)
        import regex
        from tokenizers import Tokenizer
        self.table, self.limit = table, len(table) + cache_size
        self.tok = Tokenizer.from_str(conf)
        self.find = regex.compile(PATTERN).findall
        special = sorted((t["content"] for t in json.loads(conf).get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, piece: str) -> int:
        n = len(self.tok.encode(piece, add_special_tokens=False))
        if len(self) >= self.limit:
            self.clear()
            self.update(self.table)
        self[piece] = n
        return n

    def parts(self, text: str) -> tuple[int, list[str]]:
        """Special strings in the text, and the stretches between them."""
        if self.special is None:
            return 0, [text]
        parts = self.special.split(text)
        return len(parts) - 1, parts

    def count(self, text: str) -> int:
        n, parts = self.parts(text)
        get = self.__getitem__
        return n + sum(sum(map(get, self.find(p))) for p in parts)


def frequent_pieces(texts: DataFrame, conf: str, sample_rows: int, table_size: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample of whole texts."""
    def top():
        pieces = Pieces(conf, {}, CACHE_SIZE)
        seen: Counter[str] = Counter()

        def step(cols):
            for text in cols["__text"]:
                for part in pieces.parts(text)[1]:
                    seen.update(pieces.find(part))
            best = [p for p, _ in seen.most_common(table_size)]
            return {"piece": best, "n": [pieces[p] for p in best]}
        return step

    share = min(1.0, 2.0 * sample_rows / max(1, texts.count()))      # so that no task sends more than it must
    sample = texts.sample(share, seed=7).limit(sample_rows).coalesce(1)
    rows = map_batches(sample, top, "piece string, n long").collect()
    out: dict[str, int] = {}
    for r in reversed(rows):     # the last batch saw the whole sample: it goes first
        if len(out) < table_size:
            out.setdefault(r["piece"], r["n"])
    return out


def count_tokens(df: DataFrame, text: str = "text", tokenizer_path: str | None = None, limit: int = 1024,
                 sample_rows: int = SAMPLE_ROWS, table_size: int = TABLE_SIZE,
                 cache_size: int = CACHE_SIZE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = df.sparkSession
    conf = tokenizer_json(tokenizer_path)
    texts = df.select(*keep, text_of(text).alias("__text"))
    tier1 = spark.sparkContext.broadcast((conf, frequent_pieces(texts.select("__text"), conf, sample_rows, table_size)))
    types = dict(df.dtypes)

    def counter():
        pieces = Pieces(*tier1.value, cache_size)

        def step(cols):
            texts_ = cols.pop("__text")
            return cols | {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts_],
                           "n_tokens": [pieces.count(t) for t in texts_]}
        return step

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "n_bytes long", "n_tokens long"])
    return map_batches(texts, counter, schema).withColumn("over_limit", F.col("n_tokens") > limit)
