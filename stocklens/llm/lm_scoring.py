"""LM scoring: a bigram model in a log-frequency Bloom filter (Talbot and Osborne).

Counts of words, of word pairs and of each word's distinct followers are quantised on a
logarithmic scale; an event of level q is entered as (event, 1) .. (event, q). A worker
reads a level back by probing (event, 1), (event, 2), ... until a probe misses, and turns
the levels into Witten-Bell smoothed probabilities

    P(w | h) = (c(hw) + T(h) P(w)) / (c(h) + T(h)),   P(w) = (c(w) + 1) / (N + V + 1),

with T(h) the number of distinct followers of h. Counting and filling run on Spark: tasks
reduce their tokens to sorted blocks of (key, count), blocks meet by the key's high bits,
and each bucket fills its own slice of the filter. Only the filter is sent to the workers,
as a file that they map into memory; the driver passes it on slice by slice. Its size follows the number of events, ``BITS_PER_EVENT`` each, so that the rate
of false positives is the same at every size.

``base_score`` needs exact counts of every token: the most frequent words (at most
``HEAD``) are broadcast, the others of each text meet the count table in a join.

Defined cases: null and empty texts are the end token alone; equal rows get equal scores;
without training rows N = V = 0 and every token scores log10(1 / 1); ids may repeat or be
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import MASK64, Shared, WordIds, map_batches, mix, pieces, publish, small_batches, staged, text_of, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOG_BASE = 1.25            # quantisation
BITS_PER_EVENT = 12
MAX_HASHES = 4             # probes of one level
LINE = 512                 # bits of a block: a cache line
HEAD = 1 << 19             # words whose exact counts are broadcast
FLUSH = 3 << 19            # keys that a counting task holds before it emits a block
TOKENS_PER_BUCKET = 1 << 20
SCORE_TOKENS = 1 << 17     # tokens scored at once
PIECE = 1 << 21            # bytes of texts that a task unpacks at once
START, END = 0x5354415254, 0x454E44          # ids of the text's edges (fixed values)
WORD, PAIR, FOLLOW = 0, 1, 2
_LOW = np.uint64(0xFFFFFFFF)


def thresholds(limit: int = 1 << 50) -> np.ndarray:
    """Smallest count of each level: the distinct ceilings of LOG_BASE's powers."""
    out, x = [1], 1.0
    while out[-1] < limit:
        x *= LOG_BASE
        if math.ceil(x) > out[-1]:
            out.append(math.ceil(x))
    return np.array(out, dtype=np.int64)


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """High half: hash of the pair, which spreads a frequent history over all buckets; low
    half: hash of the history, by which its followers are counted."""
    h = mix(history, 3)
    return (mix(word ^ h, 4) & ~_LOW) | (h >> np.uint64(32))


def history_keys(history: np.ndarray) -> np.ndarray:
    """Key of a history's follower count; its high half is the low half of its pairs' keys."""
    return spread(mix(history, 3) >> np.uint64(32))


def spread(h32: np.ndarray) -> np.ndarray:
    return h32 << np.uint64(32)


def planes(a: np.ndarray) -> bytes:
    """Bytes of an integer array, grouped by significance: high zero bytes compress away."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view("<u8").astype(np.uint64)


def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, and their counts."""
    return planes(np.diff(keys, prepend=np.uint64(0))), planes(counts)


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unplanes(keys), dtype=np.uint64), unplanes(counts).astype(np.int64)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def blocks(kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple]:
    """(kind, bucket, keys, counts): the sorted keys cut by their top ``bits``."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])
    edges = np.append(edges, len(keys))
    return ((kind, b, *pack(keys[edges[b]:edges[b + 1]], counts[edges[b]:edges[b + 1]]))
            for b in range(1 << bits) if edges[b] < edges[b + 1])


BLOCK_SCHEMA = "kind int, bucket int, keys binary, counts binary"


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
    cols = zip(*rows) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(cols, types)], schema=pa.schema(types))


def _block_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + len(row[3])
        if size >= PIECE:
            yield _block_batch(held)
            held, size = [], 0
    if held:
        yield _block_batch(held)


def count_blocks(texts: DataFrame, bits: int) -> DataFrame:
    """Blocks of word and pair counts, one set for every FLUSH tokens of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        held: list[np.ndarray] = []
        size = 0

        def emit():
            """The held tokens' blocks, those of one kind at a time and about PIECE bytes a batch."""
            ids = np.concatenate(held)
            held.clear()
            prev = np.concatenate([[np.uint64(START)], ids[:-1]])
            prev[1:][ids[:-1] == np.uint64(END)] = np.uint64(START)
            pairs = pair_keys(prev, ids)
            del prev
            for kind, keys in ((WORD, ids), (PAIR, pairs)):
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                yield from _block_batches(blocks(kind, keys[first], np.diff(first, append=len(keys)), bits))

        end = np.array([END], dtype=np.uint64)
        for piece in (p for batch in batches for p in pieces(batch, PIECE)):
            for text in piece.column(0).to_pylist():
                ids = words.of(words_of(text))
                held += [ids, end]
                size += len(ids) + 1
                if size >= FLUSH:
                    yield from emit()
                    size = 0
        if held:
            yield from emit()

    return texts.mapInArrow(run, BLOCK_SCHEMA)


MERGED_SCHEMA = BLOCK_SCHEMA + ", n long, total long, events long"


def merge_blocks(rows: DataFrame) -> DataFrame:
    """One block for each kind and bucket, with its distinct keys, total count and filter
    events. A bucket's size is set by the bits of the blocks, not by any one key."""
    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(k, c) for k, c in zip(pdf["keys"], pdf["counts"])]
        keys, counts = merged(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        levels = np.searchsorted(thresholds(), counts, side="right")
        k, c = pack(keys, counts)
        return pd.DataFrame([(key[0], key[1], k, c, len(keys), int(counts.sum()), int(levels.sum()))],
                            columns=["kind", "bucket", "keys", "counts", "n", "total", "events"])

    return rows.groupBy("kind", "bucket").applyInPandas(merge, MERGED_SCHEMA)


def follower_blocks(pairs: DataFrame, bits: int) -> DataFrame:
    """Blocks of distinct-follower counts from merged pair blocks."""
    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            for k, c in zip(cols["keys"], cols["counts"]):
                keys, n = np.unique(unpack(k, c)[0] & _LOW, return_counts=True)
                yield from _block_batches(blocks(FOLLOW, spread(keys), n.astype(np.int64), bits))

    return pairs.select("keys", "counts").mapInArrow(run, BLOCK_SCHEMA)


class Filter:
    """One log-frequency Bloom filter: ``2 ** bits`` slices of ``width`` bits each. The slices
    lie in a file that every executor has, in any order; ``place`` says where each bucket's is
    (an empty slice for buckets without keys). Workers of one machine share its pages."""

    def __init__(self, bits: int, width: int, hashes: int, file: str = "", place: np.ndarray | None = None):
        self.bits, self.width, self.hashes, self.file = bits, width, hashes, file
        self.place = np.zeros(1 << bits, dtype=np.uint64) if place is None else place
        self.array: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"array": None}

    def load(self) -> Filter:
        if self.array is None and self.file:
            self.array = np.memmap(SparkFiles.get(self.file), dtype=np.uint8, mode="r")
        return self

    def _place(self, keys: np.ndarray, level: int, i: int) -> np.ndarray:
        """Bit of hash function i in a slice. The bits of four levels of a key lie in one block
        of LINE bits, so that probing them costs one access to memory; block and bit are
        multiply-shifts of the (hashed) keys."""
        with np.errstate(over="ignore"):
            line = keys * np.uint64(_odd(-1 - level // 4)) >> np.uint64(32)
            line = line * np.uint64(self.width // LINE) >> np.uint64(32)
            bit = keys * np.uint64(_odd(level * MAX_HASHES + i)) >> np.uint64(55)
        return line * np.uint64(LINE) + bit

    def slice_of(self, keys: np.ndarray, levels: np.ndarray) -> bytes:
        """The slice that holds the keys of one bucket, each up to its level."""
        out = np.zeros(self.width, dtype=bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for i in range(self.hashes):
                out[self._place(keys[levels >= level], level, i).astype(np.int64)] = True
        return np.packbits(out, bitorder="little").tobytes()

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Representative counts (0: not in the filter), by repeated membership probes."""
        levels = np.zeros(len(keys), dtype=np.int64)
        if self.width and len(keys):
            array = self.load().array
            bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), dtype=np.int64)
            alive, level = np.arange(len(keys)), 1
            here, base = keys, self.place[bucket] * np.uint64(self.width)
            while len(alive):
                for i in range(self.hashes):
                    p = base + self._place(here, level, i)
                    ok = (array[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    alive, here, base = alive[ok], here[ok], base[ok]
                levels[alive] = level
                level += 1
        return _REPRESENTATIVE[np.minimum(levels, len(_REPRESENTATIVE) - 1)]

    def fill(self) -> float:
        return float(np.unpackbits(self.load().array).mean()) if self.width else 0.0


def _odd(n: int) -> int:
    """The n-th odd multiplier."""
    x = (n + 1_000_003) * 0x9E3779B97F4A7C15 & MASK64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK64
    return (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK64 | 1


def _representatives() -> np.ndarray:
    t = thresholds().astype(np.float64)
    return np.concatenate([[0.0], (t[:-1] + t[1:] - 1) / 2, t[-1:]])


_REPRESENTATIVE = _representatives()


def layout(bits: int, events: int) -> Filter:
    """An unfilled filter of BITS_PER_EVENT for each event, however many there are."""
    width = -(-events * BITS_PER_EVENT // (1 << bits) // LINE) * LINE
    return Filter(bits, width, min(MAX_HASHES, round(math.log(2) * (width << bits) / events)) if events else 1)


def build_filter(rows: DataFrame, bits: int, events: int) -> Filter:
    """Fill the slices on the executors and lay them side by side."""
    made = layout(bits, events)
    width, hashes = made.width, made.hashes
    if not width:
        return made

    def slices(pdfs):
        t = thresholds()
        for pdf in pdfs:
            yield pd.DataFrame({"bucket": pdf["bucket"], "bits": [
                made.slice_of(keys, np.searchsorted(t, counts, side="right"))
                for keys, counts in (unpack(k, c) for k, c in zip(pdf["keys"], pdf["counts"]))]})

    filled = staged(rows.select("bucket", "keys", "counts").mapInPandas(slices, "bucket int, bits binary"), "slices")
    place = np.zeros(1 << bits, dtype=np.uint64)

    def parts():
        yield bytes(width // 8)
        for k, r in enumerate(filled.toLocalIterator(), 1):
            place[r["bucket"]] = k
            yield r["bits"]

    return Filter(bits, width, hashes, publish(rows.sparkSession, "lm-filter", parts()), place)


class Model:
    def __init__(self, words: Filter, pairs: Filter, follow: Filter, n_tokens: int, n_words: int, n_texts: int):
        self.words, self.pairs, self.follow = words, pairs, follow
        self.n_tokens, self.n_words, self.n_texts = n_tokens, n_words, n_texts

    def log10(self, names: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 P of the tokens ``names[at]``; texts follow one another, each closed by END.
        ``names`` are distinct and sorted, START among them."""
        start, end = np.searchsorted(names, np.array([START, END], dtype=np.uint64))
        count = self.words.counts(names)
        unigram = (count + 1) / (self.n_tokens + self.n_words + 1)
        count[start] = self.n_texts
        kinds = self.follow.counts(history_keys(names))
        prev = np.concatenate([[start], at[:-1]])
        prev[1:][at[:-1] == end] = start
        c_h, t_h = count[prev], kinds[prev]
        pair = np.minimum(self.pairs.counts(pair_keys(names[prev], names[at])), c_h)
        p = unigram[at]
        known = (c_h + t_h > 0) & ((pair > 0) | (t_h > 0))
        smooth = np.divide(pair + t_h * p, c_h + t_h, out=p.copy(), where=known)
        return np.log10(np.minimum(smooth, 1.0))


class Trained:
    """The broadcastable model and the exact word counts (id, c)."""

    def __init__(self, model: Model, counts: DataFrame):
        self.model, self.counts = model, counts


@small_batches
def train(texts: DataFrame) -> Trained:
    """``texts``: one column of training texts (nulls as empty)."""
    texts = texts.select(text_of(texts.columns[0]).alias("text"))
    n_texts, chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    bits = max(6, math.ceil(math.log2(max(1, chars / 6 / TOKENS_PER_BUCKET))))
    rows = staged(merge_blocks(count_blocks(texts, bits)), "ngrams")
    follow_bits = min(bits, 8)
    follow = staged(merge_blocks(follower_blocks(rows.filter(F.col("kind") == PAIR), follow_bits)), "followers")
    sums = {r["kind"]: r for r in rows.unionByName(follow).groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("events").alias("events")).collect()}
    get = lambda kind, what: int(sums[kind][what]) if kind in sums else 0
    filters = [build_filter(src.filter(F.col("kind") == kind), b, get(kind, "events"))
               for src, kind, b in ((rows, WORD, bits), (rows, PAIR, bits), (follow, FOLLOW, follow_bits))]
    model = Model(*filters, n_tokens=get(WORD, "total"), n_words=get(WORD, "n"), n_texts=n_texts)

    def exact(pdfs):
        for pdf in pdfs:
            for k, c in zip(pdf["keys"], pdf["counts"]):
                keys, counts = unpack(k, c)
                yield pd.DataFrame({"id": keys.view(np.int64), "c": counts})

    counts = staged(rows.filter(F.col("kind") == WORD).select("keys", "counts").mapInPandas(exact, "id long, c long"), "words")
    return Trained(model, counts)


def frequent(counts: DataFrame, limit: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and counts of all words above the count that at most ``limit`` words exceed."""
    seen, least = 0, None
    for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(limit).collect():
        if seen + r["n"] > limit:
            break
        seen, least = seen + r["n"], r["c"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    got = counts.filter(F.col("c") >= least).toPandas()
    ids, c = got["id"].to_numpy(dtype=np.int64).view(np.uint64), got["c"].to_numpy(dtype=np.int64)
    order = np.argsort(ids)
    return ids[order], c[order]


def _chunks(texts: list[str], words: WordIds):
    """Runs of whole texts of about SCORE_TOKENS tokens: their ids with END, and sizes."""
    end = np.array([END], dtype=np.uint64)
    ids, sizes, held = [], [], 0
    for t in texts:
        own = words.of(words_of(t))
        ids += [own, end]
        sizes.append(len(own) + 1)
        held += len(own) + 1
        if held >= SCORE_TOKENS:
            yield np.concatenate(ids), np.array(sizes)
            ids, sizes, held = [], [], 0
    if sizes:
        yield np.concatenate(ids), np.array(sizes)


def _lookup(head: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Exact counts of the ids in the head, -1 for the others."""
    keys, counts = head
    if not len(keys):
        return np.full(len(ids), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
    return np.where(keys[at] == ids, counts[at], -1)


def text_key(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@small_batches
def score(df: DataFrame, trained: Trained, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_tokens, n_known, train_tokens, base_score and score."""
    sc = df.sparkSession.sparkContext
    model, counts = trained.model, trained.counts
    sent, head = Shared(df.sparkSession, model), sc.broadcast(frequent(counts))
    n, v = model.n_tokens, model.n_words
    types = dict(df.dtypes)

    rows = df.select(*keep, text_of(text).alias("text"))

    def whole():
        words, top, lm = WordIds(), head.value, sent.value
        edges = np.array([START, END], dtype=np.uint64)

        def step(cols):
            texts = cols.pop("text")
            out = {c: [] for c in ("n_tokens", "common", "common_base", "score", "rare_ids", "rare_ns")}
            for ids, sizes in _chunks(texts, words):
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                names, at = np.unique(np.concatenate([edges, ids]), return_inverse=True)
                at = at[2:]
                exact = _lookup(top, names)
                base = np.where(exact >= 0, np.log10(np.maximum(exact, 0) + 1.0) - math.log10(n + v + 1), 0.0)
                rare = exact[at] < 0
                out["n_tokens"] += sizes.tolist()
                out["common"] += np.add.reduceat((~rare).astype(np.int64), starts).tolist()
                out["common_base"] += np.add.reduceat(base[at], starts).tolist()
                out["score"] += np.add.reduceat(lm.log10(names, at), starts).tolist()
                where = np.repeat(np.arange(len(sizes)), sizes)[rare]
                code, times = np.unique(where * np.int64(len(names)) + at[rare], return_counts=True)
                cuts = np.searchsorted(code, np.arange(1, len(sizes)) * len(names))
                out["rare_ids"] += np.split(names[code % len(names)].view(np.int64), cuts)
                out["rare_ns"] += np.split(times, cuts)
            return cols | {"key": [text_key(t) for t in texts]} | out
        return step

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "key long, n_tokens long, common long, common_base double, "
                        "score double, rare_ids array<long>, rare_ns array<long>"])
    scored = staged(map_batches(rows, whole, schema, PIECE), "scored")
    # the rare words of each text meet their exact counts; equal texts are summed
    pairs = F.explode(F.arrays_zip("rare_ids", "rare_ns")).alias("p")
    tail = (scored.select("key", pairs).select("key", F.col("p.rare_ids").alias("id"), F.col("p.rare_ns").alias("n"))
            .groupBy("key", "id").agg(F.sum("n").alias("n")).join(counts, "id", "left"))
    exact = F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)) - F.log10(F.lit(float(n + v + 1)))
    tails = staged(tail.groupBy("key").agg(
        F.sum("n").alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * exact).alias("rare_base")), "rare")
    out = scored.drop("rare_ids", "rare_ns").join(tails, "key", "left")
    # rows of equal text were summed in ``rare``: each has its n_tokens - common of it
    part = F.when(F.col("rare") > 0, (F.col("n_tokens") - F.col("common")) / F.col("rare")).otherwise(F.lit(0.0))
    return out.select(
        *keep, "n_tokens",
        (F.col("common") + F.coalesce(F.round(F.col("rare_known") * part), F.lit(0.0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("common_base") + F.coalesce(F.col("rare_base") * part, F.lit(0.0))).alias("base_score"), "score")
