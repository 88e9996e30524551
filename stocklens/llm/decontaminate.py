"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of words (``\\w+``, lower case). The Chakraborty-Goldenberg-Koucky
random walk embeds a sequence so that few edits become a small Hamming distance: at step j
it copies the symbol under the cursor and moves on if a random function of (j, symbol) says
so. Each of T repetitions samples ``BITS`` positions of the embedding; a window of a
document and an item of the same length are candidates if they agree on all of them in one
repetition. T is set for each length by simulation on all its items, so that a window at the
allowed distance is found with probability ``recall``; where ``MAX_REPEATS`` do not reach it
(long items) every window left is a candidate. Candidates are verified by the exact edit
distance in words.

Windows have the size of an item and start at every word of the whole text. Those that
cannot be within the distance are left out by a lossless count of shared word pairs: one
edit destroys at most two of an item's L - 1 pairs.

The benchmark is taken in blocks of ``block_items``, each broadcast (a bounded block of
whole items against all rows), so its size is not limited; with several blocks the rows found so
far are staged between them, so that one block's index exists at a time.

Defined cases: null and empty texts and items match nothing; an item of fewer than two
words has no pairs and is compared as an exact word; equal items are all reported; repeated
rows each get their own result; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import Shared, map_batches, mix, staged, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIMILARITY = 0.8           # 1 - edits / item words
RECALL = 0.995
BITS = 2                   # sampled positions per repetition
BLOCK_ITEMS = 20_000       # items in one broadcast block
MAX_REPEATS = 64


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def allowed(length: int, similarity: float) -> int:
    """Edits that a window may have against an item of ``length`` words."""
    return int(math.floor((1 - similarity) * length + 1e-9))


_EDGES = ".,;:!?\"'()[]{}*%$&#-"


class TokenIds(dict):
    """Chunk of text between white space -> id of its word, 0 if the vocabulary has it not;
    chunks without a word are -1, those of several words point into ``several``."""

    def __init__(self, vocab: dict[str, int], limit: int = 1 << 19):
        super().__init__()
        self.vocab, self.limit, self.several = vocab, limit, []

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.several.clear()
        bare = chunk.strip(_EDGES)
        if bare.isalnum():                   # the usual case: one word between punctuation
            v = self.vocab.get(bare, 0)
        else:
            ws = words(chunk)
            if len(ws) > 1:
                self.several.append([self.vocab.get(w, 0) for w in ws])
            v = self.vocab.get(ws[0], 0) if len(ws) == 1 else -1 - len(self.several) if ws else -1
        self[chunk] = v
        return v

    def of(self, text: str) -> np.ndarray:
        """Ids of the words of a text, as ``words`` would split it."""
        chunks = text.lower().split()
        if len(self) + len(chunks) >= self.limit:      # nothing may be forgotten inside a text
            self.clear()
            self.several.clear()
            self.limit = max(self.limit, 2 * len(chunks))
        ids = np.fromiter(map(self.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        if len(ids) and ids.min() < -1:
            parts = [self.several[-2 - v] if v < -1 else [v] for v in ids.tolist()]
            ids = np.array([x for p in parts for x in p], dtype=np.int64)
        return ids[ids >= 0]


class Walks:
    """The random functions: for repetition t, ``BITS`` sampled steps per item length, and
    one random bit for each (step, symbol): 64 steps share a hashed word per symbol."""

    def __init__(self, repeats: int, n_symbols: int, seed: int = 7):
        self.repeats, self.seed = repeats, seed
        self.symbols = np.arange(n_symbols + 1, dtype=np.uint64)   # the last one is the pad
        self.words: dict[tuple[int, int], np.ndarray] = {}

    def samples(self, t: int, length: int) -> np.ndarray:
        """Sampled embedding positions; the walk covers an item of L words in about 2 L steps."""
        rng = np.random.default_rng((self.seed, t, length))
        return np.sort(rng.choice(max(BITS, int(1.8 * length)), BITS, replace=False))

    def bits(self, t: int, j: int) -> np.ndarray:
        if (t, j >> 6) not in self.words:
            self.words[t, j >> 6] = mix(self.symbols, (self.seed << 40) + (t << 16) + (j >> 6))
        return self.words[t, j >> 6]

    def signatures(self, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, t: int) -> np.ndarray:
        """Hash of the sampled symbols of the walk from each start up to its end. ``tokens``
        ends with the pad symbol."""
        at, pad = starts, len(tokens) - 1
        picks = self.samples(t, length).tolist()
        sig = np.zeros(len(starts), dtype=np.uint64)
        for j in range(picks[-1] + 1):
            sym = tokens[np.where(at < ends, at, pad)]
            if j in picks:
                sig = mix(sig ^ sym.astype(np.uint64), j + 1)
            at = at + ((self.bits(t, j)[sym] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
        return sig


class Index:
    """One block of items: vocabulary, word pairs and signatures, by length class."""

    def __init__(self, items: list[tuple[int, list[str]]], similarity: float, recall: float):
        self.similarity = similarity
        self.vocab: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.token_ids: TokenIds | None = None      # filled by the worker
        self.seqs = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], dtype=np.int64)
                     for _, ws in items]
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(self.seqs):
            if len(s):
                by_length.setdefault(len(s), []).append(k)
        self.by_length = {n: by_length[n] for n in sorted(by_length)}
        self.base = len(self.vocab) + 2
        self.pad = len(self.vocab) + 1
        # word pairs with the item that has them (-1: several items)
        code = np.concatenate([np.unique(q[:-1] * self.base + q[1:]) for q in self.seqs] or [np.zeros(0, dtype=np.int64)])
        owner = np.concatenate([np.full(len(np.unique(q[:-1] * self.base + q[1:])), k) for k, q in enumerate(self.seqs)] or [code])
        self.pairs, first, times = np.unique(code, return_index=True, return_counts=True)
        self.owner = np.where(times == 1, owner[first], -1) if len(first) else first
        # word pairs of an item that others have too; where they are fewer than the pairs needed,
        # a match also holds a pair of the item alone
        common = self.pairs[self.owner == -1]
        self.shared = [int(np.isin(q[:-1] * self.base + q[1:], common).sum()) for q in self.seqs]
        self.by_shared = {k for k, q in enumerate(self.seqs) if len(q) > 1 and self.shared[k] >= self._need(len(q))}
        self.repeats = self._repeats(recall)
        self.walks = Walks(max(self.repeats.values(), default=1), self.pad)
        self.signed = np.zeros((self.walks.repeats, len(self.seqs)), dtype=np.uint64)
        for n, group in self.by_length.items():
            for t in range(self.repeats[n]):
                self.signed[t, group] = self._sign(self.walks, [self.seqs[k] for k in group], n, t)

    def _need(self, n: int) -> int:
        """Pairs that a window within the allowed distance of an item of n words shares with it."""
        return max(1, n - 1 - 2 * allowed(n, self.similarity))

    def _sign(self, walks: Walks, seqs: list[np.ndarray], length: int, t: int) -> np.ndarray:
        """Signatures of whole sequences, as windows of ``length``."""
        ends = np.cumsum([len(s) for s in seqs])
        starts = ends - [len(s) for s in seqs]
        tokens = np.concatenate([*seqs, [self.pad]]).astype(np.int64)
        return walks.signatures(tokens, starts, np.minimum(ends, starts + length), length, t)

    def _edited(self, seq: np.ndarray, rng) -> np.ndarray:
        """The sequence with as many random edits as are allowed."""
        out = seq.tolist()
        for _ in range(allowed(len(seq), self.similarity)):
            at = int(rng.integers(1, len(out)))
            kind = int(rng.integers(3))
            if kind == 0:
                out[at] = 0
            elif kind == 1 and len(out) > 2:
                del out[at]
            else:
                out.insert(at, 0)
        return np.array(out, dtype=np.int64)

    def _repeats(self, recall: float) -> dict[int, int]:
        """For each length, the repetitions that find an item with the allowed random edits with
        probability ``recall``, measured by simulation on all items of the length; 0 where
        MAX_REPEATS do not: all windows are verified there."""
        rng, out = np.random.default_rng(11), {}
        for n, group in self.by_length.items():
            if not allowed(n, self.similarity):
                out[n] = 1                                       # equal sequences walk alike
                continue
            seqs = [self.seqs[g] for g in group]
            edited = [self._edited(s, rng) for s in seqs]
            probe = Walks(min(64, max(16, 1024 // len(group))), self.pad, seed=5)
            same = sum((self._sign(probe, seqs, n, t) == self._sign(probe, edited, n, t)).astype(np.int64) for t in range(probe.repeats))
            rate = (same + 0.5) / (probe.repeats + 1)            # add-half, as walks are few
            found = [1 - ((1 - rate) ** t).mean() for t in range(1, MAX_REPEATS + 1)]
            out[n] = next((t for t, f in enumerate(found, 1) if f >= recall), 0)
        return out

    def matches(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item index, first word, words, edits): the best window of each
        item found. Windows of all the texts are signed together."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        parts, spans = [], []           # spans: (text, offset, length) of texts with pairs
        if self.token_ids is None:
            self.token_ids = TokenIds(self.vocab)
        windows: dict[int, list[tuple[int, int, np.ndarray]]] = {}     # by length: (span, item, starts)
        total = 0
        for d, text in enumerate(texts):
            tokens = self.token_ids.of(text)
            for i in self.by_length.get(1, ()):
                for s in np.flatnonzero(tokens == self.seqs[i][0])[:1].tolist():
                    found[d][i] = (0, s, 1)
            at = np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
            if not len(at) or not len(self.pairs):
                continue
            code = tokens[at] * self.base + tokens[at + 1]
            spot = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            hit = self.pairs[spot] == code
            at, owner = at[hit], self.owner[spot[hit]]
            counts = np.bincount(owner[owner >= 0], minlength=1)
            items = set(np.flatnonzero(counts).tolist()) | (self.by_shared if (owner < 0).any() else set())
            used = False
            for i in items:
                n = len(self.seqs[i])
                need, k = self._need(n), allowed(n, self.similarity)
                if (counts[i] if i < len(counts) else 0) < need - self.shared[i]:
                    continue
                mine = at[(owner == i) | (owner == -1)]
                if len(mine) < need:
                    continue
                # starts s with at least ``need`` of the pairs within [s, s + n + k)
                near = np.flatnonzero(mine[need - 1:] - mine[:len(mine) - need + 1] < n + k)
                if len(near):
                    starts = np.unique(np.concatenate(
                        [np.arange(max(0, mine[j + need - 1] - n - k + 1), mine[j] + 1) for j in near]))
                    windows.setdefault(n, []).append((len(spans), i, starts))
                    used = True
            if used:
                spans.append((d, total, len(tokens)))
                parts.append(tokens)
                total += len(tokens)
        if spans:
            self._search(np.concatenate([*parts, [self.pad]]), spans, windows, found)
        return [[(i, s, size, e) for i, (e, s, size) in sorted(f.items())] for f in found]

    def _search(self, tokens, spans, windows, found) -> None:
        """Candidates are windows whose sampled walk equals their item's in one repetition;
        they are verified, and the best window of each item is kept in ``found``."""
        text, offset, length = (np.array(x) for x in zip(*spans))
        for n, group in windows.items():
            k = allowed(n, self.similarity)
            span = np.concatenate([np.full(len(st), j) for j, _, st in group])
            item = np.concatenate([np.full(len(st), i) for _, i, st in group])
            starts = np.concatenate([st for _, _, st in group]) + offset[span]
            stop = offset[span] + length[span]
            if not self.repeats[n]:
                self._search_all(tokens, text, offset, stop, span, item, starts, found)
                continue
            left, tried = np.arange(len(starts)), np.zeros(len(starts), dtype=bool)
            for t in range(self.repeats[n]):
                ends = np.minimum(starts[left] + n, stop[left])
                sig = self.walks.signatures(tokens, starts[left], ends, n, t)
                new = left[sig == self.signed[t, item[left]]]
                tried[new] = True
                for j in new.tolist():                       # verbatim: nothing beats it
                    if stop[j] - starts[j] >= n and np.array_equal(tokens[starts[j]:starts[j] + n], self.seqs[item[j]]):
                        best = found[text[span[j]]]
                        if best.get(int(item[j]), (1,))[0]:
                            best[int(item[j])] = 0, int(starts[j] - offset[span[j]]), n
                done = np.array([found[text[span[j]]].get(int(item[j]), (1,))[0] == 0 for j in left.tolist()], dtype=bool)
                left = left[~tried[left] & ~done]
                if not len(left):
                    break
            for j in np.flatnonzero(tried).tolist():
                best, i = found[text[span[j]]], int(item[j])
                limit = min(k, best[i][0] - 1) if i in best else k
                if limit >= 0:
                    got = self._verify(tokens[starts[j]:min(starts[j] + n + k, stop[j])], i, k, limit)
                    if got:
                        best[i] = got[0], int(starts[j] - offset[span[j]]), got[1]

    def _search_all(self, tokens, text, offset, stop, span, item, starts, found) -> None:
        """Every window: stretches of neighbouring starts are aligned with their item at once."""
        order = np.lexsort((starts, item, span))
        span, item, starts, stop = span[order], item[order], starts[order], stop[order]
        cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(item) != 0) | (np.diff(span) != 0)) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(starts)).tolist()):
            i, best = int(item[a]), found[text[span[a]]]
            n = len(self.seqs[i])
            k = allowed(n, self.similarity)
            limit = min(k, best[i][0] - 1) if i in best else k
            if limit < 0:
                continue
            region = tokens[starts[a]:min(starts[b - 1] + n + k, stop[a])]
            got = self._align(region, self.seqs[i], limit, b - a)
            if got:
                best[i] = got[0], int(starts[a] - offset[span[a]]) + got[1], got[2]

    @staticmethod
    def _align(region: np.ndarray, seq: np.ndarray, limit: int, n_starts: int) -> tuple[int, int, int] | None:
        """(edits, start, words) of the stretch of ``region`` closest to ``seq`` that begins at one
        of the first ``n_starts`` places, if within ``limit`` edits: one table with a free start
        gives the least distance and its end, one backwards from there its start."""
        def last_row(a: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
            steps = np.arange(len(w) + 1)
            row = first
            for x in range(1, len(a) + 1):
                new = np.empty_like(row)
                new[0] = row[0] + 1
                new[1:] = np.minimum(row[:-1] + (w != a[x - 1]), row[1:] + 1)
                row = np.minimum.accumulate(new - steps) + steps       # steps to the right cost one each
            return row

        free = np.zeros(len(region) + 1, dtype=np.int64)
        free[n_starts:] = np.arange(1, len(region) + 2 - n_starts)    # later places only through the last start
        row = last_row(seq, region, free)
        d = int(row.min())
        if d > limit:
            return None
        n = len(seq)
        for end in np.flatnonzero(row == d)[np.argsort(np.abs(np.flatnonzero(row == d) - n), kind="stable")].tolist():
            back = last_row(seq[::-1], region[:end][::-1], np.arange(end + 1))
            fits = [e for e in np.flatnonzero(back == d).tolist() if 0 < e and end - e < n_starts]
            if fits:
                size = min(fits, key=lambda e: (abs(e - n), e))
                return d, end - size, size
        return None

    def _verify(self, window: np.ndarray, i: int, k: int, limit: int) -> tuple[int, int] | None:
        """(edits, words) of the best prefix of ``window`` against item i, if within ``limit``
        edits: one banded table, whose last row holds the distance to each end."""
        a, w, big = self.seqs[i].tolist(), window.tolist(), k + 1
        n, there = len(a), set(w)
        if not w or sum(x not in there for x in a) > limit:    # each absent word costs an edit
            return None
        row = list(range(len(w) + 1))
        for x in range(1, n + 1):
            new = [x] + [big] * len(w)
            for j in range(max(1, x - k), min(len(w), x + k) + 1):
                new[j] = min(row[j - 1] + (a[x - 1] != w[j - 1]), row[j] + 1, new[j - 1] + 1)
            row = new
        d, _, end = min((v, abs(e - n), e) for e, v in enumerate(row) if e)
        return (d, end) if d <= limit else None


def blocks(benchmark: DataFrame, item_id: str, text: str, block_items: int):
    """The benchmark's items in blocks of at most ``block_items``."""
    rows = benchmark.filter(F.col(text).isNotNull()).select(
        F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    part: list[tuple[int, list[str]]] = []
    for r in rows.orderBy("i", "t").toLocalIterator():
        if ws := words(r["t"]):
            part.append((r["i"], ws))
        if len(part) == block_items:
            yield part
            part = []
    if part:
        yield part


MATCH_SCHEMA = "item_id long, first_word long, n_words long, edits long, similarity double"


def find_matches(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL,
                 block_items: int = BLOCK_ITEMS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``matches``: the items found in each text (best window each)."""
    types = dict(df.dtypes)
    spark = df.sparkSession
    found = df.select(*keep, text_of(text).alias("__text"),
                      F.array().cast(f"array<struct<{MATCH_SCHEMA.replace(' ', ':').replace(',:', ',')}>>").alias("matches"))
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "__text string",
                        f"matches array<struct<{MATCH_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"])
    for number, block in enumerate(blocks(benchmark, item_id, item_text, block_items)):
        if number:                              # one block at a time is on the driver and the workers
            found = staged(found, "matches")
            sent.destroy()
        sent = Shared(spark, Index(block, similarity, recall))

        def finder(sent=sent):
            index = sent.value

            def step(cols):
                out = [before + [{"item_id": index.ids[i], "first_word": s, "n_words": size, "edits": e,
                                  "similarity": 1 - e / len(index.seqs[i])} for i, s, size, e in got]
                       for before, got in zip(cols["matches"], index.matches(cols["__text"]))]
                return cols | {"matches": out}
            return step

        found = map_batches(found, finder, schema)
    return found.drop("__text")


def decontaminate(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: contaminated, item_ids (ascending), n_items, best similarity."""
    found = find_matches(df, benchmark, **options)
    return found.withColumns({
        "contaminated": F.size("matches") > 0,
        "item_ids": F.array_sort(F.array_distinct(F.col("matches.item_id"))),
        "n_items": F.size(F.array_distinct(F.col("matches.item_id"))).cast("long"),
        "similarity": F.coalesce(F.array_max(F.col("matches.similarity")), F.lit(0.0)),
    })


def clean_rows(df: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY,
               recall: float = RECALL, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``df`` without a benchmark item in their text, all columns kept. Items are
    searched inside one pass per block; nothing is joined or shuffled."""
    out = df
    arrow = df.schema
    for number, block in enumerate(blocks(benchmark, "item_id", "text", block_items)):
        if number:
            out = staged(out, "clean")
            sent.destroy()
        sent = Shared(df.sparkSession, Index(block, similarity, recall))

        def run(batches, sent=sent):
            import pyarrow as pa
            index = sent.value
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array([not m for m in index.matches([t or "" for t in texts])], type=pa.bool_()))

        out = out.mapInArrow(run, arrow)
    return out
