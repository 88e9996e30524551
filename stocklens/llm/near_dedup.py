"""MinHash near-duplicates with sequential Bayesian verification (BayesLSH).

1. Each text becomes the set of its distinct 5-word shingles (64-bit hashes) and a MinHash
   signature; texts with equal sets are one *node*.
2. Signatures are cut into ``BANDS`` bands of ``ROWS``; nodes that agree on a band share a
   bucket. In every bucket each node is compared with the bucket's leader only, so the
   number of pairs is linear in the rows, however large a group is.
3. Signatures of a pair are compared in batches. After each batch the pair is dropped if the
   posterior probability of a similarity of at least the threshold (uniform prior) is below
   ``MISS``. Survivors are verified on their full sets.
4. Verified links give connected components. Buckets whose nodes are all in one component
   are finished. The nodes of the others meet by an exact prefix filter: of a set of n shingles,
   ordered rarest first, only the first n - ceil(t n) + 1 are keys, and two sets of similarity t
   share one of them. Shingles of common passages come last and make no keys. Nodes of different
   components that share a key are compared as in 3, inside tasks: the nodes outside the key's
   largest component are held, block by block, and the key's nodes pass them; nodes of the
   largest component never meet each other. First each node is compared with its most similar one,
   which merges a group that hangs together by linearly many pairs; then all pairs that are left,
   verified inside the tasks, so that only links leave them, no more than join a run's components. In the
   end every two nodes that share a bucket are in one component, or share no key (so they are not
   linked), or have been compared.

The threshold is a parameter and the bands follow from it (``banding``). A link of similarity 0.85 shares no band with probability (1 - 0.85^6)^24 = 1.2e-5.

Nothing is collected to the driver but counters. Intermediate tables are Parquet files in
the shared folder, so a lost executor costs a recomputed task only.

Defined cases: null and wordless texts have an empty set and are linked with nothing; texts
of fewer than five words have one shingle, the whole sequence; equal texts are linked; ties
cannot arise (the smallest doc_id of a group stays); a null doc_id never represents a group
that has another id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from stocklens.llm.common import WordIds, map_batches, mix, staged, text_of, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
THRESHOLD = 85             # per cent: 100 * |A and B| >= THRESHOLD * |A or B|
BANDS, ROWS = 24, 6
NO_BAND = 2e-5             # probability that a link at the threshold shares no band
BATCH = 16                 # hashes compared between two looks at the posterior
MISS = 1e-6                # posterior below which a pair is dropped
HELD = 1 << 20             # bytes of a block of held nodes in step 4
PASSING = 1 << 22          # bytes of a part of the nodes that pass it
TILE = 512                 # held and passing nodes that are compared at once
ROUNDS = 2                 # rounds of best partners before all open pairs are verified
_CHUNK = 4096


def shingles(ids: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; of the whole text if shorter."""
    n = min(len(ids), SHINGLE)
    if n == 0:
        return ids
    h = mix(ids[:len(ids) - n + 1], n)
    for j in range(1, n):
        h = mix(h ^ ids[j:len(ids) - n + 1 + j], n)
    return np.unique(h)


class Signer:
    """The MinHash functions: h_i(x) = (x xor s_i) * a_i with odd a_i, in 64-bit arithmetic."""

    def __init__(self):
        rng = np.random.default_rng(2012)
        k = BANDS * ROWS
        self.a = rng.integers(0, 1 << 64, k, dtype=np.uint64)[:, None] | np.uint64(1)
        self.s = rng.integers(0, 1 << 64, k, dtype=np.uint64)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(hashes), _CHUNK):
                part = hashes[None, i:i + _CHUNK]
                np.minimum(low, ((part ^ self.s) * self.a).min(axis=1), out=low)
        return low

    @staticmethod
    def bands(low: np.ndarray, percent: int = THRESHOLD) -> np.ndarray:
        bands, rows = banding(percent)
        key = np.arange(bands, dtype=np.uint64)
        for row in low[:bands * rows].reshape(bands, rows).T:
            key = mix(key ^ row, 1)
        return key.view(np.int64)

    @staticmethod
    def short(low: np.ndarray) -> bytes:
        """16 bits of each minimum, for the Bayesian comparison."""
        return (mix(low, 2) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows with which a link at the threshold shares no band with a
    probability of at most NO_BAND. At 85 per cent these are BANDS and ROWS."""
    fits = [r for r in range(1, ROWS + 1) if (1 - (percent / 100) ** r) ** (BANDS * ROWS // r) <= NO_BAND]
    rows = max(fits, default=1)
    return BANDS * ROWS // rows, rows


def sign(df: DataFrame, doc_id: str, text: str, percent: int = THRESHOLD) -> DataFrame:
    """(key, doc_id, n_shingles, node, bands, sig): node identifies the set, null if empty."""
    def signer():
        ids, sig = WordIds(), Signer()

        def step(cols):
            out = {"key": cols["key"], "doc_id": cols["doc_id"], "n_shingles": [], "node": [], "bands": [], "sig": []}
            for t in cols["text"]:
                s = shingles(ids.of(words_of(t)))
                out["n_shingles"].append(len(s))
                if len(s):
                    low = sig(s)
                    out["node"].append(set_id(s))
                    out["bands"].append(sig.bands(low, percent))
                    out["sig"].append(sig.short(low))
                else:
                    for c in ("node", "bands", "sig"):
                        out[c].append(None)
            return out
        return step

    rows = df.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"),
                     text_of(text).alias("text"))
    return map_batches(rows, signer, "key long, doc_id long, n_shingles long, node long, bands array<long>, sig binary")


def row_key(doc_id: str, text: str):
    """Hash of a row's id and text."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), text_of(text))


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set of shingles."""
    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def least_matches(threshold: float = THRESHOLD / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes seen, matches needed) after each batch. With a uniform prior and m matches of
    n the posterior is Beta(m + 1, n - m + 1), so P(J >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, -1
        while below < miss and m < n:
            m += 1
            below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(left: np.ndarray, right: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of two signature matrices that no batch drops."""
    alive, matches, before = np.arange(len(left)), np.zeros(len(left), dtype=np.int64), 0
    for n, need in rule:
        matches = matches + (left[alive, before:n] == right[alive, before:n]).sum(axis=1)
        ok = matches >= need
        alive, matches, before = alive[ok], matches[ok], n
    return alive


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype="<u2").reshape(len(sigs), BANDS * ROWS)


def sizes_fit(a, b, percent: int):
    """Necessary for a link: the smaller set is at least ``percent`` per cent of the larger."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def bayes(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the size bound and the sequential Bayesian test."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"),
                                  F.col("sig").alias(f"sig_{x}"))
    rows = (pairs.join(side("a"), "a").join(side("b"), "b").filter(sizes_fit(F.col("n_a"), F.col("n_b"), percent))
            .select("a", "b", "sig_a", "sig_b"))

    def test():
        rule = least_matches(percent / 100)

        def step(cols):
            ok = surviving(_matrix(cols["sig_a"]), _matrix(cols["sig_b"]), rule) if cols["a"] else []
            return {"a": [cols["a"][i] for i in ok], "b": [cols["b"][i] for i in ok]}
        return step

    return map_batches(rows, test, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked by their full sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"set_{x}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .withColumn("both", both)
            .filter(100 * F.col("both") >= percent * (F.size("set_a") + F.size("set_b") - F.col("both")))
            .select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over the edges (a, b). Minimum labels spread
    to neighbours and then jump to the label of their label, until nothing changes."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m")))
        spread = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        new = staged(spread.join(jump, "near").select("node", "old", F.least("near", "far").alias("comp")), "labels")
        if new.filter("old <> comp").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def bucket_runs(members: DataFrame, nodes: DataFrame, with_sets: bool = False) -> DataFrame:
    """(key, i, j, held, met, outer, node, comp, keys, n_shingles, sig): runs in which all nodes
    of a key that are in different components meet. The outer nodes, those outside the key's
    largest component, are dealt into blocks of about HELD bytes, all its nodes into parts of about
    PASSING bytes; block i is held while part j passes. A key whose outer nodes fit one block and
    whose nodes fit one part travels once. ``members``: (key, node, comp, keys)."""
    weight = F.lit(2 * BANDS * ROWS) + 8 * F.size("keys") + (8 * F.col("n_shingles") if with_sets else F.lit(0))
    rows = members.join(nodes.select("node", "n_shingles", "sig"), "node").withColumn("weight", weight.cast("long"))
    of_comp = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    sizes = of_comp.groupBy("key").agg(F.max(F.struct("n", "comp", "w")).alias("main"), F.sum("w").alias("w"))
    cut = lambda w, size: F.greatest(F.ceil(w / size), F.lit(1)).cast("int")
    sizes = sizes.select("key", F.col("main.comp").alias("main"), cut(F.col("w") - F.col("main.w"), HELD).alias("blocks"),
                         cut(F.col("w"), PASSING).alias("parts"))
    rows = (rows.join(sizes, "key").withColumn("outer", F.col("comp") != F.col("main"))
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")))
    passes = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("part").alias("j")))
    stays = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    rows = rows.withColumn("run", F.explode(F.when(F.col("outer"), F.array_union(stays, passes)).otherwise(passes)))
    i, j = F.col("run.i"), F.col("run.j")
    return rows.select("key", i.alias("i"), j.alias("j"), (F.col("outer") & (F.col("block") == i)).alias("held"),
                       (F.col("part") == j).alias("met"), "outer", "node", "comp", "keys", "n_shingles", "sig")


def per_run(rows: DataFrame, fn, schema: str) -> DataFrame:
    """Apply ``fn`` (columns of one run -> tuple of arrays or None) to every run of
    (key, i, j), in tasks that stream through their runs."""
    names = rows.columns
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j")
    fields = [f.split()[0] for f in schema.split(", ")]

    def column(batch, c):
        if c == "sig":
            return _matrix(batch.column(c).to_pylist())
        if c in ("hashes", "keys"):
            out = np.empty(batch.num_rows, dtype=object)
            out[:] = [np.asarray(v.values) for v in batch.column(c)]
            return out
        return batch.column(c).to_numpy(zero_copy_only=False)

    def batch_of(found):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=fields)

    def run(batches):
        held = None
        for batch in batches:
            cols = {c: column(batch, c) for c in names}
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in names}
            name = np.stack([cols["key"], cols["i"], cols["j"]], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1])
            found = [x for a, b in zip(edges[:-1], edges[1:]) if (x := fn({c: v[a:b] for c, v in cols.items()})) is not None]
            held = {c: v[edges[-1]:] for c, v in cols.items()}       # the last run may go on in the next batch
            if found:
                yield batch_of(found)
        if held is not None and (x := fn(held)) is not None:
            yield batch_of([x])

    return dealt.sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def open_pairs(run: dict[str, np.ndarray], percent: int):
    """Rows of the pairs of a run that are in different components and that neither size nor
    signatures rule out, tile by tile. Of the keys that two nodes share the first one has the
    pair; of two outer nodes the smaller one is held."""
    node, comp, size, outer, sig, keys = (run[c] for c in ("node", "comp", "n_shingles", "outer", "sig", "keys"))
    rule, held, met = least_matches(percent / 100), np.flatnonzero(run["held"]), np.flatnonzero(run["met"])
    for k in range(0, len(held), TILE):
        for m in range(0, len(met), TILE):
            p, q = held[k:k + TILE, None], met[None, m:m + TILE]
            x, y = np.nonzero((comp[p] != comp[q]) & (~outer[q] | (node[p] < node[q]))
                              & (100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q])))
            if not len(x):
                continue
            x, y = held[k + x], met[m + y]
            alive = np.concatenate([c + surviving(sig[x[c:c + 4096]], sig[y[c:c + 4096]], rule) for c in range(0, len(x), 4096)])
            x, y, key = x[alive], y[alive], run["key"][0]
            first = np.fromiter((np.intersect1d(keys[a], keys[b], assume_unique=True)[0] == key for a, b in zip(x.tolist(), y.tolist())), dtype=bool, count=len(x))
            if first.any():
                yield x[first], y[first]


def _ordered(node, x, y):
    return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])


def prefixes(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, key): the keys of an exact prefix filter for the nodes ``left`` (node, comp).
    Shingles that no two components share come first and need no row; rows are two numbers
    wide, as every shingle of a node travels once."""
    rows = left.join(sets, "node")
    shared = (rows.select("comp", F.explode("hashes").alias("key")).groupBy("key")
              .agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key", "n"))
    held = rows.select("node", F.explode("hashes").alias("key")).join(shared, "key").select("node", "key", "n")
    own = Window.partitionBy("node")
    ranked = held.join(rows.select("node", F.size("hashes").alias("size")), "node").select(
        "node", "key", "size", F.row_number().over(own.orderBy("n", "key")).alias("rank"), F.count(F.lit(1)).over(own).alias("held"))
    most = F.col("size") - F.floor((F.col("size") * percent + 99) / F.lit(100)) + 1
    keys = staged(ranked.filter(F.col("rank") <= most - (F.col("size") - F.col("held"))).select("node", "key"), "keys")
    # of the keys that the very same nodes hold one is enough; one node alone makes no pair
    digest = [F.bit_xor(F.xxhash64("node", F.lit(i))) for i in range(2)]
    once = (keys.groupBy("key").agg(*[d.alias(f"d{i}") for i, d in enumerate(digest)], F.count(F.lit(1)).alias("n")).filter("n > 1")
            .groupBy("d0", "d1", "n").agg(F.min("key").alias("key")).select("key", "n"))
    # numbered by falling size of their groups; equal numbers of two keys only join their groups
    number = F.shiftleft(F.lit((1 << 31) - 1).cast("bigint") - F.least("n", F.lit((1 << 31) - 1)), 32).bitwiseOR(F.col("key").bitwiseAND((1 << 32) - 1))
    return keys.join(once, "key").select("node", number.alias("key")).distinct()


def best_partners(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node of a run with the open partner of most equal hashes."""
    def best(run):
        sig, most, at = run["sig"], np.full(len(run["node"]), -1), np.full(len(run["node"]), -1)
        for x, y in open_pairs(run, percent):
            same = np.concatenate([(sig[x[k:k + 4096]] == sig[y[k:k + 4096]]).sum(axis=1) for k in range(0, len(x), 4096)])
            for who, other in ((x, y), (y, x)):
                order = np.lexsort((-same, who))
                order = order[np.flatnonzero(np.concatenate([[True], who[order][1:] != who[order][:-1]]))]
                order = order[same[order] > most[who[order]]]
                most[who[order]], at[who[order]] = same[order], other[order]
        take = np.flatnonzero(at >= 0)
        return _ordered(run["node"], take, at[take]) if len(take) else None

    return per_run(bucket_runs(members, nodes), best, "a long, b long").distinct()


def all_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join what the links among the open pairs join, verified inside the tasks
    on full sets. Only nodes that have an open pair in a run of their key travel with their sets."""
    def busy(run):
        own = np.zeros(len(run["node"]), dtype=bool)
        for x, y in open_pairs(run, percent):
            own[x] = own[y] = True
        return tuple(run[c][own] for c in ("key", "node", "comp", "keys")) if own.any() else None

    def verify(run):
        sets_, comp, up, linked = run["hashes"], run["comp"].tolist(), {}, []

        def top(c):
            while c in up:
                up[c], c = up.get(up[c], up[c]), up[c]
            return c

        for x, y in open_pairs(run, percent):
            for p, q in zip(x.tolist(), y.tolist()):
                u, v = top(comp[p]), top(comp[q])
                if u == v:                                   # joined by an earlier link of this run
                    continue
                a, b = sets_[p], sets_[q]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    up[max(u, v)] = min(u, v)
                    linked.append((p, q))
        return _ordered(run["node"], *np.array(linked).T) if linked else None

    rows = staged(per_run(bucket_runs(members, nodes), busy, "key long, node long, comp long, keys array<long>")
                  .dropDuplicates(["key", "node"]), "busy")
    return per_run(bucket_runs(rows, nodes, with_sets=True).join(sets, "node"), verify, "a long, b long").distinct()


def shingle_sets(df: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, hashes) of the wanted nodes, from the text of one document each.
    ``wanted``: (doc_id, node)."""
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))

    def sets():
        ids = WordIds()

        def step(cols):
            out = {"node": [], "hashes": []}
            for t, node in zip(cols["text"], cols["node"]):
                s = shingles(ids.of(words_of(t)))
                if len(s) and set_id(s) == node:      # another row may have the same doc_id
                    out["node"].append(node)
                    out["hashes"].append(s.view(np.int64))
            return out
        return step

    return map_batches(texts.join(wanted, texts.doc_id.eqNullSafe(wanted.doc_id)).select("text", "node"), sets,
                       "node long, hashes array<long>")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """key, doc_id, n_shingles, comp, component_id and kept for every row of ``df``; comp names
    the component also where no row of it has a doc_id."""
    signed = staged(sign(df, doc_id, text, percent), "signed")
    nodes = staged(signed.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")

    rows = nodes.select("node", F.explode("bands").alias("key"))
    buckets = staged(rows.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").drop("n"), "buckets")
    members = staged(rows.join(buckets, "key"), "members")

    shared = members.select("node").distinct()
    once = nodes.join(shared, "node").select(F.col("first_doc").alias("doc_id"), "node")
    sets = staged(shingle_sets(df, once, doc_id, text).dropDuplicates(["node"]), "sets")

    led = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = staged(verified(bayes(led, nodes, percent), sets, percent), "verified")
    comps = components(links)

    keys: list[DataFrame] = []

    def open_members() -> DataFrame:
        """(key, node, comp, keys): prefix keys of the nodes in buckets with more than one component
        left. The first round's keys serve all: components only grow, so no new key appears."""
        tagged = (members.select("key", "node").join(comps, "node", "left")
                  .select("key", "node", F.coalesce("comp", "node").alias("comp")))
        mixed = staged(tagged.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
                       .filter("x <> y").select("key"), "mixed")
        left = staged(tagged.join(mixed, "key").select("node", "comp").distinct(), "open")
        if not keys:
            keys.append(staged(prefixes(left, sets, percent), "prefixes"))
        held = keys[0].join(left, "node")
        live = held.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
        held = staged(held.join(live, "key"), "held")
        lists = held.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))
        return staged(held.join(lists, "node"), "members")

    for _ in range(ROUNDS):
        more = staged(verified(best_partners(open_members(), nodes, percent).join(links, ["a", "b"], "left_anti"), sets, percent), "verified")
        if more.isEmpty():
            break
        links = links.union(more)
        comps = components(links)
    more = staged(all_links(open_members(), nodes, sets, percent), "verified")
    if not more.isEmpty():
        comps = components(links.union(more))

    named = nodes.select("node", "first_doc").join(comps, "node", "left").select(
        "node", "first_doc", F.coalesce("comp", "node").alias("comp"))
    smallest = staged(named.groupBy("comp").agg(F.min("first_doc").alias("component_id")), "smallest")
    by_node = staged(named.join(smallest, "comp").select("node", "comp", "component_id"), "classes")
    out = signed.select("key", "doc_id", "n_shingles", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("key", "doc_id", "n_shingles", "comp", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``df``."""
    return classes(df, doc_id, text, percent).select("doc_id", "n_shingles", "component_id", "kept")


def kept_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """One row of each component, all columns kept: that of the smallest doc_id; if several
    have it, one of them by hash. Of rows without words repeated ones are dropped only."""
    name = "__key"
    while name in df.columns:
        name += "_"
    stay = staged(classes(df, doc_id, text, percent).filter("kept").groupBy(F.coalesce("comp", "key").alias("comp"))
                  .agg(F.min("key").alias(name)).select(name), "stay")
    rows = df.withColumn(name, row_key(doc_id, text))
    return rows.join(stay, name, "left_semi").dropDuplicates([name]).drop(name)
