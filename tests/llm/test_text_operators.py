"""LM scoring, language ID, near-duplicates, fingerprints, token counts: brute force and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stocklens.llm import common, fingerprints, langid, lm_scoring, near_dedup, token_counts
from stocklens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here at all today", "en", "a", 1),
       (3, "the same words " * 40, "en", "b", 1), (3, "the same words " * 40, "en", "b", 1),
       (4, "\t \n ", None, None, None), (5, "42 17 %%% !!!", "en", "c", 3), (6, "a " * 30_000 + "ünï <|endoftext|>", "de", "a", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names clash with internal ones."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({"n_tokens": F.lit("x"), "key": F.lit(1), "node": F.lit("n"), "row": F.lit(2), "score": F.lit("s")})


def words(t):
    return (t or "").encode().lower().split()


def shingle_set(t):
    w = words(t)
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(items):
    """items: [(doc_id, text)] -> component of each row by all pairs."""
    sets = [shingle_set(t) for _, t in items]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(items)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(items):
        groups[find(i)].append(d)
    smallest = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [smallest[find(i)] for i in range(len(items))], [len(s) for s in sets]


def test_lm_scores(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op1_lm_scoring"](spark, SF).collect()}
    c = collections.Counter()
    for d, t, _ in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(words(t))
            c[b"\0end"] += 1
    n, v = sum(c.values()), len(c)
    better = []
    for d, t, _ in rows:
        w = [*words(t), b"\0end"]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
        better.append(r.score > r.base_score)
    assert sum(better) > 0.8 * len(better)


def test_lm_probabilities_sum_to_one(spark):
    """P(. | h) over the vocabulary and the end is about 1, as counts are quantised."""
    texts = spark.createDataFrame([("a b a c a b d",), ("b a b a",), (None,), ("c d a b",)], "text string")
    m = lm_scoring.train(texts).model
    ids = [common.WordIds()[w] for w in (b"a", b"b", b"c", b"d")] + [lm_scoring.END]
    assert (m.n_tokens, m.n_words, m.n_texts) == (19, 5, 4)

    def log10(*tokens):
        names, at = np.unique(np.array([lm_scoring.START, lm_scoring.END, *tokens], dtype=np.uint64), return_inverse=True)
        return m.log10(names, at[2:])

    for h in ids[:4]:
        assert 0.85 < sum(10 ** log10(h, w)[1] for w in ids) <= 1.05
    assert log10(ids[0], ids[1])[1] > log10(ids[0], ids[3])[1]


def test_lm_filter_reads_back_levels():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 64, 4000, dtype=np.uint64))
    counts = rng.integers(1, 5000, len(keys))
    levels = np.searchsorted(lm_scoring.thresholds(), counts, side="right")
    f = lm_scoring.Filter(0, 512 * 6_000, 3, place=np.zeros(1, dtype=np.uint64))
    f.array = np.frombuffer(f.slice_of(keys, levels), dtype=np.uint8)
    ratio = f.counts(keys) / counts
    assert ((ratio > 0.8) & (ratio < 1.6)).mean() > 0.98      # quantised, few false positives
    assert (f.counts(rng.integers(0, 1 << 64, 4000, dtype=np.uint64)) > 0).mean() < 0.02


def slice_with_production_settings(events, bits, seed):
    """False positives and fill of one slice of a filter for so many events."""
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(0, 1 << (64 - bits), events >> bits, dtype=np.uint64))      # bucket 0
    f = lm_scoring.layout(bits, events)
    f.array = np.frombuffer(f.slice_of(keys, np.ones(len(keys), dtype=np.int64)), dtype=np.uint8)
    strangers = rng.integers(0, 1 << (64 - bits), 200_000, dtype=np.uint64)
    return f, (f.counts(strangers) > 0).mean(), f.fill()


def test_lm_filter_with_production_bits():
    f, wrong, _ = slice_with_production_settings(200_000, 0, 2)
    assert f.hashes == 4 and f.width >= 12 * 200_000 and wrong < 0.01


@pytest.mark.parametrize("events", [200_000_000, 1_000_000_000])
def test_lm_filter_grows_with_the_events(events):
    """Above 107 million events, where filters were once capped, the rate stays the same."""
    f, wrong, fill = slice_with_production_settings(events, 12, 3)
    assert f.width << 12 >= lm_scoring.BITS_PER_EVENT * events and wrong < 0.03 and fill < 0.35


def test_lm_block_round_trip():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 64, 999, dtype=np.uint64))
    counts = np.arange(1, len(keys) + 1)
    for kind, bucket, k, c in lm_scoring.blocks(1, keys, counts, 3):
        k, c = lm_scoring.unpack(k, c)
        assert (k >> np.uint64(61) == bucket).all() and kind == 1
        assert (counts[np.searchsorted(keys, k)] == c).all()


def test_lm_odd_rows(spark, odd):
    t = lm_scoring.train(odd.select(common.text_of().alias("t")))
    got = lm_scoring.score(odd, t, keep=("doc_id",)).collect()
    assert len(got) == len(ODD)
    empty = [r for r in got if r.doc_id in (1, 2, 4)]
    assert {r.n_tokens for r in empty} == {1} and len({r.score for r in empty}) == 1
    same = [r for r in got if r.doc_id == 3]
    assert same[0] == same[1] and same[0].n_tokens == 121
    none = spark.createDataFrame([], SCHEMA)
    assert lm_scoring.score(none, t).count() == 0
    blank = lm_scoring.train(none.select("text"))
    assert {(r.base_score, r.n_known) for r in lm_scoring.score(odd, blank).collect()} == {(0.0, 0)}


def test_lm_rare_words_meet_exact_counts(spark, docs, rows):
    """The join path gives the same base scores as the broadcast head."""
    t = lm_scoring.train(docs.select(common.text_of().alias("t")))
    full = {r.doc_id: r for r in lm_scoring.score(docs, t).collect()}
    head, lm_scoring.frequent.__defaults__ = lm_scoring.frequent.__defaults__, (50,)
    try:
        few = {r.doc_id: r for r in lm_scoring.score(docs, t).collect()}
    finally:
        lm_scoring.frequent.__defaults__ = head
    for d, r in full.items():
        assert few[d].n_known == r.n_known == r.n_tokens
        assert few[d].base_score == pytest.approx(r.base_score, rel=1e-9)


def test_language_id_accuracy_on_held_out(spark, rows):
    lang = {d: la for d, _, la in rows}
    got = QUERIES["op2_language_id"](spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_odd_rows(spark, docs, odd):
    m = langid.train(docs)
    got = langid.detect(odd, m).collect()
    assert len(got) == len(ODD)
    assert all((r.lang_pred, r.rejected) == ("und", True) for r in got if r.doc_id in (1, 2, 4, 5))
    assert {r.lang_pred for r in got if r.doc_id == 3} == {"en"}
    assert langid.detect(odd.limit(0), m).count() == 0
    unlabelled = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.detect(odd, unlabelled).collect()} == {"und"}


def test_language_models_are_distributions(docs):
    """Over the alphabet, P(c | context) of the interpolated model sums to about one."""
    m = langid.train(docs.filter("lang in ('en', 'de')"))
    alphabet = [32, *range(97, 123), 228, 246, 252, 223]
    for context in ("the", "  a", "ung"):
        total = sum(np.exp(m.log_probs(np.array([*map(ord, context), c], dtype=np.uint32))[0]) for c in alphabet)
        assert (total > 0.97).all() and (total < 1.01).all()


def test_language_rejects_foreign_script(spark, docs):
    m = langid.train(docs)
    odd = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок, да выпей чаю " * 5)], "doc_id long, text string")
    assert langid.detect(odd, m).first().rejected
    assert langid.accepted_rows(odd, m).count() == 0
    assert langid.accepted_rows(docs, m).count() > 0.97 * docs.count()


def test_long_texts_are_scored_whole(docs):
    m = langid.train(docs)
    t = "erheth onthe the and tion " * 40_000          # longer than one slice
    _, h = m.entropies([t])
    _, parts = m.entropies([t[:len(t) // 2], t[len(t) // 2:]])
    assert h[0] == pytest.approx(parts.mean(axis=0), rel=1e-3)


def test_near_duplicates_equal_brute_force(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op6_near_dedup"](spark, SF).collect()}
    comp, sizes = brute_components([(d, t) for d, t, _ in rows])
    assert [(got[d].component_id, got[d].n_shingles, got[d].kept) for d, _, _ in rows] == [
        (c, n, c == d) for (d, _, _), c, n in zip(rows, comp, sizes)]


def chain_corpus():
    """Near copies that are linked only over others, a star, exact copies, strangers."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    out, ident = [], 100
    doc = list(base)
    for step in range(12):                             # a chain: each differs a little from the last
        doc = list(doc)
        doc[step * 15] = f"x{step}"
        out.append((ident, " ".join(doc)))
        ident -= 1
    star = [f"s{i}" for i in range(150)]
    out.append((300, " ".join(star)))
    for k in range(60):                                # each near the centre, many not near each other
        v = list(star)
        for at in rng.choice(145, 2, replace=False):
            v[at] = f"y{k}_{at}"
        out.append((301 + k, " ".join(v)))
    out += [(500 + k, " ".join(star)) for k in range(30)]
    out += [(600 + k, " ".join(f"z{k}_{i}" for i in range(50)) + " " + " ".join(base[:40])) for k in range(40)]
    out += [(700, "a b c"), (701, "a b c"), (702, "A B c"), (703, "a b"), (704, None), (705, ""), (706, " \n"), (None, "a b c")]
    return out


def test_near_duplicates_chains_stars_and_odd_rows(spark):
    items = chain_corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in items], "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(df).collect()), key=str)
    comp, sizes = brute_components(items)
    want = []
    for (d, t), c, n in zip(items, comp, sizes):
        want.append((d, c if n else d, n))
    assert got == sorted(want, key=str)
    stay = near_dedup.kept_rows(df)
    assert stay.columns == df.columns
    kept = [r.doc_id for r in stay.collect()]
    assert len(kept) == len(set(kept)) and {700, 300, 89, 703, 704, 705, 706} <= set(kept)
    assert not {701, 702, None} & set(kept)


def test_near_duplicates_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.kept_rows(none).count() == 0
    same = spark.createDataFrame([(1, "one two three four five six")] * 5 + [(2, "one two three four five six")], "doc_id long, text string")
    assert [tuple(r) for r in near_dedup.near_duplicates(same).distinct().orderBy("doc_id").collect()] == [(1, 2, 1, True), (2, 2, 1, False)]
    assert near_dedup.kept_rows(same).count() == 1


def test_bayes_rule_keeps_true_links():
    """Pairs at the threshold survive the sequential test; clearly different ones do not."""
    rng, sign, rule = np.random.default_rng(3), near_dedup.Signer(), near_dedup.least_matches()
    kept = {0.85: 0, 0.4: 0}
    for sim in kept:
        inter = round(2 * 400 * sim / (1 + sim))
        for _ in range(60):
            x = rng.integers(0, 1 << 64, 800 - inter, dtype=np.uint64)
            a, b = (np.frombuffer(sign.short(sign(s)), "<u2")[None] for s in (x[:400], x[400 - inter:]))
            kept[sim] += len(near_dedup.surviving(a, b, rule))
    assert kept[0.85] == 60 and kept[0.4] == 0


def brute_prints(items):
    """edited texts by the contract: items sorted by descending id."""
    order = sorted(items, key=lambda x: -x[0])
    out = {}
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        out[d] = t[:len(t) - cut] + nxt[:cut]
    return out


def test_fingerprints(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op4_fingerprints"](spark, SF).collect()}
    edited = brute_prints([(d, t or "") for d, t, _ in rows])
    assert len(got) == len(rows)
    by_text = collections.defaultdict(set)
    for d, t, _ in rows:
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited[d].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[t].add(r.fingerprint)
        by_text[edited[d]].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r.near_edited for r in got.values()) > 5 * sum(r.near_next for r in got.values())


def test_fingerprint_parts_by_hand(spark, rows):
    """Each part is equal exactly where the lexicon keeps the same terms of two texts."""
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma BETA, alpha"), (3, "alpha beta delta"), (4, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(df, low=0.0, high=1.0).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert got[2].near_next == 1.0                    # 2 is followed by 1
    assert 0.0 < got[3].near_next < 1.0 and got[4].near_next == 0.0


def test_fingerprint_odd_rows(spark, odd):
    got = fingerprints.fingerprint_pairs(odd).collect()
    assert len(got) == len(ODD)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert [r.near_next for r in got if r.doc_id == 2] == [1.0]         # the next one is empty too
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    r = fingerprints.fingerprint_pairs(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0
    assert fingerprints.fingerprint_pairs(one.limit(0)).count() == 0


def test_fingerprint_order_over_blocks(spark):
    old, fingerprints.ROWS_PER_BLOCK = fingerprints.ROWS_PER_BLOCK, 7
    try:
        items = [(i * 3, "abc" * (i % 5 + 1)) for i in range(100)]
        df = spark.createDataFrame(items, "doc_id long, text string")
        got = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_pairs(df).collect()}
        assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in brute_prints(items).items()}
    finally:
        fingerprints.ROWS_PER_BLOCK = old


def test_fingerprints_run_no_python(spark, docs):
    plan = fingerprints.fingerprint_pairs(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_token_counts_equal_the_library(spark, rows, odd):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(token_counts.tokenizer_json())
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False))
    got = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    for d, t, _ in rows:
        assert (got[d].n_tokens, got[d].n_bytes) == (count(t), len(t.encode()))
        assert got[d].over_limit == (count(t) > 1024)
    out = token_counts.count_tokens(odd).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(d), count(t)) for d, t, *_ in ODD)
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_token_pieces_on_random_text():
    from hypothesis import given, settings, strategies as st
    from tokenizers import Tokenizer
    conf = token_counts.tokenizer_json()
    tok, pieces = Tokenizer.from_str(conf), token_counts.Pieces(conf, {}, 50)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn", "Co"]), st.sampled_from(" \n\t\r'sd<|>  \x1c")), max_size=40)
           | st.sampled_from(["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " it's  \n\n x", "\x1c\x1d a"]))
    def check(t):
        assert pieces.count(t) == len(tok.encode(t, add_special_tokens=False))
    check()


def test_prefix_keys_of_a_large_open_bucket_stay_linear(spark):
    """5,000 unlinked nodes that share half of their shingles, and 40 linked pairs among them."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 62, 100)
    rows = [(i, i, np.concatenate([common, rng.integers(0, 1 << 62, 100)]).tolist()) for i in range(5000)]
    for i in range(40):
        rows.append((5000 + i, 5000 + i, rows[i][2][:185] + rng.integers(0, 1 << 62, 15).tolist()))
    df = spark.createDataFrame([(n, c, sorted(set(h))) for n, c, h in rows], "node long, comp long, hashes array<long>")
    keys = near_dedup.prefixes(df.select("node", "comp"), df.select("node", "hashes"), 80).collect()
    assert len(keys) <= 40 * 2
    met = {}
    for r in keys:
        met.setdefault(r.key, set()).add(r.node)
    assert {(i, 5000 + i) for i in range(40)} == {tuple(sorted(p)) for p in met.values()}


@pytest.mark.parametrize("percent", [80, 85])
def test_links_of_open_buckets_are_found_at_the_bound(spark, percent):
    """Groups with a common passage whose linked pairs lie at or just below the bound."""
    rng, rows, want = random.Random(percent), [], {}
    for g in range(3):
        passage = [f"p{g}_{i}" for i in range(104)]
        for k in range(60):
            own = [f"g{g}k{k}_{i}" for i in range(100)]
            base = passage + own
            n = len(base) - 4                                     # x changed end words: (n - x) / (n + x)
            most = max(x for x in range(n) if 100 * (n - x) >= percent * (n + x))
            x = most + (k % 2)
            i = len(rows)
            rows += [(i, " ".join(base)), (i + 1, " ".join(base[:len(base) - x] + [f"c{rng.random()}" for _ in range(x)]))]
            want |= {i: i, i + 1: i + (k % 2)}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_runs_of_a_large_group_carry_each_node_once(spark):
    """One key of 3,000 nodes, 200 of them outside its largest component."""
    ids = spark.range(3000).withColumnRenamed("id", "node")
    one = F.lit(7).cast("long")
    members = ids.select(one.alias("key"), "node", F.when(F.col("node") < 200, F.col("node")).otherwise(5000).alias("comp"), F.array(one).alias("keys"))
    nodes = ids.select("node", F.lit(9).cast("long").alias("n_shingles"), F.lit(bytearray(2 * near_dedup.BANDS * near_dedup.ROWS)).alias("sig"))
    assert near_dedup.bucket_runs(members, nodes).count() == 3000


def test_links_are_found_across_blocks_parts_and_tiles(spark, monkeypatch):
    for name, size in (("HELD", 4_000), ("PASSING", 6_000), ("TILE", 3)):
        monkeypatch.setattr(near_dedup, name, size)
    test_links_of_open_buckets_are_found_at_the_bound(spark, 80)


def test_large_batches_are_unpacked_in_pieces(spark):
    """400 texts of 1 kB reach a task's function in lists of at most about 20 kB, all of them."""
    def sizes():
        return lambda cols: {"n": [len(cols["text"])] * len(cols["text"])}
    df = spark.range(400).coalesce(1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    got = [r.n for r in common.map_batches(df, sizes, "n long", 20_000).collect()]
    assert len(got) == 400 and max(got) <= 20


def test_lm_tasks_exchange_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    df = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    got = common.small_batches(lambda d: d.mapInArrow(sizes, "n long").collect())(df)
    assert len(got) > 3 and max(r.n for r in got) < common.BATCH_BYTES + 100_000 and spark.conf.get(key) == before
    keys = np.sort(common.mix(np.arange(1 << 19, dtype=np.uint64)))
    out = list(lm_scoring._block_batches(lm_scoring.blocks(lm_scoring.WORD, keys, np.ones(len(keys), dtype=np.int64), 6)))
    assert len(out) > 3 and max(b.nbytes for b in out) < 2 * lm_scoring.PIECE and sum(b.num_rows for b in out) == 64
    back = [lm_scoring.unpack(k, c)[0] for b in out for k, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
    assert (np.concatenate(back) == keys).all()
