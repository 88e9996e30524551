"""Decontamination, licences, mixing, URL filter, HTML extraction and the pipeline."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stocklens.llm import decontaminate, html_extract, langid, licenses, mixing, near_dedup, url_filter
from stocklens.llm.common import draw as common_draw
from stocklens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_decontamination_finds_verbatim_items(spark, docs, benchmark):
    got = {r.doc_id: r for r in QUERIES["op3_decontaminate"](spark, SF).collect()}
    norm = lambda t: " " + " ".join(decontaminate.words(t)) + " "
    items = [(r.item_id, norm(r.text)) for r in benchmark.collect()]
    for r in docs.collect():
        assert {i for i, t in items if t in norm(r.text)} <= set(got[r.doc_id].item_ids)
    assert len(got) == docs.count()
    assert all(r.contaminated == (r.n_items > 0) == bool(r.item_ids) for r in got.values())


def test_decontamination_of_edited_items_and_clean_texts(spark, docs, benchmark):
    """Random word edits up to the bound are found; what is reported is within it."""
    rng = random.Random(4)
    items = [(r.item_id, decontaminate.words(r.text)) for r in benchmark.collect()]
    index = decontaminate.Index(items, 0.8, decontaminate.RECALL)
    texts, want = [], []
    host = decontaminate.words(docs.first().text)
    for _ in range(150):
        i, ws = rng.choice(items)
        ws = list(ws)
        for _ in range(rng.randint(0, decontaminate.allowed(len(ws), 0.8))):
            at = rng.randrange(len(ws))
            rng.choice([lambda: ws.__setitem__(at, "zzz"), lambda: ws.pop(at), lambda: ws.insert(at, "qqq")])()
        cut = rng.randrange(len(host))
        texts.append(" ".join(host[:cut] + ws + host[cut:]))
        want.append(i)
    got = index.matches(texts)
    assert sum(any(index.ids[m[0]] == i for m in g) for i, g in zip(want, got)) >= 147
    for t, g in zip(texts, got):
        for i, s, size, e in g:
            seq = index.seqs[i].tolist()
            window = [index.vocab.get(w, 0) for w in decontaminate.words(t)[s:s + size]]
            assert edit_distance(seq, window) == e <= decontaminate.allowed(len(seq), 0.8)
    assert not any(index.matches(["the of and is on " * 300, "", "one two three"]))


def test_decontamination_odd_rows_and_blocks(spark, docs, benchmark):
    item = benchmark.orderBy("item_id").first()
    rows = [(1, None), (2, ""), (3, item.text.upper()), (3, item.text.upper()), (None, "x " * 9000 + item.text), (5, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"matches": F.lit(1), "item_ids": F.lit("x")})
    bench = benchmark.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, item.text)], "item_id long, text string"))
    got = decontaminate.decontaminate(df, bench).collect()
    found = sorted((r.doc_id or 0, tuple(r.item_ids)) for r in got if r.contaminated)
    assert found == [(0, (item.item_id, 902)), (3, (item.item_id, 902)), (3, (item.item_id, 902))] and len(got) == len(rows)
    small = decontaminate.decontaminate(df, bench, block_items=7).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    clean = decontaminate.clean_rows(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 5]
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(df, bench.limit(0)).collect())


LINES = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
         "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0"}


def test_license_scan_finds_the_notice_lines(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op5_license_scan"](spark, SF).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        lines = [LINES[x] for x in r.text.split("\n") if x in LINES]
        assert (got[r.doc_id].licenses, got[r.doc_id].n_paragraphs) == (sorted(set(lines)), len(lines))


def test_license_scan_held_out_wording_and_odd_rows(spark, docs):
    scanner = licenses.train(docs)
    rows = [(1, None), (2, ""), (3, "license"), (4, "We sell licences for fishing and driving in the county."),
            (5, "intro\nPermission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation files, to deal in it without restriction\nend"),
            (5, "Licensed under the Mozilla Public License, version 2.0!"), (6, "word " * 50_000),
            (7, "released under the mit license"), (7, "released under the mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "words": F.lit("x"), "family": F.lit("y")})
    got = sorted((r.doc_id, tuple(r.licenses), r.n_paragraphs) for r in licenses.scan(df, scanner).collect())
    assert got == [(1, (), 0), (2, (), 0), (3, (), 0), (4, (), 0), (5, ("mit",), 1), (5, ("mpl-2.0",), 1), (6, (), 0),
                   (7, ("mit",), 1), (7, ("mit",), 1)]
    assert licenses.scan(df.limit(0), scanner).count() == 0
    plan = licenses.scan(df, scanner)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_license_training_uses_every_paragraph(spark, docs, monkeypatch):
    seen, features = [], licenses.features
    monkeypatch.setattr(licenses, "features", lambda df: seen.append(df.count()) or features(df))
    licenses.train(docs.limit(0))
    spans = seen[0]
    rows = [(i, "\n".join(f"some words of line {i} {k} and more" for k in range(10))) for i in range(30)]
    rows.append((30, "Released under the MIT License."))
    licenses.train(spark.createDataFrame(rows, "doc_id long, text string"), negatives=20)
    assert seen[1] == 0 and sum(seen[2:]) - spans == 300


def test_license_query_makes_the_features_of_a_paragraph_once(spark, tmp_path, monkeypatch):
    rows = [(i, "\n".join(f"some words of line {i} {k} and more" for k in range(5))) for i in range(20)]
    rows += [(None, None), (20, ""), (21, "Released under the MIT License.\nend"), (21, "Released under the MIT License.\nend")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    seen, features = [], licenses.features
    monkeypatch.setattr(licenses, "features", lambda df: seen.append(df.count()) or features(df))
    got = sorted(map(tuple, QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()), key=str)
    query, seen[:] = sum(seen), []
    apart = sorted(map(tuple, licenses.scan(df, licenses.train(df)).collect()), key=str)
    spans = seen[0]
    assert query == spans + 104
    assert got == apart and [r[:3] for r in got if r[2]] == [(21, ["mit"], 1)] * 2 and len(got) == 24


def test_license_near_a_notice_is_a_shared_trigram(spark):
    texts = ["released under the mit license", "Released under the", "under the", "the mit", "", "license mit the under released",
             "It is released under the county's rules", "to deal in it", "a copy of this programme", "of of of of"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("words", licenses.tokens(F.col("t")))
    ours = {r.g for r in licenses.notices(spark).select(F.explode(licenses.grams(F.col("words"), 3)).alias("g")).collect()}
    for r in rows.withColumn("near", licenses.near_notice(spark)).collect():
        assert r.near == any(" ".join(r.words[i:i + 3]) in ours for i in range(len(r.words) - 2)), r.t


def test_license_threshold_is_reached_by_one_in_a_hundred(spark):
    p = lambda *counts: spark.createDataFrame([(x,) for n, x in counts for _ in range(n)], "p double")
    assert licenses.calibrated(p((990, 0.1), (10, 0.9))) == 0.5
    assert licenses.calibrated(p((985, 0.1), (10, 0.7), (5, 0.9))) == pytest.approx(0.7001)
    assert licenses.calibrated(p((970, 0.1), (30, 0.95))) == pytest.approx(0.9501)
    assert licenses.calibrated(p((100, 0.4999))) == licenses.calibrated(p((1, 0.1)).limit(0)) == 0.5


def test_license_training_on_an_empty_table(spark, docs):
    scanner = licenses.train(docs.limit(0))
    assert licenses.scan(docs.limit(3), scanner).count() == 3


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 1000, 60).astype(float)
    labels = [np.arange(60) % 5, np.arange(60) // 5 % 3, np.arange(60) // 15]
    targets = [np.array([.3, .2, .2, .2, .1]), np.array([.5, .3, .2]), np.array([.25] * 4)]
    p = mixing.rake(tokens, labels, targets, 0.3)
    assert ((p >= 0) & (p <= 1)).all()
    for lab, want in zip(labels, targets):
        got = np.bincount(lab, weights=p * tokens)
        assert got / got.sum() == pytest.approx(want, abs=1e-3)


def test_a_rare_class_does_not_shrink_the_corpus():
    """One document of its own source and language is kept, and so is half of the rest."""
    rng = np.random.default_rng(3)
    grid = [(i, j, k, rng.uniform(0.5, 2) * 1e6) for i in range(6) for j in range(3) for k in range(4)] + [(6, 3, 0, 100.0)]
    tokens = np.array([c[3] for c in grid])
    labels = [np.array([c[d] for c in grid]) for d in range(3)]
    have = [np.bincount(lab, weights=tokens) for lab in labels]
    targets = [h ** mixing.TEMPER[d] / (h ** mixing.TEMPER[d]).sum() for d, h in zip(mixing.DIMS, have)]
    p = mixing.rake(tokens, labels, targets)
    assert p[-1] == 1.0 and (p * tokens).sum() / tokens.sum() == pytest.approx(0.5, abs=1e-6)
    for lab, h, want in zip(labels, have, targets):
        quota = mixing.quotas(h, want, 0.5 * tokens.sum())
        assert np.bincount(lab, weights=p * tokens) == pytest.approx(quota, rel=1e-5)
    assert mixing.quotas(np.array([1.0, 100, 100]), np.array([.4, .4, .2]), 61).tolist() == pytest.approx([1, 40, 20])


def test_three_hundred_sources_meet_their_targets(spark):
    """Equal targets for 300 sources of unequal size: none is left out; kept tokens by enumeration."""
    texts = [" ".join(f"w{k % 9}" for k in range(30)), " ".join(f"v{k % 7}" for k in range(30))]
    rows = [(k * 100 + j, texts[j % 2], "en", f"s{k:03d}") for k in range(300) for j in range(6 + 2 * (k % 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = mixing.make_plan(df, targets={"source": {f"s{k:03d}": 1.0 for k in range(300)}}, budget=0.4)
    got = mixing.mixture(df, plan).collect()
    assert len(got) == len(rows) and all(r.n_tokens == 30 for r in got)
    kept, total = {}, sum(r.n_tokens for r in got)
    for r in got:
        kept[r.source] = kept.get(r.source, 0.0) + r.n_tokens * r.probability
    assert len(kept) == 300 and sum(kept.values()) == pytest.approx(0.4 * total, rel=1e-3)
    assert max(kept.values()) == pytest.approx(min(kept.values()), rel=2e-3)
    assert all(r.probability == plan.prob[r.source, r.lang, r.topic] for r in got)
    draws = {r.doc_id: r.u for r in df.select("doc_id", common_draw("keep", F.col("doc_id").cast("string"), F.col("text")).alias("u")).collect()}
    assert all(r.kept == (draws[r.doc_id] < r.probability) for r in got)


def test_sources_without_a_name_share_their_targets(spark):
    """With 40 of 300 sources named the others are kept at one rate that meets the sum of their targets."""
    texts = [" ".join(f"w{k % 9}" for k in range(30)), " ".join(f"v{k % 7}" for k in range(30))]
    rows = [(k * 100 + j, texts[j % 2], "en", f"s{k:03d}") for k in range(300) for j in range(8 if k < 40 else 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = mixing.make_plan(df, targets={"source": {f"s{k:03d}": 1.0 for k in range(300)}}, budget=0.4, max_classes=40)
    got = mixing.mixture(df, plan).collect()
    tail = [r for r in got if r.source >= "s040"]
    assert min(r.probability for r in tail) > 0
    share = sum(r.n_tokens * r.probability for r in tail) / sum(r.n_tokens * r.probability for r in got)
    assert share == pytest.approx(260 / 300, rel=1e-3)


def test_mixture_marginals_and_sample(spark):
    got = QUERIES["op8_mix_sources"](spark, SF).toPandas()
    expected = (got.n_tokens * got.probability)
    assert set(got.kept.unique()) <= {True, False} and got.probability.between(0, 1).all()
    for d in mixing.DIMS:
        have = got.groupby(d).n_tokens.sum() ** mixing.TEMPER[d]
        share = expected.groupby(got[d]).sum() / expected.sum()
        assert (share - have / have.sum()).abs().max() < 0.02


def test_mixing_odd_rows_and_given_targets(spark, docs):
    rows = [(i, "the words of one text " * (i % 7 + 1), "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i in range(400)]
    rows += [(900, None, "en", "s1"), (901, "", None, None), (None, "a text", "de", "s2"), (902, "big " * 50_000, "de", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"u": F.lit(1), "topic": F.lit("t")})
    plan = mixing.make_plan(df, targets={"source": {"s1": 0.5, "s2": 0.25, "s3": 0.25}}, max_classes=3)
    out = mixing.mixture(df, plan).collect()
    assert len(out) == len(rows)
    assert plan.named["source"] <= {"s0", "s1", "s2", "s3", "(null)"} and len(plan.named["source"]) == 3
    kept = mixing.sample_rows(df, plan)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in out if r.kept)
    none = docs.limit(0)
    plan = mixing.make_plan(none)
    assert mixing.mixture(none, plan).count() == 0 and mixing.sample_rows(none, plan).count() == 0


def test_topics_are_fitted_on_all_documents(spark):
    """idf over all 3,000 documents, brute force; the same model from other partitions."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{i % 8}_{w}" for w in rng.integers(0, 60, 25)) for i in range(3000)]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    one, two = (mixing.make_plan(d).topics for d in (df.repartition(2), df.repartition(5, "text")))
    ids = mixing.WordIds()
    seen = np.array([np.bincount((ids.of(mixing.words_of(t)) & np.uint64(mixing.WIDTH - 1)).astype(int), minlength=mixing.WIDTH) > 0 for t in texts])
    assert np.allclose(one.idf, np.log(3001 / (1 + seen.sum(axis=0))) + 0.1)
    assert (one.centroids == two.centroids).all() and (one.idf == two.idf).all()
    rows = [mixing.frequencies(ids.of(mixing.words_of(t))) for t in texts]
    sims = one.units(mixing.matrix(rows, "<u2")) @ one.centroids.T / mixing.UNIT ** 2
    own = [one.units(mixing.matrix(rows, "<u2"))[np.array(one.topics(rows)) == k].sum(axis=0) for k in range(mixing.TOPICS)]
    for k, m in enumerate(own):                                # each centroid is the mean of its documents
        assert np.allclose(m / np.linalg.norm(m), one.centroids[k] / mixing.UNIT, atol=2e-4)
    assert sims.max(axis=1).min() > 0.2


def test_url_filter_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = con.execute(ORACLE["op9_url_filter"]).df()
    got = QUERIES["op9_url_filter"](spark, SF).toPandas()
    cols = sorted(want.columns)
    key = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).to_numpy().tolist()), key=str)
    assert key(got) == key(want)


def brute_url(url, rules, listed):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m.group(1)), m.group(2)) if m else ("", "")
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if m and under(h) and path.startswith(p)]
    rule = max(fits) if fits else None
    hit = [h for h in listed if under(h)]
    return host, path, rule[1] if rule else None, rule[2] if rule else "block" if hit else "allow"


def test_url_filter_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://x.org", "http://x.org/", "https://EXAMPLE.org/es/a?b#c",
            "http://a.example.org/en/12", "http://badexample.org/es/", "ftp://u.com/fr/x://y.org/", "http://y.com?/fr/",
            "http://m.spam-farm.example.com/x", "http://xspam-farm.example.com/x", "http://É.com/de/", "http://a..com/de/1",
            "x" * 100_000 + "://q.org/z", "http://q.com/" + "fr/" * 50_000, "http://q.com/fr/"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "path": F.lit(1), "rule": F.lit(1)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got == {i: brute_url(u, url_filter.RULES, url_filter.LISTED_HOSTS) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    free = url_filter.filter_urls(df, rules=[], listed=[]).collect()
    assert {r.verdict for r in free} == {"allow"}


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    """With all digests equal only the stored string tells entries apart."""
    import xxhash
    real = xxhash.xxh64_intdigest
    names = [(f"host{i}.org", i % 3) for i in range(500)]
    for fake in (None, lambda b: 7):
        monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", fake or real)
        path = tmp_path / f"array{fake is None}"
        path.write_bytes(url_filter.build_array([*names, ("host1.org", 2)]))
        a = url_filter.DigestArray(str(path))
        at = a.find([n for n, _ in names] + ["absent.org", ""])
        assert (at[:-2] >= 0).all() and (at[-2:] == -1).all()
        assert [int(a.codes[k]) for k in at[:-2]] == [c for _, c in names]


def expected_article(page):
    import html
    body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", body))
    return "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in parts) if x)


def test_html_extraction_of_the_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op10_html_extract"](spark, SF).collect()}
    assert len(got) == len(pages)
    for i, page in pages.items():
        assert got[i].text == expected_article(page) and got[i].n_chars == len(got[i].text)


def site(title, paragraphs, ad=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f"<html><head><title>{title}</title></head><body><div class='top-menu'><a href='/'>Home</a> <a href='/x'>News</a></div>"
            f"{ad}<div id=content><div>Read on our site</div><h2>{title}</h2>{body}</div><div id='comments'><p>first!</p></div>"
            "<div class=legal-footer>All rights</div><script>var a='<p>no</p>';</script></body></html>")


def test_wrappers_without_article_elements(spark):
    """Template texts are constants of the wrapper, slots are content."""
    pages = [site(f"Title {w}", [f"{w} one &amp; two", f"{w} three"][: k % 2 + 1], "<div class=ad>Buy!</div>" if k % 2 else "")
             for k, w in enumerate(["alpha", "beta", "gamma", "delta"])]
    df = spark.createDataFrame([(k, "http://h.org/p", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got == {0: "Title alpha\nalpha one & two", 1: "Title beta\nbeta one & two\nbeta three", 2: "Title gamma\ngamma one & two",
                   3: "Title delta\ndelta one & two\ndelta three"}


def test_wrappers_are_matched_inside_articles(spark):
    """Constants go from an article too, also from its repeated groups; a title before it stays."""
    def page(w, extra=""):
        return (f"<html><body><h3>The Site</h3><h1>Title {w}</h1><article><div class=lead>You read the daily</div>{extra}"
                f"<p>{w} one</p><p>{w} two</p><p>read more</p></article></body></html>")
    names = ["alpha", "beta", "gamma", "delta"]
    pages = [page(w, "<blockquote>only here</blockquote>" if w == "beta" else "") for w in names]
    df = spark.createDataFrame([(k, "http://h.org/p", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got == {k: "\n".join([f"Title {w}", *(["only here"] if w == "beta" else []), f"{w} one", f"{w} two"])
                   for k, w in enumerate(names)}


def test_wrappers_learn_from_all_pages_of_a_host(spark):
    """Copies count once, every structure is learned, and what one page alone has is no constant."""
    words = [f"word{k}" for k in range(40)]
    pages = [site(f"Title {w}", [f"{w} one", f"{w} two"], f"<section class=kind{chr(97 + n % 20)}>x</section>") for n, w in enumerate(words)]
    pages[3] = pages[3].replace("<h2>", "<blockquote>a word of its own</blockquote><h2>", 1)
    copies = [(100 + k, f"http://h.org/{j}", p) for j, p in enumerate(pages) for k in range(9)]
    rows = [(k, "http://h.org/p", p) for k, p in enumerate(pages)] + copies
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert not any("Read on our site" in t for t in got.values())
    assert "a word of its own" in got[3]
    assert all(f"Title {w}\n{w} one\n{w} two" in got[k] for k, w in enumerate(words))
    small = html_extract.wrappers(df, fan=2)
    assert [r.host for r in small.collect()] == ["h.org"]


def test_wrapper_of_deep_and_wide_pages():
    deep = "<div>" * 3000 + "a" + "</div>" * 2999 + "b"
    wide = "<article>" + "".join(f"x{k}<h{k % 5 + 1}>y{k}</h{k % 5 + 1}>" * (k % 3 + 1) for k in range(600)) + "</article>"
    for page in (deep, wide):
        assert html_extract.extract(page, html_extract.infer([page, page])) == html_extract.extract(page, None) != ""


def test_wrapper_expression_has_repeats_and_optionals():
    tree = lambda s: html_extract.wrapper_of(html_extract.parse(s)[0][1])
    w = html_extract.align(tree("<div><h1>a</h1><p>x</p><p>y</p></div>"), tree("<div><h1>b</h1><hr><ul><li>q</li></ul><p>z</p></div>"))
    (kind, label, children), = w
    assert (kind, label) == ("t", "div")
    assert [c[0] for c in children] == ["t", "?", "+"]
    assert children[0] == ("t", "h1", [("x", None)])           # differing texts became a slot
    assert children[1][1][1] == "ul" and children[2][1][0][1] == "p"


def test_html_odd_rows(spark):
    rows = [(1, None, None), (2, "http://a.org/", ""), (3, None, "plain  text &lt;only&gt;"), (4, "x", "<p>un<b>closed <p>next<!-- gone"),
            (5, "http://a.org/", "<article><nav>menu</nav><header><h1>T</h1></header>a<br>b<aside>no</aside><div class=comments>c</div></article>"),
            (6, "http://a.org/", "<article>" + "<p>word</p>" * 20_000), (7, "http://a.org/", "</div></p><<<>>& x"),
            (7, "http://a.org/", "</div></p><<<>>& x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit(1), "wrapper": F.lit(1)})
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.main_text(df).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6, 7, 7]
    text = {i: t for i, t, _ in got}
    assert (text[1], text[2], text[3], text[4], text[5]) == ("", "", "plain text <only>", "unclosed\nnext", "T\na b")
    assert text[6] == "\n".join(["word"] * 20_000) and all(len(t) == n for _, t, n in got)
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_html_names_do_not_exclude_what_contains_the_main_text(spark):
    """A sidebar class on the body, on a box around main, and an ad-like name of the article itself."""
    body = "<p>First words of it.</p><div class='sidebar'>links</div><p>Last words of it.</p>"
    rows = [(1, "http://a.org/", f"<body class='single right-sidebar'><article>{body}</article><footer>f</footer></body>"),
            (2, "http://b.org/", f"<body><nav>menu</nav><div class='with-sidebar'><main>{body}</main></div></body>"),
            (3, "http://c.org/", f"<body><article class='post ad-hoc'>{body}</article></body>"),
            (4, "http://d.org/", "<body><p>The page has its text outside of any article, much of it.</p><div class='related'><article>teaser</article></div></body>"),
            (5, "http://e.org/", f"<body><div class='with-sidebar'><main>{body}</main></div><div class='comments'><article>a reader says so</article></div></body>")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "First words of it.\nLast words of it." for i in (1, 2, 3, 5))
    assert got[4] == "The page has its text outside of any article, much of it."


def kept_by_all_pairs(rows, percent):
    """The smallest id of every component over all pairs of texts."""
    sets = {}
    for i, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        n = min(5, len(words))
        sets[i] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def test_pipeline_equals_its_operators(spark, docs):
    """Each stage against brute force on its own input."""
    one = corpus_pipeline.language(spark, docs, SF)
    model = langid.train(docs)
    keep = {r.doc_id for r in langid.detect(docs, model).collect() if not r.rejected}
    assert {r.doc_id for r in one.collect()} == keep and len(keep) > 0.97 * docs.count()
    two = corpus_pipeline.near_duplicates(spark, docs, SF)
    stay = kept_by_all_pairs([(r.doc_id, r.text) for r in docs.collect()], 80)
    assert {r.doc_id for r in two.collect()} == stay and len(stay) < docs.count()
    three = corpus_pipeline.benchmark_free(spark, docs, SF)
    bad = {r.doc_id for r in QUERIES["op3_decontaminate"](spark, SF).collect() if r.contaminated}
    assert bad and {r.doc_id for r in three.collect()} == {r.doc_id for r in docs.collect()} - bad
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert {r.doc_id for r in out.collect()} <= (keep & stay) - bad
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources"]


def test_pipeline_drops_near_duplicates_from_080(spark):
    """The stage against brute force at 0.8, with copies on both sides of the bound."""
    texts = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(104)]            # 100 shingles; the last k words differ: (100 - k) / (100 + k)
        texts += [" ".join(base), " ".join(base[:104 - k] + [f"x{g}_{i}" for i in range(k)]) if (k := 5 + g % 10) else ""]
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {i for i in range(len(texts)) if not any(near(sets[i], sets[j]) for j in range(i))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == want
    assert len(want) < len({r.doc_id for r in near_dedup.kept_rows(df).collect()})


def test_pipeline_stages_on_empty_and_extra_columns(spark, docs):
    df = docs.limit(60).withColumns({"__key": F.lit(1), "u": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and empty.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, SF).columns == df.columns


def free_distance(item, text):
    """Least edit distance of ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for x, a in enumerate(item, 1):
        new = [x]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_recall_at_every_length_of_one_block(spark):
    """Items of 7, 30, 150 and 300 words at the allowed distance, against all windows by brute force."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    items, texts, want = [], [], []
    for n, count in ((7, 120), (30, 100), (150, 24), (300, 12)):
        for _ in range(count):
            item, i = [rng.choice(vocabulary) for _ in range(n)], len(items)
            items.append((i, item))
            edited = list(item)
            for _ in range(decontaminate.allowed(n, 0.8)):
                at = rng.randrange(1, len(edited) - 1)
                rng.choice([lambda: edited.__setitem__(at, "zzz"), lambda: edited.pop(at), lambda: edited.insert(at, "qqq")])()
            texts.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + edited + [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))])
            want.append((n, i))
    index = decontaminate.Index(items, 0.8, decontaminate.RECALL)
    assert index.repeats[7] and not index.repeats[300]
    hit, met = {}, {}
    for (n, i), t, got in zip(want, texts, index.matches([" ".join(t) for t in texts]), strict=True):
        by = {k: (s, size, e) for k, s, size, e in got}
        assert set(by) <= {i}                                     # random words match nothing else
        true = free_distance(items[i][1], t)
        assert true <= decontaminate.allowed(n, 0.8)
        hit.setdefault(n, []).append(i in by)
        if i in by:
            s, size, e = by[i]
            assert edit_distance(items[i][1], t[s:s + size]) == e >= true
            met.setdefault(n, []).append(e == true)
    assert all(np.mean(v) >= 0.99 for v in hit.values()), {n: np.mean(v) for n, v in hit.items()}
    assert all(met[300]) and all(met[150])


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        seq, region = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 16))
        n_starts = int(rng.integers(1, len(region) + 1))
        best = min(edit_distance(seq.tolist(), region[s:e].tolist()) for s in range(n_starts) for e in range(s + 1, len(region) + 1))
        got = decontaminate.Index._align(region, seq, len(seq), n_starts)
        if got is None:
            assert best >= len(seq)
            continue
        d, s, size = got
        assert d == best and s < n_starts and edit_distance(seq.tolist(), region[s:s + size].tolist()) == d
