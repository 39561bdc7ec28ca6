"""Each text operator against a brute-force version, on the smallest tables and on odd rows."""

import math
import os
import random
import re
import string

import brute
import numpy as np
import pytest
from oracle_check import DATA, duck, rows_of

import corpus_pipeline
from tieline.llm import bloom_lm, common, decontaminate, language, mixing, near_duplicates, site_lines, site_quality, url_filter, warc
from tieline.llm.queries import LLM_ORACLES, LLM_QUERIES

FOLDER = f"{DATA}/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, key string, host string, component_id int, score string, `odd name` int"
LONG = " ".join(f"word{i % 997} tail{i % 13}" for i in range(60_000))
ODD = [(None, "a row without id that has some words", "en", "s"), (1, None, "en", "s"), (2, "", "de", None), (3, " \t\n\r\x0b\f ", None, "s"), (4, "one", "en", "s"), (5, "ONE", "en", "t"), (6, "one", "en", "s"),
       (6, "one", "en", "s"), (7, LONG, "en", "s"), (8, LONG + " x", "en", "s"), (9, "123 456 !!! |||", "fr", "s"), (10, "été à l'école où Ça va ÉCOLE", "fr", "s"), (11, "a b c d e f g a b c d e f g x", "en", "s"),
       (12, "same line\nsame line\nother line \n  same line", "en", "s"), (13, "\u6f22\u5b57 \u3042\u3044\u3046 \u6f22\u5b57", "ja", "s"), (14, "x\ny\nz " * 30, "en", "u")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, "k", "h", 3, "s", 4) for r in ODD], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, con, name):
    df = LLM_QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(LLM_ORACLES[name])
    assert got == rows_of([d[0] for d in rel.description], rel.fetchall())


# ---- URL filter

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM", "http://example.com/en/x", "http://www.example.com/en/x", "http://x.www.example.com/en/", "http://example.com?u=http://b.net/es/1", "http://a.net/es/", "http://a.net/es",
        "http://net/fr/1", "http://planet/fr/1", "http://notexample.com/en/", "http://exam\nple.com/en/#x", "a://b://c.com/", "http://\u00c9.com/x?y#z", "http://com/", "http://.com/"]


def test_urls_against_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(0, None, "again")]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string")).collect()}
    want = {(i, *brute.url_parts(u), *brute.url_rule(*brute.url_parts(u), url_filter.RULES)) for i, u in enumerate(URLS)}
    assert got == want


def test_url_query_and_lexical_features(spark):
    out = LLM_QUERIES["op1_url_filter"](spark, FOLDER).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert len(out) == len(pages)
    for r in out:
        host, path = brute.url_parts(pages[r.page_id])
        rule, verdict = brute.url_rule(host, path, url_filter.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)
    rows = [r for r in url_filter.lexical_features(url_filter.split_url(spark.createDataFrame([(u,) for u in URLS], "url string"))).collect()]
    for r in rows:
        u = r.url or ""
        entropy = -sum(c / len(u) * math.log2(c / len(u)) for c in map(u.count, set(u)))
        assert math.isclose(r.entropy, entropy, abs_tol=1e-9) and r.length == len(u)


def test_trees_extend_the_rules(spark):
    """Names like the blocked ones under an unruled suffix are told from names like the allowed ones."""
    rows = [(i, f"http://shop{i}{i * 7 % 100}.net/es/{i}") for i in range(150)] + [(1000 + i, f"http://{'abcdefghij'[i % 10]}park.com/{'garden' * (1 + i % 3)}") for i in range(150)]
    rows += [(5000, "http://shop77539.org/es/77"), (5001, "http://cpark.org/gardengarden")]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got[5000].verdict == "block" and got[5001].verdict == "allow"


def test_suffix_shares_are_counted_over_all_labelled_urls(spark, monkeypatch):
    """Rows with a rule beyond the training bound count for their suffix, and copies of one url do not fill the sample."""
    rules = [("good.com/", "allow"), ("bad.net/", "block"), ("late.org/", "block")]
    rows = [(i, "http://good.com/same") for i in range(300)] + [(1000 + i, f"http://n{i}.bad.net/{i}") for i in range(40)] + [(2000 + i, f"http://late.org/{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    kept = {}
    monkeypatch.setattr(url_filter, "stored", lambda d, name: kept.setdefault(name, common.stored(d, name)))
    out = url_filter.judge_urls(df, rules, train_rows=60)
    assert out.count() == len(rows)
    assert {(r.suffix, r.k, r.n) for r in kept["suffixes"].collect()} == {("com", 0.0, 300), ("net", 40.0, 40), ("org", 40.0, 40)}
    assert kept["url-sample"].count() == 60 == kept["url-sample"].select("url").distinct().count()


def test_urls_without_labels(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.judge_urls(empty).count() == 0
    one = url_filter.judge_urls(spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.com/")], "page_id bigint, url string")).collect()
    assert {r.verdict for r in one} == {"allow"}


# ---- language

def test_encoder_equals_plain_sums(monkeypatch):
    monkeypatch.setattr(language, "PIECE", 64)
    enc = language.Encoder(128, 3)
    texts = ["Hello, World  one", None, "", "123", "Été ça", "long text " * 40, "x"]
    got = enc.encode(texts)
    for text, row in zip(texts, got):
        runs = re.sub(r"\0+", "\0", "\0" + "".join(c if c.isalpha() else "\0" for c in (text or "").lower()) + "\0") if text and any(map(str.isalpha, text)) else ""
        want = sum((np.roll(enc.vector(ord(a)), 2) * np.roll(enc.vector(ord(b)), 1) * enc.vector(ord(c)) for a, b, c in zip(runs, runs[1:], runs[2:])), np.zeros(128))
        assert np.array_equal(row, want), text


def test_held_out_languages_are_found(spark):
    out = LLM_QUERIES["op2_language_id"](spark, f"{DATA}/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    assert len(out) == len(lang) and all(r.held_out == brute.held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_of_odd_rows(spark, odd):
    profiles = language.train_profiles(language.training_rows(odd))
    out = language.identify_language(odd, profiles, ["doc_id"]).collect()
    assert len(out) == len(ODD)
    texts = {r[0]: r[1] for r in ODD}
    for r in out:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or ""))) and 0 <= r.score <= 1
    kept = language.keep_languages(odd, profiles)
    assert kept.columns == odd.columns and kept.count() == sum(any(map(str.isalpha, r[1] or "")) for r in ODD)
    none = language.train_profiles(language.training_rows(odd.limit(0)))
    assert {r.lang_pred for r in language.identify_language(odd, none, ["doc_id"]).collect()} == {"und"}


# ---- lines

def test_boilerplate_lines(spark, docs, odd):
    rows = [(i, f"menu\nlegal  \nbody {i}\n\n" + ("tail" if i < 3 else ""), "en", "big" if i else None) for i in range(20)] + [(99, "menu", "en", "big"), (99, "menu", "en", "big"), (98, None, "en", "big")]
    made = spark.createDataFrame([(*r, 1, 2, "k", "h", 3, "s", 4) for r in rows], DOC)
    for df in (made, odd, docs):
        table = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        bad = brute.boilerplate([(s, t) for _, t, s in table], 0.1, 5)
        want = sorted((d is not None, d or 0, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r") not in bad[s or ""]), 0 if t is None else t.count("\n") + 1) for d, t, s in table)
        out = site_lines.drop_boilerplate(df, ratio=0.1, min_pages=5).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.n_lines) for r in out) == want if df is not odd else len(out) == len(table)
    kept = site_lines.without_boilerplate(made, ratio=0.1, min_pages=5)
    assert kept.columns == made.columns and all(r.n_chars == len(r.text) and "menu" not in r.text for r in kept.where("source IS NOT NULL").collect())
    assert site_lines.drop_boilerplate(made.limit(0)).count() == 0


@pytest.mark.parametrize("share", [6, 8, 10])
def test_boilerplate_on_a_small_share_of_pages(spark, share):
    """A line on 6 to 10 % of a host's pages goes, whatever the host's size; one on 4 % stays."""
    rows = [(i, f"own {n} {i}" + ("\nmenu" if i % 100 < share else "") + ("\nphrase" if 20 <= i % 100 < 24 else ""), f"h{n}") for n in (100, 600) for i in range(n)]
    out = site_lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert not any("menu" in r.text for r in out) and sum(r.n_dropped for r in out) == share * 7 and sum("phrase" in r.text for r in out) == 28


def test_quality_rules(spark, docs, odd):
    for df, most in ((docs, 3), (odd, 1), (odd.limit(0), 1)):
        rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
        texts = {}
        for _, t, s in rows:
            for x in (t or "").split("\n"):
                texts.setdefault((s or "", norm(x)), set()).add(t)
        want = []
        for d, t, s in rows:
            n, chars, symbols, _, repeat, bare = brute.base_counts(t)
            dup = len(bare) - len({x for x in (y for y in (t or "").split("\n")) if brute.blank_words(x)})
            gone = sum(len(brute.blank_words(x)) for x in (t or "").split("\n") if brute.blank_words(x) and len(texts[s or "", norm(x)]) > most)
            failed = n < 10 or 100 * repeat > 20 * n
            want.append((str(d), n, chars, symbols, dup, repeat, gone, failed, not failed and n - gone >= n * 0.3))
        got = [(str(r[0]), *r[1:]) for r in site_lines.quality_rules(df, max_docs=most).collect()]
        assert sorted(got) == sorted(want)


def test_line_rate_is_judged_alike_in_all_hosts(spark):
    """A line in 8 % of a host's texts goes and one in 4 % stays, in hosts of 100, 500 and 3000 texts."""
    def letters(i):
        return "".join(chr(97 + int(d)) for d in str(i))  # digits are one in normalised lines

    rows = [(i, " ".join(f"own{letters(i)}" + "abcdefghijkl"[j] for j in range(12)) + ("\nmenu home" if i % 100 < 8 else "") + ("\na short phrase" if 20 <= i % 100 < 24 else ""), f"h{n}")
            for n in (100, 500, 3000) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for n in (100, 500, 3000):
        out = site_lines.quality_rules(df.where(f"source = 'h{n}'")).collect()
        assert all(r.n_removed_words == (2 if r.doc_id % 100 < 8 else 0) and r.kept for r in out) and len(out) == n
    assert sorted(map(tuple, site_lines.quality_rules(df).collect())) == sorted(tuple(r) for n in (100, 500, 3000) for r in site_lines.quality_rules(df.where(f"source = 'h{n}'")).collect())


# ---- language model

def test_base_scores(spark, docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        held = language.is_held_out(common.F.col("doc_id"), 10, 0)
        model = bloom_lm.train_model(df.where(~held))
        want, n = brute.base_scores([r.text for r in rows], [r.text for r in rows if not brute.held_out(r.doc_id, 10, 0)])
        got = bloom_lm.score_texts(df, model, {"doc_id": common.F.col("doc_id")}).collect()
        assert model.tokens == n and len(got) == len(rows)
        key = lambda x: (str(x[0]), x[1], x[3])
        for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), sorted(((r.doc_id, *x) for r, x in zip(rows, want)), key=key)):
            assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9)
        assert all(r.score <= 0 for r in got)
    empty = bloom_lm.train_model(docs.limit(0))
    assert bloom_lm.score_texts(docs.limit(5), empty, {"doc_id": common.F.col("doc_id")}).count() == 5


def test_filter_gives_back_levels(spark):
    rng = np.random.default_rng(1)
    keys, level = rng.integers(-2 ** 62, 2 ** 62, 30_000), rng.integers(1, 9, 30_000)
    df = spark.createDataFrame(list(zip(keys.tolist(), level.tolist())), "k bigint, level int")
    chunks = -(-int(level.sum()) * bloom_lm.BITS_PER_ENTRY // bloom_lm.CHUNK_BITS)
    bits = np.frombuffer(bloom_lm.build_filter(df, chunks), np.uint8)
    found = bloom_lm.probe_levels(keys.view(np.uint64), bits, chunks)
    assert (found >= level).all() and (found == level).mean() > 0.97
    other = bloom_lm.probe_levels(rng.integers(0, 2 ** 62, 30_000).view(np.uint64), bits, chunks)
    assert (other > 0).mean() < 0.03


def test_model_prefers_seen_order(spark):
    text = "the old cat sat on the red mat and the old dog sat on the blue rug " * 50
    df = spark.createDataFrame([(i, text) for i in range(20)], "doc_id bigint, text string")
    model = bloom_lm.train_model(df)
    made = spark.createDataFrame([(1, "the old cat sat on the red mat"), (2, "mat red the on sat cat old the"), (3, "zzz qqq xxx yyy kkk jjj vvv www")], "doc_id bigint, text string")
    s = {r.doc_id: r.score for r in bloom_lm.score_texts(made, model, {"doc_id": common.F.col("doc_id")}).collect()}
    assert s[1] > s[2] > s[3]


def test_every_pair_counts(spark, monkeypatch):
    """A pair of words seen twice in a large corpus raises the score, by the broadcast filter and by the joined chunks."""
    filler = [" ".join(f"w{(i * 7919 + j * j) % 5003}" for j in range(3000)) for i in range(60)]
    table = [(i, t + (" rareone raretwo rarethree" if i in (3, 40) else "")) for i, t in enumerate(filler)]
    train = spark.createDataFrame(table, "doc_id bigint, text string")
    made = spark.createDataFrame([(1, "rareone raretwo rarethree"), (2, "raretwo rareone rarethree"), (3, None), (4, "zzz rareone")], "doc_id bigint, text string")
    words = [["", *(t.split()), ""] for _, t in table]
    pairs = {p for w in words for p in zip(w, w[1:])}
    results = []
    for most in (bloom_lm.BROADCAST_CHUNKS, 0):
        monkeypatch.setattr(bloom_lm, "BROADCAST_CHUNKS", most)
        model = bloom_lm.train_model(train)
        assert (model.slices is None) == (most > 0)
        out = {r.doc_id: r for r in bloom_lm.score_texts(made, model, {"doc_id": common.F.col("doc_id")}).collect()}
        assert len(out) == 4 and out[1].base_score == pytest.approx(out[2].base_score) and out[1].score > out[2].score + 4
        results.append({d: r.score for d, r in out.items()})
    assert results[0] == pytest.approx(results[1])
    found = bloom_lm.count_pairs(train.selectExpr("cast(text as binary)"), 3)
    assert sum(sum(r.n) for r in found.collect()) == len(pairs) and sum(sum(r.total) for r in found.collect()) == model.tokens


def test_filter_larger_than_a_broadcast(spark, monkeypatch):
    """Mapped from one file, or read slab by slab, the filter gives the same scores; each of its chunks moves once, not once for
    each group of texts that asks it."""
    table = [(i, " ".join(f"w{(i * 7919 + j * j) % 50021}" for j in range(2500))) for i in range(130)] + [(500, None), (501, " "), (None, "w1 w4 unseen")]
    df = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    train = df.where("doc_id < 100")
    moved, results = [], []
    monkeypatch.setattr(bloom_lm, "spread", lambda d, *k, old=bloom_lm.spread: moved.append(d) or old(d, *k), raising=False)
    monkeypatch.setattr(bloom_lm, "SLAB", 1)
    for most, mapped in ((1024, 1024), (0, 1024), (0, 0)):
        monkeypatch.setattr(bloom_lm, "BROADCAST_CHUNKS", most)
        monkeypatch.setattr(bloom_lm, "MAPPED_CHUNKS", mapped)
        model = bloom_lm.train_model(train)
        file, chunks = model.shared.value["file"], model.shared.value["chunks"]
        assert chunks > 2 and (file is not None) == (mapped > most) and (file is None or os.path.getsize(file) == chunks * bloom_lm.CHUNK_BITS // 8)
        out = bloom_lm.score_texts(df, model, {"doc_id": common.F.col("doc_id")}).collect()
        results.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in out})
        assert len(out) == len(table) and len(moved) == (most == mapped == 0)
    for other in results[1:]:
        assert other.keys() == results[0].keys() and all(other[d] == pytest.approx(r) for d, r in results[0].items())
    assert moved[0].where("_group < 0").count() == model.shared.value["chunks"] and moved[0].where("_group >= 0").count() > 2


# ---- near duplicates

@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, words):
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("doc_id < 600")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute.components(rows, words)
    got = near_duplicates.near_duplicates(df, shingle_words=words).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(brute.shingles(t, words)) for d, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_and_mixed_bands(spark, odd):
    """Chains (only neighbours are similar), a hub of many copies, short texts around the limit, odd rows."""
    words = [f"w{i}" for i in range(700)]
    rows = [(100 + i, " ".join(words[i * 10:i * 10 + 200])) for i in range(30)]
    rows += [(300 + i, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".replace("mu", ["mu", "nu"][i % 2])) for i in range(40)]
    rows += [(400 + i, " ".join(["p", "q", "r", "s", "t", "u", "v"][:k])) for i, k in enumerate([1, 2, 3, 4, 5, 6, 7, 5, 6])]
    made = spark.createDataFrame([(d, t, "en", "s", 1, 2, "k", "h", 3, "s", 4) for d, t in rows], DOC)
    for df in (made, odd, odd.limit(0)):
        for k in (2, 5):
            table = [tuple(r) for r in df.select("doc_id", "text").collect()]
            want = brute.components(table, k)
            got = near_duplicates.near_duplicates(df, shingle_words=k).collect()
            assert len(got) == len(table) and {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    kept = near_duplicates.keep_one_of_each(odd)
    want = [d for d, c in brute.components([r[:2] for r in ODD], 5).items() if d == c]
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_rows_that_repeat_an_id_keep_the_links_of_each(spark):
    """Both texts of one doc_id are linked with their own family, also where only the second search finds the link."""
    rng = random.Random(4)
    def family(seed, n, size=120):
        base = [f"{seed}{i}" for i in range(size)]
        return [" ".join(w if j != 7 * k % size else f"x{seed}{k}" for j, w in enumerate(base)) for k in range(n)]
    rows = []
    for f in range(12):
        one, two = family(f"a{f}_", 6), family(f"b{f}_", 6)
        ids = list(range(100 * f, 100 * f + 11))
        rng.shuffle(ids)
        rows += list(zip(ids, one + two[:5])) + [(ids[0], two[5]), (ids[1], one[1]), (ids[2], "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k in (2, 5):
        got = near_duplicates.near_duplicates(df, shingle_words=k).collect()
        assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == brute.components(rows, k)
        links = {(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if a != b and (s := brute.shingles(x, k)) and (t := brute.shingles(y, k)) and 100 * len(s & t) >= 80 * len(s | t)}
        assert sum(r.n_links for r in {r.doc_id: r for r in got}.values()) <= 2 * len({tuple(sorted(p)) for p in links})


def test_components_of_long_chain_and_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    seeds = common.mix(np.arange(1, 201, dtype=np.uint64))
    a = rng.integers(0, 2 ** 64, 2000, np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2 ** 64, 400, np.uint64)])
    x, y = near_duplicates.register_set(a, seeds)[0], near_duplicates.register_set(b, seeds)[0]
    assert abs((x == y).mean() - 1600 / 2400) < 0.12


# ---- decontamination

def test_contamination(spark, docs, odd):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    made_items = spark.createDataFrame([(1, "a b c d e f g a b c"), (2, "one"), (3, None), (4, ""), (5, "same line same"), (None, "one"), (6, "Word1 tail1 word2 TAIL2 word3 tail3 word4 tail4 word5 tail5 word6"), (7, "\u6f22\u5b57"), (8, "one")], "item_id bigint, text string")
    for df, bench in ((docs, items), (odd, made_items), (odd.limit(0), made_items), (odd, made_items.limit(0))):
        bench_rows = [tuple(r) for r in bench.select("item_id", "text").collect()]
        want = sorted((str(r.doc_id), *map(str, brute.contamination(r.text, bench_rows))) for r in df.select("doc_id", "text").collect())
        got = decontaminate.contamination(df, bench).collect()
        assert sorted((str(r.doc_id), str(r.n_words), str(r.n_hit), str(r["items"])) for r in got) == want
        clean = decontaminate.drop_contaminated(df, bench)
        assert clean.columns == df.columns and clean.count() == sum(w[2] == "0" for w in want)


# ---- WARC

def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "x" * 5000 + "\u00e9" * 300), (2, None, None), (3, "http://b\r\nX: 1", ""), (4, "u", "x" * 5000 + "\u00e9" * 300), (5, "u", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (5, "u", "other html"),
             (6, "u", "\u6f22" * 999), (7, "u", "same"), (8, "u", "same"), (8, "u", "same"), (7, "other", "same"), (7, None, "same"), (9, "u", "x" * 600), (9, "u", "x" * 600),
             (None, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, digest string")
    for small, name in ((0, "all"), (100, "large")):
        warc.write_archives(df, f"{tmp_path}/{name}", min_bytes=small, chunk_chars=256)
        got = warc.read_records(spark, f"{tmp_path}/{name}").collect()
        rows = [(p[0], (p[2] or "").encode()) for p in pages]
        want, met = [], set()
        for d, body in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            first = min((x for x, b in rows if b == body and x is not None), default=None)
            again = len(body) >= small and body in met
            met.add(body)
            want.append((str(d), len(body), brute.digest(body), "revisit" if again else "response", str(first if again else None)))
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want) and all(r.intact for r in got)
    ids = [r.record_id for r in warc.chunk_rows(df).where("chunk_no = 1").collect()]
    assert len(set(ids)) == len(ids) == len(pages)
    urls = [r.value for r in spark.read.text(f"{tmp_path}/all").where("value LIKE 'WARC-Target-URI: other'").collect()]
    assert len(urls) == 1
    assert warc.read_chunks(spark, f"{tmp_path}/all").where("chunk_no > 10").count() > 0
    warc.write_archives(df.limit(0), f"{tmp_path}/none")
    assert warc.read_records(spark, f"{tmp_path}/none").count() == 0


def test_warc_query(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in LLM_QUERIES["op9_warc"](spark, FOLDER).collect()}
    assert got == {p.page_id: (len((p.html or "").encode()), brute.digest((p.html or "").encode())) for p in pages}


# ---- mixing and quality

def test_raking_fits_its_targets(spark, odd):
    cells = spark.createDataFrame([(a, b, c, 10 * (i + 1)) for i, (a, b, c) in enumerate((a, b, c) for a in "xy" for b in "pq" for c in "mn")], "source string, lang string, topic string, tokens bigint")
    goal = {"source": [("x", 0.7), ("y", 0.3)], "lang": [("p", 0.5), ("q", 0.5)], "topic": [("m", 0.2), ("n", 0.8)]}
    raked = mixing.rake(cells, {m: spark.createDataFrame(g, f"{m} string, share double") for m, g in goal.items()}, rounds=20).collect()
    for m, g in goal.items():
        for v, share in g:
            assert math.isclose(sum(r.weight for r in raked if r[m] == v) / 360, share, rel_tol=1e-6)
    out = mixing.mix_sources(odd)
    assert out.count() == len(ODD) and all(0 <= r.probability <= 1 for r in out.collect()) and mixing.mix_sources(odd.limit(0)).count() == 0


def test_sample_has_the_wanted_size(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    r = mixing.mix_sources(df).selectExpr("sum(n_tokens * probability) / sum(n_tokens)", "sum(CASE WHEN sampled THEN n_tokens END) / sum(n_tokens)").first()
    assert abs(r[0] - 0.5) < 0.01 and abs(r[1] - 0.5) < 0.1


def test_quality_scores_on_held_out_labels(spark, odd):
    folder = f"{DATA}/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = {r.doc_id: r for r in site_quality.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
    held = [(out[r.doc_id].kept, r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert sum(k == (q == 1) for k, q in held) > 0.93 * len(held)
    few = spark.createDataFrame([(4, 1), (4, 0), (7, 1), (9, 0), (11, None), (12, 5), (None, 1)], "doc_id bigint, quality int")
    assert site_quality.quality_scores(odd, few).count() == len(ODD)
    assert {r.path_rate for r in site_quality.quality_scores(odd, few.limit(0)).collect()} == {0.5}
    assert site_quality.quality_scores(odd.limit(0), few).count() == 0


def test_sparse_sites_shrink_toward_the_prior(spark):
    rows = [(i, "x", "a", int(i % 10 > 0)) for i in range(400)] + [(i, "y", "a", int(i % 10 == 0)) for i in range(400)] + [(1, "z", "a", 0)]
    prior, sites = site_quality.site_posteriors(spark.createDataFrame([r[1:] for r in rows], "host string, path string, good int"))
    s = {r.host: r.host_rate for r in sites.collect()}
    assert abs(s["x"] - 0.9) < 0.02 and abs(s["y"] - 0.1) < 0.02 and 0.1 < s["z"] < prior


# ---- pipeline

def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "lines", "near_duplicates", "benchmark", "mix"]
    first = steps["language"](spark, docs, FOLDER)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    second = steps["lines"](spark, first, FOLDER)
    table = first.collect()
    bad = brute.boilerplate([(r.source, r.text) for r in table], site_lines.RATIO, site_lines.MIN_PAGES)
    cut = {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(" \t\n\x0b\f\r") not in bad[r.source]) for r in table}
    assert {r.doc_id: r.text for r in second.collect()} == {d: t for d, t in cut.items() if brute.blank_words(t)}
    third = steps["near_duplicates"](spark, second, FOLDER)
    parts = brute.components([(r.doc_id, r.text) for r in second.collect()], 5)
    assert sorted(r.doc_id for r in third.collect()) == sorted({c for c in parts.values()})
    fourth = steps["benchmark"](spark, third, FOLDER)
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(r.doc_id for r in fourth.collect()) == sorted(r.doc_id for r in third.collect() if not brute.contamination(r.text, items)[1])
    last = steps["mix"](spark, fourth, FOLDER)
    assert last.columns == docs.columns and {r.doc_id for r in last.collect()} <= {r.doc_id for r in fourth.collect()}
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, last.collect()))


def test_stages_take_odd_and_empty_tables(spark, odd, tmp_path):
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, FOLDER).columns == df.columns
            stage(spark, df, FOLDER).write.format("noop").mode("overwrite").save()


def test_letters():
    assert string.ascii_uppercase == common.UPPER and string.ascii_lowercase == common.LOWER
