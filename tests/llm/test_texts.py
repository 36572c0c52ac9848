"""Encoding (p8), leaks (p9) and text quality (p10) against the libraries and brute force."""

import os
import random

import numpy as np
import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronodoc.llm import encoding, leakage, quality, textscan
from pyspark.sql import functions as F

VOCAB = os.path.join(encoding.DEFAULT_DIR, encoding.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")
TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")
PIECES = ["a", "b", "'s", "'", "t", "re", " ", "  ", "\n", "\t", "é", "1", "23", "!", "?", "'ll", "don't", "\xa0", "　", "世", "界", "é", "ſ", "<|endoftext|>", "İ", "​", "🙂", "\x1c"]


@pytest.fixture(scope="module")
def enc():
    with open(VOCAB, "rb") as f:
        return encoding.TreeEncoder(f.read())


def as_lists(flat, counts):
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), min_size=1, max_size=5))
def test_blocks_equal_the_library(enc, texts):
    assert as_lists(*enc.encode(texts)) == [enc.own.encode_ordinary(t) for t in texts]


@needs_vocabulary
@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_text(enc, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert as_lists(*enc.encode(texts)) == [enc.own.encode_ordinary(t) for t in texts]


@needs_vocabulary
@settings(max_examples=100, deadline=None)
@given(st.sampled_from(["ab", "aeh", "=", "的世界", "thingesr", "0", "é́"]), st.integers(1, 700), st.integers(0, 999))
def test_tree_of_halves(enc, letters, n, seed):
    text = "".join(random.Random(seed).choices(letters, k=n)).encode()
    before, encoding.HALVE = encoding.HALVE, 16
    try:
        assert enc.tree(text) == enc.piece(text)
    finally:
        encoding.HALVE = before


@pytest.fixture
def short_halves():
    before, encoding.HALVE = encoding.HALVE, 12
    yield
    encoding.HALVE = before


@needs_vocabulary
@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([PIECES, ["a", "b"], [" "], ["世", "界", " "], ["="], ["\n", " "], ["'", "s", "t"], ["a", "1", "!"]]), st.integers(0, 300)), min_size=1, max_size=4), st.integers(0, 999))
def test_trees_of_texts(enc, short_halves, kinds, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(pieces, k=n)) for pieces, n in kinds]
    assert all("".join(enc.halves(t)) == t for t in texts if t)
    assert as_lists(*enc.encode(texts)) == [enc.own.encode_ordinary(t) for t in texts]


@needs_vocabulary
@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=200), min_size=1, max_size=4))
def test_trees_of_any_text(enc, short_halves, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert as_lists(*enc.encode(texts)) == [enc.own.encode_ordinary(t) for t in texts]


@needs_vocabulary
def test_classes_unknown_to_python(enc):
    new = np.flatnonzero(textscan.unassigned())
    some = [chr(c) for c in new[:: len(new) // 4000] if not 0xD800 <= c < 0xE000]
    texts = [f"ab{c}cd {c}12{c} !{c}{c}" for c in some] + ["".join(some)]
    assert as_lists(*enc.encode(texts)) == [enc.own.encode_ordinary(t) for t in texts]


@needs_vocabulary
def test_two_pieces_of_one_hash(enc, monkeypatch):
    monkeypatch.setattr(encoding, "span_hashes", lambda cp, starts, ends: (starts % 3).astype(np.uint64))
    texts = ["one two three one", "", "four 5 six"]
    assert as_lists(*enc.encode(texts)) == [enc.own.encode_ordinary(t) for t in texts]


@needs_vocabulary
def test_encode_documents(spark, enc):
    texts = [None, "", "Hello world", "x" * 90_000, "lorem ipsum " * 2000, "Hello world", "世界" * 3000, "\n" * 5000, "a1" * 3000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(2, "Hello world", 0)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in encoding.encode_documents(df).collect())
    assert got == sorted([(i, enc.own.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(2, enc.own.encode_ordinary("Hello world"))])
    figures = encoding.encode_documents(df.coalesce(1), report=True).agg(F.sum("joins"), F.count("ids")).first()
    assert figures[0] > 40 and figures[1] == len(texts) + 1
    assert encoding.encode_documents(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), min_size=1, max_size=4))
def test_scanned_terms(texts):
    s = textscan.scan_terms(texts)
    joined = "\n".join(t.lower() for t in texts)
    for i, t in enumerate(texts):
        own = slice(s.bounds[i], s.bounds[i + 1])
        words = TERM.findall(t.lower())
        assert [joined[a:b] for a, b in zip(s.starts[own], s.ends[own], strict=True)] == words
        if words:
            assert np.array_equal(s.hashes[own], textscan.hash_terms(words))


def brute_overlaps(docs, items, run=13):
    out = []
    for d, text in docs:
        w = TERM.findall((text or "").lower())
        for i, item in items:
            m = TERM.findall((item or "").lower())
            n, best = min(run, len(m)), (0, 0, 0)
            before = {}
            for x, word in enumerate(w):
                now = {y: before.get(y - 1, 0) + 1 for y, other in enumerate(m) if other == word}
                best = min([best, *((-k, x - k + 1, y - k + 1) for y, k in now.items())])
                before = now
            if n and -best[0] >= n:
                out.append((d, i, -best[0], best[1], best[2]))
    return sorted(out)


def brute_leaks(docs, items, run=13):
    out = set()
    for d, text in docs:
        w = TERM.findall((text or "").lower())
        for i, item in items:
            m = TERM.findall((item or "").lower())
            n = min(run, len(m))
            if n and any(w[a : a + n] == m[b : b + n] for b in range(len(m) - n + 1) for a in range(len(w) - n + 1)):
                out.add((d, i))
    return sorted(out)


def test_leaks(spark, rows):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "?!"), (103, items[5][1]), (104, "lonely"), (105, "the the the the the the the the the the the the the the")]
    docs = []
    for i in range(120):
        body = rng.choices(words, k=rng.randrange(0, 400))
        if i % 3 == 0:
            source = rng.choice(items[:40])[1].split()
            a = rng.randrange(len(source))
            body[len(body) // 2 : len(body) // 2] = source[a : a + rng.choice([5, 12, 13, 14, 40])]
        docs.append((i, ", ".join(body).upper() if i % 2 else "\n".join(body)))
    docs += [(200, None), (201, ""), (202, "a lonely word"), (203, "the " * 5000), (204, "x " * 90 + items[7][1] + " y" * 3)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(*x, "c") for x in items], "item_id long, item_text string, text string")
    assert rows(leakage.leaked_items(d, e)) == brute_leaks(docs, items)
    short = [x for x in docs if x[0] != 203]  # the slow brute force leaves out the long one
    assert rows(leakage.overlaps(d.where("doc_id <> 203"), e)) == brute_overlaps(short, items)
    assert leakage.leaked_items(d, e.limit(0)).count() == 0 and leakage.leaked_items(d.limit(0), e).count() == 0


@pytest.mark.parametrize("limit", [leakage.INDEX_BYTES, 1])
def test_leaks_over_several_indexes(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(leakage, "ITEMS_PER_INDEX", 2)
    monkeypatch.setattr(leakage, "INDEX_BYTES", limit)  # with 1 every index takes a scan of its own
    items = [(i, " ".join(f"t{i}_{j}".replace("_", "x") for j in range(15))) for i in range(5)] + [(9, "some"), (9, "other words here")]
    docs = [(i, "some words " + items[i][1] + " more") for i in range(5)] + [(7, "other words here")]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    assert sorted(set(rows(got))) == sorted([(i, i) for i in range(5)] + [(i, 9) for i in range(5)] + [(7, 9)])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_wand_finds_all_above_the_bar(seed):
    rng = random.Random(seed)
    ix = leakage.ItemIndex([(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(3, 30))]) for i in range(25)], 4, 2)
    words = sorted(rng.sample(range(len(ix.hashes)), min(len(ix.hashes), rng.randrange(1, 30))))
    score = {}
    for w in words:
        for at in range(ix.start[w], ix.start[w + 1]):
            score[ix.slot[at]] = score.get(ix.slot[at], 0) + ix.weight[at]
    assert sorted(ix.search(words)) == sorted(i for i, s in score.items() if s >= leakage.SLACK)


def brute_counts(text, common):
    words = TERM.findall(text.lower())
    ink = [c for c in text if c not in " \t\r\n"]
    lines = [x for x in (y.strip(" \t\r") for y in text.split("\n")) if x]
    return (len(words), sum(map(len, words)), len(ink), sum(not TERM.fullmatch(c) for c in ink), len(lines), sum(x[-1] in quality.LINE_ENDS for x in lines), sum(w in common for w in words))


COMMON = ["the", "of", "und", "la", "a"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, ". ", ".\n", "the ", "\r\n", "。\n"]), max_size=25).map("".join), min_size=1, max_size=4))
def test_counts(texts):
    got = quality.scan_statistics(texts, np.sort(textscan.hash_terms(COMMON)))
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("words", "word_chars", "ink", "symbols", "lines", "ended", "common")) == brute_counts(t, COMMON)


def brute_failed(docs):
    out = []
    for d, text in docs:
        if text is None:
            continue
        w, c, ink, sym, lines, ended, com = brute_counts(text, COMMON)
        out += [(d, "few_words")] * (w < 40)
        if w:
            out += [(d, "word_length")] * (c / w < 3.5 or c / w > 9) + [(d, "symbols")] * (sym / ink > 0.15)
            out += [(d, "line_ends")] * (ended / lines < 0.3) + [(d, "common_words")] * (com / w < 0.15)
    return sorted(out)


def quality_corpus(spark):
    rng = random.Random(2)
    docs, langs = [], []
    for i in range(300):
        kind = rng.random()
        body = [rng.choice(["the", "of", "valve", "pressure", "device", "large", "a", "member"]) for _ in range(rng.randrange(30, 120))]
        if kind < 0.7:
            text = ". ".join(" ".join(body[a : a + 9]) for a in range(0, len(body), 9)) + "."
        elif kind < 0.8:
            text = "\n".join(f"{x}\t{rng.randrange(999)}" for x in body)
        else:
            text = "".join(rng.choice("ab=|+ \n.1") for _ in range(400))
        docs.append((i, text))
        langs.append(rng.choice(["en", "EN", "en-US", " de", None, "", "zz9"]))
    docs += [(900, None), (901, ""), (902, "..."), (903, "the " * 20000), (904, "\n\n")]
    return docs, spark.createDataFrame([(d, t, (langs + ["en"] * 5)[k], 7) for k, (d, t) in enumerate(docs)], "doc_id long, text string, lang string, words int"), spark.createDataFrame([("en", w) for w in COMMON] + [("x", None), ("en", "the")], "lang string, word string")


def test_quality(spark, rows):
    docs, df, common = quality_corpus(spark)
    q = quality.text_quality(df, common).cache()
    assert rows(quality.failed_checks(q)) == brute_failed(docs)
    assert q.count() == len(docs) - 1
    for r in q.where("words > 0").collect():
        assert sum(r["contributions"]) == pytest.approx(r["distance"], rel=1e-6, abs=1e-6)
    prose = q.where("words > 0 and distance < bound")
    assert prose.count() > 0  # the screen does pass over something
    assert quality.failed_checks(quality.text_quality(df.limit(0), common)).count() == 0
    assert rows(quality.failed_checks(quality.text_quality(df, common.limit(0)))) == sorted({(d, c) for d, c in brute_failed(docs) if c != "common_words"} | {(d, "common_words") for d, t in docs if t and TERM.search(t)})


def test_models_resist_junk(spark):
    rng = np.random.default_rng(0)
    prose = [(float(np.log1p(200 + 20 * rng.normal())), 5 + 0.3 * rng.normal(), 0.04 + 0.01 * rng.normal(), 0.9 + 0.05 * rng.normal(), 0.4 + 0.03 * rng.normal()) for _ in range(400)]
    junk = [(1.0, 2.0, 0.6, 0.0, 0.0)] * 150
    df = spark.createDataFrame([("en", 10, *map(float, x)) for x in prose + junk], "lang string, words long, " + ", ".join(f"{s} double" for s in quality.STATS))
    model = {r["lang"]: r for r in quality.prose_models(df).collect()}["en"]
    assert np.allclose(model["mu"], np.mean(prose, axis=0), rtol=0.05)


def test_consistency_factor():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400_000, 5))
    core = x[(x**2).sum(1) <= quality.CORE]
    assert len(core) / len(x) == pytest.approx(0.975, abs=2e-3)
    assert core.var(0).mean() * quality._consistency(5, quality.CORE, 0.975) == pytest.approx(1.0, abs=5e-3)


def test_screening_bound_is_the_least_distance():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(5, 5))
    cov = a @ a.T + np.eye(5)
    mu = np.array([5.3, 5.0, 0.05, 0.9, 0.5])
    bound, p = quality.screening_bound(mu, cov), np.linalg.inv(cov)
    for _ in range(2000):
        x = mu + 3 * rng.normal(size=5)
        fails = any(sign * (x[quality.STATS.index(s)] - t) > 0 for _, s, sign, t in quality.CHECKS)
        if fails:
            assert (x - mu) @ p @ (x - mu) >= bound
