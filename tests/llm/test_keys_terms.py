"""Seen keys (p1), term statistics (p4), enrichment (p7) against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronodoc.llm import cuckoo, enrichment, termstats
from pyspark.sql import functions as F


def hashes(n, seed=0):
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64, endpoint=False)


def test_cuckoo_never_forgets_and_rarely_errs():
    h = hashes(60_000)
    t = cuckoo.CuckooTable(1000)  # far too small: grows on saturation
    for a in range(0, len(h), 7000):
        t.insert_many(h[a : a + 7000])
        assert t.contains_many(h[: a + 7000]).all()
    assert len(t.tables) > 1 and len(t) == len(h)
    assert t.contains_many(hashes(100_000, 1)).mean() < 2e-3


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 900))
def test_cuckoo_delete(seed, n):
    h = hashes(n, seed)
    t = cuckoo.CuckooTable(16)
    for a in range(0, n, 60):  # a chain of several sizes
        t.insert_many(h[a : a + 60])
    gone, kept = h[: n // 2], h[n // 2 :]
    done = t.delete_many(gone)
    assert t.contains_many(kept).all() and len(t) == n - done.sum()
    assert n < 20 or done.mean() > 0.8  # only matches in tables of two sizes are left alone


def test_deleting_never_takes_a_twin_of_another_table():
    t = cuckoo.CuckooTable(16)
    t._grow(400)
    small, large = t.tables
    low = np.array([(3 << 16) | 77], np.uint64)
    high = np.array([((3 + len(small)) << 16) | 77], np.uint64)  # same fingerprint and first bucket in the small table
    one = np.array([77], np.uint16)
    t._settle(small, np.array([3]), one)
    t._settle(large, np.array([3 + len(small)]), one)
    assert not t.delete_many(high)[0]  # either could be the only copy of the other key
    assert t.contains_many(low)[0] and t.contains_many(high)[0]


def test_cuckoo_full_of_one_fingerprint():
    t = cuckoo.CuckooTable(64)
    same = np.full(50, 12345, np.uint64)
    t.insert_many(same)
    assert t.contains_many(same).all() and len(t) == 50
    done = t.delete_many(same)
    assert len(t) == 50 - done.sum() and t.contains_many(same[:1])[0] == (not done.all())


def test_cuckoo_dump_and_load():
    h = hashes(3000)
    t = cuckoo.CuckooTable(100)
    t.insert_many(h[:2000])
    t = cuckoo.CuckooTable.load(t.dump())
    t.insert_many(h[2000:])
    assert t.contains_many(h).all() and len(t) == 3000


def brute_seen(entries, arrivals):
    seen, out = {e for e in entries if e is not None}, []
    for no, raw in sorted(arrivals):
        if raw is not None:
            if raw in seen:
                out.append((no,))
            seen.add(raw)
    return sorted(out)


@pytest.mark.parametrize("first_size", [None, 4])
def test_judged_arrivals(spark, rows, tmp_path, first_size):
    rng = random.Random(1)
    entries = [rng.choice([None, b"", b"hot", bytes([rng.randrange(200)])]) for _ in range(300)]
    arrivals = [(i, rng.choice([None, b"hot", b"warm", b"warm", bytes([rng.randrange(256), 0]), bytes([rng.randrange(256)]), b""])) for i in range(1500)]
    rng.shuffle(arrivals)
    e = spark.createDataFrame([(x, 1) for x in entries], "raw binary, arrival_no int")  # a clashing column
    a = spark.createDataFrame([(n, r, "x") for n, r in arrivals], "arrival_no long, raw binary, h string")
    seen, counts, rates = cuckoo.judge_arrivals(e, a, path=f"file://{tmp_path}/k", first_size=first_size)
    assert rows(seen) == brute_seen(entries, arrivals)
    c, r = counts.first(), rates.first()
    assert c["judged"] + c["not_judged"] == 1500 and r["false_maybe"] <= c["new_keys"] and 0 <= r["wrong_rate"] <= 0.05
    assert c["judged"] - c["new_keys"] == len(rows(seen))
    distinct = {x for x in entries if x is not None} | {x for _, x in arrivals if x is not None}
    assert r["stored"] + r["false_maybe"] >= len(distinct) and (r["tables"] > r["parts"]) == (first_size is not None)


def test_false_alarms_of_short_fingerprints(spark, rows, tmp_path):
    """Fingerprints of three bits: many 'maybe' verdicts are wrong, the rows stay right."""
    e = [bytes([i]) for i in range(100)]
    arrivals = [(i, bytes([i % 200, i % 3])) for i in range(700)]
    df = spark.createDataFrame(arrivals, "arrival_no long, raw binary")
    seen, _, rates = cuckoo.judge_arrivals(spark.createDataFrame([(x,) for x in e], "raw binary"), df, path=f"file://{tmp_path}/k", first_size=4, bits=3)
    assert rows(seen) == brute_seen(e, arrivals) and rates.first()["wrong_rate"] > 0.3


def test_tables_are_kept_between_runs(spark, rows, tmp_path):
    tables = cuckoo.KeyTables(spark, f"file://{tmp_path}/k", 1000)
    frame = lambda xs: spark.createDataFrame([(int(x),) for x in xs], "h long")
    asked = lambda xs: spark.createDataFrame([(i, int(x)) for i, x in enumerate(xs)], "arrival_no long, h long")
    h = hashes(400, 3).view(np.int64)
    tables.run(insert=frame(h[:200]))
    again = cuckoo.KeyTables(spark, f"file://{tmp_path}/k", 5)
    got = dict(rows(again.run(arrivals=asked(h[100:300]))))
    assert all(got[i] for i in range(100)) and sum(got.values()) <= 102
    again.owe(frame(h[300:310]))
    got = dict(rows(again.run(delete=frame(h[:50]), arrivals=asked(h))))
    assert sum(got[i] for i in range(50)) <= 1 and all(got[i] for i in range(50, 310))
    assert again.figures().first()["stored"] >= 398


def test_judging_after_deletion(spark, rows, tmp_path):
    e = spark.createDataFrame([("s", "old", b"a"), ("s", "old", b"b"), ("s", "new", b"b"), ("s", "new", None)], "store string, table_id string, raw binary")
    live = spark.createDataFrame([("s", "new")], "store string, table_id string")
    a = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"a"), (4, None)], "arrival_no long, raw binary")
    assert rows(cuckoo.judge_after_merge(e, live, a, path=f"file://{tmp_path}/k")) == [(2,), (3,)]


def test_judging_empty_tables(spark, rows):
    e = spark.createDataFrame([], "raw binary")
    a = spark.createDataFrame([(2, b"k"), (1, b"k")], "arrival_no long, raw binary")
    assert rows(cuckoo.judge_arrivals(e, a)[0]) == [(2,)]
    seen, counts, rates = cuckoo.judge_arrivals(e, a.limit(0))
    assert seen.count() == 0 and counts.first()["new_keys"] == 0 and rates.first()["wrong_rate"] == 0.0


DOCS = "id long, text string, sequence long, tag string"


def corpus(spark):
    words = ["the", "of", "Rare", "größe", "x1", "don't", "éa", "mid"]
    rng = random.Random(5)
    data = []
    for i in range(60):
        text = " ".join(rng.choices(words, [30, 20, 1, 2, 3, 2, 1, 4], k=rng.randrange(0, 25)))
        data += [(i, text, i, "t"), (i, "older text of id", i - 1000, "t")]
    data += [(100, None, 5, None), (101, "", 5, None), (102, " .,! ", 5, None), (103, "the " * 5000, 7, None), (103, "the " * 5000, 7, None), (104, "seen", 1, None), (104, None, 2, None), (None, "null id", 1, None)]
    return spark.createDataFrame(data, DOCS).withColumn("term", F.lit("clash")).withColumn("f", F.lit(0)), data


def brute_counts(data):
    cur = {}
    for i, text, s, _ in data:
        if i not in cur or s > cur[i][0]:
            cur[i] = (s, text)
    import regex

    return {i: Counter(regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower())) for i, (_, t) in cur.items() if t is not None}


def test_marked_terms(spark):
    df, data = corpus(spark)
    counts = brute_counts(data)
    occ, rec = Counter(), Counter()
    for c in counts.values():
        occ.update(c)
        rec.update(c.keys())
    want = {t: (occ[t], rec[t], "rare" if occ[t] < 5 or rec[t] < 3 else "common" if rec[t] * 5 > len(counts) else None) for t in occ}
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in termstats.marked_terms(df).collect()}
    assert got == want
    assert termstats.marked_terms(df.limit(0)).count() == 0


def test_index_drift(spark):
    docs = spark.createDataFrame([(1, "a b b", 1, None)], DOCS)
    held = spark.createDataFrame([("a", {"1": 1}), ("b", {"1": 1}), ("z", {"9": 2, "8": None}), ("n", None)], "term string, postings map<string,int>")
    got = {r["term"]: (r["occurrences"], r["index_occurrences"]) for r in termstats.index_drift(docs, held).collect()}
    assert got == {"b": (2, 1), "z": (0, 2)}


def exact_surprise(f, n, k, t):
    tail = sum(math.comb(k, x) * math.comb(t - k, n - x) for x in range(f, min(n, k) + 1) if n - x <= t - k)
    return math.log(math.comb(t, n)) - math.log(tail)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 400), st.integers(0, 400), st.integers(0, 400))
def test_upper_tail(t, a, b, c):
    n, k = min(a, t), min(b, t)
    f = min(c, n, k)
    got = enrichment.upper_tail(*(np.array([v]) for v in (f, n, k, t)))[0]
    assert got == pytest.approx(exact_surprise(f, n, k, t), rel=1e-9, abs=1e-9)


def test_log_gamma():
    x = np.array([1, 2, 5, 1023, 1024, 10**6, 10**12])
    assert np.allclose(enrichment.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13)


@pytest.mark.parametrize("floor", [enrichment.HOT_FLOOR, 3.0])
def test_enrichment(spark, monkeypatch, floor):
    monkeypatch.setattr(enrichment, "HOT_FLOOR", floor)  # with 3 the frequent terms go the way of hot ones
    df, data = corpus(spark)
    counts = brute_counts(data)
    occ, rec = Counter(), Counter()
    for c in counts.values():
        occ.update(c)
        rec.update(c.keys())
    t = sum(occ.values())
    out = enrichment.term_enrichment(df)
    got = {(r["id"], r["term"]): r for r in out.collect()}
    assert set(got) == {(i, w) for i, c in counts.items() for w in c}
    by = defaultdict(list)
    for (i, w), r in got.items():
        n = sum(counts[i].values())
        assert (r["f"], r["n"], r["k"], r["d"], r["t"], r["n_records"]) == (counts[i][w], n, occ[w], rec[w], t, len(counts))
        assert r["surprise"] == pytest.approx(exact_surprise(r["f"], n, occ[w], t), rel=1e-9, abs=1e-6)
        by[i].append((r["surprise"], w))
    for i, ps in by.items():
        for p, w in ps:
            adjusted = max(x - math.log(len(ps) / sum(y >= x for y, _ in ps)) for x, _ in ps if x <= p)
            assert got[i, w]["score"] == pytest.approx(max(0.0, adjusted), abs=1e-6)
    best = {}
    for i, c in counts.items():
        scored = sorted((-round(f * math.log(len(counts) / rec[w]), 6), w.encode()) for w, f in c.items() if rec[w] >= 2)
        if scored:
            best[i] = scored[0][1].decode()
    assert {r["id"]: r["term"] for r in enrichment.most_distinctive(out).collect()} == best
    assert enrichment.most_distinctive(enrichment.term_enrichment(df.limit(0))).count() == 0
