"""Reads, scans and indexes over small version logs."""

import pytest

from chronodoc.functions.text import stopword_analyzer
from chronodoc.model import InvalidRequest, UniqueViolation, UnknownIndex
from chronodoc.operators import batch, fulltext, indexes, knn, paging, scans, versions
from chronodoc.operators.indexes import Index

LOG = "id long, seq long, deleted boolean, tag string"


@pytest.fixture(scope="module")
def log(spark):
    data = [(1, 1, False, "a"), (2, 2, False, "b"), (3, 3, False, "c"), (2, 4, True, None), (3, 5, False, "c2"), (4, 6, False, "d"), (4, 6, False, "d")]
    return spark.createDataFrame(data, LOG).cache()


def test_state_and_snapshot(log, rows):
    assert rows(versions.state_as_of(log), "id", "tag") == [(1, "a"), (3, "c2"), (4, "d")]
    assert rows(versions.state_as_of(log, 3), "id", "tag") == [(1, "a"), (2, "b"), (3, "c")]
    assert versions.state_as_of(log, 0).count() == 0


def test_get_history_last(log):
    assert versions.get(log, 2).count() == 0
    assert versions.get(log, 2, 3).first()["tag"] == "b"
    assert [(r["seq"], r["tag"]) for r in versions.history(log, 2).collect()] == [(2, "b"), (4, None)]
    assert versions.history(log, 4).count() == 1  # a repeated row is one version
    assert versions.last_sequence(log, 2).first()[0] == 4
    assert versions.last_sequence(log, 9).first()[0] is None
    assert versions.store_sequence(log.limit(0)).first()[0] == 0


def test_scan_order_and_limits(spark, log):
    assert [r["id"] for r in scans.scan(log, limit=2).collect()] == [1, 3]
    many = spark.createDataFrame([(i, i, False, "x") for i in range(1, 121)], LOG)
    got = [r["id"] for r in scans.scan(many).collect()]
    assert got == sorted(range(1, 121), key=str)[:100]
    assert [r["id"] for r in scans.scan(many, prefix="11").collect()] == [11, 110, 111, 112, 113, 114, 115, 116, 117, 118, 119]
    names = spark.createDataFrame([("a", 1, False, "x"), ("a!", 2, False, "x"), ('q"', 3, False, "x")], LOG.replace("id long", "id string"))
    assert [r["id"] for r in scans.scan(names).collect()] == ["a!", "a", 'q"']


def test_unique_index_follows_versions(spark):
    log = spark.createDataFrame([(1, 1, False, "a@"), (1, 2, False, "b@"), (1, 3, True, None)], LOG)
    ix = Index.on("byTag", "tag", "unique")
    assert indexes.by_index(log, ix, "a@", 2).count() == 0
    assert indexes.by_index(log, ix, "b@", 2).count() == 1
    assert indexes.by_index(log, ix, "a@", 1).first()["id"] == 1
    assert indexes.by_index(log, ix, "b@").count() == 0


def test_multi_index_and_arrays(spark, rows):
    log = spark.createDataFrame([(1, 1, False, ["a", "b", "a"]), (2, 2, False, ["a1"]), (1, 3, False, ["b", None])], "id long, seq long, deleted boolean, tags array<string>")
    ix = Index.on("byTag", "tags")
    assert indexes.by_index(log, ix, "a").count() == 0
    assert indexes.by_index(log, ix, "a", 2).first()["id"] == 1
    assert rows(indexes.scan_index(log, ix, "a", snapshot=2), "key", "id") == [("a", 1), ("a1", 2)]
    assert indexes.scan_index(log, ix, "", 1, 2).first()["key"] == "a"


def test_index_errors(spark, log):
    with pytest.raises(UnknownIndex):
        indexes.by_index(log, None, "a")
    assert indexes.by_index(log, None, "a", strict=False).count() == 0
    with pytest.raises(InvalidRequest):
        indexes.by_index(log, Index.on("n", "seq"), "1")
    twice = spark.createDataFrame([(1, 1, False, "x"), (2, 2, False, "x")], LOG)
    with pytest.raises(UniqueViolation) as e:
        indexes.check_unique(twice, Index.on("byTag", "tag", "unique"))
    assert e.value.key == "x"


def test_json_paths(spark):
    docs = ['{"tags":["x",3,"y"],"a":{"b":"z"},"s":"t"}', "not json", None, '{"tags":"solo","n":1}', "[1]"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, value string")
    keys = lambda p: [r[0] for r in df.orderBy("id").select(Index.at_path("i", p).keys(df)).collect()]
    assert keys(".tags[]") == [["x", "y"], [], [], ["solo"], []]
    assert keys(".tags") == [[], [], [], ["solo"], []]
    assert keys(".a.b") == [["z"], [], [], [], []]
    assert keys(".n") == [[], [], [], [], []]
    assert keys("id")[0] == ["0"]


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "Hello hello world"), (3, None), (4, "")], "id long, text string")
    hits = lambda q, n=None, **k: [r["id"] for r in fulltext.search(docs, "text", q, n, **k).collect()]
    assert hits("hello") == [2, 1]
    assert hits("hello", 1) == [2]
    assert hits("zebra world") == [] and hits("") == []
    assert hits("the hello", analyzer=stopword_analyzer({"the"})) == [2, 1]


def test_vectors(spark):
    docs = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.5, 0.5]), ("n", None)], "id string, e array<double>")
    near = lambda q, k, m="l2": [(r["id"], r["distance"]) for r in knn.vector_search(docs, "e", q, k, m).collect()]
    assert [i for i, _ in near([0.6, 0.6], 2)] == ["c", "b"]
    assert near([1.0, 0.0], 3, "cosine")[-1] == ("a", 1.0)
    with pytest.raises(Exception, match="dimension"):
        near([1.0], 1)
    join = knn.knn_join(docs, docs.where("id = 'a'"), "e", 1).collect()
    assert [(r["query_id"], r["id"]) for r in join] == [("a", "c")]


def test_pages_and_tokens(spark):
    df = spark.createDataFrame([(f"a{i}",) for i in range(1, 6)], "id string")
    sizes, cursor = [], None
    while True:
        page = paging.fetch_page(df, 2, cursor)
        sizes.append(len(page.items))
        cursor = page.next_cursor
        if cursor is None:
            break
    assert sizes == [2, 2, 1]
    assert paging.fetch_page(df, 2, "zzz").items == []
    assert paging.page_size(0) == 1 and paging.page_size(None) == 100 and paging.page_size(10**6) == 1000
    assert paging.list_page(["b", "a", "c"], 2) == (["a", "b"], "b")
    assert paging.unseal(paging.seal("x", "k"), "k") == "x"
    for bad in ("x", paging.seal("x", "other"), "e30"):
        with pytest.raises(InvalidRequest):
            paging.unseal(bad, "k")


def test_walk_gives_the_pages_of_single_reads(spark, monkeypatch):
    names = [None, "", "a", "Z", "\u00e9", "\uffee", "\U0001f600", *[f"n{i:02}" for i in range(30)]]
    df = spark.createDataFrame([(n, "x" * (200 if n == "n07" else 3)) for n in names], "id string, text string").cache()
    monkeypatch.setattr(paging, "AHEAD_GROWTH", 3)
    cursors = [None, "", "Z", "n00", "n29", "n05", "n05", "\uffee", "zzz", "n06"]
    want = {(size, c): paging.fetch_page(df, size, c) for size in (1, 4) for c in cursors}
    for rows, size in ((50_000, 8 << 20), (5, 8 << 20), (50_000, 100)):
        monkeypatch.setattr(paging, "AHEAD_ROWS", rows)
        monkeypatch.setattr(paging, "AHEAD_BYTES", size)
        walk = paging.Walk(df)
        assert all(walk.page(s, c) == p for (s, c), p in want.items())
        seen, cursor = [], None
        while cursor is not None or not seen:
            page = walk.page(4, cursor)
            seen += [r["id"] for r in page.items]
            cursor = page.next_cursor
            assert len(walk._held[2]) <= min(rows, 4 + size // 20) + 1
        assert seen == [None, *sorted(names[1:])]


def test_dense_sequences_and_batches(spark, log, rows):
    ops = spark.createDataFrame([(i, i % 7, False, f"t{i}") for i in range(200)], "op_index long, id long, deleted boolean, tag string")
    numbered = batch.dense_sequence(ops.repartition(5), "op_index", 10)
    assert rows(numbered, "op_index", "seq") == [(i, 11 + i) for i in range(200)]
    after = versions.state_as_of(batch.apply_batch(log, ops, 6))
    assert {r["id"]: r["tag"] for r in after.collect()}[6] == "t195"


def test_unique_keys_may_move_within_a_batch(spark):
    log = spark.createDataFrame([(1, 1, False, "k"), (2, 2, False, "m")], LOG)
    ix = Index.on("byTag", "tag", "unique")
    swap = spark.createDataFrame([(1, 1, False, "free"), (2, 2, False, "k")], "op_index long, id long, deleted boolean, tag string")
    assert batch.batch_conflicts(log, swap, ix, 2).count() == 0
    clash = spark.createDataFrame([(1, 2, False, "k")], "op_index long, id long, deleted boolean, tag string")
    assert [r["key"] for r in batch.batch_conflicts(log, clash, ix, 2).collect()] == ["k"]
