"""The persistent store and the service over it."""

import json
import random

import pytest

from chronodoc.model import InvalidRequest, SequenceTooLow, StoreOptions, UniqueViolation, UnknownIndex, UnknownSnapshot
from chronodoc.operators import fulltext, paging
from chronodoc.operators.versions import state_as_of
from chronodoc.service import AdminService
from chronodoc.sources.commitlog import CommitConflict
from chronodoc.sources.store import Op, Store
from pyspark.sql import functions as F


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def ids(df):
    return [json.loads(r["id"]) for r in df.collect()]


def test_put_get_snapshot_reopen(spark, store):
    c = store.collection("items")
    c.put(1, {"v": 1})
    s = store.snapshot()
    c.put(1, {"v": 2})
    c.delete(1)
    assert c.get(1) is None and c.get(1, s) == {"v": 1}
    assert c.history(1) == [(1, {"v": 1}), (2, {"v": 2}), (3, None)]
    again = Store(spark, store.path)
    assert again.sequence == 3 and again.collection("items").get(1, s) == {"v": 1}
    assert again.collection("items").last_sequence(1) == 3


def test_batches_are_atomic(store):
    c = store.collection("users")
    store.define_index("users", "byEmail", "unique", ".email")
    c.put(1, {"email": "a@"})
    with pytest.raises(UniqueViolation):
        c.batch([(3, {"email": "c@"}), (2, {"email": "a@"})])
    assert c.get(3) is None and store.sequence == 1
    c.batch([(1, {"email": "z@"}), (2, {"email": "a@"})])
    assert ids(c.by_index("byEmail", "a@")) == [2]
    with pytest.raises(SequenceTooLow):
        c.batch([(9, {})], require_sequence_at_least=99)
    assert c.batch([]) == 3
    store.batch([Op("a", 1, {"x": 1}), Op("b", "k", {"n": 7})])
    assert store.list_collections() == ["a", "b", "users"]


def test_unique_definition_over_duplicates_raises(store):
    c = store.collection("u")
    c.batch([(1, {"e": "x"}), (2, {"e": "x"})])
    with pytest.raises(UniqueViolation):
        store.define_index("u", "byE", "unique", ".e")
    assert store.index_definitions("u") == []


def test_two_writers_conflict(spark, store):
    store.collection("c").put(1, {"v": 1})
    other = Store(spark, store.path)
    store.collection("c").put(2, {"v": 2})
    with pytest.raises(CommitConflict):
        other.collection("c").put(3, {"v": 3})
    other.refresh()
    other.collection("c").put(3, {"v": 3})
    assert ids(other.collection("c").scan()) == [1, 2, 3]


def test_backup_compaction_vacuum(store):
    c = store.collection("c")
    c.batch([(1, {"v": "a"}), (2, {"v": "b"})])
    ref = store.create_backup("before")
    c.delete(1)
    c.put(3, {"v": "c"})
    assert ids(c.scan()) == [2, 3]
    store.compact()
    assert len(store.manifest["files"]) == 1 and ids(c.scan()) == [2, 3] and c.history(1)[0] == (1, {"v": "a"})
    assert store.vacuum() == 2  # the backup's set is kept
    store.restore_backup(ref["id"])
    assert ids(c.scan()) == [1, 2] and store.sequence == 4
    assert [b["note"] for b in store.list_backups()] == ["before"]
    store.compact(retain_from=store.sequence)
    assert store.compaction_status()["levels"][0]["level"] == 0
    assert store.clear_collection("c") == 2 and ids(c.scan()) == []


def test_search_and_typed_documents(store):
    c = store.collection("t")
    store.define_index("t", "words", "fts", ".text")
    store.define_index("t", "near", "vector", ".e")
    store.define_index("t", "stopped", "fts", ".text", analyzer={"stopwords": ["hello"]})
    store.define_index("t", "odd", "fts", ".text", analyzer=lambda text: F.split(F.lower(text), "l+"))
    c.batch([(1, {"text": "hello world", "e": [0.0, 0.0]}), (2, {"text": "hello hello world", "e": [1.0, 1.0]})])
    assert ids(c.search_text("words", "hello", 1)) == [2] and ids(c.search_text("stopped", "hello")) == []
    assert ids(c.search_text("odd", "HEL")) == [] and ids(c.search_text("odd", "hello world")) == [1, 2]
    assert ids(c.vector_search("near", [0.1, 0.0], 1)) == [1]
    for wrong in (lambda: c.search_text("near", "x"), lambda: c.vector_search("words", [1.0], 1), lambda: c.search_text("none", "x")):
        with pytest.raises(UnknownIndex):
            wrong()
    with pytest.raises(UnknownIndex):
        Store(store.spark, store.path).collection("t").search_text("odd", "x")
    assert sorted(r["text"] for r in c.documents("text string").collect()) == ["hello hello world", "hello world"]


def test_stored_text_index_follows_changes(spark, store):
    c = store.collection("t")
    store.define_index("t", "words", "fts", "text")
    c.batch([(i, {"text": f"apple pear{i}"}) for i in range(5)])
    assert len(ids(c.search_text("words", "apple"))) == 5
    snap, ref = store.snapshot(), store.create_backup()
    c.batch([(0, None), (1, {"text": "plum"}), (9, {"text": "apple apple"}), (8, {"text": 7})])
    again = Store(spark, store.path).collection("t")
    got = again.search_text("words", "apple").collect()
    assert [json.loads(r["id"]) for r in got] == [9, 2, 3, 4]
    direct = fulltext.search(again._text(state_as_of(again.log()), store.definition("t", "words", "fts")), "_text", "apple").collect()
    assert [(r["id"], r["score"]) for r in got] == [(r["id"], r["score"]) for r in direct]
    assert ids(again.search_text("words", "apple", snapshot=snap)) == [0, 1, 2, 3, 4]
    store.restore_backup(ref["id"])
    c.put(0, {"text": "fig"})
    assert ids(c.search_text("words", "apple")) == [1, 2, 3, 4]


def test_load_is_validated(spark, store):
    store.define_index("u", "byE", "unique", ".e")
    docs = lambda *rows: spark.createDataFrame([(i, "u", json.dumps(k), v is None, None if v is None else json.dumps({"e": v}), None) for i, (k, v) in enumerate(rows)], "n int, collection string, id string, deleted boolean, value string, version string")
    assert store.load(docs((1, "a"), (2, "b"), (1, None), (3, "a")), "n") == 4
    for bad in (docs((4, "x"), (5, "x")), docs((6, "b"))):
        with pytest.raises(UniqueViolation):
            store.load(bad, "n")
    assert store.sequence == 4 and store.load(docs().limit(0), "n") == 4
    assert ids(store.collection("u").scan()) == [2, 3]


def test_transactions_are_all_or_none(store):
    a = AdminService(store)
    put = lambda i, e: {"op": "put", "collection": "u", "record": {"id": i, "data": {"e": e}}}
    index = {"op": "defineIndex", "collection": "u", "index": {"name": "byE", "kind": "unique", "keyPath": ".e"}}
    bad = a.commit_transaction({"operations": [put("1", "x"), index, put("2", "x")]})
    assert bad["results"][0]["error"]["status"] == 409 and store.index_definitions("u") == [] and store.sequence == 0
    assert a.commit_transaction({"operations": [put("1", "x"), index, put("2", "y")]})["committedSequence"] == 2
    assert [d["name"] for d in store.index_definitions("u")] == ["byE"]
    assert a.commit_transaction({"operations": [put("3", "y")]})["results"][0]["status"] == "error" and store.sequence == 2
    with pytest.raises(InvalidRequest):
        a.commit_transaction({"operations": [{"op": "rename"}]})


def test_drop_keeps_or_clears(store):
    c = store.collection("d")
    store.define_index("d", "byE", "multi", ".e")
    c.batch([(1, {"e": "x"}), (2, {"e": "x"})])
    store.drop_collection("d")
    assert store.list_collections() == [] and store.index_definitions("d") == [] and ids(c.scan()) == [1, 2]
    c.put(3, {"e": "y"})
    assert store.list_collections() == ["d"] and ids(c.scan()) == [1, 2, 3]
    assert store.clear_collection("d") == 3 and ids(c.scan()) == [] and store.list_collections() == []


def test_compaction_leaves_large_files(store):
    c = store.collection("c")
    for i in range(3):
        c.put(i, {"v": i})
    large = store.manifest["files"][0]["name"]
    store.manifest["files"][0]["bytes"] = 1 << 30
    store.compact()
    assert len(store.manifest["files"]) == 2 and store.manifest["files"][0]["name"] == large and ids(c.scan()) == [0, 1, 2]


def test_metrics_and_events(spark, tmp_path):
    seen = []
    s = Store(spark, StoreOptions(f"file://{tmp_path}/m", default_scan_limit=5, logger=lambda e: seen.append(e.to_dict())))
    c = s.collection("i")
    s.define_index("i", "byB", "unique", ".b")
    c.put(1, {"b": "x"})
    c.get(1)
    c.history(1)
    c.by_index("byB", "x").count()
    c.scan_index("byB", "x").count()
    c.scan().count()
    c.delete(1)
    m = s.metrics.snapshot()
    assert (m["puts"], m["scans"], m["indexLookups"], m["deletes"], m["batches"], m["histories"]) == (1, 1, 2, 1, 0, 1)
    assert {"type": "put", "collection": "i"} in seen
    s.metrics.reset()
    assert set(s.metrics.snapshot().values()) == {0}


def test_random_history_against_a_model(store):
    rng, model, c = random.Random(42), {}, store.collection("r")
    for _ in range(5):
        ops = [(rng.randrange(12), None if rng.random() < 0.3 else {"v": rng.randrange(100)}) for _ in range(20)]
        c.batch(ops)
        model.update(dict(ops))
    live = {k for k, v in model.items() if v is not None}
    assert ids(c.scan()) == sorted(live, key=str)
    assert all(c.get(k) == v for k, v in list(model.items())[:3])


def test_service(store):
    a = AdminService(store, secret="k")
    a.create_collection("things")
    with pytest.raises(InvalidRequest):
        a.create_collection("no spaces")
    a.define_index("things", {"name": "byTag", "kind": "multi", "keyPath": ".tags[]"})
    tx = {"operations": [{"op": "put", "collection": "things", "record": {"id": f"item_{i}", "data": {"tags": ["x"]}}} for i in (1, 2, 10)]}
    assert a.commit_transaction(tx)["committedSequence"] == 3
    snap = a.create_snapshot()["id"]
    a.put_record("things", {"id": "item_1", "data": {"tags": ["y"]}, "version": "v2"})
    assert a.get_record("things", "item_1")["version"] == "v2"
    assert a.get_record("things", "item_1", snap)["data"] == {"tags": ["x"]}
    with pytest.raises(UnknownSnapshot):
        a.get_record("things", "item_1", "nope")
    q = {"type": "indexEquals", "index": "byTag", "key": "x", "pageSize": 1}
    first = a.query("things", q)
    second = a.query("things", q | {"pageToken": first["nextPageToken"]})
    assert [i["id"] for i in first["items"] + second["items"]] == ["item_10", "item_2"] and second["nextPageToken"] is None
    assert [i["id"] for i in a.query("things", {"type": "scan", "prefix": "item_1"})["items"]] == ["item_1", "item_10"]
    assert a.query("things", {"type": "byId", "id": "item_2"})["items"][0]["sequence"] == 2
    low = a.commit_transaction({"operations": [], "requireSequenceAtLeast": 10**9})
    assert low["results"][0]["status"] == "error"
    a.delete_record("things", "item_2")
    assert a.get_record("things", "item_2") is None
    assert a.status()["collections"] == [{"name": "things", "recordsApprox": 2}] and a.health()["status"] == "ok"
    assert "chronodoc_puts_total" in a.metrics(prometheus=True)
    ref = a.create_backup()
    assert a.list_backups()["items"][0]["id"] == ref["id"]
    assert a.list_index_definitions("things")["items"][0]["keyPath"] == ".tags[]" and a.rebuild_dynamic_indexes() == 1
    assert a.release_snapshot(snap) and not a.release_snapshot(snap)
    assert a.compaction_run()["debtBytes"] == 0
    assert a.drop_collection("things")["deleted"] == 2


def test_pages_of_a_walk_share_reads(store, monkeypatch):
    c, a, reads = store.collection("things"), AdminService(store, secret="k"), []
    a.define_index("things", {"name": "byTag", "kind": "multi", "keyPath": ".tag"})
    names = [f"i{n:02}" for n in range(60)]
    c.batch([(n, {"tag": "x"}) for n in names])
    snap = a.create_snapshot()["id"]
    store.clear_collection("things")
    a.define_index("things", {"name": "byTag", "kind": "multi", "keyPath": ".tag"})
    real = paging.page_rows
    monkeypatch.setattr(paging, "page_rows", lambda *args, **kw: reads.append(1) or real(*args, **kw))
    for q, token in (({"type": "scan", "limit": 3}, "startAfter"), ({"type": "indexEquals", "index": "byTag", "key": "x", "pageSize": 3}, "pageToken")):
        pages, more = [], {}
        reads.clear()
        while True:
            got = a.query("things", q | more, snap)
            pages.append([i["id"] for i in got["items"]])
            if got["nextPageToken"] is None:
                break
            more = {token: got["nextPageToken"]}
        assert pages == [names[i : i + 3] for i in range(0, 60, 3)] and len(reads) <= 4
    with pytest.raises(InvalidRequest):
        a.query("things", {"type": "scan", "limit": 3, "startAfter": "i02"}, snap)
    a.release_snapshot(snap)
    with pytest.raises(UnknownSnapshot):
        a.query("things", q, snap)


def test_pages_see_commits_between_them(store):
    c, a = store.collection("things"), AdminService(store)
    c.batch([(f"i{n}", {"v": n}) for n in range(6)])
    q = {"type": "scan", "limit": 2}
    page = lambda t: [(i["id"], i["data"]["v"]) for i in a.query("things", q | {"startAfter": t})["items"]]
    assert page("i0") == [("i1", 1), ("i2", 2)] and page("i2") == [("i3", 3), ("i4", 4)]
    snap = a.create_snapshot()["id"]
    c.batch([("i3", None), ("i4", {"v": 40})])
    assert page("i2") == [("i4", 40), ("i5", 5)] and page("i0") == [("i1", 1), ("i2", 2)]
    assert [i["data"]["v"] for i in a.query("things", q | {"startAfter": "i2"}, snap)["items"]] == [3, 4]
