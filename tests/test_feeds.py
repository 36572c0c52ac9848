"""Committed changes, the fold, incremental runs and compaction: nulls, repeats, ties, skew, empty tables."""

import datetime as dt
import itertools
import random

import pytest

from chronodoc.operators.changes import committed_changes, current_documents, fold_changes, live
from chronodoc.operators import incremental
from chronodoc.operators.compaction import CompactedTables, level_drift, live_tables
from chronodoc.operators.incremental import PENDING, IncrementalTable, fingerprints, partition_key, refresh_pending
from chronodoc.sources.commitlog import CommitConflict, CommitLog

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

FRAME = "record_no long, store string, segment string, sequence long, frame_type string, txid string, collection string, doc_key string, value string, written_at timestamp_ntz, arrived_at timestamp_ntz"
SAVE = "store string, save_no int, sequence long, started_at timestamp_ntz, saved_at timestamp_ntz, outcome string, tables array<string>"


def t(m):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m)


def frame(no, seq, kind="op", tx=None, key="1", value="{}", at=0, store="s"):
    return (no, store, None, seq, kind, tx, "c" if kind not in ("begin", "commit") else None, key, value, None, None if at is None else t(at))


@pytest.fixture
def frames(spark):
    return lambda *rows: spark.createDataFrame(list(rows), FRAME)


def test_which_frames_are_committed(frames, rows):
    df = frames(
        frame(1, 1, " OP", None), frame(2, 2, None, None), frame(3, 3, "op", "x", at=1), frame(4, 0, "Commit ", "x", at=9), frame(5, 0, "commit", "x", at=7),
        frame(6, 4, "op", "lost"), frame(7, 5, ""), frame(8, 6, "what"), frame(9, 7, "op", "y", at=None), frame(10, 0, "commit", "y", at=1),
        frame(11, 8, "op", "x", store="other"), frame(12, 0, "commit", None),
    )
    clashing = df.withColumn("extra", F.lit(1)).withColumn("_ca", F.lit(2)).withColumn("available_at", F.lit(3))
    got = sorted((r["sequence"], r["available_at"]) for r in committed_changes(clashing).collect() if r["sequence"] != 7)
    assert got == [(1, t(0)), (2, t(0)), (3, t(7))]
    assert [r["available_at"] for r in committed_changes(df).where("sequence = 7").collect()] == [None]


def test_fold_in_any_order_and_number(frames, rows):
    changes = [frame(1, 1, key="a"), frame(2, 5, key="a", value=None), frame(3, 3, key="a"), frame(4, 2, key="b", value=""), frame(5, 4, key="b", value="broken{"), frame(6, 6, key=None)]
    want = None
    for order in itertools.islice(itertools.permutations(changes), 0, 720, 97):
        got = rows(live(current_documents(frames(*order, *order[:3]))).na.fill("-"), "doc_key", "sequence")
        want = want or got
        assert got == want == [("-", 6), ("b", 4)]
    early, late = frames(*changes[1:]), frames(changes[0])
    state = current_documents(early)
    assert rows(live(current_documents(late, base=state)).na.fill("-"), "doc_key", "sequence") == want  # the tombstone holds


def test_fold_ties_and_empty(spark, frames, rows):
    df = frames(frame(1, 1, value=None), frame(2, 1, value="x"), frame(3, 1, value="y"), frame(4, None, value="z"))
    assert rows(current_documents(df), "sequence", "operation", "value") == [(1, 1, "y")]
    assert current_documents(df.limit(0)).count() == 0
    with_clash = df.withColumn("operation", F.lit(9)).withColumn("_top", F.lit(1))
    assert rows(fold_changes(with_clash, ["doc_key"]), "sequence", "operation") == [(1, 1)]


def test_fingerprints_are_additive(spark, rows):
    data = [("a", 1, None), ("a", None, 1), ("b", 2, 2), ("b", 2, 2), (None, 3, 3)]
    df = spark.createDataFrame(data, "p string, x int, y int")
    key = partition_key(F.col("p"))
    a = rows(fingerprints(df, key))
    assert a == rows(fingerprints(df.repartition(3, "x"), key)) and len(a) == 3
    other = spark.createDataFrame([("a", None, 1), ("a", None, 1), ("b", 2, 2), (None, 3, 3)], df.schema)
    b = dict((r[0], r[1:]) for r in rows(fingerprints(other, key)))
    assert all(b[r[0]] != r[1:] for r in a if r[0] != "n") and b["n"] == [r[1:] for r in a if r[0] == "n"][0]


def save(no, seq, start, ok="saved", store="s", tables=("t1",), done=True):
    return (store, no, seq, None if start is None else t(start), t((start or 0) + 1) if done else None, ok, list(tables) if tables is not None else None)


def brute_pending(frames, saves):
    commits = {}
    for f in frames:
        if (f[4] or "").strip().lower() == "commit" and f[5]:
            commits[f[1], f[5]] = min(f[10], commits.get((f[1], f[5]), f[10]))
    changes = {}
    for f in frames:
        kind = None if f[4] is None else f[4].strip().lower()
        if kind in (None, "op") and (f[5] is None or (f[1], f[5]) in commits):
            when = max(f[10], commits.get((f[1], f[5]), f[10]))
            key = (f[1], f[3], f[5], f[6], f[7], f[8])
            changes[key] = min(when, changes.get(key, when))
    good = [s for s in saves if (s[5] or "").strip().lower() == "saved" and s[4] and s[3] and s[2] is not None]
    return sorted({(c[0], c[1]) for c, when in changes.items() if not any(s[0] == c[0] and c[1] <= s[2] and when < s[3] for s in good)})


def random_feed(seed, n=150):
    rng = random.Random(seed)
    fs = []
    for i in range(n):
        store, tx = rng.choice("sssuv"), rng.choice([None, "a", "b", "c", "d"])
        kind = rng.choice(["op", "op", " Op", None, "commit", "begin"])
        fs.append(frame(i, rng.randrange(40), kind, tx, rng.choice("xyz"), rng.choice(["{}", "", None]), rng.randrange(60), store))
    fs += [f[:10] + (f[10] + dt.timedelta(minutes=5),) for f in rng.sample(fs, 20)]
    ss = [save(i, rng.choice([None, 5, 20, 30, 45]), rng.choice([None, 10, 30, 70]), rng.choice(["saved", " SAVED", "failed", None]), rng.choice("suv"), done=rng.random() < 0.9) for i in range(15)]
    return fs, ss


@pytest.mark.parametrize("seed", [1, 2])
def test_pending_against_brute_force(spark, rows, tmp_path, seed):
    fs, ss = random_feed(seed)
    table, report = refresh_pending(spark, spark.createDataFrame(fs, FRAME), spark.createDataFrame(ss, SAVE), f"file://{tmp_path}/p")
    assert rows(table.read(), "store", "sequence") == brute_pending(fs, ss)
    assert report.changed == report.partitions == 3


def test_only_changed_partitions_are_recomputed(spark, rows, tmp_path):
    fs, ss = random_feed(3)
    path, f, s = f"file://{tmp_path}/p", spark.createDataFrame(fs, FRAME), spark.createDataFrame(ss, SAVE)
    refresh_pending(spark, f, s, path)
    assert refresh_pending(spark, f, s, path)[1].changed == 0
    more = [*fs, frame(999, 77, store="u")]
    table, report = refresh_pending(spark, spark.createDataFrame(more, FRAME), s, path)
    assert report.changed == 1 and rows(table.read(), "store", "sequence") == brute_pending(more, ss)
    done = [*ss, save(99, 10**6, 10**4, store="u")]  # a save that handles all: the partition must become empty
    table, report = refresh_pending(spark, spark.createDataFrame(more, FRAME), spark.createDataFrame(done, SAVE), path)
    assert report.changed == 1 and rows(table.read(), "store", "sequence") == brute_pending(more, done)
    gone = [x for x in more if x[1] != "v"]
    left = [x for x in done if x[0] != "v"]
    table, report = refresh_pending(spark, spark.createDataFrame(gone, FRAME), spark.createDataFrame(left, SAVE), path)
    assert report.changed == 1 and rows(table.read(), "store", "sequence") == brute_pending(gone, left)
    table, _ = refresh_pending(spark, f.limit(0), s.limit(0), path)
    assert table.read().count() == 0


@pytest.mark.parametrize("step", ["prints", "data", "commit"])
def test_a_crash_at_any_step_repeats_nothing(spark, rows, tmp_path, monkeypatch, step):
    fs, ss = random_feed(4)
    path, f, s = f"file://{tmp_path}/p", spark.createDataFrame(fs, FRAME), spark.createDataFrame(ss, SAVE)
    first = [x for x in fs if x[0] < 70]
    refresh_pending(spark, spark.createDataFrame(first, FRAME), s, path)
    real = DataFrameWriter.parquet

    def crash(self, at, *args, **kw):
        if f"{path}/{step}" in at:
            if step == "data":  # torn: some files are there
                real(self, at, *args, **kw)
            raise OSError("crash")
        return real(self, at, *args, **kw)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", crash)
        if step == "commit":
            m.setattr(CommitLog, "commit", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            refresh_pending(spark, f, s, path)
    left = IncrementalTable(spark, path, PENDING)
    assert rows(left.read(), "store", "sequence") == brute_pending(first, ss)  # nothing unfinished is seen
    table, report = refresh_pending(spark, f, s, path)
    assert report.changed == 3 and rows(table.read(), "store", "sequence") == brute_pending(fs, ss)
    assert table.vacuum(0) > 0 and rows(table.read(), "store", "sequence") == brute_pending(fs, ss)


def test_two_writers_lose_nothing(spark, rows, tmp_path, monkeypatch):
    """B starts on older input, A commits newer input while B computes, B comes to publish."""
    fs, ss = random_feed(5)
    path, s = f"file://{tmp_path}/p", spark.createDataFrame(ss, SAVE)
    older = [x for x in fs if x[0] < 60]
    refresh_pending(spark, spark.createDataFrame(older[:20], FRAME), s, path)
    real, seen = incremental.pending_changes, []

    def slow(changes, frontier):
        if not seen:
            seen.append(1)
            refresh_pending(spark, spark.createDataFrame(fs, FRAME), s, path)  # A, from start to end
            assert rows(IncrementalTable(spark, path, PENDING).read(), "store", "sequence") == brute_pending(fs, ss)
        return real(changes, frontier)

    with monkeypatch.context() as m:
        m.setattr(incremental, "pending_changes", slow)
        with pytest.raises(CommitConflict):
            refresh_pending(spark, spark.createDataFrame(older, FRAME), s, path)
    assert rows(IncrementalTable(spark, path, PENDING).read(), "store", "sequence") == brute_pending(fs, ss)
    table, report = refresh_pending(spark, spark.createDataFrame(fs, FRAME), s, path)
    assert report.changed == 0 and rows(table.read(), "store", "sequence") == brute_pending(fs, ss)


@pytest.mark.parametrize("literals", [IncrementalTable.LITERALS, 0])
def test_old_run_folders_are_taken_over(spark, rows, tmp_path, monkeypatch, literals):
    monkeypatch.setattr(IncrementalTable, "MAX_RUNS", 2)
    monkeypatch.setattr(IncrementalTable, "LITERALS", literals)
    path, fs = f"file://{tmp_path}/p", []
    none = spark.createDataFrame([], SAVE)
    for i, store in enumerate("abcd"):
        fs.append(frame(i, i + 1, store=store))
        table, _ = refresh_pending(spark, spark.createDataFrame(fs, FRAME), none, path)
        assert rows(table.read(), "store", "sequence") == brute_pending(fs, []) and len(table.log.latest()[1]["runs"]) <= 3


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.latest() == (0, {})
    log.commit(1, {"a": 1})
    with pytest.raises(CommitConflict):
        log.commit(1, {"a": 2})
    base = log.begin()
    (tmp_path / "log" / "000000000002.json").write_text('{"torn')
    assert log.latest() == (1, {"a": 1}) and log.begin().number == 3
    with pytest.raises(CommitConflict):
        log.commit(base.number, {"a": 3})
    assert not [p for p in (tmp_path / "log").iterdir() if "tmp" in p.name]


ENTRY = "store string, table_id string, collection string, doc_key string, sequence long, value string"


def test_compaction(spark, rows, tmp_path):
    saves = spark.createDataFrame(
        [save(1, 1, 0, tables=["old"]), save(2, 1, 0, " Saved", tables=["t1", "t2", "t3", None]), save(2, 1, 0, tables=["t1", "t2", "t3"]), save(3, 1, 0, "failed", tables=["bad"]),
         save(1, 1, 0, store="few", tables=["t1"]), save(5, 1, 0, store="null", tables=None), save(4, 1, 0, store="null", tables=["t1"])], SAVE)
    entries = spark.createDataFrame(
        [("s", f"t{1 + i % 3}", "c", str(i % 10), i % 4, None if i % 4 == 0 else "v") for i in range(200)] + [("s", "old", "c", "gone", 1, "v"), ("few", "t1", "c", "k", 1, ""), ("few", "t1", "c", "k", 1, ""), ("null", "t1", "c", "k", 1, "v"), ("x", "t1", "c", "k", 1, "v")], ENTRY)
    live = live_tables(saves)
    assert len(rows(live)) == 4
    assert rows(level_drift(saves.withColumn("levels", F.expr("array(named_struct('level', 0, 'tables', 3, 'size_bytes', 1L), null)")), entries).na.fill("-")) == [
        ("few", 3, 1, 1), ("null", 3, 0, 0), ("s", 3, 3, 3)]
    tables = CompactedTables(spark, f"file://{tmp_path}/c", max_small=2, target_bytes=1500)
    report = tables.compact(entries, live)
    want = sorted({("s", "c", str(i % 10), i % 4) for i in range(200)} | {("few", "c", "k", 1)})
    assert (report.rewritten, report.kept) == (1, 1) and rows(tables.records(entries, live)) == want
    assert 1 < len(tables.table.read().inputFiles()) <= 8
    assert tables.compact(entries, live).rewritten == 0  # again: nothing to do
    assert rows(tables.records(entries, live)) == want
    assert CompactedTables(spark, f"file://{tmp_path}/e").compact(entries.limit(0), live.limit(0)).rewritten == 0
    assert CompactedTables(spark, f"file://{tmp_path}/e").records(entries, live).count() == len(want)  # nothing compacted yet


def test_hot_document_spreads_over_tables(spark, rows, tmp_path):
    entries = spark.createDataFrame([("s", f"t{i % 9}", "c", "hot", i, "v" * 50) for i in range(400)] * 2 + [("s", "t0", "c", "cold", 1, "v")], ENTRY)
    live = entries.select("store", "table_id").distinct()
    tables = CompactedTables(spark, f"file://{tmp_path}/c", target_bytes=10_000)
    tables.compact(entries, live)
    sizes = [r["count"] for r in tables.table.read().groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 150 and tables.records(entries, live).count() == 401


def test_compaction_after_the_source_merged(spark, rows, tmp_path):
    first = spark.createDataFrame([("s", f"t{i}", "c", str(i), 1, None if i == 4 else "v") for i in range(9)], ENTRY)
    merged = spark.createDataFrame([("s", "m", "c", str(i), 1, "v") for i in (5, 6, 7, 8, 100)], ENTRY)
    both, tables = first.unionByName(merged), CompactedTables(spark, f"file://{tmp_path}/c")
    before, after = first.select("store", "table_id"), merged.select("store", "table_id").distinct()
    assert tables.compact(both, before).rewritten == 1
    assert rows(tables.records(both, after), "doc_key") == [("100",), ("5",), ("6",), ("7",), ("8",)]  # not compacted yet
    assert tables.compact(both, after).kept == 1  # one table: left alone
    assert rows(tables.records(both, after), "doc_key") == [("100",), ("5",), ("6",), ("7",), ("8",)]
    assert tables.records(both, before).count() == 9


def test_two_compactions_at_once(spark, rows, tmp_path, monkeypatch):
    entries = spark.createDataFrame([("s", f"t{i}", "c", str(i), 1, "v") for i in range(20)], ENTRY)
    small, large = entries.where("doc_key < '5'").select("store", "table_id"), entries.select("store", "table_id")
    path = f"file://{tmp_path}/c"
    mine, other = CompactedTables(spark, path), CompactedTables(spark, path)
    real, seen = mine.table.run, []

    def slow(*args, **kw):
        other.compact(entries, large)  # from start to end, after mine has read its base
        seen.append(1)
        return real(*args, **kw)

    monkeypatch.setattr(mine.table, "run", slow)
    with pytest.raises(CommitConflict):
        mine.compact(entries, small)
    assert seen and other.records(entries, large).count() == 20 and other.table.read().count() == 20
    assert other.compact(entries, large).rewritten == 0
