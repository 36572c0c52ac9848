"""Log and table files: round trips, torn files, damaged blocks."""

import base64
import io
import json
import zlib

import numpy as np
import pytest

from chronodoc.functions import filters
from chronodoc.operators.filteraudit import filter_audit
from chronodoc.operators.versions import state_as_of
from chronodoc.sources import binlog
from pyspark.sql import functions as F


def b64(x):
    return base64.b64encode(x).decode()


def record(seq, **frame):
    payload = json.dumps(frame).encode()
    return binlog.HEAD.pack(seq, len(payload)) + payload + binlog.TAIL.pack(zlib.crc32(payload))


def op(seq, key, value, tx=None, kind="op"):
    f = {"key": b64(b"c\0" + key), **({"type": kind} if kind else {}), **({"txid": tx} if tx else {})}
    return record(seq, **f, **({} if value is None else {"value": b64(value)}))


def versioned(key, seq):
    return b"c\0" + key + b"\0" + seq.to_bytes(8, "big")


def test_recovery(spark, rows, tmp_path):
    log = op(5, b"1", b'{"id":1}') + record(0, type="begin", txid="t") + op(6, b"2", b'{"id":2}', "t") + op(7, b"3", b"{}", "lost") + record(0, type="commit", txid="t") + op(8, b'"s"', None, kind=None)
    (tmp_path / "wal.log").write_bytes(log)
    (tmp_path / "wal.000001.log").write_bytes(op(9, b"4", b"{}") + op(10, b"5", b"{}")[:-1])  # torn
    (tmp_path / "a.sst").write_bytes(binlog.table_bytes([(versioned(b"1", 1), b"old"), (versioned(b"1", 2), b""), (versioned(b'"s"', 3), b"x")]))
    got = binlog.recover(spark, str(tmp_path))
    assert rows(state_as_of(got, keys=("collection", "id")), "id", "seq") == [("1", 5), ("2", 6), ("4", 9)]
    assert rows(state_as_of(got, 4, keys=("collection", "id")), "id", "value") == [('"s"', "x")]


def test_damage(spark, tmp_path):
    data = bytearray(binlog.table_bytes([(versioned(b"1", 1), b"value")]))
    data[12] ^= 1
    with pytest.raises(binlog.Corrupt):
        list(binlog.table_entries(bytes(data)))
    with pytest.raises(binlog.Corrupt):
        list(binlog.table_entries(b"short"))
    whole = op(1, b"1", b"{}") + op(2, b"2", b"{}")
    bad = bytearray(whole)
    bad[len(whole) // 2 + 20] ^= 1
    assert [s for s, _ in binlog.log_records(bytes(bad))] == [1]


def test_tables_and_lookups(spark, rows, tmp_path):
    entries = [(f"t{i % 3}", "c", f"k{i % 40}", i, None if i % 7 == 0 else "v" * (i * 13 % 900)) for i in range(300)]
    df = spark.createDataFrame(entries + entries[:2], "file string, collection string, doc_key string, sequence long, value string")
    sizes = binlog.write_table_files(df, f"file://{tmp_path}/t").collect()
    assert len(sizes) == 3 and max(r["bytes"] for r in sizes) > 3 * binlog.BLOCK_BYTES
    got = binlog.read_table_files(spark, f"{tmp_path}/t").select(F.regexp_extract("path", r"(t\d)\.sst", 1).alias("file"), "collection", "doc_key", "sequence", "value")
    want = sorted((f, c, k, s, v or "-") for f, c, k, s, v in entries + entries[:2])
    assert rows(got.na.fill("-")) == want
    keys = spark.createDataFrame([(f"t{i % 4 % 3}", bytearray(versioned(f"k{i % 40}".encode(), i))) for i in range(320)], "file string, key binary")
    found = {(r["file"], bytes(r["key"])): bytes(r["value"]).decode() for r in binlog.lookup(spark, f"file://{tmp_path}/t", keys).collect()}
    held = {(f, versioned(k.encode(), s)): v or "" for f, c, k, s, v in entries}
    asked = {(r["file"], bytes(r["key"])) for r in keys.collect()}
    assert found == {k: v for k, v in held.items() if k in asked} and len(found) > 50


def test_equal_keys_over_blocks():
    same = [(versioned(b"a", 1), b"x" * 3000), (versioned(b"k", 1), b"1" * 3000), (versioned(b"k", 1), b"2" * 3000), (versioned(b"z", 1), b"z")]
    t = binlog.TableFile(io.BytesIO(binlog.table_bytes(same)))
    assert t.get(versioned(b"k", 1)) == b"1" * 3000 and t.get(versioned(b"a", 1)) == b"x" * 3000 and t.get(b"nothing") is None
    assert binlog.TableFile(io.BytesIO(binlog.table_bytes([]))).get(b"x") is None


def slow_bits(keys, words, k):
    b = [0] * words
    for key in keys:
        for i in range(k):
            h = filters.FNV_OFFSET + i
            for c in key:
                h = ((h ^ c) * filters.FNV_PRIME) % 2**64
            h %= words * 64
            b[h // 64] |= 1 << (h % 64)
    return b


def test_filter_layout():
    keys = [b"", b"a", b"abc" * 50, *[f"k{i}".encode() for i in range(30)]]
    assert filters.filter_words(keys, 7, 3).tolist() == slow_bits(keys, 7, 3)
    assert filters.may_hold([*keys, b"other" * 9], np.array(slow_bits(keys, 70, 3), np.uint64), 3).tolist() == [True] * len(keys) + [False]


def test_filter_audit(spark):
    keys = [f"k{i}".encode() for i in range(20)]
    signed = lambda b: [x - 2**64 if x >= 2**63 else x for x in b]
    good, bad, wide = (signed(slow_bits(k, n, 3)) for k, n in ((keys, 4), (keys[:5], 4), (keys, 3000)))
    files = spark.createDataFrame(
        [("s", "t", 3, good, 1), ("s", "t", 3, bad, 0), ("s", "u", 3, bad, 1), ("s", "v", 3, None, 1), ("s", "w", 0, good, 1), ("s", "x", 3, [], 1), ("s", "big", 3, wide, 1)],
        "store string, table_id string, hashes int, bits array<long>, created_at int")
    entries = spark.createDataFrame([("s", t, k, 1) for t in ("t", "u", "v", "w", "x", "big") for k in [*keys, None, keys[0]]], "store string, table_id string, raw binary, bit int")
    got = {r["table_id"]: (r["keys"], r["denied"]) for r in filter_audit(files, entries).collect()}
    assert set(got) == {"t", "u", "big"} and got["t"] == got["big"] == (20, 0) and got["u"][0] == 20 and got["u"][1] > 0
    assert filter_audit(files.limit(0), entries).count() == 0
