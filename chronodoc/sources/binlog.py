"""Stores kept as write-ahead logs (.log) and sorted tables (.sst), read and written: every file is one task's work."""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodoc.functions import filters
from chronodoc.session import hadoop

FRAMES = "path string, position long, sequence long, frame_type string, txid string, collection string, doc_key string, value string"
ENTRIES = "path string, collection string, doc_key string, sequence long, value string"
# fixed values of the file formats: record head (sequence, length), tail (checksum), footer (four offsets and sizes)
HEAD, TAIL, FOOTER = struct.Struct(">QI"), struct.Struct(">I"), struct.Struct("<QQQQ")
U32 = struct.Struct("<I")
BLOCK_BYTES = 4096
BITS_A_KEY, PROBES = 10, 3


class Corrupt(ValueError):
    """A block whose checksum does not fit, or a file that ends too early."""


def log_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(sequence, payload) of a log; reading ends at the first short or damaged record."""
    at = 0
    while at + HEAD.size <= len(data):
        sequence, length = HEAD.unpack_from(data, at)
        end = at + HEAD.size + length
        if end + TAIL.size > len(data):
            return
        payload = data[at + HEAD.size : end]
        if TAIL.unpack_from(data, end)[0] != zlib.crc32(payload):
            return
        yield sequence, payload
        at = end + TAIL.size


def split_key(key: bytes, with_sequence: bool = False) -> tuple[str | None, str | None, int | None]:
    """(collection, id text, sequence) of a stored key."""
    name, zero, rest = key.partition(b"\0")
    if not zero:
        return None, None, None
    sequence = None
    if with_sequence and len(rest) >= 9 and rest[-9] == 0:
        sequence, rest = int.from_bytes(rest[-8:], "big"), rest[:-9]
    return name.decode("utf-8", "replace"), rest.decode("utf-8", "replace"), sequence


def parse_frame(payload: bytes) -> tuple[str | None, str | None, str | None, str | None, str | None] | None:
    """(frame_type, txid, collection, doc_key, value); payloads without a type are single changes of the older kind."""
    try:
        d = json.loads(payload)
    except ValueError:
        return None
    raw = d.get("key")
    collection, key, _ = split_key(base64.b64decode(raw)) if raw else (None, None, None)
    value = d.get("value")
    return d.get("type"), d.get("txid"), collection, key, None if value is None else base64.b64decode(value).decode("utf-8", "replace")


def frame_bytes(sequence: int, frame_type: str | None, txid: str | None, collection: str | None, doc_key: str | None, value: str | None) -> bytes:
    """One log record; what is null is left out of its payload, and so is the key unless both of its parts are there."""
    named = {"type": frame_type, "txid": txid}
    if collection is not None and doc_key is not None:
        named["key"] = base64.b64encode(f"{collection}\0{doc_key}".encode()).decode()
    if value is not None:
        named["value"] = base64.b64encode(value.encode()).decode()
    payload = json.dumps({k: v for k, v in named.items() if v is not None}).encode()
    return HEAD.pack(sequence, len(payload)) + payload + TAIL.pack(zlib.crc32(payload))


def table_bytes(entries: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted table of (key, value) pairs in order of key: checksummed blocks, block index, key filter, footer."""
    out, block, index = bytearray(), bytearray(), []

    def close() -> None:
        index.append((first, len(out), len(block) + U32.size))
        out.extend(block + U32.pack(zlib.crc32(block)))
        block.clear()

    first = b""
    for key, value in entries:
        entry = U32.pack(len(key)) + key + U32.pack(len(value)) + value
        if block and len(block) + len(entry) > BLOCK_BYTES:
            close()
        if not block:
            first = key
        block += entry
    if block:
        close()
    index_at = len(out)
    out += U32.pack(len(index)) + b"".join(U32.pack(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in index)
    filter_at = len(out)
    words = filters.filter_words([k for k, _ in entries], max(64, len(entries) * BITS_A_KEY) // 64, PROBES)
    out += struct.pack("<QQ", PROBES, len(words) * 64) + words.astype("<u8").tobytes()
    return bytes(out) + FOOTER.pack(index_at, filter_at - index_at, filter_at, len(out) - filter_at)


class TableFile:
    """Point lookups in a sorted table: the filter, then the one block that can hold the key; nothing else is read."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2) or file.tell()
        if size < FOOTER.size:
            raise Corrupt("no footer")
        index_at, index_size, filter_at, filter_size = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        index, at = self._read(index_at, index_size), U32.size
        self.first, self.places = [], []
        for _ in range(U32.unpack_from(index, 0)[0]):
            n = U32.unpack_from(index, at)[0]
            at += U32.size
            self.first.append(index[at : at + n])
            self.places.append(struct.unpack_from("<QQ", index, at + n))
            at += n + 16
        stored = self._read(filter_at, filter_size)
        self.probes = struct.unpack_from("<Q", stored, 0)[0]
        self.words = np.frombuffer(stored, "<u8", offset=16)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def get(self, key: bytes) -> bytes | None:
        """The value of the first entry with this key; None if there is none."""
        if not filters.may_hold([key], self.words, self.probes)[0]:
            return None
        # equal keys may begin in the block before the first one that starts with them
        for at, size in self.places[max(0, bisect_left(self.first, key) - 1) : bisect_right(self.first, key)]:
            for k, value in block_entries(self._read(at, size)):
                if k == key:
                    return value
        return None


def _sink(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _write_groups(rows: DataFrame, path: str, suffix: str, order: list[str], encode) -> DataFrame:
    """Write one file ``<path>/<name>.<suffix>`` per ``file`` value from its rows in order; (file, bytes). A file is one
    task's work and memory, so it must be of a store's file size. Files appear by renaming, so a repeated task is harmless."""
    fs, p = hadoop(rows.sparkSession, path)
    fs.mkdirs(p)
    names = [c for c in rows.columns if c != "file"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held = None, []

        def flush() -> pd.DataFrame:
            target, root = _sink(path)
            data = encode(held)
            part = f"{root}/_{uuid.uuid4().hex}.tmp"
            with target.open_output_stream(part) as f:
                f.write(data)
            target.move(part, f"{root}/{here}.{suffix}")
            return pd.DataFrame({"file": [here], "bytes": [len(data)]})

        for b in batches:
            for name, *row in b[["file", *names]].itertuples(index=False, name=None):
                if name != here:
                    if here is not None:
                        yield flush()
                    here, held = name, []
                held.append([None if x is None or x is pd.NA or x != x else x for x in row])
        if here is not None:
            yield flush()

    return rows.repartition("file").sortWithinPartitions("file", *order).mapInPandas(run, "file string, bytes long")


def write_log_files(frames: DataFrame, path: str) -> DataFrame:
    """Frames (file, position, sequence, frame_type, txid, collection, doc_key, value) as log files in order of position."""
    rows = frames.select("file", "position", F.coalesce("sequence", F.lit(0)).alias("sequence"), "frame_type", "txid", "collection", "doc_key", "value")
    return _write_groups(rows, path, "log", ["position"], lambda held: b"".join(frame_bytes(int(r[1]), *r[2:]) for r in held))


def write_table_files(entries: DataFrame, path: str) -> DataFrame:
    """Entries (file, collection, doc_key, sequence, value) as sorted tables; null values are written as empty ones."""
    key = F.concat(F.encode("collection", "UTF-8"), F.lit(b"\0"), F.encode("doc_key", "UTF-8"), F.lit(b"\0"), F.unhex(F.lpad(F.hex(F.coalesce("sequence", F.lit(0))), 16, "0")))
    rows = entries.select("file", key.alias("key"), F.encode(F.coalesce("value", F.lit("")), "UTF-8").alias("value"))
    return _write_groups(rows, path, "sst", ["key", "value"], lambda held: table_bytes([(bytes(k), bytes(v)) for k, v in held]))


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(file, key, value) of stored keys (file, key: bytes) asked of the sorted tables they name, each through the file's
    filter and one block; keys that a file does not hold give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, table = None, None
        for b in batches:
            out = []
            for file, key in b.itertuples(index=False, name=None):
                if file != name:
                    source, root = _sink(path)
                    name, table = file, TableFile(source.open_input_file(f"{root}/{file}.sst"))
                value = table.get(bytes(key))
                if value is not None:
                    out.append((file, bytes(key), value))
            yield pd.DataFrame(out, columns=["file", "key", "value"])

    asked = keys.select("file", "key").repartition("file").sortWithinPartitions("file")
    return asked.mapInPandas(run, "file string, key binary, value binary")


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all ``*.log`` files under ``path``, in file order by ``position``; feed them to ``committed_changes``.

    Payloads that are no JSON are skipped. A torn file gives the frames before the damage.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                for i, (sequence, payload) in enumerate(log_records(bytes(content))):
                    frame = parse_frame(payload)
                    if frame is not None:
                        rows.append((p, i, sequence, *frame))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAMES.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, FRAMES)


def table_entries(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of a sorted table; every block's checksum is verified."""
    if len(data) < FOOTER.size:
        raise Corrupt("no footer")
    index_at, index_size, _, _ = FOOTER.unpack_from(data, len(data) - FOOTER.size)
    index = data[index_at : index_at + index_size]
    if len(index) < U32.size:
        raise Corrupt("no index")
    at = U32.size
    for _ in range(U32.unpack_from(index, 0)[0]):
        at += U32.size + U32.unpack_from(index, at)[0]
        start, size = struct.unpack_from("<QQ", index, at)
        at += 16
        yield from block_entries(data[start : start + size])


def block_entries(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of one block with its checksum, which is verified."""
    block, check = data[: -U32.size], data[-U32.size :]
    if len(check) != U32.size or U32.unpack(check)[0] != zlib.crc32(block):
        raise Corrupt("block checksum")
    pos = 0
    while pos < len(block):
        parts = []
        for _ in range(2):
            n = U32.unpack_from(block, pos)[0]
            parts.append(block[pos + U32.size : pos + U32.size + n])
            pos += U32.size + n
        yield parts[0], parts[1]


def read_table_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all ``*.sst`` files under ``path``; an empty value is a deletion (null). Damaged blocks raise."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                for key, value in table_entries(bytes(content)):
                    collection, doc_key, sequence = split_key(key, True)
                    rows.append((p, collection, doc_key, sequence, value.decode("utf-8", "replace") or None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRIES.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, ENTRIES)


def recover(spark: SparkSession, path: str) -> DataFrame:
    """The version log (collection, id, seq, deleted, value) a store's files hold: tables plus committed log frames."""
    from chronodoc.operators.changes import committed_changes

    frames = read_log_files(spark, path).withColumn("store", F.lit(path)).withColumn("arrived_at", F.lit(None).cast("timestamp_ntz"))
    fresh = committed_changes(frames).select("collection", F.col("doc_key").alias("id"), F.col("sequence").alias("seq"), "value")
    stored = read_table_files(spark, path).select("collection", F.col("doc_key").alias("id"), F.col("sequence").alias("seq"), "value")
    rows = stored.unionByName(fresh).distinct()
    return rows.select("collection", "id", "seq", (F.coalesce("value", F.lit("")) == "").alias("deleted"), "value")
