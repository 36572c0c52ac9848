"""Has this key been seen before? Partitioned cuckoo tables of short fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodoc.operators.compaction import live_entries
from chronodoc.session import bounded, checkpointed, scratch
from chronodoc.sources.commitlog import CommitLog

SLOTS = 4
#: Bits of a fingerprint.
BITS = 16
FULL = 0.9
KICKS = 64
#: Keys one table partition is planned for.
KEYS_PER_PART = 1 << 19


class CuckooTable:
    """Cuckoo filter over 64-bit key hashes: fingerprints of up to 16 bits, two candidate buckets of four slots.

    All operations take arrays of hashes and work on whole arrays. When a table is 90 % full or an insertion
    finds no place, a table of twice the size is added to the chain; lookups ask every table, so growth never
    loses a key. ``delete_many`` removes one stored copy per given hash (only delete what was inserted).
    """

    def __init__(self, expected: int = 1024, bits: int = BITS):
        self.bits = bits
        need = max(4, int(expected / FULL / SLOTS) + 1)
        self.tables = [np.zeros((1 << (need - 1).bit_length(), SLOTS), np.uint16)]
        self.used = [0]
        self.rng = np.random.default_rng(7)

    def _fingerprint(self, h: np.ndarray) -> np.ndarray:
        fp = (h & np.uint64((1 << self.bits) - 1)).astype(np.uint16)
        return np.where(fp == 0, np.uint16(1), fp)

    @staticmethod
    def _other(bucket: np.ndarray, fp: np.ndarray, mask: int) -> np.ndarray:
        spread = (fp.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)
        return bucket ^ (spread & np.uint64(mask)).astype(np.int64)

    def _places(self, h: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask, fp = len(table) - 1, self._fingerprint(h)
        first = ((h >> np.uint64(16)) & np.uint64(mask)).astype(np.int64)
        return fp, first, self._other(first, fp, mask)

    def contains_many(self, h: np.ndarray) -> np.ndarray:
        h = np.asarray(h, np.uint64)
        found = np.zeros(len(h), bool)
        for table in self.tables:
            fp, a, b = self._places(h, table)
            found |= ((table[a] == fp[:, None]) | (table[b] == fp[:, None])).any(1)
        return found

    @staticmethod
    def _settle(table: np.ndarray, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets, as many as fit; True where placed."""
        order = np.argsort(bucket, kind="stable")
        sorted_b = bucket[order]
        first = np.searchsorted(sorted_b, sorted_b)
        turn = np.arange(len(order)) - first  # 0, 1, ... within a bucket
        free = table[sorted_b] == 0
        fits = turn < free.sum(1)
        slot = np.argmax(np.cumsum(free, 1) == (turn + 1)[:, None], 1)
        table[sorted_b[fits], slot[fits]] = fp[order[fits]]
        placed = np.zeros(len(bucket), bool)
        placed[order[fits]] = True
        return placed

    def insert_many(self, h: np.ndarray) -> None:
        """Insert every hash (repeats included, as each can be deleted once)."""
        h = np.asarray(h, np.uint64)
        while len(h):
            table = self.tables[-1]
            room = int(table.size * FULL) - self.used[-1]
            if room <= 0:
                self._grow(len(h))
                continue
            now, h = h[:room], h[room:]
            fp, a, b = self._places(now, table)
            left = np.flatnonzero(~self._settle(table, a, fp))
            ok = self._settle(table, b[left], fp[left])
            left = left[~ok]
            self.used[-1] += len(now) - len(left)
            fp, at, mask = fp[left], b[left], len(table) - 1
            for _ in range(KICKS):
                if not len(fp):
                    break
                # one newcomer per bucket changes places with a random resident, which tries its other bucket
                _, one = np.unique(at, return_index=True)
                wait = np.ones(len(fp), bool)
                wait[one] = False
                slot = self.rng.integers(0, SLOTS, len(one))
                out = table[at[one], slot].copy()
                table[at[one], slot] = fp[one]
                to = self._other(at[one], out, mask)
                real = out != 0
                self.used[-1] += int((~real).sum())
                fp, at = np.concatenate([fp[wait], out[real]]), np.concatenate([at[wait], to[real]])
                placed = self._settle(table, at, fp)
                self.used[-1] += int(placed.sum())
                fp, at = fp[~placed], at[~placed]
            if len(fp):  # saturated: the homeless move on to a larger table, under the buckets they have there
                self._rehome(fp, at, mask)

    def _grow(self, coming: int) -> None:
        size = max(len(self.tables[-1]) * 2, 1 << (max(4, int(coming / FULL / SLOTS)) - 1).bit_length())
        self.tables.append(np.zeros((size, SLOTS), np.uint16))
        self.used.append(0)

    def _rehome(self, fp: np.ndarray, at: np.ndarray, mask: int) -> None:
        """A kicked fingerprint no longer knows its hash, so it goes to a stash table of the same size and mask."""
        stash = np.zeros((mask + 1, SLOTS), np.uint16)
        rest_fp, rest_at = fp, at
        placed = self._settle(stash, rest_at, rest_fp)
        n = int(placed.sum())
        rest_fp, rest_at = rest_fp[~placed], rest_at[~placed]
        self.tables.insert(len(self.tables) - 1, stash)
        self.used.insert(len(self.used) - 1, n)
        if len(rest_fp):
            self._rehome(rest_fp, rest_at, mask)
        if self.used[-1] > self.tables[-1].size * FULL * 0.5:
            self._grow(0)

    def delete_many(self, h: np.ndarray) -> np.ndarray:
        """Remove one stored copy of each hash; True where one was removed. Only delete what was inserted.

        Tables of one size are interchangeable: there two keys of one fingerprint share both buckets or none. A hash
        with matches in tables of different sizes is left alone (False), as the match in one of them may be
        another key's only copy; it stays a 'maybe', which the exact check settles, and nothing is ever forgotten.
        """
        h = np.asarray(h, np.uint64)
        gone = np.zeros(len(h), bool)
        sizes = sorted({len(t) for t in self.tables})
        holds = np.array([np.logical_or.reduce([self._matches(t, h)[0] >= 0 for t in self.tables if len(t) == n]) for n in sizes])
        for n, mine in zip(sizes, holds & (holds.sum(0) == 1), strict=True):
            todo = np.flatnonzero(mine)
            for k, table in enumerate(self.tables):
                while len(table) == n and len(todo):
                    at, _ = self._matches(table, h[todo])
                    slots, first = np.unique(at, return_index=True)  # of hashes with one slot in view, one takes it
                    first = first[slots >= 0]
                    if not len(first):
                        break
                    table.reshape(-1)[at[first]] = 0
                    self.used[k] -= len(first)
                    gone[todo[first]] = True
                    todo = np.delete(todo, first)
        return gone

    def _matches(self, table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat slot of a stored fingerprint of each hash, -1 where there is none; and the fingerprints."""
        fp, a, b = self._places(h, table)
        both = np.concatenate([table[a], table[b]], 1) == fp[:, None]
        first = both.argmax(1)
        slot = np.where(first < SLOTS, a * SLOTS + first, b * SLOTS + first - SLOTS)
        return np.where(both.any(1), slot, -1), fp

    def dump(self) -> list[bytes]:
        """The tables as bytes, oldest first."""
        return [t.tobytes() for t in self.tables]

    @classmethod
    def load(cls, parts: list[bytes], bits: int = BITS) -> CuckooTable:
        t = cls(1, bits)
        t.tables = [np.frombuffer(p, np.uint16).reshape(-1, SLOTS).copy() for p in parts]
        t.used = [int(np.count_nonzero(x)) for x in t.tables]
        return t

    def __len__(self) -> int:
        return sum(self.used)


#: What a run writes: verdicts (kind 'v') in order of arrival, and the tables after it (kind 't', arrival_no is the place in the chain).
RUN = "kind string, part int, arrival_no long, maybe boolean, slots binary"
#: Rows of one table partition in the order in which they are worked off.
TABLE, OWED, DELETE, INSERT, ARRIVAL = range(5)


def _work(expected: int, bits: int):
    """Rows (part, kind, arrival_no, h, slots), sorted by part, kind and arrival, to rows of ``RUN``."""

    def flush(part: int, chain: list[bytes], table: CuckooTable | None) -> pa.RecordBatch:
        dumped = table.dump() if table else chain
        n = len(dumped)
        cols = [["t"] * n, np.full(n, part, np.int32), np.arange(n), np.zeros(n, bool), dumped]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols[:4]), pa.array(dumped, pa.binary())], names=["kind", "part", "arrival_no", "maybe", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chain, table = None, [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(i)) for i in range(2)], 1)
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1).tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                p, kind = key[x].tolist()
                if p != part:
                    if part is not None:
                        yield flush(part, chain, table)
                    part, chain, table = p, [], None
                rows = batch.slice(x, y - x)
                if kind == TABLE:
                    chain += rows.column(4).to_pylist()
                    continue
                if table is None:
                    table = CuckooTable.load(chain, bits) if chain else CuckooTable(expected, bits)
                h = rows.column(3).to_numpy().view(np.uint64)
                if kind == DELETE:
                    table.delete_many(h)
                elif kind in (OWED, INSERT):
                    table.insert_many(h)
                else:  # all arriving hashes of one part are distinct, so a whole batch can be asked before it is added
                    maybe = table.contains_many(h)
                    table.insert_many(h[~maybe])
                    n = len(h)
                    cols = [pa.array(["v"] * n), rows.column(0), rows.column(2), pa.array(maybe), pa.nulls(n, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["kind", "part", "arrival_no", "maybe", "slots"])
        if part is not None:
            yield flush(part, chain, table)

    return run


class KeyTables:
    """Cuckoo tables of all keys so far, kept under ``path`` between runs: ``runs/<id>`` and a commit log.

    The tables are partitioned by the top bits of the 64-bit key hash; a partition is a chain of byte strings of about
    2.5 bytes a key. A run loads each partition in one task, works off deletions, insertions and arrivals in this
    order, and writes verdicts and grown tables as one Parquet folder, which the commit makes current; a failed
    run leaves the old tables in force. ``expected``: keys the partitions are laid out for when the first run makes them;
    more make the tables grow. ``bits`` of a fingerprint:
    fewer give smaller tables and more wrong 'maybe' verdicts.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int = 1 << 20, *, first_size: int | None = None, bits: int = BITS):
        self.spark, self.path = spark, path
        self.log = CommitLog(spark, f"{path}/commits")
        self.parts = 1 << max(4, (max(1, expected // KEYS_PER_PART) - 1).bit_length())
        self.bits = bits
        self.first_size = first_size or max(1024, expected // self.parts)

    def _rows(self, run: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.path}/runs/{run}")

    def tables(self) -> DataFrame:
        """(part, arrival_no, slots) of the newest commit."""
        content = self.log.latest()[1]
        return self._rows(content["run"]).where("kind = 't'") if content else self.spark.createDataFrame([], RUN)

    def run(self, *, arrivals: DataFrame | None = None, insert: DataFrame | None = None, delete: DataFrame | None = None) -> DataFrame:
        """Delete and insert hashes (h), judge arrivals (arrival_no, h) in their order; verdicts: (arrival_no, maybe).

        Each frame's hashes must be distinct. An arrival judged new is inserted, so of keys of one hash the later ones
        must not be passed: they are 'maybe' by definition.
        """
        base = self.log.begin()
        parts = base.content.get("parts", self.parts)
        part = F.shiftrightunsigned("h", 64 - (parts - 1).bit_length()).cast("int").alias("part")
        none = F.lit(None).cast("binary").alias("slots")
        todo = []
        if base.content:
            todo.append(self._rows(base.content["run"]).where("kind = 't'").select("part", F.lit(TABLE).alias("kind"), "arrival_no", F.lit(0).cast("long").alias("h"), "slots"))
            if base.content.get("owed"):
                todo.append(self.spark.read.parquet(base.content["owed"]).select(part, F.lit(OWED).alias("kind"), F.lit(0).cast("long").alias("arrival_no"), "h", none))
        for kind, rows in ((DELETE, delete), (INSERT, insert)):
            if rows is not None:
                todo.append(rows.select(part, F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("arrival_no"), "h", none))
        if arrivals is not None:
            todo.append(arrivals.select(part, F.lit(ARRIVAL).alias("kind"), "arrival_no", "h", none))
        laid = reduce(DataFrame.unionByName, todo).repartition("part").sortWithinPartitions("part", "kind", "arrival_no", "h")
        run = f"r{base.number:012d}-{uuid.uuid4().hex[:8]}"
        laid.mapInArrow(_work(self.first_size, base.content.get("bits", self.bits)), RUN).write.parquet(f"{self.path}/runs/{run}")
        self.log.commit(base.number, {"run": run, "parts": parts, "bits": base.content.get("bits", self.bits)})
        return self._rows(run).where("kind = 'v'").select("arrival_no", "maybe")

    def owe(self, hashes: DataFrame) -> None:
        """Hashes (h) of keys that were judged 'maybe' but proved new: the next run inserts them, so that each key in the
        tables has a fingerprint of its own and can be deleted."""
        base = self.log.begin()
        path = f"{self.path}/owed/{base.content['run']}-{uuid.uuid4().hex[:8]}"
        hashes.select("h").distinct().write.parquet(path)
        self.log.commit(base.number, base.content | {"owed": path})

    def figures(self) -> DataFrame:
        """One row: partitions, tables in all chains, stored fingerprints."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = [int(np.count_nonzero(np.frombuffer(x, np.uint16))) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["part", "stored"])

        each = self.tables().select("part", "slots").mapInArrow(count, "part int, stored long")
        return each.agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("tables"), F.sum("stored").alias("stored"))


def key_hashes(rows: DataFrame) -> DataFrame:
    """(h): the distinct hashes of non-null raws; a hot raw is combined map-side."""
    return rows.where(F.col("raw").isNotNull()).select(F.xxhash64("raw").alias("h")).distinct()


def first_arrivals(arrivals: DataFrame) -> DataFrame:
    """Per distinct raw its first arrival; a hot raw is combined map-side to one row a task."""
    return arrivals.where(F.col("raw").isNotNull()).groupBy("raw").agg(F.min("arrival_no").alias("arrival_no"))


def judge(tables: KeyTables, arrivals: DataFrame, stored: DataFrame, insert: DataFrame | None = None) -> DataFrame:
    """(arrival_no, alarm): the arrivals whose raw has not occurred before, ``alarm`` where the tables had said 'maybe'.

    ``arrivals``: unique arrival_no and raw. ``stored`` (raw): every key that was put into the tables before, or is put into
    them now by ``insert`` (h). The tables judge the first arrival of every distinct hash. They never forget a key, so
    'new' is final; every other first arrival of a raw is looked up in ``stored``, of which only rows with a
    suspect's hash are moved as long as those hashes are few enough to be broadcast.
    """
    first = checkpointed(first_arrivals(arrivals).withColumn("h", F.xxhash64("raw")))
    said = tables.run(arrivals=first.groupBy("h").agg(F.min("arrival_no").alias("arrival_no")), insert=insert)
    asked = first.join(said, "arrival_no", "left")  # no row: equal hash, so maybe
    asked = checkpointed(asked.withColumn("maybe", F.coalesce("maybe", F.lit(True))))
    suspects = asked.where("maybe")
    hashes, few = bounded(suspects.select("h").distinct())
    known = stored.where(F.col("raw").isNotNull()).select("raw")
    if few:
        known = known.withColumn("h", F.xxhash64("raw")).join(hashes, "h", "left_semi").select("raw")
    alarms = checkpointed(suspects.join(known.distinct(), "raw", "left_anti").select("arrival_no", "h"))
    tables.owe(alarms)
    new = asked.where("not maybe").select("arrival_no", F.lit(False).alias("alarm"))
    return checkpointed(new.unionByName(alarms.select("arrival_no", F.lit(True).alias("alarm"))))


def judge_arrivals(entries: DataFrame, arrivals: DataFrame, *, path: str | None = None, first_size: int | None = None, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seen, counts, rates): arrivals whose raw occurred before, and one row each of exact and of measured figures.

    ``entries`` needs ``raw``; ``arrivals`` needs ``raw`` and a unique ``arrival_no``. Null raws are never judged and
    never seen; an empty raw is a key like any other; equality is byte for byte. Other columns are ignored.

    Two runs over kept tables: the first inserts the keys of ``entries`` and judges the first nine tenths of the arrivals
    by number; the second loads the tables and judges the rest. ``first_size``: keys a partition is first made for (default:
    from the number of entries). Plan: seen = arrivals minus the first arrivals proved new, an anti-join on the unique
    arrival_no, so a hot key never meets in one task.
    """
    spark = entries.sparkSession
    arrivals, stored = arrivals.select("arrival_no", "raw"), entries.select("raw")
    tables = KeyTables(spark, path or scratch(spark, "keys"), stored.count(), first_size=first_size, bits=bits)
    cut = arrivals.agg(F.max("arrival_no").alias("m")).first()["m"] or 0
    early, late = (arrivals.where(x) for x in (F.col("arrival_no") <= cut * 9 // 10, F.col("arrival_no") > cut * 9 // 10))
    new = judge(tables, early, stored, key_hashes(stored))
    new = new.unionByName(judge(tables, late, stored.unionByName(early.select("raw"))))
    seen = arrivals.where(F.col("raw").isNotNull()).join(new, "arrival_no", "left_anti").select("arrival_no")
    judged = arrivals.agg(F.count("raw").alias("judged"), F.count(F.when(F.col("raw").isNull(), 1)).alias("not_judged"))
    counts = judged.crossJoin(new.agg(F.count(F.lit(1)).alias("new_keys")))  # two single rows
    wrong = new.agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("alarm"), 1)).alias("false_maybe"))
    rates = wrong.crossJoin(tables.figures())
    rate = F.when(F.col("_n") > 0, F.col("false_maybe") / F.col("_n")).otherwise(0.0)
    return seen, counts, rates.select("false_maybe", rate.alias("wrong_rate"), "parts", "tables", "stored")


def judge_after_merge(entries: DataFrame, live: DataFrame, arrivals: DataFrame, *, path: str | None = None) -> DataFrame:
    """(arrival_no) of arrivals whose raw is in a live table or arrived before, from tables that first held all entries.

    ``live``: (store, table_id). Keys that only dead tables hold are deleted from the kept tables, then all arrivals are
    judged. Nulls as in ``judge_arrivals``.
    """
    spark = entries.sparkSession
    tables = KeyTables(spark, path or scratch(spark, "keys"), entries.count())
    tables.run(insert=key_hashes(entries))
    kept = live_entries(entries, live).select("raw")
    tables.run(delete=key_hashes(entries).join(key_hashes(kept), "h", "left_anti"))
    arrivals = arrivals.select("arrival_no", "raw")
    new = judge(tables, arrivals, kept)
    return arrivals.where(F.col("raw").isNotNull()).join(new, "arrival_no", "left_anti").select("arrival_no")
