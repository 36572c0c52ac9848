"""Incremental processing: recompute only partitions whose content fingerprint changed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronodoc.operators.changes import committed_changes, spelled
from chronodoc.session import bounded, checkpointed, hadoop
from chronodoc.sources.commitlog import Base, CommitLog

LOW = 0xFFFFFFFF


def partition_key(col: Column) -> Column:
    """A string that names a partition and keeps null, empty and any other value apart."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def fingerprints(df: DataFrame, partition: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Per partition: row count and two additive hashes over all ``columns`` (default: all, by name).

    Sums of row hashes do not depend on row order or file layout, count repeated rows as often as they
    occur, and can be added up from parts. The 64-bit row hash is summed in two 32-bit halves, which cannot
    overflow a bigint below 2**31 rows a partition. Nulls are marked by position, so a null moving from one column to
    the next changes the hash.
    """
    cols = sorted(columns or df.columns)
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in cols])
    row = F.xxhash64(*[F.col(f"`{c}`") for c in cols], nulls)
    return (
        df.select(partition.alias("pkey"), row.alias("_h"))
        .groupBy("pkey")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col("_h").bitwiseAND(F.lit(LOW))).alias("low"),
            F.sum(F.shiftrightunsigned("_h", 32)).alias("high"),
        )
    )


@dataclass
class RunReport:
    version: int
    partitions: int
    changed: int


class IncrementalTable:
    """A derived table kept up to date partition by partition under ``path``.

    Layout: ``data/run=<id>/pkey=.../*.parquet`` (results, written once and never changed), ``prints/<id>`` (per partition:
    input fingerprint and the run that wrote its results) and ``commits/`` (the commit log). A run
      1. reads the newest commit, whose successor it wants to become,
      2. fingerprints every input partition (one scan, one map-side combined aggregation) and compares with that commit,
      3. computes the results of changed and new partitions only,
      4. writes them by dynamic partition overwrite into a folder of its own and the new map of partitions beside it,
      5. commits the map under the number after the one it read.
    Step 5 replaces all changed partitions at once for every reader, as ``read`` follows the map of one commit only. A
    run that crashes before it, or loses against another writer (``CommitConflict``), has changed nothing that anyone
    reads: the next run recomputes the same partitions, so nothing is skipped and nothing repeated. Vanished
    partitions and partitions without results have no files. Partitions still held by the oldest of more than
    ``MAX_RUNS`` folders are computed anew, which bounds the number of folders a reader opens.
    """

    MAX_RUNS = 200
    LITERALS = 2_000
    PRINTS = "pkey string, n_rows long, low long, high long, run string"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self.log = CommitLog(spark, f"{path}/commits")

    def prints(self, content: dict) -> DataFrame:
        """(pkey, n_rows, low, high, run) of a commit: fingerprints of the input it was made from."""
        if not content:
            return self.spark.createDataFrame([], self.PRINTS)
        return self.spark.read.schema(self.PRINTS).parquet(f"{self.path}/prints/{content['run']}")

    def read(self, only: DataFrame | None = None, content: dict | None = None) -> DataFrame:
        """The results as of a commit (default: the newest) with ``pkey``; ``only`` (pkey) leaves all other partitions out."""
        content = self.log.latest()[1] if content is None else content
        stored = T.StructType([*self.schema.fields, T.StructField("run", T.StringType()), T.StructField("pkey", T.StringType())])
        paths = []
        for run in content.get("runs", {}):
            fs, p = hadoop(self.spark, f"{self.path}/data/run={run}")
            if fs.exists(p):
                paths.append(p.toString())
        if not paths:
            return self.spark.createDataFrame([], stored).drop("run")
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*paths)
        whole = len(content["runs"]) == 1 and content["written"] == content["partitions"]
        if only is not None or not whole:
            want = self.prints(content).select("pkey", "run")
            if only is not None:
                want = want.join(only.select("pkey"), "pkey", "left_semi")
            want, few = bounded(want)
            if few and content["partitions"] <= self.LITERALS:  # as literals they prune the partitions that are listed
                held = want.groupBy("run").agg(F.collect_set("pkey").alias("keys")).collect()  # at most LITERALS keys
                rows = rows.where(reduce(Column.__or__, [(F.col("run") == r["run"]) & F.col("pkey").isin(r["keys"]) for r in held], F.lit(False)))
            else:
                rows = rows.join(want, ["pkey", "run"], "left_semi")
        return rows.select(*self.schema.fieldNames(), "pkey")

    def run(self, prints: DataFrame, compute: Callable[[DataFrame, bool], DataFrame], *, base: Base | None = None, rebalance: bool = True) -> RunReport:
        """One run. ``prints`` are the input's fingerprints (one row per pkey); ``compute(changed, small)`` gets
        the changed pkeys (broadcast-hinted if few) and returns rows with the schema's columns and ``pkey``. Its layout
        is kept where ``rebalance`` is off. ``base``: what the caller has read of this table before (``log.begin()``)."""
        base = base or self.log.begin()
        run = f"r{base.number:012d}-{uuid.uuid4().hex[:8]}"
        old = self.prints(base.content).select("pkey", *[F.col(c).alias(f"o_{c}") for c in ("n_rows", "low", "high", "run")])
        same = F.lit(True)
        for c in ("n_rows", "low", "high"):
            same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
        aged = sorted(base.content.get("runs", {}))[: -self.MAX_RUNS]
        if aged:
            same = same & ~F.col("o_run").isin(aged)
        both = checkpointed(prints.select("pkey", "n_rows", "low", "high").join(old, "pkey", "full_outer").withColumn("_same", same))
        changed, small = bounded(both.where("not _same").select("pkey"))
        n_changed = changed.count()
        if n_changed:
            rows = compute(changed, small).select(*self.schema.fieldNames(), "pkey")
            if rebalance:  # few files per partition, hot partitions split by size at run time
                rows = rows.hint("rebalance", "pkey")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pkey").parquet(f"{self.path}/data/run={run}")
        owner = F.when(F.col("_same"), F.col("o_run")).otherwise(F.lit(run))
        now = both.where("n_rows is not null").select("pkey", "n_rows", "low", "high", owner.alias("run"))
        now.write.parquet(f"{self.path}/prints/{run}")
        held = {r["run"]: r["n"] for r in now.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per folder
        written = {**base.content.get("wrote", {}), run: held.get(run, 0)}
        content = {"run": run, "runs": held, "wrote": {r: written[r] for r in held}, "partitions": sum(held.values()), "changed": n_changed}
        content["written"] = sum(content["wrote"].values())
        self.log.commit(base.number, content)
        return RunReport(base.number, content["partitions"], n_changed)

    def vacuum(self, older_than_hours: float = 24.0) -> int:
        """Delete folders that the newest commit does not name and that are older than any running writer can be;
        returns how many went."""
        content, gone = self.log.latest()[1], 0
        keep = {f"run={r}" for r in content.get("runs", {})} | {content.get("run")}
        limit = (time.time() - older_than_hours * 3600) * 1000
        for part in ("data", "prints"):
            fs, p = hadoop(self.spark, f"{self.path}/{part}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName() not in keep and s.getModificationTime() < limit:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone


def successful_saves(saves: DataFrame) -> DataFrame:
    """Saves with outcome ``saved`` (trimmed, any case) and a saved_at; null outcomes are not successful."""
    return saves.where((spelled(F.col("outcome")) == "saved") & F.col("saved_at").isNotNull())


def save_frontier(saves: DataFrame) -> DataFrame:
    """Per store the saves that no later-or-equal save with a higher-or-equal sequence covers.

    A change is handled by some save iff it is handled by one of these, and where sequences rise with time
    there is a single one per store. Saves without started_at or sequence handle nothing.
    """
    w = Window.partitionBy("store").orderBy(F.col("started_at").desc(), F.col("sequence").desc())
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    ok = successful_saves(saves).where(F.col("started_at").isNotNull() & F.col("sequence").isNotNull())
    best = ok.groupBy("store", "started_at").agg(F.max("sequence").alias("sequence"))
    top = best.withColumn("_above", F.max("sequence").over(w))
    kept = top.where(F.col("_above").isNull() | (F.col("sequence") > F.col("_above")))
    return kept.groupBy("store").agg(F.collect_list(F.struct("started_at", "sequence")).alias("frontier"))


PENDING = T.StructType([T.StructField("store", T.StringType()), T.StructField("sequence", T.LongType())])


def pending_changes(changes: DataFrame, frontier: DataFrame) -> DataFrame:
    """(store, sequence) of committed changes that no successful save of their store has handled, once each.

    Handled: the change's sequence <= the save's and it was available strictly before the save started. Of a
    repeated frame the first arrival counts. Null sequences cannot be handled and are not changes; they are
    left out. Equal (store, sequence) of different changes (numbers used again) give one row if any is pending.
    """
    once = (
        changes.where(F.col("sequence").isNotNull())
        .groupBy("store", "sequence", "txid", "collection", "doc_key", F.xxhash64("value").alias("_v"), F.col("value").isNull().alias("_n"))
        .agg(F.min("available_at").alias("available_at"))
    )
    side, _ = bounded(frontier.select(F.col("store").alias("_s"), "frontier"))
    handled = F.exists(
        "frontier", lambda f: (f["started_at"] > F.col("available_at")) & (f["sequence"] >= F.col("sequence"))
    )
    left = once.join(side, F.col("store").eqNullSafe(F.col("_s")), "left")
    return left.where(F.col("frontier").isNull() | ~F.coalesce(handled, F.lit(False))).select("store", "sequence").distinct()


def refresh_pending(spark: SparkSession, frames: DataFrame, saves: DataFrame, path: str) -> tuple[IncrementalTable, RunReport]:
    """Bring the table of pending changes under ``path`` up to date; only stores with news are recomputed.

    A store's fingerprint adds the fingerprints of its frames and of its saves, so either kind of news counts.
    """
    key = partition_key(F.col("store"))
    frame_cols = ["store", "sequence", "frame_type", "txid", "collection", "doc_key", "value", "arrived_at"]
    save_cols = ["store", "sequence", "started_at", "saved_at", "outcome"]
    parts = fingerprints(frames, key, frame_cols).unionByName(fingerprints(saves, key, save_cols))
    prints = parts.groupBy("pkey").agg(*[F.sum(c).alias(c) for c in ("n_rows", "low", "high")])
    table = IncrementalTable(spark, path, PENDING)

    def compute(changed: DataFrame, small: bool) -> DataFrame:
        want = changed.select(F.col("pkey").alias("_p"))
        pick = lambda df: df.join(want, partition_key(F.col("store")) == F.col("_p"), "left_semi")
        rows = pending_changes(committed_changes(pick(frames)), save_frontier(pick(saves)))
        return rows.withColumn("pkey", partition_key(F.col("store")))

    return table, table.run(prints, compute)
