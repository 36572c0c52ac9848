"""Reads of a version log: rows (id, seq, deleted, value columns), one per version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronodoc.model import Snapshot


def version_log(df: DataFrame, *, id: Column, seq: Column, deleted: Column, **values: Column) -> DataFrame:
    """A table seen as a version log; value columns are null in tombstones. Null ``deleted`` counts as live."""
    gone = F.coalesce(deleted.cast("boolean"), F.lit(False))
    kept = [F.when(~F.col("deleted"), F.col(k)).alias(k) for k in values]
    named = df.select(id.alias("id"), seq.cast("long").alias("seq"), gone.alias("deleted"), *[c.alias(k) for k, c in values.items()])
    return named.select("id", "seq", "deleted", *kept)


def at(log: DataFrame, snapshot: Snapshot | int | None) -> DataFrame:
    """The versions visible at a snapshot; the comparison reaches the Parquet scan. None: all."""
    if snapshot is None:
        return log
    return log.where(F.col("seq") <= F.lit(snapshot.sequence if isinstance(snapshot, Snapshot) else snapshot))


def state_as_of(log: DataFrame, snapshot: Snapshot | int | None = None, *, keys: tuple[str, ...] = ("id",), tombstones: bool = False) -> DataFrame:
    """The last visible version of every id, deleted ids left out unless ``tombstones``.

    Repeated rows of one version are one version. Versions of one sequence are told apart as in
    ``changes.fold_changes``: a live one before a tombstone, then the largest values (columns in order, null the
    smallest; maps are not compared). Plan: row_number = 1 becomes a group limit on both sides of
    the shuffle, so each task sends at most one row per id, however many versions a hot id has.
    """
    rest = [f.name for f in log.schema.fields if f.name not in (*keys, "seq", "deleted") and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    w = Window.partitionBy(*keys).orderBy(F.col("seq").desc(), F.col("deleted").asc(), *[F.col(f"`{c}`").desc() for c in rest])
    last = at(log, snapshot).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return last if tombstones else last.where("not deleted")


def get(log: DataFrame, id, snapshot: Snapshot | int | None = None) -> DataFrame:
    """0 or 1 row: the document at the snapshot; none if absent or deleted. Filter and top-1, no full shuffle."""
    one = at(log, snapshot).where(F.col("id") == F.lit(id)).orderBy(F.col("seq").desc()).limit(1)
    return one.where("not deleted")


def history(log: DataFrame, id, snapshot: Snapshot | int | None = None) -> DataFrame:
    """All visible versions of an id, tombstones included, oldest first."""
    return at(log, snapshot).where(F.col("id") == F.lit(id)).distinct().orderBy("seq")


def last_sequence(log: DataFrame, id, snapshot: Snapshot | int | None = None) -> DataFrame:
    """One row ``last_seq``: sequence of the last visible version, tombstones count; null if there is none."""
    return at(log, snapshot).where(F.col("id") == F.lit(id)).agg(F.max("seq").alias("last_seq"))


def store_sequence(log: DataFrame) -> DataFrame:
    """One row ``sequence``: the highest sequence of the log, 0 for an empty one."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("sequence"))
