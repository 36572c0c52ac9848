"""Batches of puts and deletes against a version log, set-based."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronodoc.operators.indexes import Index, postings, violations
from chronodoc.operators.versions import state_as_of
from chronodoc.session import checkpointed

ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition in the lower 33 bits


def dense_sequence(rows: DataFrame, order: str, base: int, name: str = "seq") -> DataFrame:
    """Adds base + 1, base + 2, ... without gaps in the given order, without gathering rows in one task.

    Range partitions are numbered inside and shifted by the sizes of the partitions before them; the layout is
    checkpointed first, so a lost executor cannot change it in between.
    """
    laid = checkpointed(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", ROW_BITS).cast("int")
    sizes = laid.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("_p", before.alias("_before")))
    inside = F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    joined = laid.join(shifts, part == F.col("_p"))
    return joined.withColumn(name, (F.lit(base) + F.col("_before") + inside + 1).cast("long")).drop("_id", "_p", "_before")


def apply_batch(log: DataFrame, ops: DataFrame, base: int) -> DataFrame:
    """The log after a batch. ``ops``: op_index, id, deleted and the log's value columns; applied in op_index order."""
    rows = dense_sequence(ops, "op_index", base)
    return log.unionByName(rows.select(*log.columns))


def batch_conflicts(log: DataFrame, ops: DataFrame, index: Index, base: int) -> DataFrame:
    """(key, n_ids) that would break a unique index once the whole batch is applied in order.

    Only the final state counts, so a key released by one operation may be claimed by another of the batch. Keys
    that were in conflict before are reported only if the batch touches one of their holders.
    """
    return conflicts_after(log, dense_sequence(ops, "op_index", base).select(*log.columns), index)


def conflicts_after(log: DataFrame, rows: DataFrame, index: Index) -> DataFrame:
    """``batch_conflicts`` of rows that have their sequence already (same columns as ``log``)."""
    after = state_as_of(log.unionByName(rows))
    touched = postings(after.join(rows.select("id").distinct(), "id", "left_semi"), index).select("key").distinct()
    return violations(after, index).join(touched, "key", "left_semi")
