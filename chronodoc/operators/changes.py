"""Change feeds: which frames carry committed changes, and the commutative fold that rebuilds state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\r\n"


def spelled(col: Column) -> Column:
    """A status word without outer white space and in lower case."""
    return F.lower(F.btrim(col, F.lit(BLANK)))


def committed_changes(frames: DataFrame, *, extra: Sequence[str] = ()) -> DataFrame:
    """Frames that carry a committed change, one row per frame, with ``available_at``.

    A change is a frame typed ``op`` (any case, trimmed) or untyped whose txid is null or has a
    ``commit`` frame of the same store and txid anywhere in the input. ``available_at`` is the frame's own
    arrival or, if later, the first arrival of its commit. Repeated frames are kept; the folds below are
    idempotent. Null arrival: the change counts but is available at no known time (null). An empty
    frame_type is neither ``op`` nor null and carries nothing. Other columns of the input are ignored.

    Plan: null-txid frames never meet the join, so they form no hot key; commits are reduced to one row per
    transaction map-side before the join.
    """
    kind = spelled(F.col("frame_type"))
    keep = ["store", "sequence", "txid", "collection", "doc_key", "value", "arrived_at", *extra]
    ops = frames.where(kind.isNull() | (kind == "op")).select(*dict.fromkeys(keep))
    commits = (
        frames.where((kind == "commit") & F.col("txid").isNotNull())
        .groupBy(F.col("store").alias("_cs"), F.col("txid").alias("_ct"))
        .agg(F.min("arrived_at").alias("_ca"))
    )
    lone = ops.where(F.col("txid").isNull()).withColumn("available_at", F.col("arrived_at"))
    grouped = ops.where(F.col("txid").isNotNull()).join(
        commits, F.col("store").eqNullSafe(F.col("_cs")) & (F.col("txid") == F.col("_ct")), "inner"
    )
    later = F.when(F.col("arrived_at").isNotNull() & F.col("_ca").isNotNull(), F.greatest("arrived_at", "_ca"))
    grouped = grouped.withColumn("available_at", later).drop("_cs", "_ct", "_ca")
    return lone.unionByName(grouped)


def fold_changes(
    changes: DataFrame,
    keys: Sequence[str],
    *,
    sequence: str = "sequence",
    operation: Column | None = None,
    payload: Sequence[str] = ("value",),
    base: DataFrame | None = None,
) -> DataFrame:
    """State after all ``changes``: per key the maximum of (sequence, operation, payload).

    The maximum is commutative, associative and idempotent, so arrival order and repetition cannot matter,
    and a result can be folded again with later changes by passing it as ``base`` (same columns as the
    result). Deletions stay in the result as tombstones (``operation`` = 0): a late older insert then still
    loses against them. ``operation`` is an integer column, 0 for a deletion; by default a null or empty
    first payload column deletes. Equal sequences: an upsert (1) wins over a deletion (0), then the larger
    payload. Null sequences carry no order and are dropped. Null keys form a key of their own.

    Plan: one shuffle of map-side partial maxima, so a hot key reaches the reducer as one row per map task.
    """
    first = F.col(payload[0])
    op = operation if operation is not None else F.when(first.isNull() | (first == ""), 0).otherwise(1)
    rows = changes.where(F.col(sequence).isNotNull()).select(
        *keys, F.col(sequence).cast("long").alias("sequence"), op.cast("int").alias("operation"), *payload
    )
    if base is not None:
        rows = rows.unionByName(base.select(*keys, "sequence", "operation", *payload))
    top = F.max(F.struct("sequence", "operation", *payload)).alias("_top")
    return rows.groupBy(*keys).agg(top).select(*keys, "_top.*")


def live(state: DataFrame) -> DataFrame:
    """The rows of a folded state that are not tombstones."""
    return state.where(F.col("operation") != 0)


def current_documents(frames: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Every document a change feed leaves behind, tombstones included, with value and sequence."""
    return fold_changes(committed_changes(frames), ["store", "collection", "doc_key"], base=base)
