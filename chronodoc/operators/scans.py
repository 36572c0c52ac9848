"""Ordered scans of a state by the JSON text of its ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronodoc.model import Snapshot
from chronodoc.operators.versions import at, state_as_of
from chronodoc.session import BROADCAST_ROWS

DEFAULT_LIMIT = 100


def id_json(df: DataFrame, name: str = "id") -> Column:
    """JSON text of an id: digits for numbers, a quoted and escaped text for strings; its bytes are the order."""
    if name == "id" and "id_json" in df.columns:
        return F.col("id_json")
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(name).cast("string")
    quoted = F.to_json(F.array(F.col(name).cast("string")))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def scan(
    log: DataFrame, prefix: str | None = None, limit: int | None = None, snapshot: Snapshot | int | None = None, *, default_limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Live documents whose id text starts with ``prefix``, in order of the id text, at most ``limit``.

    No limit means ``default_limit``. For string ids the prefix is a prefix of the id itself. Plan: the first ids are found
    from (id, seq, deleted) alone, with a top-k instead of a sort, and only their versions are fetched with all
    columns; the prefix and the snapshot reach both scans.
    """
    rows = log
    if prefix:
        if dict(log.dtypes)["id"] == "string" and "id_json" not in log.columns:
            rows = rows.where(F.col("id").startswith(prefix))
        else:
            rows = rows.where(id_json(log).startswith(prefix))
    narrow = rows.select("id", "seq", "deleted", *[c for c in ("id_json",) if c in rows.columns])
    n = default_limit if limit is None else max(0, limit)
    state = state_as_of(narrow, snapshot)
    first = state.withColumn("id_json", id_json(state)).orderBy("id_json").limit(n)
    found = state_as_of(fetch(at(rows, snapshot), first, n))
    return found.withColumn("id_json", id_json(found)).orderBy("id_json").limit(n)


def fetch(rows: DataFrame, picked: DataFrame, n: int) -> DataFrame:
    """The rows with the (id, seq) of ``picked``, of which there are at most ``n``; broadcast if that bound is low enough."""
    want = picked.select(F.col("id").alias("_id"), F.col("seq").alias("_seq")).distinct()
    if n <= BROADCAST_ROWS:
        want = F.broadcast(want)
    return rows.join(want, F.col("id").eqNullSafe(F.col("_id")) & (F.col("seq") == F.col("_seq")), "left_semi")
