"""Secondary indexes as derived projections (key, id) of a state: always consistent, valid at any snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronodoc.functions.jsonpath import json_strings
from chronodoc.model import InvalidRequest, Snapshot, UniqueViolation, UnknownIndex
from chronodoc.operators.scans import DEFAULT_LIMIT, fetch, id_json
from chronodoc.operators.versions import at, state_as_of
from chronodoc.session import BROADCAST_ROWS, bounded, checkpointed

KINDS = ("unique", "multi", "fts", "vector")


@dataclass(frozen=True)
class Index:
    """``kind`` unique or multi; ``keys`` maps a DataFrame to a string or array<string> column of it."""

    name: str
    kind: str
    keys: Callable[[DataFrame], Column]

    @staticmethod
    def on(name: str, column: str, kind: str = "multi") -> Index:
        return Index(name, kind, lambda df: F.col(column))

    @staticmethod
    def extracted(name: str, extractor: Callable[[DataFrame], Column], kind: str = "multi") -> Index:
        return Index(name, kind, extractor)

    @staticmethod
    def at_path(name: str, path: str, kind: str = "multi", *, document: str = "value") -> Index:
        version = lambda df: F.col("version") if "version" in df.columns else None
        return Index(name, kind, lambda df: json_strings(F.col(document), path, id_col=F.col("id").cast("string"), version_col=version(df)))


def key_array(state: DataFrame, index: Index) -> Column:
    """Distinct non-null keys of each row as an array."""
    column = index.keys(state)
    kind = state.select(column.alias("k")).schema["k"].dataType.simpleString()
    if kind == "string":
        column = F.array(column)
    elif kind != "array<string>":
        raise InvalidRequest(f"index {index.name!r}: keys must be strings, not {kind}")
    return F.array_compact(F.array_distinct(column))


def postings(state: DataFrame, index: Index) -> DataFrame:
    """The rows of a state once per key, with the column ``key``; rows without keys drop out."""
    return state.withColumn("key", F.explode(key_array(state, index)))


def candidates(log: DataFrame, holds: Column) -> DataFrame:
    """The versions of all ids of which any version fulfils ``holds``; the condition reaches the scan of the ids.

    Only these versions have to be compared. The ids are broadcast where they are few, so that nothing else is
    shuffled; otherwise they are joined by a shuffle.
    """
    ids, _ = bounded(log.where(holds).select(F.col("id").alias("_id")).distinct())
    return log.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")


def by_index(log: DataFrame, index: Index | None, value: str, snapshot: Snapshot | int | None = None, *, strict: bool = True) -> DataFrame:
    """Documents that hold ``value`` under the index at the snapshot, in order of id.

    The key must hold in the latest visible version: documents that ever held it are picked first, then only their
    versions are compared. An unknown (None), fts or vector index raises, or finds nothing where ``strict`` is off.
    """
    if index is None or index.kind not in ("unique", "multi"):
        if strict:
            raise UnknownIndex(index.name if index else "unknown index")
        return state_as_of(log, snapshot).limit(0)
    visible = at(log, snapshot)
    column = index.keys(visible)
    plain = visible.select(column.alias("k")).schema["k"].dataType.simpleString() == "string"
    holds = column == value if plain else F.array_contains(key_array(visible, index), value)
    return state_as_of(candidates(visible, holds)).where(holds).orderBy("id")


def scan_index(
    log: DataFrame, index: Index, prefix: str = "", limit: int | None = None, snapshot: Snapshot | int | None = None, *, default_limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """(key, document) pairs with keys that start with ``prefix``, by key, then id text; the limit counts pairs.

    A document appears once per matching key. Plan: only (id, seq, deleted, keys) of documents that ever had such a key are
    compared; the top pairs then fetch their documents.
    """
    visible = at(log, snapshot)
    n = default_limit if limit is None else max(0, limit)
    narrow = visible.select("id", "seq", "deleted", key_array(visible, index).alias("_keys"), *[c for c in ("id_json",) if c in visible.columns])
    if prefix:
        narrow = candidates(narrow, F.exists("_keys", lambda k: k.startswith(prefix)))
    state = state_as_of(narrow)
    pairs = state.withColumn("key", F.explode("_keys")).where(F.col("key").startswith(prefix))
    pairs = checkpointed(pairs.withColumn("id_json", id_json(pairs)).orderBy("key", "id_json").limit(n).select("id", "seq", "key"))
    side = pairs.select(F.col("id").alias("_id"), "key")
    if n <= BROADCAST_ROWS:
        side = F.broadcast(side)
    found = state_as_of(fetch(visible, pairs, n)).join(side, F.col("id").eqNullSafe(F.col("_id"))).drop("_id")
    return found.withColumn("id_json", id_json(found)).orderBy("key", "id_json").limit(n)


def violations(state: DataFrame, index: Index) -> DataFrame:
    """(key, n_ids): keys held by more than one id. Partial counts are combined map-side."""
    held = postings(state, index).select("key", "id").distinct()
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("n_ids")).where("n_ids > 1")


def check_unique(state: DataFrame, index: Index) -> None:
    worst = violations(state, index).orderBy("key").limit(1).collect()
    if worst:
        raise UniqueViolation(index.name, worst[0]["key"])
