"""The service layer: requests and responses as plain dictionaries, one plan per query or walk through its pages."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodoc.model import InvalidRequest, SequenceTooLow, Snapshot, StoreError, UniqueViolation, UnknownSnapshot
from chronodoc.operators import paging, versions
from chronodoc.operators.indexes import by_index
from chronodoc.sources.store import Op, Store, id_text

#: fixed value: what a collection may be called
COLLECTION_NAME = re.compile(r"^[A-Za-z0-9._-]{1,128}$")
#: Walks through pages of which rows read ahead are held, the latest ones.
WALKS = 4


def problem(title: str, status: int, detail: str | None = None) -> dict:
    return {"type": "about:blank", "title": title, "status": status, "detail": detail, "instance": None}


class AdminService:
    """Records are ``{id, data, version?}``; answers add ``sequence`` and ``deleted``. ``secret`` signs page tokens."""

    def __init__(self, store: Store, secret: str | None = None):
        self.store, self.secret = store, secret
        self.snapshots: dict[str, Snapshot] = {}
        self._walks: list[tuple[tuple, paging.Walk]] = []

    # -- health and catalog ---------------------------------------------------------------------------

    def health(self) -> dict:
        return {"status": "ok", "sequence": self.store.sequence}

    def status(self) -> dict:
        """One scan of the store counts the live documents of all collections."""
        names = self.store.list_collections()
        live = versions.state_as_of(self.store.rows(), keys=("collection", "id")).groupBy("collection").count()
        counts = {r["collection"]: r["count"] for r in live.collect()}
        return {"sequence": self.store.sequence, "collections": [{"name": n, "recordsApprox": counts.get(n, 0)} for n in names]}

    def metrics(self, prometheus: bool = False) -> dict | str:
        m = self.store.metrics.snapshot()
        if not prometheus:
            return m
        return "".join(f"# TYPE chronodoc_{k}_total counter\nchronodoc_{k}_total {v}\n" for k, v in m.items())

    def list_collections(self, page_size: int = 0, page_token: str | None = None) -> dict:
        names, cursor = paging.list_page(self.store.list_collections(), page_size, self._open(page_token))
        return {"items": names, "nextPageToken": self._close(cursor)}

    def create_collection(self, name: str) -> dict:
        if not COLLECTION_NAME.match(name):
            raise InvalidRequest(f"{name!r} is no collection name")
        self.store.create_collection(name)
        return {"name": name}

    def drop_collection(self, name: str) -> dict:
        return {"name": name, "deleted": self.store.clear_collection(name)}

    def define_index(self, collection: str, definition: dict) -> dict:
        self.store.define_index(collection, definition["name"], definition["kind"], definition.get("keyPath"))
        return definition

    def list_index_names(self, collection: str) -> list[str]:
        return [d["name"] for d in self.store.index_definitions(collection)]

    def list_index_definitions(self, collection: str, page_size: int = 0, page_token: str | None = None) -> dict:
        defs = {d["name"]: {"name": d["name"], "kind": d["kind"], "keyPath": d["path"] or d["name"]} for d in self.store.index_definitions(collection)}
        names, cursor = paging.list_page(list(defs), page_size, self._open(page_token))
        return {"items": [defs[n] for n in names], "nextPageToken": self._close(cursor)}

    def rebuild_dynamic_indexes(self) -> int:
        """Indexes are derived at query time, so nothing is rebuilt; returns how many there are."""
        return sum(len(v) for v in self.store.manifest["indexes"].values())

    # -- records --------------------------------------------------------------------------------------

    def put_record(self, collection: str, record: dict) -> dict:
        self.store.collection(collection).put(record["id"], _stored(record), record.get("version"))
        return self.get_record(collection, record["id"])

    def get_record(self, collection: str, id: str, snapshot_id: str | None = None, *, deleted: bool = False) -> dict | None:
        log = versions.at(self.store.collection(collection).log(), self._snapshot(snapshot_id))
        row = log.where(F.col("id") == id_text(id)).orderBy(F.col("seq").desc()).first()
        return _record(row) if row and (deleted or not row["deleted"]) else None

    def delete_record(self, collection: str, id: str) -> dict:
        return {"id": id, "deleted": True, "sequence": self.store.collection(collection).delete(id)}

    # -- queries --------------------------------------------------------------------------------------

    def query(self, collection: str, query: dict, snapshot_id: str | None = None) -> dict:
        """``{type: byId | indexEquals | scan, ...}`` to ``{items, nextPageToken}``."""
        kind, snapshot = query.get("type"), self._snapshot(snapshot_id)
        if kind == "byId":
            one = self.get_record(collection, query["id"], snapshot_id)
            return {"items": [one] if one else [], "nextPageToken": None}
        coll, index, extracted = self.store.collection(collection), None, None
        if kind == "indexEquals":
            index, asked = coll.index(query["index"]), query["key"]
            extracted = self.store._extracted.get((collection, index.name))
            rows = lambda: by_index(coll.log(), index, asked, snapshot)
            size, token = query.get("pageSize"), query.get("pageToken")
        elif kind == "scan":
            asked = query.get("prefix")
            rows = lambda: versions.state_as_of(coll.log().where(F.col("id").startswith(id_text(asked)[:-1])) if asked else coll.log(), snapshot)
            size, token = query.get("limit"), query.get("startAfter")
        else:
            raise InvalidRequest(f"unknown query type {kind!r}")
        after = self._open(token)
        about = (self.store.version, snapshot, collection, kind, index and index.name, extracted, repr(asked))
        page = self._walk(about, rows).page(size, after)
        return {"items": [_record(r) for r in page.items], "nextPageToken": self._close(page.next_cursor)}

    def _walk(self, about: tuple, rows: Callable[[], DataFrame]) -> paging.Walk:
        """The walk that earlier pages of the same query began. The version of the store is part of ``about``: what a
        version holds does not change, and any commit begins a new walk."""
        for i, (known, walk) in enumerate(self._walks):
            if known == about:
                self._walks = [*self._walks[:i], *self._walks[i + 1 :], (known, walk)]
                return walk
        name = F.get_json_object("id", "$")
        named = rows().withColumn("name", F.when(F.col("id").startswith('"'), F.from_json(F.concat(F.lit("["), "id", F.lit("]")), "array<string>")[0]).otherwise(name))
        walk = paging.Walk(named.select("id", "seq", "deleted", "value", "version", "name"), "name")
        self._walks = [*self._walks[1 - WALKS :], (about, walk)]
        return walk

    # -- transactions ---------------------------------------------------------------------------------

    def commit_transaction(self, tx: dict) -> dict:
        """All operations or none, index definitions included, in one commit.
        ``{operations: [{op: put|delete|defineIndex, ...}], requireSequenceAtLeast?}``."""
        ops, define, results = [], [], []
        for i, op in enumerate(tx["operations"]):
            result = {"opIndex": i, "status": "ok"}
            if op["op"] == "put":
                r = op["record"]
                ops.append(Op(op["collection"], r["id"], _stored(r), r.get("version")))
                result["record"] = r | {"sequence": self.store.sequence + len(ops), "deleted": False}
            elif op["op"] == "delete":
                ops.append(Op(op["collection"], op["id"]))
            elif op["op"] == "defineIndex":
                d = op["index"]
                define.append((op["collection"], {"name": d["name"], "kind": d["kind"], "path": d.get("keyPath")}))
            else:
                raise InvalidRequest(f"unknown operation {op['op']!r}")
            results.append(result)
        try:
            self.store.batch(ops, tx.get("requireSequenceAtLeast"), define=define)
        except UniqueViolation as e:
            return self._failed(problem("unique constraint", 409, f"key {e.key} of index {e.index} is taken"))
        except SequenceTooLow as e:
            return self._failed(problem("conflict", 409, f"the store is at {e.current}, {e.required} was asked for"))
        except StoreError as e:
            return self._failed(problem("commit", 500, str(e)))
        return {"committedSequence": self.store.sequence, "results": results}

    def _failed(self, why: dict) -> dict:
        return {"committedSequence": self.store.sequence, "results": [{"opIndex": -1, "status": "error", "error": why}]}

    # -- snapshots, backups, compaction ---------------------------------------------------------------

    def create_snapshot(self) -> dict:
        key = str(uuid.uuid4())
        self.snapshots[key] = self.store.snapshot()
        return {"id": key, "sequence": self.store.sequence}

    def release_snapshot(self, key: str) -> bool:
        return self.snapshots.pop(key, None) is not None

    def _snapshot(self, key: str | None) -> Snapshot | None:
        if key is None:
            return None
        if key not in self.snapshots:
            raise UnknownSnapshot(key)
        return self.snapshots[key]

    def create_backup(self, note: str | None = None) -> dict:
        return self.store.create_backup(note)

    def list_backups(self, page_size: int = 0, page_token: str | None = None) -> dict:
        """Newest first; the token is the id of the last one seen."""
        refs = sorted(self.store.list_backups(), key=lambda b: (b["createdAt"], b["id"]), reverse=True)
        after = self._open(page_token)
        if after is not None:
            at = [i for i, b in enumerate(refs) if b["id"] == after]
            refs = refs[at[0] + 1 :] if at else []
        page = refs[:page_size] if page_size > 0 else refs
        return {"items": page, "nextPageToken": self._close(page[-1]["id"]) if len(page) < len(refs) else None}

    def restore_backup(self, id: str) -> None:
        self.store.restore_backup(id)

    def compaction_status(self) -> dict:
        return self.store.compaction_status()

    def compaction_run(self) -> dict:
        self.store.compact()
        return self.store.compaction_status()

    def _open(self, token: str | None) -> str | None:
        return None if token is None else paging.unseal(token, self.secret)

    def _close(self, cursor: str | None) -> str | None:
        return None if cursor is None else paging.seal(cursor, self.secret)


def _stored(record: dict) -> Any:
    if record.get("data") is None:
        raise InvalidRequest("a record needs data; use delete to remove it")
    return record["data"]


def _record(row) -> dict:
    data = None if row["value"] is None else json.loads(row["value"])
    return {"id": json.loads(row["id"]), "data": data, "version": row["version"], "sequence": row["seq"], "deleted": row["deleted"]}
