"""A persistent versioned document store: immutable Parquet files listed by a commit log."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodoc.functions.jsonpath import json_strings
from chronodoc.functions.text import Analyzer, default_analyzer, stopword_analyzer
from chronodoc.model import InvalidRequest, LogEvent, Metrics, SequenceTooLow, Snapshot, StoreOptions, UniqueViolation, UnknownIndex
from chronodoc.operators import fulltext, indexes, knn, scans, versions
from chronodoc.operators.batch import conflicts_after, dense_sequence
from chronodoc.operators.indexes import Index
from chronodoc.session import BROADCAST_ROWS, bounded, checkpointed, hadoop
from chronodoc.sources.commitlog import Base, CommitConflict, CommitLog

ROWS = "collection string, id string, seq long, deleted boolean, value string, version string"
LEVEL_BASE = 256 * 1024
FREE_SMALL_TABLES = 4
#: Most collections of one bulk load.
MAX_COLLECTIONS = 10_000


@dataclass(frozen=True)
class Op:
    """One operation of a batch. ``value`` None deletes."""

    collection: str
    id: Any
    value: dict | None = None
    version: str | None = None


def _as_log(rows: DataFrame) -> DataFrame:
    return rows.select("id", "seq", "deleted", "value", "version", F.col("id").alias("id_json"))


def id_text(id: Any) -> str:
    """JSON text of an id: its identity and its place in scan order."""
    return json.dumps(id, ensure_ascii=False, separators=(",", ":"))


def table_levels(sizes: DataFrame, size: str = "size_bytes") -> DataFrame:
    """(level, tables, size_bytes): tables by size class, level = floor(log2(size / 256 KiB)), at least 0."""
    steps = F.greatest(F.lit(1), F.floor(F.coalesce(F.col(size), F.lit(0)) / LEVEL_BASE)).cast("long")
    level = (F.length(F.bin(steps)) - 1).cast("int")
    return sizes.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum(size), F.lit(0)).alias("size_bytes"))


class Store:
    """All collections under one path.

    A commit appends one set of immutable files and one manifest ``{sequence, files, indexes, collections}``; readers see
    the files of the newest manifest, so unfinished writes are invisible. Of two concurrent
    writers one gets ``CommitConflict`` and has written nothing visible. The sequence is the highest committed one,
    also after a crash. A collection is listed from its first write or its creation until it is dropped.
    """

    def __init__(self, spark: SparkSession, options: StoreOptions | str):
        self.spark = spark
        self.options = StoreOptions(options) if isinstance(options, str) else options
        self.path = self.options.path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")
        self.metrics = Metrics()
        self._extracted: dict[tuple[str, str], Index] = {}
        self._analyzers: dict[tuple[str, str], Analyzer] = {}
        self.refresh()

    # -- state ----------------------------------------------------------------------------------------

    def refresh(self) -> None:
        """Read the newest manifest, as another handle may have committed."""
        self._base = self.log.begin()
        self.version = self._base.version
        self.manifest = self._base.content or {"sequence": 0, "files": [], "indexes": {}, "collections": []}

    @property
    def sequence(self) -> int:
        return self.manifest["sequence"]

    def snapshot(self) -> Snapshot:
        return Snapshot(self.sequence)

    def rows(self) -> DataFrame:
        files = [f"{self.path}/data/{f['name']}" for f in self.manifest["files"]]
        return self.spark.read.schema(ROWS).parquet(*files) if files else self.spark.createDataFrame([], ROWS)

    def collection(self, name: str) -> Collection:
        return Collection(self, name)

    def list_collections(self) -> list[str]:
        """Names written to or created and not dropped since, sorted; no data are read."""
        return sorted(self.manifest["collections"])

    def _tell(self, event: LogEvent, metric: str, n: int = 1) -> None:
        self.metrics.hit(metric, n)
        if self.options.logger:
            self.options.logger(event)

    # -- writes ---------------------------------------------------------------------------------------

    def _publish(self, changes: dict) -> None:
        """Commit under the number after the manifest this handle has read; anyone's commit since then is a conflict."""
        content = self.manifest | changes
        self.version = self.log.commit(self._base.number, content)
        self._base, self.manifest = Base(self.version, content, self.version + 1), content

    def _write(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.select(*[f.split()[0] for f in ROWS.split(", ")]).write.parquet(f"{self.path}/data/{name}")
        fs, p = hadoop(self.spark, f"{self.path}/data/{name}")
        return {"name": name, "bytes": fs.getContentSummary(p).getLength()}

    def _append(self, rows: DataFrame, n: int, names: Sequence[str] = (), **changes) -> None:
        new = self._write(rows)
        listed = changes.pop("collections", sorted({*self.manifest["collections"], *names}))
        self._publish({"sequence": self.sequence + n, "files": [*self.manifest["files"], new], "collections": listed} | changes)

    def batch(self, ops: Sequence[Op], require_sequence_at_least: int | None = None, *, define: Sequence[tuple[str, dict]] = ()) -> int:
        """Apply all operations and index definitions or none, in one commit; returns the store's sequence. An empty
        batch does nothing.

        Unique indexes, also those defined here, must hold once the whole batch is applied in order. Deleting what is not
        there is allowed. Sequences are given out after validation, one per operation. ``define``: (collection,
        {name, kind, path}).
        """
        if require_sequence_at_least is not None and self.sequence < require_sequence_at_least:
            raise SequenceTooLow(require_sequence_at_least, self.sequence)
        if not ops and not define:
            return self.sequence
        catalog = self.manifest["indexes"]
        for collection, d in define:
            catalog = self._catalog_with(catalog, collection, d)
        base = self.sequence
        rows = [
            (o.collection, id_text(o.id), base + i, o.value is None, None if o.value is None else json.dumps(o.value, ensure_ascii=False), o.version)
            for i, o in enumerate(ops, 1)
        ]
        frame = self.spark.createDataFrame(rows, ROWS).coalesce(1)
        names = list(dict.fromkeys(o.collection for o in ops))
        for name in names:
            self._validate(name, frame, self._indexes(catalog, name))
        for name, d in define:
            if d["kind"] == "unique" and name not in names:
                indexes.check_unique(versions.state_as_of(Collection(self, name).log()), self._make(name, d))
        for name in names:  # documents the batch does not touch count for a new index
            for d in [d for c, d in define if c == name and d["kind"] == "unique"]:
                log = Collection(self, name).log()
                after = log.unionByName(_as_log(frame.where(F.col("collection") == name)))
                indexes.check_unique(versions.state_as_of(after), self._make(name, d))
        if ops:
            self._append(frame, len(ops), [*names, *[c for c, _ in define]], indexes=catalog)
        else:
            self._publish({"indexes": catalog, "collections": sorted({*self.manifest["collections"], *[c for c, _ in define]})})
        if len(ops) > 1:
            for name in names:
                self._tell(LogEvent("batch", name, count=sum(o.collection == name for o in ops)), "batches", 0)
            self.metrics.hit("batches")
        return self.sequence

    def _validate(self, collection: str, rows: DataFrame, defined: Sequence[Index]) -> None:
        """Raise if rows (with sequence) of the collection break one of its unique indexes."""
        unique = [i for i in defined if i.kind == "unique"]
        if not unique:
            return
        log = Collection(self, collection).log()
        mine = _as_log(rows.where(F.col("collection") == collection))
        for index in unique:
            broken = conflicts_after(log, mine, index).orderBy("key").limit(1).collect()
            if broken:
                raise UniqueViolation(index.name, broken[0]["key"])

    def load(self, docs: DataFrame, order: str) -> int:
        """Bulk append of a frame (collection, id JSON text, deleted, value, version) in the given order.

        All or nothing, as ``batch``: unique indexes must hold once everything is applied. The frame is evaluated once.
        """
        rows = checkpointed(dense_sequence(docs, order, self.sequence))
        per_name = rows.groupBy("collection").count().limit(MAX_COLLECTIONS + 1).collect()  # one row a collection
        if len(per_name) > MAX_COLLECTIONS:
            raise InvalidRequest(f"more than {MAX_COLLECTIONS} collections")
        for r in per_name:
            self._validate(r["collection"], rows, self.indexes(r["collection"]))
        n = sum(r["count"] for r in per_name)
        if n:
            self._append(rows, n, [r["collection"] for r in per_name])
        return self.sequence

    def drop_collection(self, name: str) -> None:
        """Forget the collection and its indexes; its documents stay and are found again once it is written to or
        read by name."""
        catalog = {k: v for k, v in self.manifest["indexes"].items() if k != name}
        self._publish({"indexes": catalog, "collections": [c for c in self.manifest["collections"] if c != name]})

    def clear_collection(self, name: str) -> int:
        """Delete every live document and drop the collection, in one commit; returns how many were live."""
        live = versions.state_as_of(self.rows().where(F.col("collection") == name)).select("id")
        rows = checkpointed(dense_sequence(live, "id", self.sequence))
        gone = rows.select(F.lit(name).alias("collection"), "id", "seq", F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("version"))
        catalog = {k: v for k, v in self.manifest["indexes"].items() if k != name}
        n = rows.count()
        self._append(gone, n, indexes=catalog, collections=[c for c in self.manifest["collections"] if c != name])
        return n

    def create_collection(self, name: str) -> None:
        if name not in self.manifest["collections"]:
            self._publish({"collections": sorted([*self.manifest["collections"], name])})

    # -- indexes --------------------------------------------------------------------------------------

    def define_index(
        self, collection: str, name: str, kind: str, path: str | None = None, extractor: Callable | None = None, analyzer: dict | Analyzer | None = None
    ) -> None:
        """Upsert by name. ``path`` is a JSON path (default: the name); an ``extractor`` (frame to column) lives as
        long as this handle. ``analyzer`` of an fts index: None for the default one, ``{"stopwords": [...]}``, or a function
        of a column, which lives as long as this handle. A unique index over present duplicates raises and is not kept."""
        d = {"name": name, "kind": kind, "path": path}
        if callable(analyzer):
            self._analyzers[collection, name] = analyzer
            d["analyzer"] = "custom"
        elif analyzer:
            d["analyzer"] = {"stopwords": sorted(set(analyzer["stopwords"]))}
        catalog = self._catalog_with(self.manifest["indexes"], collection, d)
        if extractor:
            self._extracted[collection, name] = Index.extracted(name, extractor, kind)
        if kind == "unique":
            indexes.check_unique(versions.state_as_of(Collection(self, collection).log()), self._make(collection, d))
        self._publish({"indexes": catalog, "collections": sorted({*self.manifest["collections"], collection})})

    @staticmethod
    def _catalog_with(catalog: dict, collection: str, d: dict) -> dict:
        if d["kind"] not in indexes.KINDS:
            raise InvalidRequest(f"unknown index kind {d['kind']!r}")
        return catalog | {collection: [*[x for x in catalog.get(collection, []) if x["name"] != d["name"]], d]}

    def _make(self, collection: str, d: dict) -> Index:
        return self._extracted.get((collection, d["name"])) or Index.at_path(d["name"], d["path"] or d["name"], d["kind"])

    def index_definitions(self, collection: str) -> list[dict]:
        return sorted(self.manifest["indexes"].get(collection, []), key=lambda d: d["name"])

    def _indexes(self, catalog: dict, collection: str) -> list[Index]:
        return [self._make(collection, d) for d in sorted(catalog.get(collection, []), key=lambda d: d["name"])]

    def indexes(self, collection: str) -> list[Index]:
        return self._indexes(self.manifest["indexes"], collection)

    def definition(self, collection: str, name: str, kind: str) -> dict:
        for d in self.index_definitions(collection):
            if d["name"] == name and d["kind"] == kind:
                return d
        raise UnknownIndex(f"{collection} has no {kind} index {name!r}")

    def analyzer(self, collection: str, d: dict) -> Analyzer:
        spec = d.get("analyzer")
        if spec == "custom":
            if (collection, d["name"]) not in self._analyzers:
                raise UnknownIndex(f"the analyzer of index {d['name']!r} is not known to this handle; define it again")
            return self._analyzers[collection, d["name"]]
        return stopword_analyzer(spec["stopwords"]) if spec else default_analyzer

    # -- backup and upkeep ----------------------------------------------------------------------------

    def create_backup(self, note: str | None = None) -> dict:
        """Pin the present files under an id; they are immutable, so nothing is copied."""
        ref = {"id": uuid.uuid4().hex, "createdAt": dt.datetime.now(dt.timezone.utc).isoformat(), "note": note, "sizeBytes": sum(f["bytes"] for f in self.manifest["files"])}
        backups = [*self.manifest.get("backups", []), ref | {"manifest": {k: self.manifest[k] for k in ("sequence", "files", "indexes", "collections")}}]
        self._publish({"backups": backups})
        return ref

    def list_backups(self) -> list[dict]:
        """Oldest first."""
        refs = [{k: v for k, v in b.items() if k != "manifest"} for b in self.manifest.get("backups", [])]
        return sorted(refs, key=lambda b: (b["createdAt"], b["id"]))

    def restore_backup(self, id: str) -> None:
        """Make the backup's files current. Sequence numbers go on from the highest ever given out."""
        for b in self.manifest.get("backups", []):
            if b["id"] == id:
                epoch = self.manifest.get("epoch", 0) + 1  # stored text indexes of the time before do not hold any more
                self._publish(b["manifest"] | {"sequence": max(self.sequence, b["manifest"]["sequence"]), "epoch": epoch})
                return
        raise InvalidRequest(f"no backup {id!r}")

    def compaction_status(self) -> dict:
        sizes = [(f["name"], f["bytes"]) for f in self.manifest["files"]]
        levels = table_levels(self.spark.createDataFrame(sizes, "file string, size_bytes long")).orderBy("level").collect()
        small = sorted(s for _, s in sizes if s < 2 * LEVEL_BASE)
        debt = sum(small[FREE_SMALL_TABLES:]) if len(small) > FREE_SMALL_TABLES else 0
        rows = [{"level": r["level"], "tables": r["tables"], "sizeBytes": r["size_bytes"]} for r in levels]
        return {"running": False, "pendingTables": max(0, len(sizes) - 1), "levels": rows, "debtBytes": debt}

    def compact(self, *, retain_from: int | None = None, small_bytes: int = 16 << 20, target_bytes: int = 128 << 20) -> None:
        """Rewrite the sets of files below ``small_bytes`` as one, sorted by (collection, id, seq); larger sets stay as they
        are. Every version is kept, unless ``retain_from`` names a sequence: versions no snapshot at or after it can
        see are then dropped, which rewrites everything."""
        everything = retain_from is not None
        todo = [f for f in self.manifest["files"] if everything or f["bytes"] < small_bytes]
        if len(todo) < 2 and not everything or not todo:
            return
        rows = self.spark.read.schema(ROWS).parquet(*[f"{self.path}/data/{f['name']}" for f in todo])
        rows = rows.distinct()
        if everything:
            old = versions.state_as_of(rows, retain_from, keys=("collection", "id"))
            rows = old.unionByName(rows.where(F.col("seq") > retain_from))
        n = max(1, -(-sum(f["bytes"] for f in todo) // target_bytes))
        order = ("collection", "id", "seq")
        new = self._write(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
        names = {f["name"] for f in todo}
        self._publish({"files": [*[f for f in self.manifest["files"] if f["name"] not in names], new]})

    def vacuum(self) -> int:
        """Delete files that neither the newest manifest nor a backup names; returns how many sets went."""
        self.refresh()
        kept = [self.manifest["files"], *[b["manifest"]["files"] for b in self.manifest.get("backups", [])]]
        keep = {f["name"] for files in kept for f in files}
        fs, p = hadoop(self.spark, f"{self.path}/data")
        gone = 0
        for status in fs.listStatus(p) if fs.exists(p) else []:
            if status.getPath().getName() not in keep:
                gone += bool(fs.delete(status.getPath(), True))
        return gone


class Collection:
    """Reads and writes of one collection. Reads return frames with id (JSON text), seq, value (JSON) and version."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name

    def log(self) -> DataFrame:
        return _as_log(self.store.rows().where(F.col("collection") == self.name))

    def _tell(self, kind: str, metric: str, index: str | None = None) -> None:
        self.store._tell(LogEvent(kind, self.name, index), metric)

    def put(self, id: Any, value: dict, version: str | None = None) -> int:
        self._tell("put", "puts")
        return self.store.batch([Op(self.name, id, value, version)])

    def delete(self, id: Any) -> int:
        self._tell("delete", "deletes")
        return self.store.batch([Op(self.name, id)])

    def batch(self, ops: Sequence[tuple[Any, dict | None]], require_sequence_at_least: int | None = None) -> int:
        return self.store.batch([Op(self.name, i, v) for i, v in ops], require_sequence_at_least)

    def get(self, id: Any, snapshot: Snapshot | None = None) -> dict | None:
        self._tell("get", "gets")
        row = versions.get(self.log(), id_text(id), snapshot).first()
        return json.loads(row["value"]) if row else None

    def history(self, id: Any, snapshot: Snapshot | None = None) -> list[tuple[int, dict | None]]:
        self._tell("history", "histories")
        rows = versions.history(self.log(), id_text(id), snapshot).collect()
        return [(r["seq"], None if r["deleted"] else json.loads(r["value"])) for r in rows]

    def last_sequence(self, id: Any, snapshot: Snapshot | None = None) -> int | None:
        return versions.last_sequence(self.log(), id_text(id), snapshot).first()["last_seq"]

    def scan(self, prefix: str | None = None, limit: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """``prefix`` is a prefix of the id: of its text for strings, of its digits for numbers."""
        self._tell("scan", "scans")
        log = self.log()
        if prefix:
            log = log.where(F.col("id_json").startswith(prefix) | F.col("id_json").startswith(id_text(prefix)[:-1]))
        return scans.scan(log, None, limit, snapshot, default_limit=self.store.options.default_scan_limit)

    def index(self, name: str) -> Index:
        for i in self.store.indexes(self.name):
            if i.name == name:
                return i
        raise UnknownIndex(f"{self.name} has no index {name!r}")

    def by_index(self, name: str, equals: str, snapshot: Snapshot | None = None) -> DataFrame:
        self._tell("indexLookup", "indexLookups", name)
        self.store.metrics.hit("gets")
        return indexes.by_index(self.log(), self.index(name), equals, snapshot)

    def scan_index(self, name: str, prefix: str = "", limit: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        self._tell("indexLookup", "indexLookups", name)
        return indexes.scan_index(self.log(), self.index(name), prefix, limit, snapshot, default_limit=self.store.options.default_scan_limit)

    def _text(self, df: DataFrame, d: dict) -> DataFrame:
        """(id, _text): the field a text index covers; what is no string counts as no text."""
        path = d["path"] or d["name"]
        return df.select("id", F.array_join(json_strings(F.col("value"), path), " ").alias("_text"))

    def _text_index(self, d: dict) -> tuple[DataFrame, DataFrame]:
        """(postings, lengths) of the present documents: the stored index, with the documents changed since it was written
        taken out and indexed anew; it is written again once too many have changed."""
        store, analyzer = self.store, self.store.analyzer(self.name, d)
        spark, log = store.spark, self.log()
        if d.get("analyzer") == "custom":  # another handle may mean another function by it
            return fulltext.build_index(self._text(versions.state_as_of(log), d), "_text", analyzer)
        mark = hashlib.sha256(json.dumps([self.name, d], sort_keys=True).encode()).hexdigest()[:24]
        kept = CommitLog(spark, f"{store.path}/text/{mark}/commits")
        base, epoch = kept.begin(), store.manifest.get("epoch", 0)
        at = base.content
        if at and at["epoch"] == epoch and at["sequence"] <= store.sequence:
            changed, few = bounded(log.where(F.col("seq") > at["sequence"]).select(F.col("id").alias("_id")).distinct())
            if few:
                hit = F.col("id") == F.col("_id")
                fresh = fulltext.build_index(self._text(versions.state_as_of(log.join(changed, hit, "left_semi")), d), "_text", analyzer)
                stored = [spark.read.parquet(f"{at['path']}/{x}") for x in ("postings", "lengths")]
                return tuple(s.join(changed, hit, "left_anti").unionByName(f) for s, f in zip(stored, fresh, strict=True))
        path = f"{store.path}/text/{mark}/{uuid.uuid4().hex}"
        postings, lengths = fulltext.build_index(self._text(versions.state_as_of(log), d), "_text", analyzer)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # by range of (term, id): a search reads the row groups of its terms, a frequent term lies in many files
        postings.repartitionByRange(n, "term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
        lengths.write.parquet(f"{path}/lengths")
        try:
            kept.commit(base.number, {"path": path, "sequence": store.sequence, "epoch": epoch})
        except CommitConflict:  # another handle has written one too; this one is as good
            pass
        return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")

    def search_text(self, name: str, query: str, limit: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Documents whose indexed text holds all tokens of the query, with score, best first. ``name``: an fts index.

        Without a snapshot the stored index answers; a snapshot is searched directly.
        """
        d = self.store.definition(self.name, name, "fts")
        self._tell("indexLookup", "indexLookups", name)
        log, analyzer = self.log(), self.store.analyzer(self.name, d)
        if snapshot is not None:
            found = fulltext.search(self._text(versions.state_as_of(log, snapshot), d), "_text", query, limit, analyzer=analyzer)
        else:
            found = fulltext.search_index(*self._text_index(d), fulltext.query_terms(self.store.spark, query, analyzer), limit)
        found, _ = bounded(found.select(F.col("id").alias("_id"), "score"))
        hit = F.col("id") == F.col("_id")
        state = versions.state_as_of(log.join(found.select("_id"), hit, "left_semi"), snapshot)
        return state.join(found, hit).drop("_id").orderBy(F.col("score").desc(), "id")

    def vector_search(self, name: str, query: Sequence[float], k: int, metric: str = "l2", snapshot: Snapshot | None = None) -> DataFrame:
        """The k documents nearest to the query, with distance, nearest first. ``name``: a vector index, whose path names an
        array of numbers; documents without one are left out."""
        d = self.store.definition(self.name, name, "vector")
        self._tell("indexLookup", "indexLookups", name)
        state = versions.state_as_of(self.log(), snapshot)
        path = "$." + (d["path"] or d["name"]).removeprefix(".")
        state = state.withColumn("_e", F.try_variant_get(F.try_parse_json("value"), path, "array<double>"))
        found = knn.vector_search(state, "_e", query, k, metric)
        found = F.broadcast(found) if k <= BROADCAST_ROWS else found
        return state.drop("_e").join(found, "id").orderBy("distance", "id")  # found: k rows

    def documents(self, schema: str, snapshot: Snapshot | None = None) -> DataFrame:
        """The live documents with typed columns. Values that do not parse raise; they never count as deleted."""
        state = versions.state_as_of(self.log(), snapshot)
        return state.select("seq", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_v")).select("seq", "_v.*")
