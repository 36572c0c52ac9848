"""Queries that go through a persistent store, its service, its files and its stream, with their SQL.

Every query builds a store of its own in the shared folder from whole input tables, works on it, and returns what a
reader finds afterwards.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodoc import api
from chronodoc.model import InvalidRequest, SequenceTooLow, StoreOptions, UniqueViolation, UnknownIndex, UnknownSnapshot
from chronodoc.operators import indexes, versions
from chronodoc.operators.changes import committed_changes
from chronodoc.operators.filteraudit import filter_audit
from chronodoc.operators.indexes import Index
from chronodoc.plans.documents import STOP, WORDS, events_log, query_into
from chronodoc.plans.tables import table
from chronodoc.service import AdminService
from chronodoc.session import scratch
from chronodoc.sources import binlog
from chronodoc.sources.store import Op, Store, id_text
from chronodoc.streaming.live import drain, live_state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = query_into(QUERIES, ORACLES)


def as_docs(df: DataFrame, collection: str, id: str, *columns: str) -> DataFrame:
    """A table as documents to load: the id's JSON text, the columns as JSON values."""
    text = F.col(id).cast("string") if dict(df.dtypes)[id] != "string" else F.expr(f"regexp_extract(to_json(array({id})), '(?s)^.(.*).$', 1)")
    value = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select(F.lit(collection).alias("collection"), text.alias("id"), F.lit(False).alias("deleted"), value.alias("value"), F.lit(None).cast("string").alias("version"), F.col(id).alias("n"))


def shop(spark: SparkSession, d: str, **options) -> Store:
    """A store with all customers, loaded in one bulk append in order of their key."""
    store = Store(spark, StoreOptions(scratch(spark, "store"), **options))
    store.load(as_docs(table(spark, d, "customer"), "customer", "c_custkey", "c_name", "c_mktsegment"), "n")
    return store


def rows_of(spark: SparkSession, d: str, name: str, *columns: str) -> list:
    """The rows of one of the two tables of fixed size (5 regions, 25 nations), in order of key."""
    return table(spark, d, name).select(*columns).orderBy(columns[0]).collect()


def live_rows(store: Store, collection: str) -> DataFrame:
    docs = versions.state_as_of(store.collection(collection).log())
    parts = [F.get_json_object("value", f"$.{c}").alias(c) for c in ("c_name", "c_mktsegment")]
    return docs.select(F.col("id").cast("long").alias("id"), "seq", *parts)


SHOP = "shop AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS seq, c_name, c_mktsegment FROM customer), n AS (SELECT count(*) AS n FROM customer)"


@query(
    f"""WITH {SHOP} SELECT id, seq, c_name, c_mktsegment FROM shop WHERE id NOT IN (1, 2)
UNION ALL SELECT -1, n + 1, 'new', 'X' FROM n UNION ALL SELECT 1, n + 2, 'changed', NULL FROM n"""
)
def store_put_delete(spark, d):
    """A put of a new document, a put over one, a deletion, and the store opened again."""
    store = shop(spark, d)
    c = store.collection("customer")
    c.put(-1, {"c_name": "new", "c_mktsegment": "X"})
    c.put(1, {"c_name": "changed"})
    c.delete(2)
    return live_rows(Store(spark, store.path), "customer")


@query(f"WITH {SHOP} SELECT seq, FALSE AS deleted FROM shop WHERE id = 1 UNION ALL SELECT n + 1, FALSE FROM n UNION ALL SELECT n + 2, TRUE FROM n UNION ALL SELECT n + 3, TRUE FROM n")
def store_history(spark, d):
    """All versions of a document of a reopened store; deleting what is deleted is allowed and counts."""
    store = shop(spark, d)
    c = store.collection("customer")
    c.put(1, {"c_name": "changed"})
    c.delete(1)
    c.delete(1)
    return versions.history(Store(spark, store.path).collection("customer").log(), id_text(1)).select("seq", "deleted")


@query(
    """SELECT 'region' AS collection, CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, row_number() OVER (ORDER BY r_regionkey) AS seq FROM region
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name, (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_nationkey) FROM nation"""
)
def store_batch(spark, d):
    """One batch over two collections, and an empty one, which takes no sequence."""
    store = Store(spark, scratch(spark, "store"))
    ops = [Op("region", r[0], {"name": r[1]}) for r in rows_of(spark, d, "region", "r_regionkey", "r_name")]
    ops += [Op("nation", r[0], {"name": r[1]}) for r in rows_of(spark, d, "nation", "n_nationkey", "n_name")]
    store.batch(ops)
    store.batch([])
    state = versions.state_as_of(Store(spark, store.path).rows(), keys=("collection", "id"))
    return state.select("collection", "id", F.get_json_object("value", "$.name").alias("name"), "seq")


@query(f"WITH {SHOP} SELECT 'guard' AS what, n + 1 AS asked, n AS held FROM n UNION ALL SELECT 'met', n, n + 1 FROM n UNION ALL SELECT 'empty', n, n + 1 FROM n")
def store_guard(spark, d):
    """A guard that is too high refuses the batch; one that is met lets it through; an empty batch changes nothing."""
    store, out = shop(spark, d), []
    n = store.sequence
    try:
        store.batch([Op("customer", 1)], require_sequence_at_least=n + 1)
    except SequenceTooLow as e:
        out.append(("guard", e.required, e.current))
    out.append(("met", n, store.batch([Op("customer", 1)], require_sequence_at_least=n)))
    out.append(("empty", n, store.batch([], require_sequence_at_least=n)))
    return spark.createDataFrame(out, "what string, asked long, held long")


@query(
    f"""WITH {SHOP} SELECT 'put' AS what, (SELECT min(c_name) FROM customer) AS key, n AS held FROM n
UNION ALL SELECT 'batch', 'twice', n FROM n UNION ALL SELECT 'load', (SELECT min(c_name) FROM customer), n FROM n UNION ALL SELECT 'moved', NULL, n + 2 FROM n"""
)
def store_unique(spark, d):
    """A unique index over all customers refuses a put, a batch and a bulk load, and lets a name move within a batch."""
    store, out = shop(spark, d), []
    store.define_index("customer", "byName", "unique", ".c_name")
    c = store.collection("customer")
    first = table(spark, d, "customer").agg(F.min("c_name")).first()[0]
    owner = int(c.by_index("byName", first).first()["id"])
    again = table(spark, d, "customer").where(F.col("c_name") == first).select((F.col("c_custkey") + 10**9).alias("k"), "c_name", "c_mktsegment")
    attempts = {
        "put": lambda: c.put(-1, {"c_name": first}),
        "batch": lambda: c.batch([(-1, {"c_name": "twice"}), (-2, {"c_name": "twice"})]),
        "load": lambda: store.load(as_docs(again, "customer", "k", "c_name", "c_mktsegment"), "n"),
    }
    for what, attempt in attempts.items():
        try:
            attempt()
        except UniqueViolation as e:
            out.append((what, e.key, store.sequence))
    out.append(("moved", None, c.batch([(owner, {"c_name": "other"}), (-1, {"c_name": first})])))
    return spark.createDataFrame(out, "what string, key string, held long")


@query(f"WITH {SHOP} SELECT id, seq, c_name, c_mktsegment FROM shop UNION ALL SELECT -1, 2 * n + 1, 'late', NULL FROM n")
def store_backup_restore(spark, d):
    """Backup, deletion of everything, restore, one more put: sequences go on from the highest ever given out."""
    store = shop(spark, d)
    ref = store.create_backup("full")
    store.clear_collection("customer")
    store.restore_backup(ref["id"])
    store.collection("customer").put(-1, {"c_name": "late"})
    again = Store(spark, store.path)
    assert [b["id"] for b in again.list_backups()] == [ref["id"]]
    return live_rows(again, "customer")


@query(
    """SELECT 'nation' AS collection, FALSE AS listed, 0::BIGINT AS live UNION ALL SELECT 'region', FALSE, count(*) FROM region UNION ALL SELECT 'customer', TRUE, count(*) FROM customer"""
)
def store_drop(spark, d):
    """A collection dropped with its documents left in place, one cleared, one untouched."""
    store = shop(spark, d)
    store.load(as_docs(table(spark, d, "region"), "region", "r_regionkey", "r_name").unionByName(as_docs(table(spark, d, "nation"), "nation", "n_nationkey", "n_name")), "n")
    store.drop_collection("region")
    store.clear_collection("nation")
    again = Store(spark, store.path)
    rows = versions.state_as_of(again.rows(), keys=("collection", "id"), tombstones=True)
    listed = F.col("collection").isin(again.list_collections())
    return rows.groupBy("collection").agg(F.count(F.when(~F.col("deleted"), 1)).alias("live")).select("collection", listed.alias("listed"), "live")


@query("SELECT DISTINCT n_regionkey::VARCHAR AS name FROM nation UNION SELECT 'empty'")
def collections_list(spark, d):
    """Collections written by one bulk load (a collection a region of the nations), and one created by name."""
    store = Store(spark, scratch(spark, "store"))
    nations = table(spark, d, "nation")
    docs = as_docs(nations, "", "n_nationkey", "n_name").drop("collection").join(nations.select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").cast("string").alias("collection")), "n")
    store.load(docs, "n")
    store.create_collection("empty")
    return spark.createDataFrame([(n,) for n in Store(spark, store.path).list_collections()], "name string")


@query("SELECT 3::BIGINT AS sets_before, 1::BIGINT AS sets_after, 3::BIGINT AS vacuumed, count(*) AS versions, count(DISTINCT o_orderkey) AS live FROM orders")
def store_compaction(spark, d):
    """Three bulk loads, compacted into one set, the old sets deleted: every version is still there once."""
    store = Store(spark, scratch(spark, "store"))
    orders = table(spark, d, "orders")
    cuts = orders.agg(F.expr("max(o_orderkey) div 3").alias("a"), F.expr("2 * (max(o_orderkey) div 3)").alias("b")).first()
    for low, high in ((None, cuts["a"]), (cuts["a"], cuts["b"]), (cuts["b"], None)):
        part = orders.where((F.lit(low is None) | (F.col("o_orderkey") > F.lit(low or 0))) & (F.lit(high is None) | (F.col("o_orderkey") <= F.lit(high or 0))))
        store.load(as_docs(part, "orders", "o_orderkey", "o_orderstatus"), "n")
    before = len(store.manifest["files"])
    store.compact()
    gone = store.vacuum()
    again = Store(spark, store.path)
    figures = again.rows().agg(F.count(F.lit(1)).alias("versions"), F.countDistinct("id").alias("live"))
    return figures.select(F.lit(before).cast("long").alias("sets_before"), F.lit(len(again.manifest["files"])).cast("long").alias("sets_after"), F.lit(gone).cast("long").alias("vacuumed"), "versions", "live")


@query(
    """WITH s AS (SELECT s_name AS id, row_number() OVER (ORDER BY s_name) - 1 AS r, row_number() OVER (ORDER BY s_name) AS sequence FROM supplier),
k AS (SELECT s_name AS id, row_number() OVER (ORDER BY s_name) - 1 AS r, 'index' AS kind FROM supplier WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier))
SELECT 'scan' AS kind, (r // 7)::INTEGER AS page, id, sequence FROM s
UNION ALL SELECT 'index', (k.r // 7)::INTEGER, k.id, sequence FROM k JOIN s ON s.id = k.id
UNION ALL SELECT 'byId', 0, id, sequence FROM s WHERE r = 0"""
)
def service_pages(spark, d):
    """All pages of a scan and of an index query at a snapshot, walked by their signed tokens after later deletions."""
    store = Store(spark, scratch(spark, "store"))
    suppliers = table(spark, d, "supplier").select("s_name", "s_nationkey", F.concat(F.lit("n"), "s_nationkey").alias("nation"))
    store.load(as_docs(suppliers, "supplier", "s_name", "nation"), "n")
    service, out = AdminService(store, secret="k"), []
    service.define_index("supplier", {"name": "byNation", "kind": "multi", "keyPath": ".nation"})
    snapshot = service.create_snapshot()["id"]
    store.clear_collection("supplier")
    service.define_index("supplier", {"name": "byNation", "kind": "multi", "keyPath": ".nation"})
    nation = suppliers.orderBy("s_nationkey").first()["nation"]
    for kind, q, token in (("scan", {"type": "scan", "limit": 7}, "startAfter"), ("index", {"type": "indexEquals", "index": "byNation", "key": nation, "pageSize": 7}, "pageToken")):
        page, more = 0, {}
        while True:
            got = service.query("supplier", q | more, snapshot)
            out += [(kind, page, i["id"], i["sequence"]) for i in got["items"]]
            if got["nextPageToken"] is None:
                break
            page, more = page + 1, {token: got["nextPageToken"]}
    first = min(r[2] for r in out)
    out += [("byId", 0, i["id"], i["sequence"]) for i in service.query("supplier", {"type": "byId", "id": first}, snapshot)["items"]]
    service.release_snapshot(snapshot)
    return spark.createDataFrame(out, "kind string, page int, id string, sequence long")


@query(
    """WITH r AS (SELECT replace(r_name, ' ', '_') AS name, row_number() OVER (ORDER BY r_name) - 1 AS up, row_number() OVER (ORDER BY r_regionkey DESC) - 1 AS newest FROM region)
SELECT 'collections' AS kind, (up // 2)::INTEGER AS page, name FROM r UNION ALL SELECT 'indexes', (up // 2)::INTEGER, name FROM r
UNION ALL SELECT 'backups', (newest // 2)::INTEGER, name FROM r UNION ALL SELECT 'names', 0, name FROM r"""
)
def service_lists(spark, d):
    """Pages of the lists of collections, index definitions and backups (newest first), two a page."""
    store = Store(spark, scratch(spark, "store"))
    service, out = AdminService(store), []
    names = [r["r_name"].replace(" ", "_") for r in rows_of(spark, d, "region", "r_regionkey", "r_name")]
    for name in names:
        service.create_collection(name)
        service.define_index(names[0], {"name": name, "kind": "multi", "keyPath": f".{name}"})
        service.create_backup(name)
    lists = {
        "collections": (service.list_collections, lambda i: i),
        "indexes": (lambda n, t: service.list_index_definitions(names[0], n, t), lambda i: i["keyPath"][1:]),
        "backups": (service.list_backups, lambda i: i["note"]),
    }
    for kind, (get, name) in lists.items():
        page, token = 0, None
        while True:
            got = get(2, token)
            out += [(kind, page, name(i)) for i in got["items"]]
            page, token = page + 1, got["nextPageToken"]
            if token is None:
                break
    out += [("names", 0, n) for n in service.list_index_names(names[0])]
    assert service.rebuild_dynamic_indexes() == len(names)
    return spark.createDataFrame(out, "kind string, page int, name string")


@query(
    """SELECT 'ok' AS tx, (r_regionkey)::INTEGER AS op, 'ok' AS status, row_number() OVER (ORDER BY r_regionkey) AS sequence FROM region
UNION ALL SELECT 'ok', (count(*))::INTEGER, 'ok', NULL FROM region UNION ALL SELECT 'ok', (count(*) + 1)::INTEGER, 'ok', NULL FROM region
UNION ALL SELECT 'unique', -1, 'unique constraint', count(*) + 1 FROM region UNION ALL SELECT 'guard', -1, 'conflict', count(*) + 1 FROM region"""
)
def service_transaction(spark, d):
    """A transaction of puts, a deletion and an index definition; one that breaks the index and one below its guard."""
    service, out = AdminService(Store(spark, scratch(spark, "store"))), []
    regions = rows_of(spark, d, "region", "r_regionkey", "r_name")
    put = lambda i, name: {"op": "put", "collection": "region", "record": {"id": str(i), "data": {"name": name}}}
    index = {"op": "defineIndex", "collection": "region", "index": {"name": "byName", "kind": "unique", "keyPath": ".name"}}
    txs = {
        "ok": {"operations": [*[put(*r) for r in regions], {"op": "delete", "collection": "region", "id": "none"}, index]},
        "unique": {"operations": [put("x", regions[0][1])]},
        "guard": {"operations": [put("y", "y")], "requireSequenceAtLeast": 10**6},
    }
    for name, tx in txs.items():
        done = service.commit_transaction(tx)
        for r in done["results"]:
            sequence = done["committedSequence"] if r["opIndex"] < 0 else r.get("record", {}).get("sequence")
            out.append((name, r["opIndex"], r["error"]["title"] if r["status"] == "error" else "ok", sequence))
    return spark.createDataFrame(out, "tx string, op int, status string, sequence long")


@query(
    """SELECT * FROM (VALUES ('puts', 2), ('gets', 2), ('deletes', 1), ('scans', 1), ('indexLookups', 1), ('batches', 1), ('histories', 1),
('event put', 2), ('event get', 1), ('event delete', 1), ('event batch', 1), ('event history', 1), ('event scan', 1), ('event indexLookup', 1), ('after reset', 0)) t(name, n)"""
)
def store_metrics(spark, d):
    """Counters and log events of a known series of calls over a store with all customers."""
    seen = []
    store = shop(spark, d, logger=lambda e: seen.append(e.type))
    c = store.collection("customer")
    store.define_index("customer", "bySegment", "multi", ".c_mktsegment")
    c.put(-1, {"c_name": "a"})
    c.put(-2, {"c_name": "b"})
    c.get(-1)
    c.delete(-1)
    c.batch([(-3, {"c_name": "c"}), (-4, None)])
    c.history(-1)
    c.scan(limit=3)
    c.by_index("bySegment", "none")
    out = list(store.metrics.snapshot().items()) + [(f"event {k}", seen.count(k)) for k in sorted(set(seen))]
    store.metrics.reset()
    out.append(("after reset", sum(store.metrics.snapshot().values())))
    return spark.createDataFrame(out, "name string, n int")


@query(
    """SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'created', 0 UNION ALL SELECT 'health ok', count(*) FROM customer
UNION ALL SELECT 'snapshot', count(*) FROM customer UNION ALL SELECT 'unknown snapshot', 1 UNION ALL SELECT 'unknown index', 1 UNION ALL SELECT 'bad name', 1 UNION ALL SELECT 'not strict', 0"""
)
def service_status(spark, d):
    """Health, status with live counts, the snapshot registry, and the errors of wrong requests."""
    store = shop(spark, d)
    service = AdminService(store)
    service.create_collection("created")
    out = [(c["name"], c["recordsApprox"]) for c in service.status()["collections"]]
    health = service.health()
    out.append((f"health {health['status']}", health["sequence"]))
    snapshot = service.create_snapshot()
    out.append(("snapshot", snapshot["sequence"]))
    service.release_snapshot(snapshot["id"])
    wrong = {
        "unknown snapshot": (UnknownSnapshot, lambda: service.query("customer", {"type": "byId", "id": "1"}, snapshot["id"])),
        "unknown index": (UnknownIndex, lambda: store.collection("customer").by_index("none", "x")),
        "bad name": (InvalidRequest, lambda: service.create_collection("no spaces")),
    }
    for name, (error, call) in wrong.items():
        try:
            call()
        except error:
            out.append((name, 1))
    vague = Index.at_path("words", ".c_name", "fts")
    out.append(("not strict", indexes.by_index(store.collection("customer").log(), vague, "x", strict=False).count()))
    return spark.createDataFrame(out, "name string, n long")


@query(
    """SELECT 'PUT' AS step, r_name AS id, 201 AS status, row_number() OVER (ORDER BY r_regionkey) AS sequence FROM region
UNION ALL SELECT 'GET', r_name, 200, row_number() OVER (ORDER BY r_regionkey) FROM region
UNION ALL SELECT 'tool', r_name, 0, row_number() OVER (ORDER BY r_regionkey) FROM region
UNION ALL SELECT 'DELETE', r_name, 204, NULL FROM region UNION ALL SELECT 'again', r_name, 404, NULL FROM region"""
)
def service_routes(spark, d):
    """Every region put, read, read by a tool, deleted and asked for again, by the routes."""
    service, out = AdminService(Store(spark, scratch(spark, "store"))), []
    names = [r["r_name"] for r in rows_of(spark, d, "region", "r_regionkey", "r_name")]
    url = lambda name: "/collections/region/records/" + quote(name)
    for step, method in (("PUT", "PUT"), ("GET", "GET"), ("tool", None), ("DELETE", "DELETE"), ("again", "GET")):
        for name in names:
            if method is None:
                call = {"id": 1, "method": "tools/call", "params": {"name": "chronodoc.record.getMeta", "arguments": {"collection": "region", "id": name}}}
                status, got = 0, api.rpc(service, call)["result"]
            else:
                status, got = api.handle(service, method, url(name), b'{"data": {}}' if method == "PUT" else b"")
            out.append((step, name, status, (got or {}).get("sequence")))
    return spark.createDataFrame(out, "step string, id string, status int, sequence long")


def _corpus(spark: SparkSession, d: str) -> Store:
    """All documents of known language in a store; documents with null language were loaded first and then deleted."""
    store = Store(spark, scratch(spark, "store"))
    docs = table(spark, d, "documents")
    store.load(as_docs(docs, "docs", "doc_id", "text"), "n")
    gone = docs.where("lang is null").select(F.lit("docs").alias("collection"), F.col("doc_id").cast("string").alias("id"), F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("version"), F.col("doc_id").alias("n"))
    store.define_index("docs", "words", "fts", ".text")
    store.define_index("docs", "plain", "fts", ".text", analyzer={"stopwords": STOP})
    store.collection("docs").search_text("words", "sensor").limit(1).count()  # writes the stored index
    store.load(gone, "n")
    return store


@query(
    f"""WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS ws FROM documents WHERE lang IS NOT NULL),
t AS (SELECT doc_id, len(ws) AS dl, len(list_filter(ws, lambda w: w = 'pressure')) AS a, len(list_filter(ws, lambda w: w = 'sensor')) AS b FROM d),
s AS (SELECT count(*) AS n, sum(dl) AS total, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM t)
SELECT doc_id AS id, round(ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * dl / (total / greatest(1, n))))
  + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * dl / (total / greatest(1, n)))), 6) AS score FROM t, s WHERE a > 0 AND b > 0"""
)
def fts_named_index(spark, d):
    """Search through a named text index whose stored part was written before documents were deleted."""
    found = _corpus(spark, d).collection("docs").search_text("words", "Pressure sensor")
    return found.select(F.col("id").cast("long").alias("id"), "score")


@query(
    f"""SELECT doc_id AS id FROM documents WHERE lang IS NOT NULL AND list_contains(list_filter({WORDS}, lambda w: NOT list_contains({STOP}, w)), 'valve')"""
)
def fts_named_stopwords(spark, d):
    """A named text index with its own analyzer: the query's stop words do not count."""
    return _corpus(spark, d).collection("docs").search_text("plain", "the valve of").select(F.col("id").cast("long").alias("id"))


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], q) ^ 2, 6) AS distance FROM embeddings, q ORDER BY distance, vec_id::VARCHAR LIMIT 10"""
)
def vector_named_index(spark, d):
    """Search through a named vector index over documents that hold their vectors as JSON arrays."""
    store = Store(spark, scratch(spark, "store"))
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    store.load(as_docs(vectors, "vectors", "vec_id", "e"), "n")
    store.define_index("vectors", "near", "vector", ".e")
    q = vectors.where("vec_id = 0").first()["e"]
    return store.collection("vectors").vector_search("near", q, 10).select(F.col("id").cast("long").alias("id"), "distance")


@query(
    """SELECT store, sequence, frame_type, txid, CASE WHEN doc_key IS NOT NULL THEN collection END AS collection, CASE WHEN collection IS NOT NULL THEN doc_key END AS doc_key, value FROM wal_frames"""
)
def log_files(spark, d):
    """All frames written as checksummed log files, one a store, and read back."""
    path = scratch(spark, "logs")
    frames = table(spark, d, "wal_frames").select(F.col("store").alias("file"), F.col("record_no").alias("position"), "sequence", "frame_type", "txid", "collection", "doc_key", "value")
    binlog.write_log_files(frames, path).count()
    back = binlog.read_log_files(spark, path)
    return back.select(F.regexp_extract("path", r"([^/]+)\.log$", 1).alias("store"), "sequence", "frame_type", "txid", "collection", "doc_key", "value")


@query(
    """WITH ops AS (SELECT * FROM wal_frames WHERE frame_type IS NULL OR lower(trim(frame_type)) = 'op'),
commits AS (SELECT DISTINCT store, txid FROM wal_frames WHERE lower(trim(frame_type)) = 'commit' AND txid IS NOT NULL)
SELECT DISTINCT o.store, sequence, collection, doc_key, value FROM ops o LEFT JOIN commits c ON c.store = o.store AND c.txid = o.txid WHERE o.txid IS NULL OR c.txid IS NOT NULL"""
)
def log_replay(spark, d):
    """Committed changes of log files read back: operations without their commit drop out."""
    path = scratch(spark, "logs")
    frames = table(spark, d, "wal_frames").select(F.col("store").alias("file"), F.col("record_no").alias("position"), "sequence", "frame_type", "txid", "collection", "doc_key", "value")
    binlog.write_log_files(frames, path).count()
    back = binlog.read_log_files(spark, path).withColumn("store", F.regexp_extract("path", r"([^/]+)\.log$", 1)).withColumn("arrived_at", F.lit(None).cast("timestamp_ntz"))
    return committed_changes(back).select("store", "sequence", "collection", "doc_key", "value").distinct()


def _tables_on_disk(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    path = scratch(spark, "tables")
    rows = table(spark, d, "table_entries").select(F.concat("store", F.lit("~"), "table_id").alias("file"), "collection", "doc_key", "sequence", "value")
    rows = rows.where("collection is not null and doc_key is not null and sequence is not null")
    binlog.write_table_files(rows, path).count()
    return path, rows


@query(
    """SELECT store || '~' || table_id AS file, collection, doc_key, sequence, nullif(value, '') AS value FROM table_entries
WHERE collection IS NOT NULL AND doc_key IS NOT NULL AND sequence IS NOT NULL"""
)
def table_scan(spark, d):
    """All entries written as sorted tables with checksummed blocks, and read back whole."""
    path, _ = _tables_on_disk(spark, d)
    return binlog.read_table_files(spark, path).select(F.regexp_extract("path", r"([^/]+)\.sst$", 1).alias("file"), "collection", "doc_key", "sequence", "value")


STORED = "hex(encode(collection)) || '00' || hex(encode(doc_key)) || '00' || printf('%016X', sequence)"


@query(
    f"""WITH e AS (SELECT store || '~' || table_id AS file, {STORED} AS key, coalesce(value, '') AS value FROM table_entries
  WHERE collection IS NOT NULL AND doc_key IS NOT NULL AND sequence IS NOT NULL),
asked AS (SELECT file, min(key) AS key FROM e GROUP BY file UNION SELECT file, (SELECT min(key) FROM e) FROM e UNION SELECT file, (SELECT max(key) FROM e) FROM e)
SELECT e.file, e.key, min(value) AS value FROM e JOIN asked a ON e.file = a.file AND e.key = a.key GROUP BY ALL"""
)
def table_point_get(spark, d):
    """Every table asked for its own first stored key and for the first and last of all, through its filter and block index."""
    path, rows = _tables_on_disk(spark, d)
    stored = F.concat(F.encode("collection", "UTF-8"), F.lit(b"\0"), F.encode("doc_key", "UTF-8"), F.lit(b"\0"), F.unhex(F.lpad(F.hex("sequence"), 16, "0")))
    keyed = rows.select("file", stored.alias("key"))
    own = keyed.groupBy("file").agg(F.min("key").alias("key"))
    ends = keyed.agg(F.array(F.min("key"), F.max("key")).alias("ends"))  # one row
    both = own.crossJoin(F.broadcast(ends)).select("file", F.explode(F.concat(F.array("key"), "ends")).alias("key")).distinct()
    return binlog.lookup(spark, path, both).select("file", F.hex("key").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query(
    """WITH f AS (SELECT store, table_id, bits, hashes FROM (SELECT *, row_number() OVER (PARTITION BY store, table_id ORDER BY created_at DESC NULLS LAST, bits DESC NULLS LAST) AS r
  FROM table_files WHERE len(bits) > 0 AND coalesce(hashes, 0) >= 1 AND len(list_filter(bits, lambda x: x IS NULL)) = 0) WHERE r = 1),
k AS (SELECT DISTINCT store, table_id, raw FROM table_entries WHERE raw IS NOT NULL),
p AS (SELECT k.store, k.table_id, raw, bits, unnest(range(0, hashes)) AS probe, [('0x' || x)::HUGEINT FOR x IN regexp_extract_all(hex(raw), '..')] AS bytes
      FROM k JOIN f ON k.store = f.store AND k.table_id = f.table_id),
h AS (SELECT *, list_reduce(list_prepend((1469598103934665603 + probe)::HUGEINT, bytes), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616::HUGEINT) % (len(bits) * 64) AS bit FROM p),
t AS (SELECT store, table_id, raw, min(CASE WHEN bits[(bit // 64)::BIGINT + 1] < 0 THEN
        ((bits[(bit // 64)::BIGINT + 1]::HUGEINT + 18446744073709551616::HUGEINT) // (2::HUGEINT ** (bit % 64)::INTEGER)::HUGEINT) % 2
      ELSE (bits[(bit // 64)::BIGINT + 1]::HUGEINT // (2::HUGEINT ** (bit % 64)::INTEGER)::HUGEINT) % 2 END) AS ok FROM h GROUP BY ALL)
SELECT t.store, t.table_id, count(*) AS keys, count(*) FILTER (ok = 0) AS denied,
  any_value(round(list_sum(list_transform(bits, lambda x: bit_count(x)))::DOUBLE / (len(bits) * 64), 6)) AS fill FROM t JOIN f ON t.store = f.store AND t.table_id = f.table_id GROUP BY ALL"""
)
def table_filters(spark, d):
    """Per table with a usable stored filter: its keys, the keys the filter wrongly denies, and its fill."""
    return filter_audit(table(spark, d, "table_files"), table(spark, d, "table_entries"))


@query(
    """SELECT id, seq, deleted, kind FROM (SELECT user_id AS id, event_id + 1 AS seq, coalesce(event_type = 'error', FALSE) AS deleted,
CASE WHEN coalesce(event_type = 'error', FALSE) THEN NULL ELSE event_type END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"""
)
def live_stream(spark, d):
    """The live state kept by a stream over the event log, after everything has arrived."""
    path = scratch(spark, "stream")
    log = events_log(spark, d).select("id", "seq", "deleted", "kind")
    log.repartition(4).write.parquet(f"{path}/log")
    name = "live_" + path.rsplit("-", 1)[1]
    return drain(live_state(spark, f"{path}/log", log.schema, keys=("id",)), name, f"{path}/state").select("id", "seq", "deleted", "kind")
