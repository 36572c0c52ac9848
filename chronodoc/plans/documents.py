"""Queries for the document-store operators over the star-schema and event tables, with their SQL.

``events`` is read as a version log: id = user_id, seq = event_id + 1, tombstone = event_type 'error'.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronodoc.functions.jsonpath import json_strings
from chronodoc.functions.text import default_analyzer, stopword_analyzer
from chronodoc.operators import batch, fulltext, indexes, knn, paging, scans, versions
from chronodoc.operators.indexes import Index
from chronodoc.plans.tables import table
from chronodoc.session import scratch
from chronodoc.sources.store import table_levels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query_into(queries: dict, oracles: dict[str, str]):
    """The decorator that registers a query under its name, with the SQL it is checked against."""

    def query(sql: str | None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query


query = query_into(QUERIES, ORACLES)


def events_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return versions.version_log(e, id=F.col("user_id"), seq=F.col("event_id") + 1, deleted=F.col("event_type") == "error", kind=F.col("event_type"), amount=F.col("value"))


def keyed(df: DataFrame, id: str, **values: str) -> DataFrame:
    """A table as a log of one live version per row."""
    return versions.version_log(df, id=F.col(id), seq=F.lit(1), deleted=F.lit(False), **{k: F.col(c) for k, c in values.items()})


def half(spark: SparkSession, d: str) -> int:
    """Snapshot in the middle of the event log."""
    return table(spark, d, "events").agg(F.max("event_id")).first()[0] // 2


def some_user(spark: SparkSession, d: str) -> int:
    return table(spark, d, "events").agg(F.max("user_id")).first()[0] // 3


LOG = """
log AS (SELECT user_id AS id, event_id + 1 AS seq, coalesce(event_type = 'error', FALSE) AS deleted,
  CASE WHEN coalesce(event_type = 'error', FALSE) THEN NULL ELSE event_type END AS kind,
  CASE WHEN coalesce(event_type = 'error', FALSE) THEN NULL ELSE value END AS amount FROM events),
cut AS (SELECT max(event_id) // 2 AS s FROM events),
who AS (SELECT max(user_id) // 3 AS u FROM events),
state AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND NOT deleted),
old AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM log, cut WHERE seq <= s) WHERE r = 1 AND NOT deleted)
"""
COLS = ["id", "seq", "kind", "amount"]


@query(f"WITH {LOG} SELECT id, seq, kind, amount FROM state, who WHERE id = u")
def get_latest(spark, d):
    return versions.get(events_log(spark, d), some_user(spark, d)).select(*COLS)


@query(f"WITH {LOG} SELECT id, seq, kind, amount FROM old, who WHERE id = u")
def get_at_snapshot(spark, d):
    return versions.get(events_log(spark, d), some_user(spark, d), half(spark, d)).select(*COLS)


@query(f"WITH {LOG} SELECT seq, deleted, kind, amount FROM log, who WHERE id = u")
def history_all(spark, d):
    return versions.history(events_log(spark, d), some_user(spark, d)).select("seq", "deleted", "kind", "amount")


@query(f"WITH {LOG} SELECT seq, deleted, kind, amount FROM log, who, cut WHERE id = u AND seq <= s")
def history_at_snapshot(spark, d):
    return versions.history(events_log(spark, d), some_user(spark, d), half(spark, d)).select("seq", "deleted", "kind", "amount")


@query(f"WITH {LOG} SELECT max(seq) AS last_seq FROM log, who, cut WHERE id = u AND seq <= s")
def last_sequence(spark, d):
    return versions.last_sequence(events_log(spark, d), some_user(spark, d), half(spark, d))


@query("SELECT max(event_id) + 1 AS sequence FROM events")
def store_sequence(spark, d):
    return versions.store_sequence(events_log(spark, d))


@query(f"WITH {LOG} SELECT id, seq, kind, amount FROM state")
def state_latest(spark, d):
    return versions.state_as_of(events_log(spark, d)).select(*COLS)


@query(f"WITH {LOG} SELECT id, seq, kind, amount FROM old")
def state_at_snapshot(spark, d):
    return versions.state_as_of(events_log(spark, d), half(spark, d)).select(*COLS)


@query(f"WITH {LOG} SELECT id, seq, kind, amount FROM state ORDER BY CAST(id AS VARCHAR) LIMIT 7")
def scan_limit(spark, d):
    return scans.scan(events_log(spark, d), limit=7).select(*COLS)


@query(f"WITH {LOG} SELECT id, seq, kind, amount FROM old ORDER BY CAST(id AS VARCHAR) LIMIT 100")
def scan_default_limit(spark, d):
    return scans.scan(events_log(spark, d), snapshot=half(spark, d)).select(*COLS)


@query(f"WITH {LOG} SELECT id, seq, kind, amount FROM state WHERE CAST(id AS VARCHAR) LIKE '1%' ORDER BY CAST(id AS VARCHAR) LIMIT 100")
def scan_prefix(spark, d):
    return scans.scan(events_log(spark, d), prefix="1").select(*COLS)


@query("SELECT c_name AS id, c_custkey AS k, CAST(row_number() OVER (ORDER BY to_json(c_name)::VARCHAR) AS INTEGER) AS pos FROM customer ORDER BY pos LIMIT 50")
def scan_string_ids(spark, d):
    rows = scans.scan(keyed(table(spark, d, "customer"), "c_name", k="c_custkey"), limit=50)
    return rows.select("id", "k", F.row_number().over(Window.orderBy("id_json")).alias("pos"))  # 50 rows


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_name = (SELECT max(c_name) FROM customer)")
def unique_lookup(spark, d):
    c = table(spark, d, "customer")
    key = c.agg(F.max("c_name")).first()[0]
    return indexes.by_index(keyed(c, "c_custkey", name="c_name", balance="c_acctbal"), Index.on("byName", "name", "unique"), key).select("id", "name", "balance")


@query(f"WITH {LOG} SELECT id, seq, kind FROM old WHERE kind || ':' || id = (SELECT min(kind || ':' || id) FROM old)")
def unique_lookup_snapshot(spark, d):
    log, s = events_log(spark, d), half(spark, d)
    index = Index.extracted("byKindAndId", lambda df: F.concat_ws(":", "kind", "id"), "unique")
    key = versions.state_as_of(log, s).agg(F.min(F.concat_ws(":", "kind", "id"))).first()[0]
    return indexes.by_index(log, index, key, s).select("id", "seq", "kind")


@query("SELECT p_name AS key, count(DISTINCT p_partkey) AS n_ids FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def unique_violations(spark, d):
    parts = keyed(table(spark, d, "part"), "p_partkey", name="p_name")
    return indexes.violations(versions.state_as_of(parts), Index.on("byName", "name", "unique"))


@query("SELECT c_name AS key, c_custkey AS id FROM customer WHERE c_name LIKE 'Customer#00000001%' ORDER BY c_name, CAST(c_custkey AS VARCHAR) LIMIT 25")
def unique_scan_prefix(spark, d):
    c = keyed(table(spark, d, "customer"), "c_custkey", name="c_name")
    return indexes.scan_index(c, Index.on("byName", "name", "unique"), "Customer#00000001", 25).select("key", "id")


@query("SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS total FROM orders WHERE o_orderpriority = '1-URGENT'")
def multi_lookup(spark, d):
    o = keyed(table(spark, d, "orders"), "o_orderkey", priority="o_orderpriority", cust="o_custkey", total="o_totalprice")
    return indexes.by_index(o, Index.on("byPriority", "priority"), "1-URGENT").select("id", "cust", "total")


@query(f"WITH {LOG} SELECT id, seq, kind FROM old WHERE kind = 'click'")
def multi_lookup_snapshot(spark, d):
    return indexes.by_index(events_log(spark, d), Index.on("byKind", "kind"), "click", half(spark, d)).select("id", "seq", "kind")


TOKENS = "(SELECT p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> ''))) AS token FROM part)"
NAME_WORDS = Index.extracted("byWord", lambda df: default_analyzer(F.col("name")))


@query(f"SELECT p_partkey AS id FROM {TOKENS} WHERE token = (SELECT min(token) FROM {TOKENS})")
def multi_array_lookup(spark, d):
    parts = keyed(table(spark, d, "part"), "p_partkey", name="p_name")
    word = parts.select(F.explode(default_analyzer(F.col("name"))).alias("w")).agg(F.min("w")).first()[0]
    return indexes.by_index(parts, NAME_WORDS, word).select("id")


@query(
    f"""SELECT token AS key, p_partkey AS id, CAST(row_number() OVER (ORDER BY token, CAST(p_partkey AS VARCHAR)) AS INTEGER) AS pos
FROM {TOKENS} WHERE token LIKE (SELECT left(min(token), 1) FROM {TOKENS}) || '%' ORDER BY pos LIMIT 60"""
)
def multi_scan_prefix(spark, d):
    parts = keyed(table(spark, d, "part"), "p_partkey", name="p_name")
    first = parts.select(F.explode(default_analyzer(F.col("name"))).alias("w")).agg(F.min("w")).first()[0][:1]
    rows = indexes.scan_index(parts, NAME_WORDS, first, 60)
    return rows.select("key", "id", F.row_number().over(Window.orderBy("key", "id_json")).alias("pos"))  # 60 rows


@query("SELECT doc_id AS id, k AS key FROM (SELECT doc_id, unnest(list_distinct([lang, source])) AS k FROM documents) WHERE k IS NOT NULL")
def extractor_index(spark, d):
    docs = keyed(table(spark, d, "documents"), "doc_id", lang="lang", source="source")
    return indexes.postings(versions.state_as_of(docs), Index.extracted("byOrigin", lambda df: F.array("lang", "source"))).select("id", "key")


@query(
    """SELECT c_custkey AS id, k AS key FROM (SELECT c_custkey, unnest(list_distinct([c_mktsegment, 'n' || c_nationkey])) AS k FROM customer) WHERE k IS NOT NULL
UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_name IS NOT NULL"""
)
def jsonpath_index(spark, d):
    """Documents with an array and a nested string, indexed by ``.tags[]`` and ``.who.name``; numbers are no keys."""
    c = table(spark, d, "customer")
    doc = F.to_json(F.struct(F.array("c_mktsegment", F.concat(F.lit("n"), "c_nationkey")).alias("tags"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("n")).alias("who")))
    state = c.select(F.col("c_custkey").alias("id"), doc.alias("value"))
    out = [indexes.postings(state, Index.at_path("i", p)).select("id", "key") for p in (".tags[]", ".who.name", ".who.n", ".tags")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    """SELECT coalesce(sum(CASE json_type(props, '$.k') WHEN 'VARCHAR' THEN 1 ELSE 0 END), 0)::BIGINT AS n_strings, count(*) AS n FROM events"""
)
def jsonpath_over_props(spark, d):
    """String leaves of the events' props: numbers are no keys, so this counts what is left."""
    e = table(spark, d, "events")
    return e.agg(F.sum(F.size(json_strings(F.col("props"), ".k"))).alias("n_strings"), F.count(F.lit(1)).alias("n"))


WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> '')"
STOP = ["the", "and", "a", "of", "to", "in", "is"]


@query(f"SELECT doc_id AS id, CAST(coalesce(len({WORDS}), 0) AS BIGINT) AS doc_len, coalesce(array_to_string({WORDS}, ' '), '') AS terms FROM documents")
def tokenize_default(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fulltext.tokenized(docs, "text").select("id", "doc_len", F.array_join("tokens", " ").alias("terms"))


@query(f"SELECT doc_id AS id, CAST(coalesce(len(list_filter({WORDS}, lambda w: NOT list_contains({STOP}, w))), 0) AS BIGINT) AS doc_len, coalesce(array_to_string(list_filter({WORDS}, lambda w: NOT list_contains({STOP}, w)), ' '), '') AS terms FROM documents")
def tokenize_stopwords(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fulltext.tokenized(docs, "text", stopword_analyzer(STOP)).select("id", "doc_len", F.array_join("tokens", " ").alias("terms"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY term")
def postings_df(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fulltext.term_postings(docs, "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _bm25(terms: list[str], stop: list[str] | None = None, limit: str = "", cols: str = "doc_id AS id, score") -> str:
    words = f"list_filter({WORDS}, lambda w: NOT list_contains({stop}, w))" if stop else WORDS
    need = sorted(set(terms))
    tf = ", ".join(f"len(list_filter(ws, lambda w: w = '{w}')) AS tf{i}" for i, w in enumerate(need))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(need)))
    part = " + ".join(
        f"{terms.count(w)} * ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * dl / (total / greatest(1, n))))" for i, w in enumerate(need)
    )
    every = " AND ".join(f"tf{i} > 0" for i in range(len(need)))
    return f"""WITH d AS (SELECT doc_id, lang, coalesce({words}, []) AS ws FROM documents),
t AS (SELECT doc_id, lang, len(ws) AS dl, {tf} FROM d),
s AS (SELECT count(*) AS n, sum(dl) AS total, {df} FROM t),
scored AS (SELECT doc_id, lang, round({part}, 6) AS score FROM t, s WHERE {every})
SELECT {cols} FROM scored ORDER BY score DESC, doc_id {limit}"""


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


@query(_bm25(["pressure", "sensor"]))
def fts_search_and(spark, d):
    return fulltext.search(_docs(spark, d), "text", "Pressure sensor")


@query(_bm25(["storage"], limit="LIMIT 10"))
def fts_search_limit(spark, d):
    return fulltext.search(_docs(spark, d), "text", "storage", 10)


@query(_bm25(["valve"], stop=STOP, limit="LIMIT 20"))
def fts_stopword_search(spark, d):
    return fulltext.search(_docs(spark, d), "text", "the valve", 20, analyzer=stopword_analyzer(STOP))


@query(_bm25(["sensor", "sensor", "pressure"], limit="LIMIT 15"))
def fts_repeat_term(spark, d):
    return fulltext.search(_docs(spark, d), "text", "sensor sensor pressure", 15)


@query(_bm25(["spring"], limit="LIMIT 10", cols="doc_id AS id, lang, score"))
def fts_lookup_docs(spark, d):
    docs = _docs(spark, d)
    found = fulltext.search(docs, "text", "spring", 10)
    return docs.join(F.broadcast(found), "id").select("id", "lang", "score")  # 10 rows


@query(_bm25(["pressure", "sensor"], limit="LIMIT 25"))
def fts_stored_index(spark, d):
    """The same search over postings written to the shared folder, sorted by term."""
    postings, lengths = fulltext.build_index(_docs(spark, d), "text")
    at = scratch(spark, "postings")
    postings.repartition("term").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
    lengths.write.parquet(f"{at}/lengths")
    return fulltext.search_index(spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/lengths"), ["pressure", "sensor"], 25)


Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _vecs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _q0(spark, d):
    return list(_vecs(spark, d).where("id = 0").first()["embedding"])


@query(f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {Q0}) ^ 2, 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 10")
def knn_l2(spark, d):
    return knn.vector_search(_vecs(spark, d), "embedding", _q0(spark, d), 10, "l2")


@query(f"SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {Q0}), 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 10")
def knn_cosine(spark, d):
    return knn.vector_search(_vecs(spark, d), "embedding", _q0(spark, d), 10, "cosine")


@query(f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {Q0}) ^ 2, 6) AS distance FROM embeddings WHERE label <> 1 ORDER BY distance, id LIMIT 10")
def knn_filtered_state(spark, d):
    log = versions.version_log(_vecs(spark, d), id=F.col("id"), seq=F.lit(1), deleted=F.col("label") == 1, embedding=F.col("embedding"))
    return knn.vector_search(versions.state_as_of(log), "embedding", _q0(spark, d), 10)


@query(
    """SELECT query_id, id, distance, rank FROM (SELECT q.vec_id AS query_id, b.vec_id AS id, round(list_distance(b.embedding::DOUBLE[], q.embedding::DOUBLE[]) ^ 2, 6) AS distance,
CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(b.embedding::DOUBLE[], q.embedding::DOUBLE[]) ^ 2, 6), b.vec_id) AS INTEGER) AS rank
FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5"""
)
def knn_batch(spark, d):
    """The stated query set: every vector whose id is divisible by 50, against all vectors."""
    v = _vecs(spark, d)
    return knn.knn_join(v, v.where(F.col("id") % 50 == 0), "embedding", 5)


@query("SELECT o_orderkey AS id, o_custkey AS cust FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY id LIMIT 20")
def page_index_equals(spark, d):
    o = keyed(table(spark, d, "orders"), "o_orderkey", priority="o_orderpriority", cust="o_custkey")
    return paging.page_rows(indexes.by_index(o, Index.on("byPriority", "priority"), "2-HIGH"), 20, extra=0).select("id", "cust")


@query(
    """WITH p AS (SELECT o_orderkey AS id, o_custkey AS cust FROM orders WHERE o_orderpriority = '2-HIGH')
SELECT id, cust FROM p WHERE id > (SELECT max(id) FROM (SELECT id FROM p ORDER BY id LIMIT 20)) ORDER BY id LIMIT 20"""
)
def page_index_next(spark, d):
    o = keyed(table(spark, d, "orders"), "o_orderkey", priority="o_orderpriority", cust="o_custkey")
    rows = indexes.by_index(o, Index.on("byPriority", "priority"), "2-HIGH")
    cursor = paging.fetch_page(rows, 20).next_cursor
    return paging.page_rows(rows, 20, cursor, extra=0).select("id", "cust")


@query("SELECT c_name AS id, c_custkey AS k FROM customer WHERE c_name > 'Customer#000000050' ORDER BY c_name LIMIT 30")
def page_scan_next(spark, d):
    rows = versions.state_as_of(keyed(table(spark, d, "customer"), "c_name", k="c_custkey"))
    return paging.page_rows(rows, 30, "Customer#000000050", extra=0).select("id", "k")


@query(
    f"""WITH {LOG},
ops AS (SELECT o_custkey % 200 AS id, o_orderkey AS op_index, o_orderstatus = 'F' AS deleted, o_orderstatus AS kind, o_totalprice AS amount FROM orders),
numbered AS (SELECT id, (SELECT max(seq) FROM log) + row_number() OVER (ORDER BY op_index) AS seq, deleted,
  CASE WHEN deleted THEN NULL ELSE kind END AS kind, CASE WHEN deleted THEN NULL ELSE amount END AS amount FROM ops),
whole AS (SELECT * FROM log UNION ALL SELECT * FROM numbered)
SELECT id, seq, kind, amount FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM whole) WHERE r = 1 AND NOT deleted"""
)
def batch_apply(spark, d):
    """All orders applied to the event log as one batch of puts and deletes."""
    log = events_log(spark, d)
    o = table(spark, d, "orders")
    gone = F.col("o_orderstatus") == "F"
    ops = o.select((F.col("o_custkey") % 200).alias("id"), F.col("o_orderkey").alias("op_index"), gone.alias("deleted"), F.when(~gone, F.col("o_orderstatus")).alias("kind"), F.when(~gone, F.col("o_totalprice")).alias("amount"))
    base = versions.store_sequence(log).first()["sequence"]
    return versions.state_as_of(batch.apply_batch(log, ops, base)).select(*COLS)


@query(
    """WITH ops AS (SELECT s_suppkey AS id, 'Customer#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') AS name FROM supplier),
after AS (SELECT id, name FROM ops UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT id FROM ops))
SELECT name AS key, count(DISTINCT id) AS n_ids FROM after GROUP BY name HAVING count(DISTINCT id) > 1"""
)
def batch_unique_conflicts(spark, d):
    """Suppliers written over the customers of the same number under a name three numbers on."""
    log = keyed(table(spark, d, "customer"), "c_custkey", name="c_name")
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0"))
    ops = s.select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_suppkey").alias("op_index"), F.lit(False).alias("deleted"), name.alias("name"))
    return batch.batch_conflicts(log, ops, Index.on("byName", "name", "unique"), 1)


@query(
    """SELECT CAST(floor(log2(greatest(1, coalesce(size_bytes, 0) // 262144))) AS INTEGER) AS level, count(*) AS tables,
CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes FROM table_files GROUP BY 1"""
)
def compaction_levels(spark, d):
    return table_levels(table(spark, d, "table_files").select("size_bytes"))


@query(f"WITH {LOG} SELECT kind, count(*) AS n, round(avg(amount), 6) AS mean FROM state GROUP BY kind")
def sql_over_collections(spark, d):
    """Beyond the document API: states as views, joined and grouped by Spark SQL."""
    versions.state_as_of(events_log(spark, d)).createOrReplaceTempView("live_events")
    return spark.sql("SELECT kind, count(*) AS n, round(avg(amount), 6) AS mean FROM live_events GROUP BY kind")


@query("""SELECT '' AS secret, '["a", 1]' AS cursor UNION ALL SELECT 'k', '["a", 1]'""")
def page_token_round_trip(spark, d):
    """Tokens sealed and opened again, with and without a secret."""
    rows = [(s or "", paging.unseal(paging.seal(json.dumps(["a", 1]), s), s)) for s in (None, "k")]
    return spark.createDataFrame(rows, "secret string, cursor string")
