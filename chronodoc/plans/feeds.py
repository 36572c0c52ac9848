"""Queries p2, p3 and p5: pending changes, rebuilt state, compaction. Each with its SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodoc.operators.changes import current_documents, live
from chronodoc.operators.compaction import CompactedTables, level_drift, live_tables
from chronodoc.operators.incremental import refresh_pending, successful_saves
from chronodoc.plans.tables import table
from chronodoc.session import scratch


def _two_runs(spark: SparkSession, sf_dir: str, path: str, again: int = 0):
    """Table of pending changes and reports of two runs under ``path``: over the first nine tenths of the frames by
    record_no, as an earlier run met them, then over all; ``again``: further runs over all."""
    frames, saves = table(spark, sf_dir, "wal_frames"), table(spark, sf_dir, "manifest_saves")
    most = frames.agg(F.floor(F.max("record_no") * 9 / 10).alias("m")).first()["m"]
    runs = [frames.where(F.col("record_no") <= F.lit(most)), *[frames] * (1 + again)]
    done = [refresh_pending(spark, rows, saves, path) for rows in runs]
    return done[-1][0], [report for _, report in done]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read from the second of two runs, so that partitions were skipped, replaced and added."""
    return _two_runs(spark, sf_dir, scratch(spark, "p2"))[0].read().select("store", "sequence")


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over a growing input: nine tenths of the frames by record_no, all of them, all again."""
    _, reports = _two_runs(spark, sf_dir, scratch(spark, "p2r"), again=1)
    return spark.createDataFrame([(i, r.partitions, r.changed) for i, r in enumerate(reports, 1)], "run int, partitions long, changed long")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = live(current_documents(table(spark, sf_dir, "wal_frames")))
    return docs.select("store", "collection", "doc_key", "sequence")


def p3_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rebuilt table, tombstones included."""
    docs = current_documents(table(spark, sf_dir, "wal_frames"))
    return docs.select("store", "collection", "doc_key", "sequence", "operation", "value")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "table_entries").select("store", "table_id", "collection", "doc_key", "sequence", "value")


def _earlier(saves: DataFrame) -> DataFrame:
    """The saves before each store's newest successful one."""
    good = successful_saves(saves).select(F.col("store").alias("_s"), "save_no").where("save_no is not null")
    last = good.groupBy("_s").agg(F.max("save_no").alias("_m"))
    return saves.join(last, F.col("store").eqNullSafe(F.col("_s"))).where(F.col("save_no") < F.col("_m")).drop("_s", "_m")


def _compactions(spark: SparkSession, sf_dir: str, path: str):
    """Two compactions under ``path``: of the tables listed before each store's newest successful save, then of the newest."""
    entries, saves = _entries(spark, sf_dir), table(spark, sf_dir, "manifest_saves")
    tables = CompactedTables(spark, path)
    reports = [tables.compact(entries, live_tables(s)) for s in (_earlier(saves), saves)]
    return tables, reports


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read after the second of two compactions: stores were rewritten, replaced and left alone."""
    tables, _ = _compactions(spark, sf_dir, scratch(spark, "p5"))
    return tables.records(_entries(spark, sf_dir), live_tables(table(spark, sf_dir, "manifest_saves")))


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores rewritten and left alone by three compactions: of an earlier state, of the present one, of the same again."""
    tables, reports = _compactions(spark, sf_dir, scratch(spark, "p5r"))
    reports.append(tables.compact(_entries(spark, sf_dir), live_tables(table(spark, sf_dir, "manifest_saves"))))
    return spark.createDataFrame([(i, r.rewritten, r.kept) for i, r in enumerate(reports, 1)], "run int, rewritten long, kept long")


def p5_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per store: live tables, small ones among them, entries, and tables after the rewrite (0: left alone)."""
    plan = CompactedTables(spark, scratch(spark, "p5")).plan(_entries(spark, sf_dir), live_tables(table(spark, sf_dir, "manifest_saves")))
    return plan.select("store", "tables", "small", "entries", "n_out")


def p5_level_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_drift(table(spark, sf_dir, "manifest_saves"), table(spark, sf_dir, "table_entries"))


CHANGES = """
ops AS (SELECT * FROM wal_frames WHERE frame_type IS NULL OR lower(trim(frame_type)) = 'op'),
commits AS (SELECT store AS cs, txid AS ct, min(arrived_at) AS ca FROM wal_frames
            WHERE lower(trim(frame_type)) = 'commit' AND txid IS NOT NULL GROUP BY ALL),
committed AS (SELECT o.*, CASE WHEN txid IS NULL THEN arrived_at WHEN arrived_at > ca THEN arrived_at ELSE ca END AS available_at
              FROM ops o LEFT JOIN commits ON cs = store AND ct = txid WHERE txid IS NULL OR ct IS NOT NULL)
"""
SAVES = """
saves AS (SELECT * FROM manifest_saves WHERE lower(trim(outcome)) = 'saved' AND saved_at IS NOT NULL)
"""
LIVE_RECORDS = f"""
{SAVES},
listed AS (SELECT DISTINCT store, unnest(tables) AS table_id FROM saves s
           WHERE save_no = (SELECT max(save_no) FROM saves t WHERE t.store = s.store)),
records AS (SELECT e.* FROM table_entries e SEMI JOIN listed l ON e.store = l.store AND e.table_id = l.table_id)
"""
STATE = f"""
WITH {CHANGES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY store, collection, doc_key ORDER BY sequence DESC,
                CASE WHEN value IS NULL OR value = '' THEN 0 ELSE 1 END DESC, value DESC NULLS LAST) AS r FROM committed)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_runs": p2_runs,
    "p3_found": p3_found,
    "p3_state": p3_state,
    "p5_found": p5_found,
    "p5_runs": p5_runs,
    "p5_plan": p5_plan,
    "p5_level_drift": p5_level_drift,
}

ORACLES = {
    "p2_found": f"""WITH {CHANGES}, {SAVES},
once AS (SELECT store, sequence, txid, collection, doc_key, value, min(available_at) AS available_at FROM committed GROUP BY ALL)
SELECT DISTINCT store, sequence FROM once o WHERE NOT EXISTS (
  SELECT 1 FROM saves s WHERE s.store = o.store AND o.sequence <= s.sequence AND o.available_at < s.started_at)""",
    "p2_runs": """WITH cut AS (SELECT max(record_no) * 9 // 10 AS m FROM wal_frames),
before AS (SELECT store FROM manifest_saves UNION SELECT store FROM wal_frames, cut WHERE record_no <= m),
after AS (SELECT store FROM manifest_saves UNION SELECT store FROM wal_frames),
news AS (SELECT DISTINCT store FROM wal_frames, cut WHERE record_no > m)
SELECT 1::INTEGER AS run, count(*) AS partitions, count(*) AS changed FROM before
UNION ALL SELECT 2, (SELECT count(*) FROM after), (SELECT count(*) FROM news)
UNION ALL SELECT 3, (SELECT count(*) FROM after), 0""",
    "p3_found": f"{STATE} SELECT store, collection, doc_key, sequence FROM ranked WHERE r = 1 AND value IS NOT NULL AND value <> ''",
    "p3_state": f"""{STATE} SELECT store, collection, doc_key, sequence,
CASE WHEN value IS NULL OR value = '' THEN 0 ELSE 1 END AS operation, value FROM ranked WHERE r = 1""",
    "p5_found": f"WITH {LIVE_RECORDS} SELECT DISTINCT store, collection, doc_key, sequence FROM records",
    "p5_runs": f"""WITH {SAVES},
top AS (SELECT store, max(save_no) AS m FROM saves GROUP BY store),
below AS (SELECT s.store, max(s.save_no) AS m FROM saves s, top t WHERE s.store = t.store AND s.save_no < t.m GROUP BY s.store),
lists AS (SELECT DISTINCT 1 AS run, s.store, unnest(tables) AS table_id FROM saves s, below b WHERE s.store = b.store AND save_no = m
          UNION SELECT DISTINCT 2, s.store, unnest(tables) FROM saves s, top t WHERE s.store = t.store AND save_no = m),
named AS (SELECT run, store, list(table_id ORDER BY table_id) AS ids FROM lists WHERE table_id IS NOT NULL GROUP BY ALL),
sizes AS (SELECT store, table_id, sum(coalesce(octet_length(encode(doc_key)), 0) + coalesce(octet_length(encode(value)), 0) + 24) AS b FROM table_entries GROUP BY ALL),
states AS (SELECT run, l.store, count(*) FILTER (b < 16777216) > 4 AS heavy FROM lists l JOIN sizes z ON l.store = z.store AND l.table_id = z.table_id GROUP BY ALL),
first_done AS (SELECT n.store, ids FROM named n JOIN states s ON n.run = 1 AND s.run = 1 AND n.store = s.store WHERE heavy),
second AS (SELECT s.store, heavy FROM states s JOIN named n ON n.run = 2 AND n.store = s.store LEFT JOIN first_done d ON d.store = s.store
           WHERE s.run = 2 AND (d.ids IS NULL OR d.ids <> n.ids))
SELECT 1::INTEGER AS run, count(*) FILTER (heavy) AS rewritten, count(*) FILTER (NOT heavy) AS kept FROM states WHERE run = 1
UNION ALL SELECT 2, count(*) FILTER (heavy), count(*) FILTER (NOT heavy) FROM second
UNION ALL SELECT 3, 0, count(*) FILTER (NOT heavy) FROM states WHERE run = 2""",
    "p5_level_drift": f"""WITH {LIVE_RECORDS},
last_save AS (SELECT store, max(levels) AS levels FROM saves s WHERE save_no = (SELECT max(save_no) FROM saves t WHERE t.store = s.store) GROUP BY store)
SELECT store, CAST(coalesce(list_sum(list_transform(levels, lambda x: coalesce(x.tables, 0))), 0) AS BIGINT) AS in_levels,
(SELECT count(*) FROM listed l WHERE l.store = s.store AND table_id IS NOT NULL) AS listed,
(SELECT count(DISTINCT table_id) FROM records r WHERE r.store = s.store) AS with_entries FROM last_save s""",
    "p5_plan": f"""WITH {LIVE_RECORDS},
per_table AS (SELECT store, table_id, sum(coalesce(octet_length(encode(doc_key)), 0) + coalesce(octet_length(encode(value)), 0) + 24) AS b,
              count(*) AS n FROM records GROUP BY ALL),
per_store AS (SELECT store, count(*) AS tables, count(*) FILTER (b < 16777216) AS small, sum(b) AS bytes,
              CAST(sum(n) AS BIGINT) AS entries FROM per_table GROUP BY store)
SELECT store, tables, small, entries,
CAST(CASE WHEN small > 4 THEN greatest(1, ceil(bytes / 134217728.0)) ELSE 0 END AS INTEGER) AS n_out FROM per_store""",
}
