"""Queries of the llm subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodoc.llm import cuckoo, encoding, enrichment, leakage, quality, similar, termstats
from chronodoc.operators.compaction import live_tables
from chronodoc.plans.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.judge_arrivals(table(spark, sf_dir, "table_entries"), table(spark, sf_dir, "key_arrivals"))[0]


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: judged arrivals, arrivals without a key, new keys."""
    return cuckoo.judge_arrivals(table(spark, sf_dir, "table_entries"), table(spark, sf_dir, "key_arrivals"))[1]


def p1_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: wrong 'maybe' verdicts and their rate of tables that were made for 64 keys a partition and grew."""
    return cuckoo.judge_arrivals(table(spark, sf_dir, "table_entries"), table(spark, sf_dir, "key_arrivals"), first_size=64)[2]


def p1_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen arrivals once the keys that only dead tables hold are deleted from the kept tables."""
    live = live_tables(table(spark, sf_dir, "manifest_saves"))
    return cuckoo.judge_after_merge(table(spark, sf_dir, "table_entries"), live, table(spark, sf_dir, "key_arrivals"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termstats.marked_terms(table(spark, sf_dir, "text_docs")).where("mark is not null").select("term", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termstats.marked_terms(table(spark, sf_dir, "text_docs"))


def p4_index_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termstats.index_drift(table(spark, sf_dir, "text_docs"), table(spark, sf_dir, "fts_postings"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.nearest_pairs(table(spark, sf_dir, "vec_docs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.most_distinctive(enrichment.term_enrichment(table(spark, sf_dir, "text_docs")))


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score at 3 decimals: sums of log-gammas of numbers in the millions differ from the eighth decimal on."""
    rows = enrichment.term_enrichment(table(spark, sf_dir, "text_docs"))
    return rows.select("id", "term", "f", "n", "k", "d", F.round("surprise", 3).alias("surprise"), F.round("score", 3).alias("score"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_documents(table(spark, sf_dir, "documents"))


def p8_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, ids, joins of halves and windows that had to grow."""
    rows = encoding.encode_documents(table(spark, sf_dir, "documents"), report=True)
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("ids").cast("long")).alias("ids"), F.sum("joins").alias("joins"), F.sum("widened").alias("widened"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an item leaked, and from where to where: the longest shared run of terms."""
    return leakage.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failed_checks(quality.text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")))


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, words = table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")
    return quality.text_counts(docs, words).select("doc_id", "words", "word_chars", "ink", "symbol_chars", "lines", "ended", "common")


def p10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from the language's prose and each statistic's part in it."""
    rows = quality.text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    parts = [F.round(F.col("contributions")[i], 6).alias(f"from_{s}") for i, s in enumerate(quality.STATS)]
    return rows.select("doc_id", "lang", "words", F.round("distance", 6).alias("distance"), *parts)


CURRENT = """
current_docs AS (SELECT id, text FROM (SELECT id, text, row_number() OVER (
    PARTITION BY id ORDER BY sequence DESC NULLS LAST, text DESC NULLS LAST) AS r FROM text_docs) WHERE r = 1 AND text IS NOT NULL),
counts AS (SELECT id, term, count(*) AS f FROM (
    SELECT id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+')) AS term FROM current_docs) WHERE term <> '' GROUP BY ALL),
stats AS (SELECT term, CAST(sum(f) AS BIGINT) AS occurrences, count(*) AS records FROM counts GROUP BY term),
size AS (SELECT count(*) AS n_docs FROM current_docs)
"""
MARKED = """SELECT term, occurrences, records, CASE WHEN occurrences < 5 OR records < 3 THEN 'rare'
WHEN records * 5 > n_docs THEN 'common' END AS mark FROM stats, size"""
INK = r"regexp_replace(text, '[ \t\r\n]+', '', 'g')"
COUNTS = rf"""
docs AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '') AS words,
  list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '') AS ls
  FROM documents WHERE text IS NOT NULL),
vocabulary AS (SELECT list(DISTINCT word) AS vs FROM common_words),
counted AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS words,
  CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
  CAST(length({INK}) AS BIGINT) AS ink,
  CAST(length(regexp_replace({INK}, '[\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')) AS BIGINT) AS symbol_chars,
  CAST(len(ls) AS BIGINT) AS lines,
  CAST(len(list_filter(ls, lambda l: l[-1] IN ('.', '!', '?', ';', ':', '。', '！', '？'))) AS BIGINT) AS ended,
  CAST(len(list_filter(words, lambda w: list_contains(vs, w))) AS BIGINT) AS common FROM docs, vocabulary)
"""

RUNS = r"""
docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(item_text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS ws FROM eval_items WHERE item_text IS NOT NULL),
sized AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM items WHERE len(ws) > 0),
item_runs AS (SELECT item_id, n, a, array_to_string(ws[a : a + n - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS a FROM sized)),
sizes AS (SELECT DISTINCT n FROM sized),
doc_runs AS (SELECT doc_id, n, a, array_to_string(ws[a : a + n - 1], ' ') AS run FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS a FROM docs, sizes))
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p1_audit": p1_audit,
    "p1_after_merge": p1_after_merge,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p4_index_drift": p4_index_drift,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_scores": p7_scores,
    "p8_ids": p8_ids,
    "p8_joins": p8_joins,
    "p9_found": p9_found,
    "p9_overlaps": p9_overlaps,
    "p10_found": p10_found,
    "p10_counts": p10_counts,
    "p10_quality": p10_quality,
}

ORACLES = {
    "p1_found": """WITH first_of AS (SELECT raw, min(arrival_no) AS a FROM key_arrivals WHERE raw IS NOT NULL GROUP BY raw)
SELECT k.arrival_no FROM key_arrivals k JOIN first_of f ON k.raw = f.raw
WHERE k.arrival_no > f.a OR EXISTS (SELECT 1 FROM table_entries e WHERE e.raw = k.raw)""",
    "p1_counts": """SELECT count(raw) AS judged, count(*) - count(raw) AS not_judged,
(SELECT count(*) FROM (SELECT DISTINCT raw FROM key_arrivals WHERE raw IS NOT NULL) a WHERE raw NOT IN (SELECT raw FROM table_entries WHERE raw IS NOT NULL)) AS new_keys
FROM key_arrivals""",
    "p1_after_merge": """WITH saves AS (SELECT * FROM manifest_saves WHERE lower(trim(outcome)) = 'saved' AND saved_at IS NOT NULL),
listed AS (SELECT DISTINCT store, unnest(tables) AS table_id FROM saves s WHERE save_no = (SELECT max(save_no) FROM saves t WHERE t.store = s.store)),
kept AS (SELECT DISTINCT raw FROM table_entries e SEMI JOIN listed l ON e.store = l.store AND e.table_id = l.table_id),
first_of AS (SELECT raw, min(arrival_no) AS a FROM key_arrivals WHERE raw IS NOT NULL GROUP BY raw)
SELECT k.arrival_no FROM key_arrivals k JOIN first_of f ON k.raw = f.raw WHERE k.arrival_no > f.a OR EXISTS (SELECT 1 FROM kept WHERE kept.raw = k.raw)""",
    "p4_found": f"WITH {CURRENT} SELECT term, mark FROM ({MARKED}) WHERE mark IS NOT NULL",
    "p4_terms": f"WITH {CURRENT} {MARKED}",
    "p4_index_drift": f"""WITH {CURRENT},
held AS (SELECT term, unnest(map_entries(postings)) AS e FROM fts_postings),
kept AS (SELECT term, CAST(sum(e.value) AS BIGINT) AS index_occurrences, count(DISTINCT e.key) AS index_records
         FROM held WHERE e.value IS NOT NULL GROUP BY term),
both_sides AS (SELECT coalesce(s.term, k.term) AS term, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records,
         coalesce(index_occurrences, 0) AS index_occurrences, coalesce(index_records, 0) AS index_records
         FROM stats s FULL JOIN kept k ON s.term = k.term)
SELECT * FROM both_sides WHERE occurrences <> index_occurrences OR records <> index_records""",
    "p6_found": """WITH
cur AS (SELECT id, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sequence DESC NULLS LAST) AS r FROM vec_docs)
        WHERE r = 1 AND id IS NOT NULL AND len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sims AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM cur a, cur b WHERE a.id <> b.id),
firsts AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS r FROM sims)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM firsts WHERE r <= 3 AND sim >= 0.8""",
    "p7_found": f"""WITH {CURRENT},
weighed AS (SELECT id, c.term, round(f * ln(n_docs / records), 6) AS w FROM counts c JOIN stats s ON c.term = s.term, size WHERE records >= 2)
SELECT id, term FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, term) AS r FROM weighed) WHERE r = 1""",
    "p7_scores": f"""WITH {CURRENT},
sized AS (SELECT id, CAST(sum(f) AS BIGINT) AS n FROM counts GROUP BY id),
whole AS (SELECT CAST(sum(f) AS BIGINT) AS t FROM counts),
wide AS (SELECT c.id, c.term, c.f, n, occurrences AS k, records AS d, t FROM counts c JOIN sized z ON c.id = z.id JOIN stats s ON c.term = s.term, whole),
cases AS (SELECT DISTINCT f, n, k, t FROM wide),
points AS (SELECT f, n, k, t, x, lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(t - k + 1) - lgamma(n - x + 1)
  - CASE WHEN t - k - n + x >= 0 THEN lgamma(t - k - n + x + 1) END - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1) AS g
  FROM (SELECT *, unnest(range(f, least(n, k) + 1)) AS x FROM cases)),
tops AS (SELECT f, n, k, t, max(g) AS m FROM points GROUP BY ALL),
tails AS (SELECT p.f, p.n, p.k, p.t, greatest(0, -(any_value(m) + ln(sum(exp(g - m))))) AS s
  FROM points p JOIN tops o ON p.f = o.f AND p.n = o.n AND p.k = o.k AND p.t = o.t WHERE g IS NOT NULL GROUP BY ALL),
surprises AS (SELECT w.*, CASE WHEN w.f <= w.n + w.k - w.t THEN 0 ELSE s END AS s FROM wide w LEFT JOIN tails q ON w.f = q.f AND w.n = q.n AND w.k = q.k AND w.t = q.t),
ranked AS (SELECT *, count(*) OVER (PARTITION BY id) AS m, count(*) OVER (PARTITION BY id ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM surprises)
SELECT id, term, f, n, k, d, round(s, 3) AS surprise,
  round(greatest(0, max(s - ln(m / r)) OVER (PARTITION BY id ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 3) AS score FROM ranked""",
    "p10_found": f"""WITH {COUNTS},
failed AS (SELECT doc_id, unnest([
  CASE WHEN words < 40 THEN 'few_words' END,
  CASE WHEN words > 0 AND (word_chars / words < 3.5 OR word_chars / words > 9) THEN 'word_length' END,
  CASE WHEN words > 0 AND symbol_chars / ink > 0.15 THEN 'symbols' END,
  CASE WHEN words > 0 AND ended / lines < 0.3 THEN 'line_ends' END,
  CASE WHEN words > 0 AND common / words < 0.15 THEN 'common_words' END]) AS failed_check FROM counted)
SELECT * FROM failed WHERE failed_check IS NOT NULL""",
    "p10_counts": f"WITH {COUNTS} SELECT * FROM counted",
    "p9_found": f"WITH {RUNS} SELECT DISTINCT doc_id, item_id FROM doc_runs d JOIN item_runs i ON d.n = i.n AND d.run = i.run",
    "p9_overlaps": f"""WITH {RUNS},
hits AS (SELECT doc_id, item_id, d.n, d.a AS x, i.a AS y FROM doc_runs d JOIN item_runs i ON d.n = i.n AND d.run = i.run),
isles AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, item_id, x - y ORDER BY x) AS g FROM hits),
shared AS (SELECT doc_id, item_id, n + count(*) - 1 AS length, min(x) - 1 AS x, min(y) - 1 AS y FROM isles GROUP BY doc_id, item_id, n, x - y, g)
SELECT doc_id, item_id, length::INTEGER AS length, x::BIGINT AS doc_at, y::INTEGER AS item_at FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY length DESC, x, y) AS r FROM shared) WHERE r = 1""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
