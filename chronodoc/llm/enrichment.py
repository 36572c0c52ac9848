"""How distinctive a term is for a record: exact hypergeometric enrichment, false-discovery adjusted."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronodoc.functions.text import default_analyzer as terms
from chronodoc.llm.termstats import current_texts, term_stats
from chronodoc.session import bounded, checkpointed

#: A term in more than this share of all (record, term) rows is joined by broadcast; at most 1/share terms are.
HOT_SHARE = 0.0005
#: Records a term must have to count as hot at all; below that no task can be held up by it.
HOT_FLOOR = 1000.0


@lru_cache(1)
def _small() -> np.ndarray:
    return np.array([math.lgamma(i) if i else 0.0 for i in range(1024)])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of whole numbers >= 1: a table below 1024, Stirling's series (error below 1e-15) above."""
    x = np.asarray(x, np.float64)
    big = np.maximum(x, 1024.0)
    series = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(x < 1024, _small()[np.minimum(x, 1023).astype(np.int64)], series)


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def upper_tail(f: np.ndarray, n: np.ndarray, k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """-ln P(X >= f) for X hypergeometric: n draws from t, k of them marked. All arrays of whole numbers.

    The first summand comes from log-gamma sums, each further one from the last by their exact ratio; the sum
    runs until the rest is below 1e-17 of it. f at or below the smallest possible count gives 0.
    """
    f, n, k, t = (np.asarray(a, np.float64) for a in (f, n, k, t))
    low = np.maximum(0.0, n + k - t)
    at = np.maximum(f, low)
    first = log_choose(k, at) + log_choose(t - k, n - at) - log_choose(t, n)
    total, term, x, act = np.ones_like(first), np.ones_like(first), at.copy(), np.arange(len(first))
    while len(act):
        xs, ks, ns, ts = x[act], k[act], n[act], t[act]
        ratio = (ks - xs) * (ns - xs) / ((xs + 1) * (ts - ks - ns + xs + 1))
        term[act] *= ratio
        total[act] += term[act]
        x[act] += 1
        done = (x[act] >= np.minimum(ks, ns)) | ((term[act] < total[act] * 1e-17) & (ratio < 1))
        act = act[~done]
    return np.where(f <= low, 0.0, np.maximum(0.0, -(first + np.log(total))))


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(surprise=upper_tail(b["f"].to_numpy(), b["n"].to_numpy(), b["k"].to_numpy(), b["t"].to_numpy()))


ROWS = "id long, term string, f long, n long, k long, d long, t long, n_records long, surprise double"


def term_enrichment(docs: DataFrame) -> DataFrame:
    """Every (id, term) of the current texts with its counts, ``surprise`` and adjusted ``score``.

    f: count in the record; n: terms of the record; k, d: occurrences and records of the term in the whole
    collection; t: terms of the collection; n_records: current records with non-null text. surprise =
    -ln P(X >= f) for n draws without replacement; score = -ln of the Benjamini-Hochberg adjusted
    probability among the terms of the same record (ties share the larger rank). Records without terms
    give no row; null and empty texts have none.

    Plan: the texts are read once, and counts need the one shuffle by id; term statistics are joined by a shuffle on term, except for
    the few terms that make up more than ``HOT_SHARE`` of all rows, which are joined by broadcast (there are at
    most 1 / HOT_SHARE of them, whatever the size), so that no task gets a hot term's rows.
    """
    words = current_texts(docs).select("id", terms(F.col("text")).alias("_w"))
    # an empty term marks the record, so that records without terms are counted in the same pass
    rows = words.select("id", F.size("_w").cast("long").alias("n"), F.explode(F.concat("_w", F.array(F.lit("")))).alias("term"))
    counts = checkpointed(rows.groupBy("id", "n", "term").agg(F.count(F.lit(1)).alias("f")))
    n_records = counts.where("term = ''").agg(F.count(F.lit(1)).alias("n_records"))
    counts = counts.where("term <> ''")
    stats = checkpointed(term_stats(counts).select("term", F.col("occurrences").alias("k"), F.col("records").alias("d")))
    whole = stats.agg(F.sum("k").alias("t"), F.sum("d").alias("_rows")).crossJoin(n_records)
    whole = checkpointed(whole)  # one row
    often = F.greatest(F.lit(HOT_FLOOR), F.col("_rows") * HOT_SHARE)
    hot, _ = bounded(stats.crossJoin(F.broadcast(whole.select("_rows"))).where(F.col("d") > often).drop("_rows"))
    cold = stats.join(hot.select("term"), "term", "left_anti")
    joined = counts.join(hot, "term").unionByName(counts.join(hot.select("term"), "term", "left_anti").join(cold, "term"))
    rows = joined.crossJoin(F.broadcast(whole.drop("_rows"))).select("id", "term", "f", "n", "k", "d", "t", "n_records")
    scored = rows.mapInPandas(_score, ROWS)
    mine = Window.partitionBy("id")
    by_rank = mine.orderBy(F.col("surprise").desc())
    ranked = scored.withColumn("_m", F.count(F.lit(1)).over(mine)).withColumn(
        "_rank", F.count(F.lit(1)).over(by_rank.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    )
    adjusted = F.col("surprise") - F.log(F.col("_m") / F.col("_rank"))
    # the smallest adjusted probability at this or a larger probability is the largest score there
    best = F.max(adjusted).over(mine.orderBy(F.col("surprise").asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("score", F.greatest(F.lit(0.0), best)).drop("_m", "_rank")


def most_distinctive(scored: DataFrame, *, min_records: int = 2) -> DataFrame:
    """(id, term): of each record the term with the highest f ln(N / d), at 6 decimals, among d >= ``min_records``.

    Ties go to the smallest term by bytes; records without such a term give no row.
    """
    weight = F.round(F.col("f") * F.log(F.col("n_records") / F.col("d")), 6)
    rows = scored.where(F.col("d") >= min_records).select("id", F.struct((-weight).alias("w"), "term").alias("_s"))
    return rows.groupBy("id").agg(F.min("_s").alias("_s")).select("id", "_s.term")
