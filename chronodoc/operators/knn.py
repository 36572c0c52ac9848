"""Exact nearest-neighbour search of one or a few query vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronodoc.functions.vectors import METRICS, doubles
from chronodoc.model import InvalidRequest


def vector_search(docs: DataFrame, embedding: str, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """(id, distance) of the k nearest, at 6 decimals, ties by id.

    Null embeddings are left out; an embedding of another length than the query raises when it is met. Plan: the
    query is a literal, each task keeps its k best rows (TakeOrderedAndProject).
    """
    if metric not in METRICS:
        raise InvalidRequest(f"unknown metric {metric!r}")
    q = F.array(*[F.lit(float(x)) for x in query])
    e = doubles(F.col(embedding))
    ok = F.when(F.size(e) == len(query), METRICS[metric](e, q)).otherwise(F.raise_error(F.lit("embedding of another dimension")).cast("double"))
    return docs.where(F.col(embedding).isNotNull()).select("id", F.round(ok, 6).alias("distance")).orderBy("distance", "id").limit(max(0, k))


def knn_join(base: DataFrame, queries: DataFrame, embedding: str, k: int, metric: str = "l2", *, max_queries: int = 10_000) -> DataFrame:
    """(query_id, id, distance, rank): exact k nearest of every query row, for a stated, bounded set of queries.

    The queries are broadcast after their number has been checked; more than ``max_queries`` raise. A row is
    not its own neighbour.
    """
    if queries.limit(max_queries + 1).count() > max_queries:
        raise InvalidRequest(f"more than {max_queries} queries")
    q = F.broadcast(queries.select(F.col("id").alias("query_id"), doubles(F.col(embedding)).alias("_q")))
    pairs = base.where(F.col(embedding).isNotNull()).select("id", doubles(F.col(embedding)).alias("_e")).join(q, F.col("id") != F.col("query_id"))
    rows = pairs.select("query_id", "id", F.round(METRICS[metric](F.col("_e"), F.col("_q")), 6).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
