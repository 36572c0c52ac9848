"""Live state of an append-only version log by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def live_state(spark: SparkSession, path: str, schema, *, keys: tuple[str, ...] = ("collection", "id")) -> DataFrame:
    """Streaming frame with the latest version per key (tombstones included as ``deleted``).

    The state store holds one row per key: the maximum of (seq, live, values). It is the batch fold, with its rule for
    versions of one sequence (a live one wins), so order of arrival and redelivery do not matter. Use output mode
    ``complete`` or ``update``.
    """
    rows = spark.readStream.schema(schema).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "seq", "deleted")]
    top = F.max(F.struct("seq", (~F.col("deleted")).alias("_live"), "deleted", *rest)).alias("_t")
    return rows.groupBy(*keys).agg(top).select(*keys, "_t.*").drop("_live")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over everything available now into a memory table and return it."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
