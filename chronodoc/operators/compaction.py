"""Small-file compaction of versioned tables, store by store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronodoc.operators.incremental import IncrementalTable, fingerprints, partition_key, successful_saves
from chronodoc.session import bounded, checkpointed

RECORD = T.StructType(
    [T.StructField(c, T.LongType() if c == "sequence" else T.StringType()) for c in ("store", "collection", "doc_key", "sequence", "value")]
)
KEY = ["store", "collection", "doc_key", "sequence"]


def live_tables(saves: DataFrame) -> DataFrame:
    """(store, table_id) of the tables listed by each store's successful save with the highest save_no.

    Redelivered saves and repeated ids collapse; a null or empty list means no table; saves without save_no
    are never the highest. Equal save_no with different lists: the union of the lists.
    """
    ok = successful_saves(saves).where(F.col("save_no").isNotNull())
    w = Window.partitionBy("store").orderBy(F.col("save_no").desc())
    last = ok.select("store", "save_no", "tables").withColumn("_r", F.rank().over(w)).where("_r = 1")
    return last.select("store", F.explode("tables").alias("table_id")).where("table_id is not null").distinct()


def live_entries(entries: DataFrame, live: DataFrame) -> DataFrame:
    """The entries of live tables only; tables left behind by merges and failed runs drop out."""
    side = live.select(F.col("store").alias("_s"), F.col("table_id").alias("_t"))
    return entries.join(side, F.col("store").eqNullSafe(F.col("_s")) & (F.col("table_id") == F.col("_t")), "left_semi")


def level_drift(saves: DataFrame, entries: DataFrame) -> DataFrame:
    """Per store: tables its newest successful save lists, tables its levels count, and tables that have entries.

    Shows which recorded figures cannot be trusted, the reason why ``CompactedTables`` measures sizes itself. Stores
    without a successful save with a save_no give no row; null levels count nothing; redelivered saves count once.
    """
    ok = successful_saves(saves).where(F.col("save_no").isNotNull())
    w = Window.partitionBy("store").orderBy(F.col("save_no").desc())
    last = ok.withColumn("_r", F.rank().over(w)).where("_r = 1").groupBy("store").agg(F.max("levels").alias("levels"))
    counted = F.aggregate(F.col("levels"), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x["tables"], F.lit(0)))
    live = live_tables(saves)
    filled = live_entries(entries.select("store", "table_id").distinct(), live)
    listed = live.groupBy("store").agg(F.count(F.lit(1)).alias("listed"))
    found = filled.groupBy("store").agg(F.count(F.lit(1)).alias("with_entries"))
    both = last.select("store", F.coalesce(counted, F.lit(0)).alias("in_levels"))
    for side in (listed, found):
        other = side.withColumnRenamed("store", "_s")
        both = both.join(other, F.col("store").eqNullSafe(F.col("_s")), "left").drop("_s")
    return both.na.fill(0, ["listed", "with_entries"])


@dataclass
class CompactionReport:
    version: int
    rewritten: int
    kept: int


class CompactedTables:
    """Compacted tables under ``path``, kept as an ``IncrementalTable`` with one partition a store.

    Tables are immutable, so the list of a store's live tables says which records it has: its fingerprint is the
    fingerprint of that list. ``compact`` measures the live tables of stores whose list has changed from the entries
    themselves (recorded sizes may be wrong), picks the stores with more than ``max_small`` tables below ``small_bytes``,
    and rewrites only those: their records, each once, in tables of about ``target_bytes``, sorted by key and
    sequence and cut at any record, so that the versions of one hot document also spread over tables and tasks.
    Versions and conflicts are those of ``IncrementalTable``: a writer that loses has changed nothing that anyone reads.
    ``records`` uses a compacted partition only while the store's list is the one it was made from.
    """

    def __init__(self, spark: SparkSession, path: str, *, small_bytes: int = 16 << 20, target_bytes: int = 128 << 20, max_small: int = 4):
        self.spark, self.path = spark, path
        self.small_bytes, self.target_bytes, self.max_small = small_bytes, target_bytes, max_small
        self.table = IncrementalTable(spark, path, RECORD)

    def plan(self, entries: DataFrame, live: DataFrame) -> DataFrame:
        """Per store: number and bytes of live tables, small ones, and tables after a rewrite (0: leave as is)."""
        width = F.coalesce(F.octet_length("doc_key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)) + 24
        sizes = entries.groupBy("store", "table_id").agg(F.sum(width.cast("long")).alias("_b"), F.count(F.lit(1)).alias("_n"))
        per_store = live_entries(sizes, live).groupBy("store").agg(
            F.count(F.lit(1)).alias("tables"),
            F.count(F.when(F.col("_b") < self.small_bytes, 1)).alias("small"),
            F.sum("_b").alias("bytes"),
            F.sum("_n").alias("entries"),
        )
        after = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(self.target_bytes))).cast("int")
        return per_store.withColumn("n_out", F.when(F.col("small") > self.max_small, after).otherwise(F.lit(0)))

    def _lists(self, live: DataFrame, content: dict) -> DataFrame:
        """Fingerprint of every store's list of live tables, and whether the commit was made from it."""
        old = self.table.prints(content).select("pkey", *[F.col(c).alias(f"o_{c}") for c in ("n_rows", "low", "high")])
        same = (F.col("n_rows") == F.col("o_n_rows")) & (F.col("low") == F.col("o_low")) & (F.col("high") == F.col("o_high"))
        lists = fingerprints(live.select("store", "table_id"), partition_key(F.col("store")))
        return lists.join(old, "pkey", "left").select("pkey", "n_rows", "low", "high", F.coalesce(same, F.lit(False)).alias("done"))

    def compact(self, entries: DataFrame, live: DataFrame) -> CompactionReport:
        """Rewrite the stores that need it. ``entries``: store, table_id, collection, doc_key, sequence, value;
        ``live``: (store, table_id). A deletion and a value under one (store, collection, doc_key, sequence): the value
        is kept."""
        base, live = self.table.log.begin(), checkpointed(live)
        lists = checkpointed(self._lists(live, base.content))
        key = partition_key(F.col("store"))
        done = bounded(lists.where("done").select(F.col("pkey").alias("_p")))[0]
        news = bounded(live.join(done, key == F.col("_p"), "left_anti"))[0]
        plan = checkpointed(self.plan(live_entries(entries, news), news).withColumn("pkey", key))
        todo = plan.where("n_out > 0")
        stores, size = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        # ranges of the target size over all stores together; small stores share a task, each with files of its own
        n = max(-(-size // self.target_bytes), min(stores, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), 1)
        wanted = lists.join(todo.select("pkey"), "pkey", "left_semi").unionByName(lists.where("done"))

        def compute(changed: DataFrame, small: bool) -> DataFrame:
            picked = bounded(live.join(changed.select(F.col("pkey").alias("_p")), key == F.col("_p"), "left_semi"))[0]
            # copies of a record are combined in the tasks that read them, before the ranges are drawn
            once = live_entries(entries, picked).groupBy(*KEY).agg(F.max("value").alias("value")).withColumn("pkey", key)
            order = ["pkey", "collection", "doc_key", "sequence"]
            return once.repartitionByRange(n, *order).sortWithinPartitions(*order)

        report = self.table.run(wanted, compute, base=base, rebalance=False)
        return CompactionReport(report.version, stores, plan.count() - stores)

    def records(self, entries: DataFrame, live: DataFrame) -> DataFrame:
        """(store, collection, doc_key, sequence) of every live record once: from the compacted tables where they stand
        for the store's present list, else from ``entries``."""
        content, live = self.table.log.latest()[1], checkpointed(live)
        done = bounded(self._lists(live, content).where("done").select("pkey"))[0]
        rest = bounded(live.join(done, partition_key(F.col("store")) == F.col("pkey"), "left_anti"))[0]
        return self.table.read(done, content).select(*KEY).unionByName(live_entries(entries, rest).select(*KEY).distinct())
