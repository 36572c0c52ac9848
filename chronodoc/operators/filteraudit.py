"""Do the stored key filters of tables hold the keys of their tables?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodoc.functions.filters import WORD, key_hashes

#: Words of a filter that are joined as one row.
SLICE = 1024


def filter_audit(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Per table with a usable filter: its distinct keys, how many the filter denies (wrong: false negatives), and its fill.

    ``files``: store, table_id, bits, hashes, created_at; ``entries``: store, table_id, raw. Filters without words, with null
    words or with hashes below 1 are not usable and give no row; of repeated file rows the newest counts, of equally new
    ones the one with the largest bits. Null raws and tables without a file row are left out.

    Plan: filters are cut into slices of ``SLICE`` words; every probe of a key becomes a row with its bit's place and meets
    the one slice that holds it, so the work is linear in keys and filter words, and a large table spreads over
    its slices. No filter is copied to keys or to the driver.
    """
    usable = files.where((F.size("bits") > 0) & (F.coalesce("hashes", F.lit(0)) >= 1) & ~F.exists("bits", lambda x: x.isNull()))
    newest = usable.groupBy("store", "table_id").agg(F.max(F.struct("created_at", "bits", "hashes")).alias("f"))
    newest = newest.select("store", "table_id", "f.bits", "f.hashes")
    keys = entries.where(F.col("raw").isNotNull()).select("store", "table_id", "raw").distinct()
    sized = newest.select("store", "table_id", "hashes", (F.size("bits").cast("long") * WORD).alias("n_bits"))
    asked = keys.join(sized, ["store", "table_id"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k, size = np.asarray(b.column(3)).astype(np.int64), np.asarray(b.column(4)).astype(np.uint64)
            at = (key_hashes(b.column(2).to_pylist(), int(k.max())) % size).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), k)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(at[turn, row])], names=["store", "table_id", "raw", "bit"])

    probes = asked.select("store", "table_id", "raw", "hashes", "n_bits").mapInArrow(probe, "store string, table_id string, raw binary, bit long")
    # two hashes of 96 bits in all stand for a key from here on
    probes = probes.select("store", "table_id", F.xxhash64("raw").alias("key"), F.crc32("raw").alias("check"), F.col("bit"))
    probes = probes.withColumn("slice", F.floor(F.col("bit") / (WORD * SLICE)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("bits") - 1) / SLICE).cast("int")), lambda i: F.struct(i.alias("slice"), F.slice("bits", i * SLICE + 1, F.lit(SLICE)).alias("words")))
    slices = newest.select("store", "table_id", F.explode(cut).alias("c")).select("store", "table_id", "c.slice", "c.words")
    met = probes.join(slices, ["store", "table_id", "slice"])
    inside = F.col("bit") % (WORD * SLICE)
    word = F.get("words", F.floor(inside / WORD).cast("int"))
    hit = F.getbit(word, (inside % WORD).cast("int"))
    per_key = met.groupBy("store", "table_id", "key", "check").agg(F.min(hit).alias("ok"))
    counted = per_key.groupBy("store", "table_id").agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(F.col("ok") == 0, 1)).alias("denied"))
    ones = F.aggregate("bits", F.lit(0).cast("long"), lambda acc, x: acc + F.bit_count(x))
    fill = newest.select("store", "table_id", F.round(ones / (F.size("bits") * WORD), 6).alias("fill"))
    return counted.join(fill, ["store", "table_id"])
