"""Term frequencies over a versioned text collection, with marks for too rare and too common terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodoc.functions.text import default_analyzer as terms


def current_texts(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, text) of the row with the highest sequence of each id, if its text is not null.

    Equal highest sequences: the larger text. Null sequences lose against any other; a null id is an id.
    One shuffle with map-side combining; the result stays partitioned by id.
    """
    top = F.max(F.struct(F.col("sequence"), F.col(text).alias("text"))).alias("_t")
    return docs.groupBy(F.col(key).alias("id")).agg(top).select("id", F.col("_t.text").alias("text")).where("text is not null")


def record_terms(texts: DataFrame) -> DataFrame:
    """(id, term, f): count of every distinct term in every record; records without terms give no row.

    ``texts`` must be partitioned by id for the count to need no shuffle, as ``current_texts`` leaves it.
    """
    return texts.select("id", F.explode(terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("f"))


def term_stats(counts: DataFrame) -> DataFrame:
    """(term, occurrences, records) from per-record counts: partial sums by hash in each task, then one shuffle.

    A term that occurs in every record reaches its reducer as one row a map task.
    """
    return counts.groupBy("term").agg(F.sum("f").alias("occurrences"), F.count(F.lit(1)).alias("records"))


def marked_terms(
    docs: DataFrame, *, min_occurrences: int = 5, min_records: int = 3, max_share_inverse: int = 5
) -> DataFrame:
    """Every term with occurrences, records and mark (``rare``, ``common`` or null).

    Rare: fewer than ``min_occurrences`` occurrences or ``min_records`` records; otherwise common: records times
    ``max_share_inverse`` exceeds the number of current records with non-null text (wordless ones included).
    Null and empty texts have no terms; exact duplicate rows are one version. Empty input: no rows.
    """
    texts = current_texts(docs)
    n = texts.agg(F.count(F.lit(1)).alias("_n"))
    stats = term_stats(record_terms(texts)).crossJoin(F.broadcast(n))  # a single row
    rare = (F.col("occurrences") < min_occurrences) | (F.col("records") < min_records)
    mark = F.when(rare, "rare").when(F.col("records") * max_share_inverse > F.col("_n"), "common")
    return stats.select("term", "occurrences", "records", mark.alias("mark"))


def index_drift(docs: DataFrame, postings: DataFrame, columns: Sequence[str] = ("term",)) -> DataFrame:
    """Per term of a stored index or of the texts: records and occurrences in each, where they differ.

    Postings rows of a term are added up; null maps and null counts count as nothing.
    """
    real = term_stats(record_terms(current_texts(docs)))
    held = postings.select("term", F.explode("postings").alias("doc", "n")).where("n is not null")
    kept = held.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("index_occurrences"), F.countDistinct("doc").alias("index_records"))
    both = real.join(kept, "term", "full_outer").na.fill(0, ["occurrences", "records", "index_occurrences", "index_records"])
    return both.where("occurrences <> index_occurrences or records <> index_records")
