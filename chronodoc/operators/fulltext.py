"""Full-text search: postings, collection figures, conjunctive BM25 search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodoc.functions.text import Analyzer, default_analyzer
from chronodoc.session import checkpointed

K1, B = 1.5, 0.75


def tokenized(docs: DataFrame, text: str, analyzer: Analyzer = default_analyzer) -> DataFrame:
    """(id, tokens, doc_len); null text counts as a document without tokens.

    The tokens go through a one-element generator: without it the optimizer would copy the tokenising expression
    to every use of the column.
    """
    tokens = F.coalesce(analyzer(F.col(text)), F.array().cast("array<string>"))
    return docs.select("id", F.explode(F.array(tokens)).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long"))


def term_postings(docs: DataFrame, text: str, analyzer: Analyzer = default_analyzer) -> DataFrame:
    """(term, id, tf): the inverted index."""
    return tokenized(docs, text, analyzer).select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(spark, query: str, analyzer: Analyzer = default_analyzer) -> list[str]:
    """The query's tokens, repeats included (one tiny local job, so that any analyzer can be used)."""
    got = spark.createDataFrame([(query,)], "q string").select(analyzer(F.col("q")).alias("t")).first()
    return list(got["t"] or [])


def _ranked(held: DataFrame, distinct: list[str], terms: Sequence[str], limit: int | None) -> DataFrame:
    """BM25 over rows with doc_len, tf0.., df0.., n, total."""
    average = F.col("total") / F.greatest(F.lit(1), F.col("n"))
    score = F.lit(0.0)
    for i, w in enumerate(distinct):
        df, f = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("doc_len") / average))
        score = score + part * list(terms).count(w)
    found = held.select("id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id")
    return found if limit is None else found.limit(max(0, limit))


def search(docs: DataFrame, text: str, query: str | Sequence[str], limit: int | None = None, *, analyzer: Analyzer = default_analyzer) -> DataFrame:
    """(id, score): documents that hold every token of the query, by BM25, ties by id; no limit means all.

    A token repeated in the query counts repeatedly; an empty query finds nothing. Scores are rounded to 6
    decimals before ordering. Plan: the texts are tokenised in one scan, eagerly; lengths and counts of the (few)
    query terms, some numbers a document, are checkpointed, and figures and scores come from them. Nothing is
    exploded; the only shuffles are one row of collection figures and the top-k.
    """
    terms = list(query) if not isinstance(query, str) else query_terms(docs.sparkSession, query, analyzer)
    if not terms:
        return docs.select("id").limit(0).withColumn("score", F.lit(0.0))
    distinct = sorted(set(terms))
    toks = tokenized(docs, text, analyzer)
    tf = [(F.size("tokens") - F.size(F.array_remove("tokens", w))).cast("long").alias(f"tf{i}") for i, w in enumerate(distinct)]
    rows = checkpointed(toks.select("id", "doc_len", *tf))
    figures = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("total"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(distinct))]
    )
    held = rows.where(" and ".join(f"tf{i} > 0" for i in range(len(distinct)))).crossJoin(F.broadcast(figures))  # one row
    return _ranked(held, distinct, terms, limit)


def build_index(docs: DataFrame, text: str, analyzer: Analyzer = default_analyzer) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) to be written once and searched often: (term, id, tf, doc_len), (id, doc_len).

    Written with ``partitionBy`` or sorted by term, a search reads only its terms' row groups.
    """
    toks = tokenized(docs, text, analyzer)
    counted = toks.select("id", "doc_len", F.explode("tokens").alias("term")).groupBy("term", "id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
    return counted.select("term", "id", "tf", "doc_len"), toks.select("id", "doc_len")


def search_index(postings: DataFrame, lengths: DataFrame, terms: Sequence[str], limit: int | None = None) -> DataFrame:
    """``search`` over a stored index: the filter on term reaches the scan, and only the query's postings move.

    Plan: one shuffle of the query terms' postings by id; collection figures and document frequencies are single
    rows.
    """
    if not terms:
        return lengths.select("id").limit(0).withColumn("score", F.lit(0.0))
    distinct = sorted(set(terms))
    rows = postings.where(F.col("term").isin(distinct))
    tf = [F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(distinct)]
    held = rows.groupBy("id").agg(F.first("doc_len").alias("doc_len"), F.count(F.lit(1)).alias("_n"), *tf).where(F.col("_n") == len(distinct))
    df = rows.agg(*[F.count(F.when(F.col("term") == w, 1)).alias(f"df{i}") for i, w in enumerate(distinct)])
    figures = lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("total")).crossJoin(df)
    return _ranked(held.crossJoin(F.broadcast(figures)), distinct, terms, limit)  # one row
