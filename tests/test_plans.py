"""Physical plans: what must reach the scan, and which operators must (not) appear."""

from pyspark.sql import functions as F

from chronodoc.operators import fulltext, indexes, knn, scans, versions
from chronodoc.operators.changes import current_documents
from chronodoc.operators.indexes import Index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 50).alias("id"), F.col("id").alias("seq"), F.lit(False).alias("deleted"), F.col("id").cast("string").alias("tag"), F.lit("x").alias("wide"))
    df.write.mode("overwrite").parquet(f"{tmp_path}/log")
    return spark.read.parquet(f"{tmp_path}/log")


def test_snapshot_and_key_filters_reach_the_scan(spark, tmp_path):
    p = plan(versions.history(log(spark, tmp_path).select("id", "seq", "deleted", "tag"), 7, 500))
    assert "LessThanOrEqual(seq,500)" in p and "EqualTo(id,7)" in p and "wide" not in p


def test_state_limits_before_the_shuffle(spark, tmp_path):
    assert plan(versions.state_as_of(log(spark, tmp_path))).count("WindowGroupLimit") == 2


def test_top_k_instead_of_sorts(spark, tmp_path):
    df = log(spark, tmp_path)
    assert "TakeOrderedAndProject" in plan(scans.scan(df, limit=5))
    assert "TakeOrderedAndProject" in plan(indexes.scan_index(df, Index.on("t", "tag"), "1", 5))
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert "TakeOrderedAndProject" in plan(fulltext.search(docs, "text", ["a"], 3))
    vec = spark.createDataFrame([(1, [1.0])], "id long, e array<double>")
    assert "TakeOrderedAndProject" in plan(knn.vector_search(vec, "e", [0.0], 1))


def test_no_python_in_the_fold(spark, tmp_path):
    frames = spark.createDataFrame([], "store string, sequence long, frame_type string, txid string, collection string, doc_key string, value string, arrived_at timestamp_ntz")
    p = plan(current_documents(frames))
    assert "Python" not in p and "Arrow" not in p and "CartesianProduct" not in p


def test_stored_index_filters_terms_in_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "a b c")], "id long, text string")
    postings, lengths = fulltext.build_index(docs, "text")
    postings.write.parquet(f"{tmp_path}/p")
    lengths.write.parquet(f"{tmp_path}/l")
    held = fulltext.search_index(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/l"), ["a", "b"])
    assert "In(term, [a,b])" in plan(held)
    assert held.collect() == fulltext.search(docs, "text", ["a", "b"]).collect()
    assert fulltext.search_index(postings, lengths, []).count() == 0


def test_lookups_compare_candidates_only(spark, tmp_path):
    df = log(spark, tmp_path)
    p = plan(indexes.by_index(df, Index.on("t", "tag"), "123", 500))
    assert "BroadcastHashJoin" in p and "LeftSemi" in p and "LessThanOrEqual(seq,500)" in p
    narrow = [x for x in plan(scans.scan(df, limit=5)).splitlines() if "ReadSchema" in x]
    assert len(narrow) == 2 and sum("wide" not in x for x in narrow) == 1  # only the fetch reads payloads
    p = plan(indexes.scan_index(df, Index.on("t", "tag"), "", 5))
    assert p.count("ReadSchema") == 1 and p.count("BroadcastHashJoin") >= 2  # the pairs are found by a job of their own


def test_scratch_is_released(spark):
    from chronodoc import session

    path = session.scratch(spark, "plans")
    spark.range(3).write.parquet(path)
    fs, p = session.hadoop(spark, path)
    assert fs.exists(p) and session.release_scratch() >= 1 and not fs.exists(p)
