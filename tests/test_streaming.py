from chronodoc.operators.changes import fold_changes
from chronodoc.operators.versions import state_as_of
from chronodoc.streaming.live import drain, live_state
from pyspark.sql import functions as F

SCHEMA = "collection string, id string, seq long, deleted boolean, value string"


def test_stream_equals_batch(spark, rows, tmp_path):
    data = [("c", str(i % 7), i * 37 % 100, i % 5 == 0, None if i % 5 == 0 else f"v{i}") for i in range(60)]
    data += [("c", "0", 500, True, None), ("c", "0", 500, False, "tie"), ("c", "0", 500, False, "a tie")]
    df = spark.createDataFrame(data, SCHEMA)
    df.repartition(4).write.parquet(f"{tmp_path}/log")
    got = drain(live_state(spark, f"{tmp_path}/log", df.schema), "live_test", f"{tmp_path}/cp")
    want = {}
    for c, i, s, d, v in data:
        want[i] = max(want.get(i, (-1,)), (s, not d, v or ""))
    assert {r["id"]: (r["seq"], not r["deleted"], r["value"] or "") for r in got.collect()} == want
    state = state_as_of(df, keys=("collection", "id"), tombstones=True)
    assert rows(state.na.fill("-"), *state.columns) == rows(got.na.fill("-"), *state.columns)
    ops = F.when(F.col("deleted"), 0).otherwise(1)
    fold = fold_changes(df, ["collection", "id"], sequence="seq", operation=ops)
    assert rows(fold.na.fill("-"), "id", "sequence", "value") == rows(got.na.fill("-"), "id", "seq", "value")
