"""Streams with state against the batch versions."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cache
from tidemark.streaming import state


def stream_of(spark, batches, schema, path):
    """A file stream that gives each list of rows as a batch of its own."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("*.parquet"):
            if not f.name.startswith("b"):
                f.rename(path / f"b{i}.parquet")
                os.utime(path / f"b{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path)).withColumn("at", F.timestamp_seconds("s"))


def run(df, tmp_path):
    out = str(tmp_path / "out")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.read.parquet(out)


def test_ttl_cache_over_batches(spark, tmp_path):
    batches = [
        [("a", 1, 1000), ("b", 2, 1001), ("a", 4, 1009), ("a", 3, 1009), (None, 5, 1009)],
        [("a", 6, 1010), ("a", 7, 1019), (None, 8, 1018), ("c", 9, 1019)],
        [("a", 10, 1020), ("b", 11, 1100), ("x", 12, None)],
        [("a", 13, 1101), ("a", 14, 1105), ("b", 15, 1109), ("c", 16, 1109)],
    ]
    got = run(state.ttl_cache(stream_of(spark, batches, "key string, id long, s long", tmp_path / "in"), 10, "20 seconds"), tmp_path)
    rows = spark.createDataFrame([r for b in batches for r in b if r[2] is not None], "key string, id long, at long")
    want = {r["id"]: r["hit"] for r in cache.replay_ttl(rows, 10).collect()}
    assert {r["id"]: r["hit"] for r in got.collect()} == want and True in want.values()
    assert {r["id"]: r["s"] for r in got.select("id", F.unix_seconds("at").alias("s")).collect()} == {r[1]: r[2] for b in batches for r in b if r[2] is not None}
    with pytest.raises(ValueError):
        state.ttl_cache(rows, 0)


def test_conversation_history_over_batches(spark, tmp_path):
    batches = [[(c, t, ("user", "assistant")[t % 2], None if t == 5 else f"m{c}-{t}", 1000 + 10 * t + c) for c in (1, 2) for t in range(4 * i, 4 * i + 4)] for i in range(3)]
    schema = "conv_id long, turn long, role string, text string, s long"
    got = run(state.conversation_history(stream_of(spark, batches, schema, tmp_path / "in"), 3, 1000, "20 seconds"), tmp_path)
    rows = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {(r["conv_id"], r["turn"]): r["history"] for r in cache.history_window(rows, 3).collect()}
    assert {(r["conv_id"], r["turn"]): r["history"] for r in got.collect()} == want


def test_conversation_starts_again_after_idle_time(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, s long"
    batches = [[(1, 0, "user", "a", 1000), (1, 1, "assistant", "b", 1001)], [(1, 2, "user", "c", 1100), (1, 3, "assistant", "d", 1101)]]
    got = run(state.conversation_history(stream_of(spark, batches, schema, tmp_path / "in"), 8, 60, "5 seconds"), tmp_path)
    assert {r["turn"]: r["history"] for r in got.collect()} == {0: "", 1: "user: a", 2: "", 3: "user: c"}


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    batches = [[("a", 1, 1000)], [("a", 2, 5000)], [("b", 3, 5001)], [("a", 4, 1000), ("a", 5, 5003)]]
    got = run(state.ttl_cache(stream_of(spark, batches, "key string, id long, s long", tmp_path / "in"), 10, "5 seconds"), tmp_path)
    assert {r["id"]: r["hit"] for r in got.collect()} == {1: False, 2: False, 3: False, 5: True}
