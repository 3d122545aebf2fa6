"""Rolling summaries by key: a query that stops and starts again against plain loops over all events."""

import random

import pytest

from tidemark.streaming import rolling

SCHEMA = "key string, id long, s long, cache_hit boolean, action string"


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def advance(spark, tmp_path, name, got, **options):
    """Run the query over the files that came since it last stopped; the last row of each key in got."""
    from pyspark.sql import functions as F

    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("s"))
    q = rolling.rolling_by(stream, **options).writeStream.outputMode("update").foreachBatch(lambda df, i: got.update({r["key"]: tuple(r)[1:] for r in df.collect()}))
    q = q.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(60)


def plain(rows, limit):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[2] is not None and r[1] is not None), key=lambda r: (r[2], r[1]))
        last = own[-limit:]
        if last:
            out[key] = (len(own), len(last), round(sum(bool(r[3]) for r in last) / len(last), 4), round(sum(r[4] == "abstain" for r in last) / len(last), 4))
    return out


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rolling.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_restart_from_the_checkpoint(spark, store, tmp_path):
    """Three runs of one query, each over new files: a hot key, late and repeated events, nulls in every column, a new key."""
    rng = random.Random(3)
    event = lambda i: (rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.choice([1000 + i, 1000 + i, 900, None]), rng.choice([True, False, None]), rng.choice(["abstain", "generate", None]))
    batches = [[event(i) for i in range(400 * b, 400 * b + 400)] for b in range(2)]
    batches[1] += [batches[1][0]] * 3 + [("new", None, 5, True, "abstain"), ("new", 9000, 5, True, "abstain")]
    batches.append([("a", 9001, 1, False, "generate")])  # older than all of a's: counted, not among the last
    got, seen = {}, []
    for b in batches:
        write(spark, b, tmp_path / "in")
        seen += b
        advance(spark, tmp_path, "cp", got, limit=25)
        assert got == plain(seen, 25)
    assert got["hot"][0] > 10 * 25 and got["hot"][1] == 25 and got["new"] == (1, 1, 1.0, 1.0)


def test_state_ends_with_the_watermark(spark, store, tmp_path):
    got = {}
    write(spark, [("a", 0, 1000, True, "generate"), ("b", 1, 5000, True, "generate")], tmp_path / "in")
    advance(spark, tmp_path, "cp", got, limit=5, idle_seconds=10, late="5 seconds")
    assert got == {"a": (1, 1, 1.0, 0.0), "b": (1, 1, 1.0, 0.0)}
    write(spark, [("a", 2, 5001, False, "abstain"), ("b", 3, 5002, False, "abstain"), ("b", 4, 4000, True, "generate")], tmp_path / "in")
    advance(spark, tmp_path, "cp", got, limit=5, idle_seconds=10, late="5 seconds")
    # a begins again, b goes on without the row that is later than the watermark
    assert got == {"a": (1, 1, 0.0, 1.0), "b": (2, 2, 0.5, 0.5)}
    with pytest.raises(ValueError):
        rolling.rolling_by(spark.createDataFrame([], SCHEMA + ", at timestamp"), 5, -1)
