"""Streams with a state by key: the answer cache's time to live, and the bounded history of a conversation.

Both give what the batch versions in operators/cache.py give, as long as rows come in the order of time, or out of it
within one batch. A row later than the watermark is dropped by Spark, one without a time by the functions here. State ends
with the watermark, so it is bounded by the keys of one life span; a key's rows of one batch are ordered in one task."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICRO = 1_000_000


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.filter("at is not null").withWatermark("at", late).withColumn("us", F.unix_micros("at"))


def _until(state: GroupState, us: int) -> None:
    """Let the state end when the watermark passes us."""
    state.setTimeoutTimestamp(max(-(-us // 1000), state.getCurrentWatermarkMs() + 1))


def ttl_cache(stream: DataFrame, ttl_seconds: float, late: str = "10 minutes") -> DataFrame:
    """stream (key string, id long, at timestamp) as key, id, at, hit: a miss writes an entry that lives ttl_seconds; reads
    don't extend it. Requests of a key at one time count by id."""
    if ttl_seconds <= 0:
        raise ValueError("ttl_seconds must be over 0")
    life = round(ttl_seconds * MICRO)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([p[["id", "us"]] for p in parts]).sort_values(["us", "id"])
        end = state.get[0] if state.exists else None
        hits = []
        for t in rows["us"]:
            hit = end is not None and t < end
            if not hit:
                end = int(t) + life
            hits.append(hit)
        state.update((end,))
        _until(state, end)
        yield rows.assign(key=key[0], hit=hits)[["key", "id", "us", "hit"]]

    got = _timed(stream.select("key", "id", "at"), late).groupBy("key").applyInPandasWithState(run, "key string, id long, us long, hit boolean", "until long", "append", GroupStateTimeout.EventTimeTimeout)
    return got.select("key", "id", F.timestamp_micros("us").alias("at"), "hit")


def conversation_history(stream: DataFrame, most: int = 8, idle_seconds: float = 86_400, late: str = "10 minutes") -> DataFrame:
    """stream (conv_id long, turn long, role, text, at timestamp) with history: the messages before, at most `most`, as
    "role: text" lines. A conversation whose last message lies idle_seconds or more before the next one's starts again."""
    if most < 1 or idle_seconds <= 0:
        raise ValueError("most and idle_seconds must be over 0")
    idle = round(idle_seconds * MICRO)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([p[["turn", "role", "text", "us"]] for p in parts]).sort_values(["us", "turn"])
        lines, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], None)
        before = []
        for role, text, us in zip(rows["role"], rows["text"], rows["us"], strict=True):
            if last is not None and us - last >= idle:
                lines = []
            before.append("\n".join(lines))
            lines = [*lines, ": ".join(x for x in (role, text) if x is not None)][-most:]
            last = int(us) if last is None else max(last, int(us))
        state.update((json.dumps(lines), last))
        _until(state, last + idle)
        yield rows.assign(conv_id=key[0], history=before)[["conv_id", "turn", "role", "text", "us", "history"]]

    columns = "conv_id long, turn long, role string, text string, us long, history string"
    got = _timed(stream.select("conv_id", "turn", "role", "text", "at"), late).groupBy("conv_id").applyInPandasWithState(run, columns, "lines string, last long", "append", GroupStateTimeout.EventTimeTimeout)
    return got.select("conv_id", "turn", "role", "text", F.timestamp_micros("us").alias("at"), "history")
