"""Rolling summaries of the last events of each key, with lists and timers in a state store on disk.

A key's state is a list of its last events, at most `limit`, by time and id; where an idle time is given, a timer ends it
when the watermark passes that time after the key's last event. What a batch reads of a key passes in Arrow batches, and
no more than `limit` events of it are held beside one of these, so a hot key needs no more memory than any other. The
state is Spark's: a query that is started again from its checkpoint goes on where it stopped."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that lists and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "us long, id long, cache_hit boolean, action string"
SUMMARY = "key string, events long, requests long, cache_hit_rate double, abstain_rate double"


def use_state_store(spark: SparkSession) -> None:
    """Set the store for the queries that the session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Last(StatefulProcessor):
    """Last events and the number of all events of a key; a summary a batch that has events of the key."""

    def __init__(self, limit: int, idle_ms: int):
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", EVENT)
        self.seen = handle.getValueState("seen", "n long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, until = self.seen.get() if self.seen.exists() else (0, None)
        held = [tuple(r) for r in self.last.get()] if n else []
        if until is not None:
            self.handle.deleteTimer(until)
            if timerValues.getCurrentWatermarkInMs() >= until:  # its timer is due but hasn't been called yet
                held, n = [], 0
        heapq.heapify(held)
        for part in rows:
            n += len(part)
            # the newest of a batch are enough
            part = part.sort_values(["us", "id"]).tail(self.limit)
            for e in zip(part["us"].tolist(), part["id"].tolist(), part["cache_hit"].tolist(), part["action"].tolist(), strict=True):
                if len(held) < self.limit:
                    heapq.heappush(held, e)
                else:
                    heapq.heappushpop(held, e)
        held.sort()
        self.last.put(held)
        until = None
        if self.idle_ms:
            until = max(held[-1][0] // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(until)
        self.seen.update((n, until))
        size = len(held)
        yield pd.DataFrame({"key": [key[0]], "events": [n], "requests": [size], "cache_hit_rate": [round(sum(e[2] for e in held) / size, 4)], "abstain_rate": [round(sum(e[3] == "abstain" for e in held) / size, 4)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def rolling_by(stream: DataFrame, limit: int = 500, idle_seconds: float = 0, late: str = "10 minutes") -> DataFrame:
    """stream (key string, id long, at timestamp, cache_hit, action) as key, events (all of the key so far), requests,
    cache_hit_rate and abstain_rate of its last `limit` (1 to 10000) events by at and id: a row a key for each batch
    that has events of it. Run it in update mode, after use_state_store.

    Rows without a time or an id are left out; a null key is a key; a missing cache_hit is false, a missing action
    "unknown"; repeated rows count each. idle_seconds 0: state has no end and no row is late; else a key without events
    for that long starts again, and rows later than the watermark are dropped. A checkpoint keeps to one or the other."""
    limit = max(1, min(10_000, limit))
    if idle_seconds < 0:
        raise ValueError("idle_seconds must not be below 0")
    if idle_seconds:
        stream = stream.withWatermark("at", late)
    e = stream.filter("at is not null and id is not null").select(
        "key", "at", F.unix_micros("at").alias("us"), F.col("id").cast("long").alias("id"), F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), F.coalesce("action", F.lit("unknown")).alias("action"),
    )
    return e.groupBy("key").transformWithStateInPandas(_Last(limit, round(idle_seconds * 1000)), SUMMARY, "Update", "EventTime" if idle_seconds else "None")
