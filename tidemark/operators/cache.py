"""Answer cache as replay over request streams: keys, time to live, capacity, single flight, conversation window."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Entries that a cache holds and their life in seconds, unless told otherwise.
CAPACITY, TTL_SECONDS = 256, 900


def cache_key(namespace: Column, query: Column, history: Column, top_k: Column) -> Column:
    """SHA-256 of the canonical JSON of a request (keys in order, no blanks, query stripped)."""
    doc = F.struct(history.alias("history"), namespace.alias("namespace"), F.trim(query).alias("query"), top_k.alias("top_k"))
    return F.sha2(F.to_json(doc), 256)


def replay_ttl(requests: DataFrame, ttl: float = TTL_SECONDS, key: str = "key", at: str = "at", order: str = "id") -> DataFrame:
    """key, order, at, hit: an entry is written at a miss and expires ttl seconds later, reads don't extend it.

    Sequential by key; each key's requests are one group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, order])
        until, hits = None, []
        for t in pdf[at]:
            hit = until is not None and t < until
            if not hit:
                until = t + ttl
            hits.append(hit)
        return pdf[[key, order, at]].assign(hit=hits)

    kinds = dict(requests.dtypes)
    return requests.select(key, order, at).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {at} {kinds[at]}, hit boolean")


def replay_lru(requests: DataFrame, ttl: float = TTL_SECONDS, capacity: int = CAPACITY, namespace: str = "namespace", key: str = "key", at: str = "at", order: str = "id") -> DataFrame:
    """Like replay_ttl with at most capacity entries a namespace; gets and sets renew an entry's turn."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, order])
        held: OrderedDict = OrderedDict()
        hits = []
        for k, t in zip(pdf[key], pdf[at], strict=True):
            hit = k in held and t < held[k]
            if not hit:
                held.pop(k, None)
                held[k] = t + ttl
            held.move_to_end(k)
            while len(held) > capacity:
                held.popitem(last=False)
            hits.append(hit)
        return pdf[[namespace, key, order, at]].assign(hit=hits)

    kinds = dict(requests.dtypes)
    return requests.select(namespace, key, order, at).groupBy(namespace).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (namespace, key, order, at)) + ", hit boolean")


def single_flight(requests: DataFrame, key: str = "key", order: str = "id") -> DataFrame:
    """requests with computes: true on the first request of each key."""
    return requests.withColumn("computes", F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1)


def history_window(turns: DataFrame, most: int = 8) -> DataFrame:
    """turns (conv_id, turn, role, text) with history: the messages before, at most `most`, as "role: text" lines."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-most, -1)
    return turns.withColumn("history", F.array_join(F.collect_list(F.concat_ws(": ", "role", "text")).over(w), "\n"))
