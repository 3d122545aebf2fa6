"""Answer generation by a hook, with the extractive answer as a fallback that names its cause."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABSTAIN = "The documents at hand don't answer this question."
EXTRACTIVE = "extractive"


class Generator(Protocol):
    """What generate() takes: a picklable object with a name and a call by prompt."""

    name: str

    def generate(self, prompt: str) -> str: ...


def generate(prompts: DataFrame, generator: Generator) -> DataFrame:
    """prompts (query_id, action, prompt, extractive) as query_id, answer, generator, error.

    abstain gets a fixed text; any exception of a call gives the extractive answer, and its type and message are named.
    Each row is a call of its own, as long as the generator takes; batches bound what a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["action"] == "abstain":
                    rows.append((r["query_id"], ABSTAIN, generator.name, None))
                    continue
                try:
                    rows.append((r["query_id"], generator.generate(r["prompt"]), generator.name, None))
                except Exception as e:
                    cause = f"{type(e).__name__}: {e}"
                    rows.append((r["query_id"], r["extractive"] or "", f"{EXTRACTIVE} (fallback after {cause})", cause))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch({"query_id": pa.array(cols[0], pa.int64())} | {n: pa.array(c, pa.string()) for n, c in zip(("answer", "generator", "error"), cols[1:], strict=True)})

    return prompts.select(F.col("query_id").cast("long").alias("query_id"), "action", "prompt", "extractive").mapInArrow(run, "query_id long, answer string, generator string, error string")
