"""Calls to services outside the engine: what is pending goes in batches to a function that is handed in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def call_in_batches(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str, size: int = 128, tries: int = 3, wait: float = 1.0, most_wait: float = 60.0, give_up: int = 2) -> DataFrame:
    """``call`` over batches of ``size`` rows of each partition: what it returns, and a column ``error`` that is null there.

    A failed batch is tried again, the wait doubling up to ``most_wait``. For a batch that keeps failing there is a row
    for each of its own with its ``key`` and the error; after ``give_up`` such batches in a row the partition stops
    calling, and the rows that are left say so. So every row has an answer or a mark; marked ones are pending in the next run.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for frame in frames:
            for start in range(0, len(frame), size):
                batch, pause, why = frame.iloc[start : start + size], wait, "not called after failures"
                for attempt in range(tries if failed < give_up else 0):
                    try:
                        out = call(batch)
                    except Exception as e:  # noqa: BLE001  whatever a service raises
                        why = f"{type(e).__name__}: {e}"
                        if attempt + 1 < tries:
                            time.sleep(min(pause, most_wait))
                            pause *= 2
                        continue
                    failed = 0
                    yield out.assign(error=None)
                    break
                else:
                    failed += 1
                    yield pd.DataFrame({c: batch[key] if c == key else [why if c == "error" else None] * len(batch) for c in names}, index=batch.index)

    full = f"{schema}, error string"
    names = rows.sparkSession.createDataFrame([], full).columns
    return rows.mapInPandas(run, full)


def embed_pending(articles: DataFrame, manifest: DataFrame, call: Callable[[list[str]], list[list[float]]], model: str, limit: int = 1500, size: int = 128, chars: int = 4000) -> DataFrame:
    """V1: vectors of articles that have a summary and none yet, the newest ``limit`` of a run, a request for ``size`` texts."""
    todo = pending(articles.where(F.trim(F.coalesce("summary", F.lit(""))) != ""), manifest, "id").orderBy(F.col("day").desc(), "id").limit(limit)
    texts = todo.select("id", "day", F.substring(F.concat_ws("\n", "title", "summary"), 1, chars).alias("text"))

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        vectors = call(batch["text"].tolist())
        return pd.DataFrame({"id": batch["id"], "day": batch["day"], "model": model, "dim": [len(v) for v in vectors], "vector": vectors})

    return call_in_batches(texts, one, f"id {dict(articles.dtypes)['id']}, day date, model string, dim int, vector array<float>", "id", size)
