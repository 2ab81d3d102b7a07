"""Structured Streaming twins of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.operators.dedupe import FOLD_IN, FOLD_OUT, fold_days


def windowed_counts(stream: DataFrame, key: str, at: str = "ts", size: str = "1 day", late: str = "7 days") -> DataFrame:
    """A22's sums on a stream: tumbling windows; rows later than ``late`` don't count."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sliding_counts(stream: DataFrame, key: str, at: str = "ts", size: str = "7 days", step: str = "1 day", late: str = "7 days") -> DataFrame:
    """W13's sums on a stream."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size, step).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_spans(stream: DataFrame, key: str, at: str = "ts", gap: str = "7 days", late: str = "7 days") -> DataFrame:
    """W8 on a stream: spans that end after a silence of more than ``gap``."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"), F.max(at).alias("last")).select(F.col("w.start").alias("start"), "last", key, "n")


def once_per_key(stream: DataFrame, key: str, at: str = "ts", late: str = "90 days") -> DataFrame:
    """P2 on a stream: the first row of a key; keys are forgotten after ``late``."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def velocities(stream: DataFrame, key: str, day: str = "day") -> DataFrame:
    """W1 on a stream of daily sums (key, day, n), a micro-batch for each day or several: n minus the day's before."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(day)
        out = []
        for d, n in zip(rows[day], rows["n"], strict=True):
            out.append((keys[0], d, n, float(n - last)))
            last = int(n)
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, day, "n", "velocity"])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {day} {kinds[day]}, n bigint, velocity double", "last bigint", "append", GroupStateTimeout.NoTimeout)


def continuity_writer(root: str) -> Callable[[DataFrame, int], None]:
    """D3 on a stream of day clusters: a foreachBatch function that writes each batch's ids to ``root``/ids/batch=i.

    The state is a table for each batch, beside the ids: a batch starts from the state that the one before it has left,
    whatever process writes it, and a batch that is run again overwrites its own ids and state with equal ones. So ids
    go on after a restart from the query's checkpoint. A batch's days go through in order, in one task.
    """

    def batch(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        state = spark.read.schema(FOLD_IN).parquet(f"{root}/state/batch={i - 1}") if i else None
        aside = f"{root}/fold/batch={i}"
        fold_days(df, state).write.mode("overwrite").parquet(aside)
        folded = spark.read.schema(FOLD_OUT).parquet(aside)
        folded.where("entry IS NULL").select("day", "grp", "cluster_id").write.mode("overwrite").parquet(f"{root}/ids/batch={i}")
        folded.where("entry IS NOT NULL").select(*spark.createDataFrame([], FOLD_IN).columns).write.mode("overwrite").parquet(f"{root}/state/batch={i}")

    return batch


def continuity_ids(spark: SparkSession, root: str) -> DataFrame:
    """The ids that a ``continuity_writer`` has written."""
    return spark.read.schema("day date, grp int, cluster_id string").parquet(f"{root}/ids/*")
