"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows sit in P partitions; the row counts of the shards are fixed beforehand and differ by one at most. The matrix
says how many rows of each partition go to each shard. Its rows are drawn one after another from the multivariate
hypergeometric law given what room is left, which is the law that a uniform permutation of all rows would give. Then
each partition permutes its rows and deals them out by its row of the matrix, the rows are exchanged, and each shard
permutes what it received: in cells of random keys, so that no task sorts a whole shard. The result is a uniform
permutation of all rows, cut into shards.

What a task sorts is one input partition or one cell, so neither a hot key nor a group of equal texts matters; the
driver holds P x shards counts and a count for each cell. Rows and their places are written to the shared folder
before they are counted: retried tasks see the same places again.

Defined results: null and repeated ids are rows like others; an empty table gives no rows; columns of the input that
are called as the added ones (shard, slot) are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import cut

#: Rows of a cell, about: what a task of the second permutation sorts.
CELL_ROWS = 250_000
_ADDED = ("shard", "slot")


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are among the ``good``; also beyond numpy's limit of 1e9."""
    if not good or not n:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    total = good + bad
    mean, sd = n * good / total, math.sqrt(max(1.0, n * (good / total) * (bad / total) * (total - n) / max(1, total - 1)))
    k = np.arange(max(low, int(mean - 12 * sd)), min(high, int(mean + 12 * sd) + 1) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[np.searchsorted(p, rng.random() * p[-1])])


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Row p: how many of the ``counts[p]`` rows of partition p go to each shard. Sums of columns are ``sizes``."""
    rng, left = np.random.default_rng(seed), np.array(sizes, dtype=np.int64)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        room = int(left.sum())
        for s in range(len(sizes)):
            rest = room - int(left[s])
            out[p, s] = hypergeometric(rng, int(left[s]), rest, n)
            n, room = n - int(out[p, s]), rest
        left -= out[p]
    return out


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    spark, own_columns = df.sparkSession, [c for c in df.columns if c.lower() not in _ADDED]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = cut(df.select(*own_columns, F.spark_partition_id().alias("__p"), place.alias("__i")), "shard-places")
    counts = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    parts, sizes = sorted(counts), shard_sizes(sum(counts.values()), shards)
    ends = np.cumsum(communication_matrix([counts[p] for p in parts], sizes, seed), axis=1)
    deal = spark.createDataFrame([(int(p), [int(x) for x in ends[i]]) for i, p in enumerate(parts)], "__p int, __ends array<bigint>")
    permuted = F.row_number().over(Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(seed), "__p", "__i"), "__i")) - 1
    dealt = placed.withColumn("__r", permuted).join(deal, "__p")
    cells = max(1, math.ceil(max(sizes) / cell_rows))
    key = F.xxhash64(F.lit(seed + 1), "__i", "__p")
    dealt = dealt.select(*own_columns, "__p", "__i", F.expr("size(filter(__ends, e -> e <= __r))").alias("shard"), key.alias("__key"), F.pmod(key, F.lit(cells)).alias("__cell"))
    dealt = cut(dealt, "shard-dealt")
    # Cells follow one another within a shard; their places come from exact counts, a row for each cell.
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("shard", "__cell").agg(F.count("*").alias("n")).select("shard", "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("__key", "__p", "__i")) - 1
    return dealt.withColumn("__n", within).join(bases, ["shard", "__cell"]).select(*own_columns, "shard", (F.col("__base") + F.col("__n")).alias("slot"))
