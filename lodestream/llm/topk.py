"""Exact top-k by inner product through distributed histogram selection.

Vectors become integers, floor(scale * x). The stated queries are taken in chunks of bounded size; each chunk is sent
to the tasks, which score it against the candidates where they lie: candidates are never shuffled. A first pass gives
the interval that holds each query's kth value: it is no less than the kth value of any task's own candidates, and no
more than the greatest score. Rounds of histograms over that interval, summed over all tasks, narrow it until it is one
integer. A last pass keeps the scores above it and, of the ties at it, the least ids; the ranks are cut after that.

The first pass sends a row for each query from a task, and a round no more than a row for each query and bin that holds
a score of the interval, which few do. Ties are cut to the k least ids within each task, which the k least of all ties
are among, so that one vector that a third of the rows share adds little.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; a vector is scored
against those of its own length; rows with one id are candidates each, and only a query's own row is left out; a null id
is no query, and as a candidate comes after the others of its score; scores beyond 64 bits are clamped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import small_batches
from lodestream.session import cut

#: Queries sent at one time and scored at one time; bins of a histogram.
CHUNK, TILE, BINS = 16_384, 1_024, 128
_LONG = 2**63 - 1


def integer_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v) of the vectors that take part; row is a place in the written table."""
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    whole = F.transform(x, lambda e: _floor(e.cast("double") * F.lit(float(scale))))
    rows = df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "topk-vectors")


def _floor(e):
    # floor() of a double is a long and clips; beyond 2^53 a double is whole already
    return F.when(F.abs(e) < float(2**53), F.floor(e).cast("double")).otherwise(e)


def products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products, exact: by floats where no sum can pass their whole numbers."""
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    a = np.array([[int(x) for x in r] for r in q], dtype=object)
    b = np.array([[int(x) for x in r] for r in c], dtype=object)
    return np.clip(a.dot(b.T), -_LONG, _LONG).astype(np.int64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def _interval(same: DataFrame, sent, n: int, k: int, bound: float, top: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """The greatest kth value that any task has among its own candidates, and the greatest score; -top where there is none."""
    none = np.iinfo(np.int64).min  # below every score

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _, q = sent.value
        held = np.full((len(own), k), none)
        for f in frames:
            c, at = _matrix(f["v"]), f["row"].to_numpy(np.int64)
            for i in range(0, len(own), TILE):
                s = slice(i, i + TILE)
                score = np.where(own[s, None] == at[None, :], none, products(q[s], c, bound))
                held[s] = np.partition(np.concatenate([held[s], score], axis=1), -k, axis=1)[:, -k:]
        yield pd.DataFrame({"q": np.arange(len(own), dtype=np.int32), "low": held.min(axis=1), "high": held.max(axis=1)})

    found = same.select("row", "v").mapInPandas(best, "q int, low bigint, high bigint").groupBy("q").agg(F.max("low").alias("low"), F.max("high").alias("high")).toPandas()  # a row for each query
    low, high = np.full(n, none), np.full(n, none)
    low[found["q"].to_numpy()], high[found["q"].to_numpy()] = found["low"].to_numpy(np.int64), found["high"].to_numpy(np.int64)
    return np.maximum(low, -top), np.maximum(high, -top)


def _matrix(batch: pd.Series) -> np.ndarray:
    return np.array(batch.tolist(), dtype=np.float64)


def top_k(df: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest scores, ties to the smaller id. ``is_query``: a condition on ``id``."""
    spark = df.sparkSession
    small_batches(spark)
    rows = integer_vectors(df, scale, id_col, vector_col)
    shapes = rows.groupBy(F.size("v").alias("dim")).agg(F.max(F.expr("aggregate(v, 0D, (m, x) -> greatest(m, abs(x)))")).alias("most")).collect()  # a row for each length
    out = None
    for shape in shapes:
        same = rows.where(F.size("v") == shape["dim"])
        bound = shape["dim"] * shape["most"] ** 2
        asked = same.where(is_query & F.col("id").isNotNull()).select("row", "id", "v")
        if len(shapes) > 1 and not asked.limit(1).count():
            continue
        # Chunks follow one another by row; their borders are found without collecting the queries.
        n = asked.count()
        borders = [None]
        if n > CHUNK:
            parts = -(-n // CHUNK)
            borders += asked.select(F.percentile("row", [i / parts for i in range(1, parts)]).alias("b")).first()["b"]
        for low, high in zip(borders, [*borders[1:], None], strict=True):
            part = asked if low is None else asked.where(F.col("row") > int(low))
            found = _chunk(same, part if high is None else part.where(F.col("row") <= int(high)), k, bound)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return out


def _chunk(same: DataFrame, asked: DataFrame, k: int, bound: float) -> DataFrame:
    spark = same.sparkSession
    queries = asked.toPandas()  # CHUNK rows, about
    sent = spark.sparkContext.broadcast((queries["row"].to_numpy(np.int64), queries["id"].to_numpy(np.int64), _matrix(queries["v"]) if len(queries) else np.zeros((0, 1))))
    n = len(queries)
    top = int(min(bound, _LONG))
    low, high = _interval(same, sent, n, k, bound, top)  # the kth value lies in low..high
    above = np.zeros(n, dtype=np.int64)  # scores over high
    while n and (high > low).any():
        width = _unsigned(high - low) // BINS + 1  # differences of longs, as unsigned ones, don't overflow
        state = spark.sparkContext.broadcast((low, high, width))

        def histogram(frames: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            (own, _, q), (lo, hi, w) = sent.value, state.value
            counts = np.zeros(len(own) * BINS, dtype=np.int64)
            for f in frames:
                c, at = _matrix(f["v"]), f["row"].to_numpy(np.int64)
                for i in range(0, len(own), TILE):
                    s = slice(i, i + TILE)
                    score = products(q[s], c, bound)
                    inside = (score >= lo[s, None]) & (score <= hi[s, None]) & (own[s, None] != at[None, :])
                    key = (_unsigned(score - lo[s, None]) // w[s, None]).astype(np.int64) + (np.arange(len(own))[s] * BINS)[:, None]
                    counts += np.bincount(key[inside], minlength=len(counts))
            full = np.flatnonzero(counts)
            yield pd.DataFrame({"q": full // BINS, "bin": full % BINS, "n": counts[full]})

        sums = same.select("row", "v").mapInPandas(histogram, "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        over = F.sum("n").over(Window.partitionBy("q").orderBy(F.col("bin").desc()))
        need = spark.createDataFrame(pd.DataFrame({"q": np.arange(n, dtype=np.int32), "need": k - above}))
        at = sums.withColumn("over", over).join(need, "q").where("over >= need and over - n < need").select("q", "bin", (F.col("over") - F.col("n")).alias("above")).toPandas()  # a row for each query
        hit = at["q"].to_numpy(np.int64)
        rest = np.setdiff1d(np.arange(n), hit)  # fewer than k candidates: all of them count
        b, w, span = at["bin"].to_numpy(np.uint64), width[hit], _unsigned(high[hit] - low[hit])
        above[hit] += at["above"].to_numpy(np.int64)
        low[hit], high[hit] = low[hit] + (b * w).view(np.int64), low[hit] + np.minimum(b * w + (w - np.uint64(1)), span).view(np.int64)
        low[rest] = high[rest] = -top
    kth = spark.sparkContext.broadcast(low)

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (own, ids, q), t = sent.value, kth.value
        tied: list[list[tuple]] = [[] for _ in own]
        for f in frames:
            c, at = _matrix(f["v"]), f["row"].to_numpy(np.int64)
            null = f["id"].isna().to_numpy()
            named = f["id"].fillna(0).to_numpy(np.int64)
            order = np.lexsort((named, null))
            for i in range(0, len(own), TILE):
                s = slice(i, i + TILE)
                score = products(q[s], c, bound)
                a, b = np.nonzero((score > t[s, None]) & (own[s, None] != at[None, :]))
                yield pd.DataFrame({"q": own[i + a], "query_id": ids[i + a], "vec_id": pd.Series(named[b]).mask(null[b]).astype("Int64"), "score": score[a, b]})
                a, b = np.nonzero(((score == t[s, None]) & (own[s, None] != at[None, :]))[:, order])
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                for x, y in zip((i + a[rank < k]).tolist(), order[b[rank < k]].tolist(), strict=True):
                    tied[x].append((null[y], named[y]))
            tied = [sorted(x)[:k] if len(x) > k else x for x in tied]
        flat = [(own[x], ids[x], None if is_null else v, t[x]) for x, found in enumerate(tied) for is_null, v in found]
        out = pd.DataFrame(flat, columns=["q", "query_id", "vec_id", "score"])
        yield out.astype({"vec_id": "Int64"}) if len(out) else pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    kept = same.mapInPandas(keep, "q bigint, query_id bigint, vec_id bigint, score bigint")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
