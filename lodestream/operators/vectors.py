"""Cosine neighbours and prototypes of dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import written

#: Bytes of candidates, as doubles, that go to the tasks at one time, at most; queries and candidates that are multiplied
#: at one time; pairs of them that are scored at one time, if each query has many.
SENT_BYTES, ROWS, COLUMNS, PAIRS = 32 << 20, 1024, 4096, 1 << 18
#: A row group is held in memory by the task that writes it and goes to one task when it is read.
GROUPS = {"parquet.block.size": str(8 << 20)}


def cosine_top_k(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each vector's k nearest others by cosine, negative ones dropped after the cut, four digits.

    Equal vectors ask once, and the first k + 1 of them are candidates: a copy has the others' nearest without itself.
    Blocks of candidates of bounded size go to the tasks, one after another; the tasks multiply them tile by tile in
    single precision with the queries they hold; what can be among the nearest by that product's error is scored in
    double precision, in the order of components, so that ties are those of the SQL (a zero norm counts as one). With
    a query go its k + 1 nearest so far, from one block to the next: no more rows come of it, and one block is held.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    held, _ = written(first.repartition(spark.sparkContext.defaultParallelism), "vectors", **GROUPS)
    stats = held.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = stats["n"], stats["dim"] or 0
    parts, drop = max(1, -(-n * dim * 8 // SENT_BYTES)), None
    none = (F.array().cast("array<bigint>").alias("near_id"), F.array().cast("array<double>").alias("near_score"))
    asked = held.where("nth = 1").select("id", "v", *none)
    schema = f"id bigint, v {held.schema['v'].dataType.simpleString()}, near_id array<bigint>, near_score array<double>"
    for part in range(parts):
        block = (held if parts == 1 else held.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).select("id", "v").toArrow()
        sent = spark.sparkContext.broadcast((block["id"].to_numpy(), _flat(block["v"].combine_chunks(), dim)))
        del block

        def best(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            at, m = sent.value
            for f in frames:
                if not len(f):
                    continue
                others = (pd.DataFrame({"id": at[j : j + COLUMNS], "v": list(m[j : j + COLUMNS])}) for j in range(0, len(at), COLUMNS))
                near = pd.concat(_nearest(np.arange(len(f)), _matrix(f["v"]), others, k + 1, (f["near_id"], f["near_score"])))
                ends = np.cumsum(np.bincount(near["rep"], minlength=len(f)))[:-1]
                yield f.assign(near_id=np.split(near["neighbour"].to_numpy(), ends), near_score=np.split(near["score"].to_numpy(), ends))

        found = asked.mapInPandas(best, schema)
        if part < parts - 1:
            found, after = written(found, "nearest", **GROUPS)
            sent.destroy()
            if drop:
                drop()
            drop = after
        asked = found
    near = asked.select("v", F.transform(F.arrays_zip("near_id", "near_score"), lambda x: F.struct(x["near_id"].alias("neighbour"), x["near_score"].alias("score"))).alias("near"))
    others = own.join(near, "v").select("id", F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("near"))
    top = others.select("id", F.posexplode("near").alias("at", "x"))
    return top.select("id", F.col("x.neighbour").alias("neighbour"), F.round("x.score", 4).alias("score"), (F.col("at") + 1).alias("rank"))


def _flat(v: pa.ListArray, dim: int) -> np.ndarray:
    """A row for each of the lists, which must have ``dim`` numbers each."""
    if set(pc.list_value_length(v).unique().to_pylist()) - {dim}:
        raise ValueError(f"vectors of other lengths than {dim}")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), -1)


def _parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows in single precision; components, one after another; squared norms, added up in their order."""
    columns, square = np.ascontiguousarray(m.T), np.zeros(len(m))
    for x in columns:
        square += x * x
    norm = np.sqrt(square)
    return (m / np.where(norm == 0, 1, norm)[:, None]).astype(np.float32), columns, square


def _nearest(ids: np.ndarray, q: np.ndarray, frames: Iterator[pd.DataFrame], most: int, known: tuple[pd.Series, pd.Series] | None = None) -> Iterator[pd.DataFrame]:
    """Of each query the ``most`` nearest rows of ``frames`` by (score, id), itself included, negative ones left out.

    ``known``: each query's nearest rows before, in their order, ids and scores, as they come of this function.
    """
    tiles = [_parts(q[i : i + ROWS]) for i in range(0, len(ids), ROWS)]
    none = lambda kind: np.zeros(0, dtype=kind)
    kept = [(none(np.int64), none(np.float64), none(np.int64)) for _ in tiles]  # query, score, id
    least = [np.zeros(len(t[0])) for t in tiles]
    for t, i in enumerate(range(0, len(ids) if known else 0, ROWS)):
        near, score = (x.iloc[i : i + ROWS] for x in known)
        size = near.map(len).to_numpy()
        kept[t] = np.repeat(np.arange(len(size)), size), np.concatenate([none(np.float64), *score]), np.concatenate([none(np.int64), *near])
        least[t][size == most] = [x[-1] for x in score[size == most]]
    # twice what rounding does to a product of unit rows: dim additions and products, and either row's own rounding
    slack = 2 * (q.shape[1] + 4) * 2.0**-23
    for f in frames:
        for j in range(0, len(f), COLUMNS):
            at, c = f["id"].to_numpy(np.int64)[j : j + COLUMNS], _parts(_matrix(f["v"].iloc[j : j + COLUMNS]))
            for t, tile in enumerate(tiles):
                near = tile[0] @ c[0].T
                hit = near >= (least[t] - slack).astype(np.float32)[:, None]
                if len(at) > most and np.count_nonzero(hit) > 4 * most * len(near):
                    hit &= near >= (np.partition(near, -most, axis=1)[:, -most] - np.float32(slack))[:, None]
                step = max(1, PAIRS // len(at)) if np.count_nonzero(hit) > PAIRS else ROWS
                for start in range(0, len(hit), step):
                    row, col = np.nonzero(hit[start : start + step])
                    row += start
                    if not len(row):
                        continue
                    dot = np.zeros(len(row))
                    for x, y in zip(tile[1], c[1], strict=True):
                        dot += x[row] * y[col]
                    base = np.sqrt(tile[2][row] * c[2][col])
                    score = np.clip(dot / np.where(base == 0, 1, base), -1, 1)
                    fine = score >= 0
                    row, score, near_id = (np.concatenate([a, b[fine]]) for a, b in zip(kept[t], (row, score, at[col]), strict=True))
                    order = np.lexsort((near_id, -score, row))
                    row, score, near_id = row[order], score[order], near_id[order]
                    nth = np.arange(len(row)) - np.searchsorted(row, row)
                    full = nth == most - 1
                    least[t][row[full]] = score[full]
                    kept[t] = tuple(a[nth < most] for a in (row, score, near_id))
    for t, (row, score, near_id) in enumerate(kept):
        yield pd.DataFrame({"rep": ids[t * ROWS + row], "neighbour": near_id, "score": score})


def normalised(vectors: DataFrame, vector: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("__norm", norm).withColumn(vector, F.transform(vector, lambda x: x / F.when(F.col("__norm") == 0, 1.0).otherwise(F.col("__norm")))).drop("__norm")


def prototypes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """V4: the mean of each group's normalised vectors, normalised again."""
    dims = normalised(vectors, vector).select(key, F.posexplode(vector).alias("i", "x"))
    mean = dims.groupBy(key, "i").agg(F.avg("x").alias("x"))
    return normalised(mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("prototype")), "prototype")


def prototype_scores(vectors: DataFrame, protos: DataFrame, key: str, vector: str) -> DataFrame:
    """V4: the cosine of each vector to its group's prototype."""
    joined = normalised(vectors, vector).join(protos, key)
    dot = F.aggregate(F.zip_with(vector, "prototype", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return joined.withColumn("score", dot)


def related_clusters(neighbours: DataFrame, cluster_of: DataFrame, k: int | None = 6) -> DataFrame:
    """Of each cluster the other clusters with their best neighbour score: k of them, or all."""
    a = neighbours.join(cluster_of.select(F.col("id"), F.col("cluster").alias("cluster")), "id")
    b = a.join(cluster_of.select(F.col("id").alias("neighbour"), F.col("cluster").alias("other")), "neighbour").where("cluster <> other")
    best = b.groupBy("cluster", "other").agg(F.max("score").alias("score"))
    if k is None:
        return best
    w = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "other")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
