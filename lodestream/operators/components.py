"""Connected components of an edge table by contraction, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b, of one type) with another end; nodes of a component share their root, one of them.

    In each round every node points to the first of itself and its neighbours, in an order that is drawn anew by
    hashing; edges are rewritten to what their ends point to, and those within one node go. The expected number of
    nodes falls by a constant factor a round, whatever the shape of the graph. A hub is pre-aggregated before its
    shuffle, and the joins on it can be split. Rounds are written to the shared folder.
    """
    left = cut(edges.where("a <> b").distinct(), "cc-edges")
    labels, step = None, 0
    while left.limit(1).count():
        step += 1
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        key = lambda c, s=step: F.struct(F.xxhash64(F.lit(s), c), F.col(c).alias("v"))
        best = both.groupBy("a").agg(F.min(key("b")).alias("near")).select("a", F.least(F.col("near"), key("a")).getField("v").alias("p"))
        best = cut(best, "cc-parents")
        ends = left.join(best, "a").select("b", F.col("p").alias("pa")).join(best.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        left = cut(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        if labels is None:
            labels = best.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(best, labels["root"] == best["a"], "left").select("node", F.coalesce("p", "root").alias("root"))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels
