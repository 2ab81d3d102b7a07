"""Joins that Spark has no operator for, as unions, windows and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import cut


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_key: str, right_at: str, out: str) -> DataFrame:
    """Each left row with the newest right time strictly before it, null if there is none.

    Both sides go into one window by key and time, so the cost is a sort, not a range join.
    """
    l = left.select("*", F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(0).alias("__s"), F.lit(None).cast("timestamp").alias("__r"))  # noqa: E741
    r = right.select(F.col(right_key).alias("__k"), F.col(right_at).alias("__t"), F.lit(1).alias("__s"), F.col(right_at).alias("__r"))
    w = Window.partitionBy("__k").orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, -1)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(out, F.last("__r", ignorenulls=True).over(w))
    return both.where("__s = 0").select(*left.columns, out)


def running(df: DataFrame, order: list, sums: dict[str, str], place: str | None = None) -> DataFrame:
    """Running sums (out -> column) in a total order, and the place of each row from zero, without one task for all rows.

    A range partitioning, running sums within each partition, and what the partitions before hold: a row for each.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "running")
    w, before = Window.partitionBy("__p").orderBy(*order), Window.orderBy("__p")
    totals = parts.groupBy("__p").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{o}") for o, c in sums.items()])
    offsets = totals.select("__p", (F.sum("__n").over(before) - F.col("__n")).alias("__n0"), *[(F.sum(f"__{o}").over(before) - F.col(f"__{o}")).alias(f"__{o}0") for o in sums])
    out = parts.select("*", (F.row_number().over(w) - 1).alias("__i"), *[F.sum(c).over(w).alias(f"__{o}") for o, c in sums.items()]).join(F.broadcast(offsets), "__p")
    done = out.select(*df.columns, *([(F.col("__n0") + F.col("__i")).alias(place)] if place else []), *[(F.col(f"__{o}0") + F.col(f"__{o}")).alias(o) for o in sums])
    return done


def global_place(df: DataFrame, order: list, out: str) -> DataFrame:
    """The place of each row in a total order, from zero."""
    return running(df, order, {}, out)


def membership_diff(old: DataFrame, new: DataFrame, key: str, group: str) -> DataFrame:
    """Joined, left, moved or stayed."""
    a, b = old.select(key, F.col(group).alias("__a")), new.select(key, F.col(group).alias("__b"))
    state = F.when(F.col("__a").isNull(), "joined").when(F.col("__b").isNull(), "left").when(F.col("__a") != F.col("__b"), "moved").otherwise("stayed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def band_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points within closed ranges of whole numbers, by equality of bins of ``width`` and a check."""
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__bin").where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")
