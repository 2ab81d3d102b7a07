"""Stable ids and slugs of story clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_suffix(df: DataFrame, base: str, order: str, out: str) -> DataFrame:
    """The first row of a base keeps it, the others get -2, -3 and so on."""
    k = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("__k", k).withColumn(out, F.when(F.col("__k") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.col("__k").cast("string")))).drop("__k")


def first_key(members: DataFrame) -> DataFrame:
    """Of each cluster the key of its earliest member, (published, url_hash); without a date it sorts first."""
    published = F.coalesce(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return members.groupBy("cluster_id").agg(F.min(F.struct(published.alias("published"), "url_hash")).alias("k")).select("cluster_id", F.col("k.published").alias("first_published"), F.col("k.url_hash").alias("first_url_hash"))


def freeze(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys that are known stay as they are, late members don't change them; clusters without one get the new one."""
    o = old.select("cluster_id", F.col("first_published").alias("__p"), F.col("first_url_hash").alias("__h"))
    both = new.join(o, "cluster_id", "full_outer")
    return both.select("cluster_id", F.coalesce("__p", "first_published").alias("first_published"), F.coalesce("__h", "first_url_hash").alias("first_url_hash"))


def stable_slugs(clusters: DataFrame, frozen: DataFrame, computed: DataFrame) -> DataFrame:
    """The frozen key, else the computed one, else the id; equal slugs are told apart by a suffix."""
    f = frozen.select("cluster_id", F.col("first_url_hash").alias("__f"))
    c = computed.select("cluster_id", F.col("first_url_hash").alias("__c"))
    own = clusters.select("cluster_id").distinct().join(f, "cluster_id", "left").join(c, "cluster_id", "left")
    base = own.select("cluster_id", F.coalesce(F.nullif("__f", F.lit("")), F.nullif("__c", F.lit("")), F.col("cluster_id").cast("string")).alias("base"))
    return unique_suffix(base, "base", "cluster_id", "slug").select("cluster_id", "slug")
