"""Entities, tags, co-occurrence and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import bound, tokens


def first_slots(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def tag_index(articles: DataFrame, days: int, cap: int = 500) -> DataFrame:
    """Of each tag in the last ``days`` days: uses, newest article ids (``cap`` at most), categories by first use."""
    end = articles.agg(F.max("day").alias("__end"))
    rows = articles.crossJoin(F.broadcast(end)).where(F.datediff("__end", "day") < days).select("id", "day", "category", F.explode("tags").alias("tag"))
    counts = rows.groupBy("tag").agg(F.count("*").alias("count"))
    newest = Window.partitionBy("tag").orderBy(F.col("day").desc(), "id")
    slots = rows.withColumn("n", F.row_number().over(newest))
    ids = slots.where(F.col("n") <= cap).groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    cats = slots.groupBy("tag", "category").agg(F.min("n").alias("n")).groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "category"))), lambda x: x["category"]).alias("categories"))
    return counts.join(ids, "tag").join(cats, "tag")


def entity_mentions(articles: DataFrame, models: Column, labs: Column) -> DataFrame:
    """A row for each tag of an article, repeats included, with its type."""
    rows = articles.select("day", "id", "cluster_id", "source_id", "importance", "category", F.explode("tags").alias("entity"))
    kind = F.when(models, "model").when(labs, "lab").otherwise("tag")
    return rows.select("day", kind.alias("entity_type"), "entity", F.col("id").alias("article_id"), "cluster_id", "source_id", "importance", "category")


def pairs_within(items: Column) -> Column:
    """The pairs a < b of an array's distinct elements, as an array of structs."""
    return bound(F.array_sort(F.array_distinct(items)), lambda s: F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.struct(a.alias("a"), b.alias("b"))))))


def tag_pairs(articles: DataFrame) -> DataFrame:
    """A row for each pair of tags of an article."""
    return articles.select("day", "id", "cluster_id", "category", F.explode(pairs_within(F.col("tags"))).alias("p")).select(
        "day", F.col("p.a").alias("tag_a"), F.col("p.b").alias("tag_b"), "cluster_id", F.col("id").alias("article_id"), "category"
    )


def entity_pairs(mentions: DataFrame) -> DataFrame:
    """A10: pairs of an article's distinct (entity, type), one side at least a model or lab; a < b by entity, then type."""
    m = mentions.select("article_id", "day", "cluster_id", "category", "entity", "entity_type").distinct()
    a = m.select("article_id", "day", "cluster_id", "category", F.col("entity").alias("entity_a"), F.col("entity_type").alias("type_a"))
    b = m.select("article_id", F.col("entity").alias("entity_b"), F.col("entity_type").alias("type_b"))
    ordered = (F.col("entity_a") < F.col("entity_b")) | ((F.col("entity_a") == F.col("entity_b")) & (F.col("type_a") < F.col("type_b")))
    return a.join(b, "article_id").where(ordered & ((F.col("type_a") != "tag") | (F.col("type_b") != "tag")))


def edge_list(pairs: DataFrame, a: str, b: str, least: int = 1) -> DataFrame:
    """Weight is the number of distinct clusters; ends in order."""
    w = pairs.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count_distinct("cluster_id").alias("weight"))
    return w.where(F.col("weight") >= least)


def cooccurrence_graph(pairs: DataFrame, a: str, b: str, top: int = 25) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): weight is the number of rows; the ``top`` nodes by total weight and the edges among them."""
    edges = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("weight"), F.count_distinct("cluster_id").alias("clusters"))
    ends = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    nodes = ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("total")).orderBy(F.col("total").desc(), "node").limit(top)
    inside = edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
    return nodes, inside


def trending(texts: DataFrame, k: int = 15) -> DataFrame:
    """The most frequent tokens of (pos, text) rows, ties by first occurrence."""
    rows = texts.select("pos", F.posexplode(tokens(F.col("text"))).alias("i", "keyword"))
    counts = rows.groupBy("keyword").agg(F.count("*").alias("count"), F.min(F.struct("pos", "i")).alias("first"))
    return counts.orderBy(F.col("count").desc(), "first").limit(k).select("keyword", "count")
