"""The corpus star schema, as read from the tables that are at hand.

An order stands for an article, its customer for the story cluster, its priority for category and importance, its
parts' brands for tags, their names for titles, its suppliers for outlets. VIEWS is the same mapping for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, entity, entity_type (model, lab, tag), article_id, cluster_id, source_id, importance, category: a row for each part of an order."""
    t = lambda n: table(spark, sf_dir, n)
    kind = F.when(F.col("p_type").isin("STANDARD", "ECONOMY"), "model").when(F.col("p_type").isin("MEDIUM", "LARGE", "SMALL"), "lab").otherwise("tag")
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(t("part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.to_date("o_orderdate").alias("day"),
        F.col("p_brand").alias("entity"),
        kind.alias("entity_type"),
        F.col("l_orderkey").alias("article_id"),
        F.col("o_custkey").alias("cluster_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("importance"),
        F.col("o_orderpriority").alias("category"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, cluster_id, source_id, category, importance, published, day, cluster_size, tags, also_covered_by, title, summary."""
    t = lambda n: table(spark, sf_dir, n)
    parts = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(t("part").select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    own = parts.groupBy("l_orderkey").agg(
        F.count("*").cast("int").alias("cluster_size"),
        F.array_sort(F.collect_set("p_brand")).alias("tags"),
        F.array_sort(F.collect_set(F.concat(F.lit("src"), (F.col("l_suppkey") % 20).cast("string")))).alias("also_covered_by"),
        F.max(F.concat_ws(" ", "p_name", "p_brand")).alias("title"),
        F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("summary"),
    )
    base = t("orders").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<string>")
    return base.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("cluster_id"),
        F.concat(F.lit("src"), (F.col("o_orderkey") % 20).cast("string")).alias("source_id"),
        F.col("o_orderpriority").alias("category"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("importance"),
        F.col("o_orderdate").alias("published"),
        F.to_date("o_orderdate").alias("day"),
        F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"),
        F.coalesce("tags", none).alias("tags"),
        F.coalesce("also_covered_by", none).alias("also_covered_by"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, entity (event type), source_id (user), a row for each event."""
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("day"), F.col("event_type").alias("entity"), F.lit("event").alias("entity_type"), F.col("user_id").alias("source_id"), F.col("event_id").alias("article_id"), "value"
    )


VIEWS = """mentions AS (SELECT o_orderdate::DATE AS day, p_brand AS entity, CASE WHEN p_type IN ('STANDARD','ECONOMY') THEN 'model' WHEN p_type IN ('MEDIUM','LARGE','SMALL') THEN 'lab' ELSE 'tag' END AS entity_type,
 l_orderkey AS article_id, o_custkey AS cluster_id, 's' || l_suppkey AS source_id, 6 - left(o_orderpriority, 1)::INT AS importance, o_orderpriority AS category
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
own_parts AS (SELECT l_orderkey, count(*)::INT AS cluster_size, list_sort(list(DISTINCT p_brand)) AS tags, list_sort(list(DISTINCT 'src' || (l_suppkey % 20))) AS also_covered_by, max(p_name || ' ' || p_brand) AS title,
 array_to_string(list_sort(list(DISTINCT p_name)), ' ') AS summary FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
articles AS (SELECT o_orderkey AS id, o_custkey AS cluster_id, 'src' || (o_orderkey % 20) AS source_id, o_orderpriority AS category, 6 - left(o_orderpriority, 1)::INT AS importance, o_orderdate AS published, o_orderdate::DATE AS day,
 coalesce(cluster_size, 1) AS cluster_size, coalesce(tags, []::VARCHAR[]) AS tags, coalesce(also_covered_by, []::VARCHAR[]) AS also_covered_by, coalesce(title, '') AS title, coalesce(summary, '') AS summary
 FROM orders LEFT JOIN own_parts ON o_orderkey = l_orderkey),
daily_events AS (SELECT ts::DATE AS day, event_type AS entity, 'event' AS entity_type, user_id AS source_id, event_id AS article_id, value FROM events)"""
