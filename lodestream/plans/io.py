"""Queries of sources and streams (S1 to S39, streaming twins)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.corpus import articles, table
from lodestream.registry import registry
from lodestream.sources import feeds, sinks
from lodestream.session import shared_dir
from lodestream.streaming import twins

query, QUERIES, ORACLES = registry()


@query("SELECT 'src' || (item_id % 5) AS source_id, 'T ' || item_id AS title, 'https://x.test/' || item_id AS url FROM benchmark")
def s1_feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as feeds, one for each source, with an entry without a link that goes."""
    item = F.format_string("<item><title> T  %d </title><link>https://x.test/%d</link><description>d</description></item>", "item_id", "item_id")
    b = table(spark, sf, "benchmark").groupBy(F.concat(F.lit("src"), (F.col("item_id") % 5).cast("string")).alias("source_id")).agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    raw = b.select("source_id", F.concat(F.lit("<rss><channel><item><title>no link</title></item>"), "items", F.lit("</channel></rss>")).alias("content"))
    return feeds.read_feed_table(raw).select("source_id", "title", "url")


@query(
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]+)"[^>]*>.*?</a>', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]+)"[^>]*>.*?</a>', 1), 1) AS pos FROM pages),
p AS (SELECT page_id, regexp_replace(regexp_replace(href, '[?#].*$', ''), '^https?://[^/]+', '') AS path, min(pos) AS pos FROM a GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM p WHERE starts_with(path, '/') AND rtrim(path, '/') <> '') SELECT page_id, path FROM k WHERE k <= 20"""
)
def s3_scrape_links(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.scrape_links(table(spark, sf, "pages"), "html", "/", 20, "page_id").select("page_id", "path")


@query("SELECT id::VARCHAR AS url_hash, CASE WHEN cluster_size <= 3 THEN 'teaser' ELSE 'body' END AS kind, CASE WHEN cluster_size <= 3 THEN summary ELSE title END AS text FROM articles WHERE CASE WHEN cluster_size <= 3 THEN summary ELSE title END <> ''")
def s16_english_corpus(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf).withColumn("url_hash", F.col("id").cast("string"))
    bodies = a.where("cluster_size > 3").select("url_hash", F.concat(F.lit("[summary] <p>"), "title", F.lit("</p>")).alias("body"))
    return feeds.english_corpus(bodies, a)


@query("SELECT day, count(*) AS n FROM articles GROUP BY day")
def s19_replace_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Written twice, the second time only the newest year; nothing is doubled."""
    path = f"{shared_dir(spark)}/s19-{uuid.uuid4().hex}"
    a = articles(spark, sf).select("id", F.date_format("day", "yyyy").alias("year"), "day")
    sinks.replace_partitions(a, path, "year")
    last = a.agg(F.max("year")).first()[0]
    if last is not None:
        sinks.replace_partitions(a.where(F.col("year") == last), path, "year")
    return spark.read.schema("id bigint, day date, year string").parquet(path).groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT cluster_id, id::VARCHAR AS url, id = max(id) OVER (PARTITION BY cluster_id) AS is_representative FROM articles")
def s21_flatten_members(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf).select("cluster_id", F.struct(F.col("id").cast("string").alias("url")).alias("m"), "id")
    c = a.groupBy("cluster_id").agg(F.max_by("m", "id").alias("representative"), F.collect_list("m").alias("members"))
    return sinks.flatten_members(c).select("cluster_id", "url", "is_representative")


@query("SELECT DISTINCT day FROM articles WHERE DATE '2001-08-02' - day < 7 OR isodow(day) = 1")
def s25_retained(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.retained(articles(spark, sf).select("day").distinct(), "2001-08-02")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream; the file name keeps the other tables of the folder out."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """All that a stream has at hand, through a query with a checkpoint, as a written table."""
    name = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{name}/out/batch={i}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{name}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{name}/out/*")


@query("SELECT ts::DATE::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A22 on a stream, complete results."""
    return _run(spark, twins.windowed_counts(_stream(spark, sf), "event_type"), "complete")


@query("SELECT (ts::DATE - s::INT)::TIMESTAMP AS start, event_type, count(*) AS n FROM events, range(0, 7) r(s) GROUP BY ALL")
def stream_sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    """W13 on a stream, complete results."""
    return _run(spark, twins.sliding_counts(_stream(spark, sf), "event_type"), "complete")


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 12 HOUR, false)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run"""
)
def stream_session_spans(spark: SparkSession, sf: str) -> DataFrame:
    """W8 on a stream, complete results."""
    return _run(spark, twins.session_spans(_stream(spark, sf), "user_id", gap="12 hours"), "complete")


@query("SELECT DISTINCT user_id FROM events")
def stream_once_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """P2 on a stream."""
    return _run(spark, twins.once_per_key(_stream(spark, sf), "user_id"), "append").select("user_id")


@query("WITH n AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, day, n, (n - coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY day), 0))::DOUBLE AS velocity FROM n")
def stream_velocities(spark: SparkSession, sf: str) -> DataFrame:
    """W1 on a stream of daily sums."""
    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    path = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    daily.write.parquet(path)
    return _run(spark, twins.velocities(spark.readStream.schema(daily.schema).parquet(path), "event_type"), "append")


@query()
def stream_continuity(spark: SparkSession, sf: str) -> DataFrame:
    """D3 on a stream: the same ids as the batch fold's (tests compare them)."""
    from lodestream.operators.dedupe import group_rows
    from lodestream.plans.graphs import _clusters

    rows = group_rows(_clusters(spark, sf))
    path = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(path)
    q = spark.readStream.schema(rows.schema).parquet(path).writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(twins.continuity_writer(f"{path}-ids")).start()
    q.awaitTermination()
    return twins.continuity_ids(spark, f"{path}-ids")
