"""Queries of statistics and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.corpus import daily_events, mentions, table
from lodestream.operators import inference as inf
from lodestream.operators import timeseries as ts
from lodestream.operators import vectors as vec
from lodestream.registry import registry

query, QUERIES, ORACLES = registry()

_SERIES = "s AS (SELECT entity, entity_type, day, count(*) AS n FROM daily_events GROUP BY ALL)"


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return daily_events(spark, sf).groupBy("entity", "entity_type", "day").agg(F.count("*").alias("n"))


_MONTHLY = "s AS (SELECT entity, category, date_trunc('month', day)::DATE AS day, count(*)::DOUBLE AS n FROM mentions GROUP BY ALL)"


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("entity", "category", F.to_date(F.date_trunc("month", "day")).alias("day")).agg(F.count("*").alias("n"))


_SHIFT = f"""{_MONTHLY}, p AS (SELECT entity, category, row_number() OVER w AS k, sum(n) OVER w AS s, sum(n * n) OVER w AS q, count(*) OVER a AS n, sum(n) OVER a AS tot, sum(n * n) OVER a AS totq FROM s WINDOW w AS (PARTITION BY entity, category ORDER BY day), a AS (PARTITION BY entity, category)),
e AS (SELECT *, round((q - s * s / k) + ((totq - q) - (tot - s) ** 2 / (n - k)), 9) AS sse FROM p WHERE k >= 4 AND n - k >= 4), b AS (SELECT *, row_number() OVER (PARTITION BY entity, category ORDER BY sse, k) AS r FROM e),
shifts AS (SELECT entity, category, k AS index, (tot - s) / (n - k) - s / k AS shift, CASE WHEN totq - tot * tot / n > 1e-12 THEN 1 - sse / (totq - tot * tot / n) ELSE 0 END AS sse_reduction FROM b WHERE r = 1)"""


@query(f"WITH {_SHIFT} SELECT entity, category, index, round(shift, 6) AS shift, round(sse_reduction, 6) AS sse_reduction FROM shifts")
def m1_level_shift(spark: SparkSession, sf: str) -> DataFrame:
    out = inf.level_shift(_monthly(spark, sf), ["entity", "category"], "day", "n")
    return out.select("entity", "category", F.col("index").cast("long").alias("index"), F.round("shift", 6).alias("shift"), F.round("sse_reduction", 6).alias("sse_reduction"))


@query(f"WITH {_SERIES}, w AS (SELECT *, avg(n) OVER v AS m, stddev_pop(n) OVER v AS sd FROM s WINDOW v AS (PARTITION BY entity)) SELECT entity, day, n FROM w WHERE sd > 1e-12 AND round(n - m - 2 * sd, 9) > 0")
def m2_burst_days(spark: SparkSession, sf: str) -> DataFrame:
    return inf.burst_days(_series(spark, sf), ["entity"], "n").select("entity", "day", "n")


@query(f"WITH {_SHIFT}, c AS (SELECT entity, category, count(*) AS d FROM s GROUP BY ALL) SELECT entity, category FROM shifts JOIN c USING (entity, category) WHERE shift > 0 AND sse_reduction >= 0.1 AND d >= 8")
def m3_take_offs(spark: SparkSession, sf: str) -> DataFrame:
    """M3 with a threshold that monthly series can meet."""
    s = _monthly(spark, sf)
    shifts = inf.level_shift(s, ["entity", "category"], "day", "n").join(s.groupBy("entity", "category").agg(F.count("*").alias("d")), ["entity", "category"])
    return inf.take_offs(shifts, F.col("d"), 8, 0.1).select("entity", "category")


@query("SELECT day, entity, round(count(*) / greatest(count(DISTINCT source_id), 1), 6) AS rate FROM daily_events GROUP BY ALL")
def m4_corrected_rate(spark: SparkSession, sf: str) -> DataFrame:
    """M4: a count over its exposure."""
    return daily_events(spark, sf).groupBy("day", "entity").agg(F.round(F.count("*") / F.greatest(F.count_distinct("source_id"), F.lit(1)), 6).alias("rate"))


@query()
def m6_nb_trends(spark: SparkSession, sf: str) -> DataFrame:
    """M5, M6: negative binomial trends of the event types; no SQL form."""
    rows = daily_events(spark, sf)
    per = rows.groupBy("day").agg(F.count("*").alias("exposure"))
    panel = _series(spark, sf).join(per, "day").withColumn("t", F.datediff("day", F.lit("2024-01-01").cast("date")))
    return inf.nb_trends(panel.select("entity", "t", "n", "exposure"), "entity")


@query("WITH d AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM events GROUP BY ALL) SELECT user_id, round(stddev_samp(a) / nullif(avg(a), 0), 6) AS cv_a, round(corr(a, b), 6) AS pearson FROM d GROUP BY user_id HAVING stddev_pop(a) > 0 AND stddev_pop(b) > 0")
def m7_validation(spark: SparkSession, sf: str) -> DataFrame:
    """M7: variation and agreement of two series of a key."""
    d = ts_user_days(spark, sf)
    g = d.groupBy("user_id").agg(F.round(F.stddev_samp("a") / F.nullif(F.avg("a"), F.lit(0)), 6).alias("cv_a"), F.round(inf.correlation("a", "b"), 6).alias("pearson"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    return g.where("sa > 0 AND sb > 0").drop("sa", "sb")


def ts_user_days(spark: SparkSession, sf: str) -> DataFrame:
    e = daily_events(spark, sf).withColumnRenamed("source_id", "user_id")
    n = lambda v: F.sum(F.when(F.col("entity") == v, 1).otherwise(0))
    return e.groupBy("user_id", "day").agg(n("view").alias("a"), n("click").alias("b"))


@query()
def m8_smooth_velocities(spark: SparkSession, sf: str) -> DataFrame:
    """M8: smoothed levels and velocities of the event types; no SQL form."""
    return inf.smooth_velocities(_series(spark, sf).select("entity", "day", "n"), "entity", "n")


@query(
    """WITH d AS (SELECT user_id, (ts::DATE - DATE '2024-01-01')::INT AS t, count(*) FILTER (event_type = 'view') AS x, count(*) FILTER (event_type = 'purchase') AS y FROM events GROUP BY ALL),
j AS (SELECT a.user_id, l.lag, a.x, b.y FROM d a CROSS JOIN range(0, 8) l(lag) JOIN d b ON a.user_id = b.user_id AND b.t = a.t + l.lag),
r AS (SELECT user_id, lag, corr(x, y) AS r FROM j GROUP BY ALL HAVING stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(r, 9) DESC, lag) AS k FROM r)
SELECT user_id, lag::INT AS lag, round(r, 6) AS corr FROM k WHERE k = 1"""
)
def m9_lag_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """M9, M10."""
    e = daily_events(spark, sf).withColumnRenamed("source_id", "user_id")
    n = lambda v: F.sum(F.when(F.col("entity") == v, 1).otherwise(0))
    d = e.groupBy("user_id", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("t")).agg(n("view").alias("x"), n("purchase").alias("y"))
    return inf.lag_correlation(d, ["user_id"], "x", "y").select("user_id", "lag", F.round("corr", 6).alias("corr"))


@query(
    "WITH f AS (SELECT user_id, min(ts::DATE) FILTER (event_type = 'view') AS first_paper, min(ts::DATE) FILTER (event_type = 'purchase') AS first_news FROM events GROUP BY user_id) SELECT user_id, first_paper, first_news, (first_news - first_paper)::INT AS lag_days FROM f"
)
def m11_media_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Days from the first paper to the first news; null if one is missing."""
    first = lambda v: F.min(F.when(F.col("entity") == v, F.col("day")))
    f = daily_events(spark, sf).groupBy(F.col("source_id").alias("user_id")).agg(first("view").alias("first_paper"), first("purchase").alias("first_news"))
    return f.withColumn("lag_days", F.datediff("first_news", "first_paper"))


@query(
    """WITH f AS (SELECT user_id, event_type, min(ts::DATE) AS first_day FROM events GROUP BY ALL), a AS (SELECT f.user_id, f.first_day < g.first_day AS before FROM f JOIN f g ON f.user_id = g.user_id AND f.event_type = 'view' AND g.event_type = 'purchase' WHERE f.first_day <> g.first_day),
c AS (SELECT count(*) FILTER (before) AS k, count(*) AS n FROM a) SELECT k, n, round(k / n, 6) AS share FROM c"""
)
def m12_paper_first_share(spark: SparkSession, sf: str) -> DataFrame:
    """How often views come before purchases (the tail probability has a unit test)."""
    lag = m11_media_lag(spark, sf).where("lag_days <> 0")
    return lag.agg(F.sum(F.when(F.col("lag_days") > 0, 1).otherwise(0)).alias("k"), F.count("*").alias("n")).withColumn("share", F.round(F.col("k") / F.col("n"), 6))


@query(
    """WITH m AS (SELECT entity, strftime(day, '%Y%m')::INT AS t, count(*) AS n FROM mentions GROUP BY ALL), r AS (SELECT entity, rank() OVER (PARTITION BY entity ORDER BY t) + (count(*) OVER (PARTITION BY entity, t) - 1) / 2.0 AS a, rank() OVER (PARTITION BY entity ORDER BY n) + (count(*) OVER (PARTITION BY entity, n) - 1) / 2.0 AS b FROM m)
SELECT entity, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY entity"""
)
def m13_spearman_trend(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf).groupBy("entity", F.date_format("day", "yyyyMM").cast("int").alias("t")).agg(F.count("*").alias("k"))
    return inf.spearman(m, ["entity"], "t", "k").select("entity", F.round("rho", 6).alias("rho"), "n")


_SEATS = """st AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY ALL), q AS (SELECT k, n * 100.0 / (SELECT sum(n) FROM st) AS q FROM st),
h AS (SELECT k, floor(q) AS f, row_number() OVER (ORDER BY round(q - floor(q), 12) DESC, k) AS p FROM q), seats AS (SELECT k, (f + (p <= 100 - (SELECT sum(f) FROM h))::INT)::BIGINT AS seats FROM h)"""


@query(f"WITH {_SEATS} SELECT k, seats FROM seats")
def m14_hamilton(spark: SparkSession, sf: str) -> DataFrame:
    strata = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("n"))
    return inf.hamilton(strata, "k", "n", 100)


@query(f"WITH {_SEATS} SELECT k, seats AS n FROM seats")
def m15_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling operator, as rows of each stratum (which rows is up to a seeded hash)."""
    rows = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "k")
    return inf.stratified_sample(rows, "k", m14_hamilton(spark, sf), "c_custkey", 7).groupBy("k").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT l_partkey % 50 AS g, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY ALL), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM c)
SELECT g, round(p, 6) AS p, round((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 6) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 6) AS high FROM z"""
)
def m16_wilson(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 50).alias("g")).agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("k"), F.count("*").alias("n"))
    w = g.select("g", inf.wilson(F.col("k"), F.col("n")).alias("w"))
    return w.select("g", *[F.round(f"w.{c}", 6).alias(c) for c in ("p", "low", "high")])


@query("SELECT o_orderpriority AS kind, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS seen, round(1 - count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS undercount FROM orders GROUP BY ALL")
def m17_undercount(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("total"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("seen"))
    return g.withColumn("undercount", F.round(1 - F.col("seen") / F.col("total"), 6))


@query()
def m18_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Share of finished orders, resampling customers; no SQL form."""
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("h"), F.count("*").alias("t"))
    return inf.clustered_bootstrap(c, "h", "t")


@query(
    """WITH f AS (SELECT cluster_id, min(day) AS a, max(day) AS b FROM articles GROUP BY cluster_id), n AS (SELECT strftime(a, '%Y-%m') AS month, count(*) AS new FROM f GROUP BY ALL), d AS (SELECT strftime(b, '%Y-%m') AS month, count(*) AS dormant FROM f WHERE (SELECT max(day) FROM articles) - b >= 21 GROUP BY ALL)
SELECT coalesce(n.month, d.month) AS month, coalesce(new, 0) AS new, coalesce(dormant, 0) AS dormant FROM n FULL JOIN d ON n.month = d.month"""
)
def m19_novelty_series(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters that begin and that fall silent (21 days before the end) by month."""
    from lodestream.corpus import articles

    a = articles(spark, sf)
    f = a.groupBy("cluster_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    end = a.agg(F.max("day").alias("e"))
    new = f.groupBy(F.date_format("a", "yyyy-MM").alias("month")).agg(F.count("*").alias("new"))
    gone = f.crossJoin(F.broadcast(end)).where(F.datediff("e", "b") >= 21).groupBy(F.date_format("b", "yyyy-MM").alias("month")).agg(F.count("*").alias("dormant"))
    return new.join(gone, "month", "full_outer").fillna(0)


@query(
    """WITH s AS (SELECT n_chars AS s, quality = 1 AS t FROM documents JOIN labels USING (doc_id)), b AS (SELECT s, count(*) AS n, count(*) FILTER (t) AS t FROM s GROUP BY s), c AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS n, sum(t) OVER (ORDER BY s DESC) AS t FROM b), f AS (SELECT s, t / n AS p, t / (SELECT sum(t) FROM b) AS r FROM c)
SELECT s AS threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM f WHERE r >= 0.9 ORDER BY p DESC, r DESC, s DESC LIMIT 1"""
)
def v5_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("n_chars").alias("s"), (F.col("quality") == 1).alias("t"))
    out = inf.calibrate_threshold(rows, "s", "t")
    return out.select(F.col("threshold").cast("long").alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT count(*) FILTER (n_chars >= 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 1000 AND quality <> 1) AS fp, count(*) FILTER (n_chars < 1000 AND quality = 1) AS fn, round(count(*) FILTER (n_chars >= 1000 AND quality = 1) / count(*) FILTER (n_chars >= 1000), 6) AS precision, round(count(*) FILTER (n_chars >= 1000 AND quality = 1) / count(*) FILTER (quality = 1), 6) AS recall FROM documents JOIN labels USING (doc_id)")
def v6_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    out = inf.evaluate(rows, F.col("n_chars") >= 1000, F.col("quality") == 1)
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query(
    """WITH s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS rank FROM s) SELECT id, neighbour, rank::INT AS rank, round(score, 4) AS score FROM k WHERE rank <= 8 AND score >= 0"""
)
def v2_cosine_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """V2, T7, J18."""
    from lodestream.operators.vectors import cosine_top_k

    return cosine_top_k(table(spark, sf, "embeddings"))


_PROTO = """nv AS (SELECT vec_id, label, list_transform(embedding, lambda x: x / nullif(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))), 0)) AS v FROM embeddings),
d AS (SELECT label, i, avg(v[i]) AS x FROM nv, range(1, 65) r(i) GROUP BY ALL), pr AS (SELECT label, list(x ORDER BY i) AS p FROM d GROUP BY label)"""


@query(f"WITH {_PROTO} SELECT vec_id, label, round(list_cosine_similarity(v, p), 6) AS score FROM nv JOIN pr USING (label)")
def v4_prototype_scores(spark: SparkSession, sf: str) -> DataFrame:
    """V4."""
    e = table(spark, sf, "embeddings")
    return vec.prototype_scores(e, vec.prototypes(e, "label", "embedding"), "label", "embedding").select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    """WITH s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, a.label AS cluster, b.label AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS k FROM s) SELECT cluster, other, round(max(score), 4) AS score FROM k WHERE k <= 8 AND score >= 0 AND cluster <> other GROUP BY ALL"""
)
def v3_related_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """All related clusters of each cluster."""
    e = table(spark, sf, "embeddings")
    near = vec.cosine_top_k(e)
    return vec.related_clusters(near, e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")), None).select("cluster", "other", "score")


@query(
    """WITH d AS (SELECT user_id, (ts::DATE - DATE '2024-01-01')::INT AS t, count(*) FILTER (event_type = 'view') AS x, count(*) FILTER (event_type = 'purchase') AS y FROM events GROUP BY ALL), k AS (SELECT user_id FROM d GROUP BY user_id HAVING count(*) FILTER (x > 0) >= 5 AND count(*) FILTER (y > 0) >= 5),
j AS (SELECT a.user_id, l.lag, a.x, b.y FROM d a JOIN k USING (user_id) CROSS JOIN range(0, 8) l(lag) JOIN d b ON a.user_id = b.user_id AND b.t = a.t + l.lag), r AS (SELECT user_id, lag, corr(x, y) AS r FROM j GROUP BY ALL HAVING stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12),
b AS (SELECT user_id, lag FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(r, 9) DESC, lag) = 1) SELECT count(*) AS n, round(median(lag), 6) AS median_lag, round(avg(lag), 6) AS mean_lag FROM b"""
)
def m10_lag_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Median and mean lag of the keys with five active days on either side."""
    d = daily_events(spark, sf).withColumnRenamed("source_id", "user_id")
    n = lambda v: F.sum(F.when(F.col("entity") == v, 1).otherwise(0))
    d = d.groupBy("user_id", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("t")).agg(n("view").alias("x"), n("purchase").alias("y"))
    active = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    keys = d.groupBy("user_id").agg(active("x").alias("a"), active("y").alias("b")).where("a >= 5 AND b >= 5").select("user_id")
    lags = inf.lag_correlation(d.join(keys, "user_id", "left_semi"), ["user_id"], "x", "y")
    return lags.agg(F.count("*").alias("n"), F.round(F.median("lag"), 6).alias("median_lag"), F.round(F.avg("lag"), 6).alias("mean_lag"))


@query("SELECT l_partkey AS paper, o_orderdate::DATE AS day, o_orderpriority AS kind, l_orderkey AS article FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def m20_paper_events(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each event of a paper."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_partkey").alias("paper"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("kind"), F.col("l_orderkey").alias("article"))


@query(
    "WITH m AS (SELECT entity, date_trunc('month', day) AS m, count(*) AS n FROM mentions GROUP BY ALL), v AS (SELECT entity, avg(n) AS level, regr_slope(n, epoch(m)) * 86400 AS slope, count(*) AS k FROM m GROUP BY entity) SELECT count(*) AS concepts, round(corr(level, slope), 6) AS pearson FROM v WHERE k > 2"
)
def m21_velocity_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of two measures over concepts, here level and constant velocity."""
    m = mentions(spark, sf).groupBy("entity", F.date_trunc("month", "day").alias("m")).agg(F.count("*").alias("n"))
    t = F.unix_timestamp("m").cast("double")
    v = m.groupBy("entity").agg(F.avg("n").alias("level"), (F.regr_slope("n", t) * 86400).alias("slope"), F.count("*").alias("k")).where("k > 2")
    return v.agg(F.count("*").alias("concepts"), F.round(inf.correlation("level", "slope"), 6).alias("pearson"))
