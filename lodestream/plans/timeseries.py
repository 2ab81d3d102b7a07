"""Queries along time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.corpus import daily_events, mentions, table
from lodestream.functions.text import iso_week
from lodestream.operators import timeseries as ts
from lodestream.registry import registry

query, QUERIES, ORACLES = registry()

GRID = """seen AS (SELECT day, entity, entity_type, count(*) AS n FROM mentions GROUP BY ALL),
days AS (SELECT unnest(generate_series((SELECT min(day) FROM seen)::TIMESTAMP, (SELECT max(day) FROM seen)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day),
counts AS (SELECT d.day, e.entity, e.entity_type, coalesce(s.n, 0) AS count FROM days d CROSS JOIN (SELECT DISTINCT entity, entity_type FROM seen) e LEFT JOIN seen s ON s.day = d.day AND s.entity = e.entity AND s.entity_type = e.entity_type),
vel AS (SELECT *, (count - coalesce(lag(count) OVER w, 0))::DOUBLE AS velocity FROM counts WINDOW w AS (PARTITION BY entity, entity_type ORDER BY day)),
acc AS (SELECT *, coalesce(velocity - lag(velocity) OVER w, 0.0) AS acceleration FROM vel WINDOW w AS (PARTITION BY entity, entity_type ORDER BY day)),
bur AS (SELECT *, (velocity - avg(velocity) OVER w) / greatest(coalesce(stddev_samp(velocity) OVER w, 0), 1) AS burst FROM acc WINDOW w AS (PARTITION BY entity, entity_type))"""


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return ts.daily_counts(mentions(spark, sf))


@query(f"WITH {GRID} SELECT day, entity, entity_type, count::BIGINT AS count FROM counts")
def a22_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


@query(f"WITH {GRID} SELECT day, entity, entity_type, velocity FROM vel")
def w1_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return ts.velocity(_counts(spark, sf)).drop("count")


@query(
    """WITH seen AS (SELECT day, entity, entity_type, count(*) AS n FROM daily_events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day) AS k FROM seen),
e AS (SELECT day, entity, entity_type, k, n::DOUBLE AS ema FROM o WHERE k = 1 UNION ALL SELECT o.day, o.entity, o.entity_type, o.k, e.ema * 0.75 + o.n * 0.25 FROM e JOIN o ON o.entity = e.entity AND o.k = e.k + 1)
SELECT day, entity, round(ema, 6) AS ema FROM e"""
)
def w2_ema(spark: SparkSession, sf: str) -> DataFrame:
    seen = daily_events(spark, sf).groupBy("day", "entity", "entity_type").agg(F.count("*").alias("n"))
    return ts.ema(seen, "n", 7, "ema").select("day", "entity", F.round("ema", 6).alias("ema"))


@query(f"WITH {GRID} SELECT day, entity, entity_type, acceleration FROM acc")
def w3_acceleration(spark: SparkSession, sf: str) -> DataFrame:
    return ts.acceleration(ts.velocity(_counts(spark, sf))).select("day", "entity", "entity_type", "acceleration")


@query(f"WITH {GRID} SELECT day, entity, entity_type, round(burst, 6) AS burst FROM bur")
def w4_burst(spark: SparkSession, sf: str) -> DataFrame:
    return ts.burst_scores(ts.velocity(_counts(spark, sf))).select("day", "entity", "entity_type", F.round("burst", 6).alias("burst"))


@query(f"WITH {GRID} SELECT entity, entity_type, velocity, round(burst, 6) AS burst FROM bur WHERE day = (SELECT max(day) FROM bur) ORDER BY velocity DESC, entity, entity_type LIMIT 10")
def top_gainers(spark: SparkSession, sf: str) -> DataFrame:
    """The ten entities that grew most on the last day, with their burst scores."""
    scored = ts.burst_scores(ts.velocity(_counts(spark, sf)))
    last = mentions(spark, sf).agg(F.max("day").alias("__last"))
    top = scored.join(F.broadcast(last), F.col("day") == F.col("__last")).orderBy(F.col("velocity").desc(), "entity", "entity_type").limit(10)
    return top.select("entity", "entity_type", "velocity", F.round("burst", 6).alias("burst"))


@query(f"WITH {GRID} SELECT entity, entity_type, velocity FROM vel WHERE day = (SELECT max(day) FROM vel) ORDER BY velocity, entity, entity_type LIMIT 10")
def w14_top_losers(spark: SparkSession, sf: str) -> DataFrame:
    last = mentions(spark, sf).agg(F.max("day").alias("__last"))
    scored = ts.velocity(_counts(spark, sf)).join(F.broadcast(last), F.col("day") == F.col("__last"))
    return scored.orderBy("velocity", "entity", "entity_type").limit(10).select("entity", "entity_type", "velocity")


_ROLL = "SELECT period, entity, entity_type, n::BIGINT AS count, (n - coalesce(lag(n) OVER (PARTITION BY entity, entity_type ORDER BY period), 0))::BIGINT AS velocity FROM p"


@query(f"WITH {GRID}, p AS (SELECT strftime(day, '%G-W%V') AS period, entity, entity_type, sum(count) AS n FROM counts GROUP BY ALL) {_ROLL}")
def a23_weekly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ts.weekly(_counts(spark, sf))


@query(f"WITH {GRID}, p AS (SELECT strftime(day, '%Y-%m') AS period, entity, entity_type, sum(count) AS n FROM counts GROUP BY ALL) {_ROLL}")
def a23_monthly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ts.monthly(_counts(spark, sf))


@query(
    """WITH seen AS (SELECT day, source_id AS paper, count(*) FILTER (entity = 'view') AS primary_n, count(*) FILTER (entity <> 'view') AS reference_n FROM daily_events GROUP BY ALL),
d AS (SELECT unnest(generate_series((SELECT min(day) FROM seen)::TIMESTAMP, (SELECT max(day) FROM seen)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day)
SELECT d.day, p.paper, coalesce(primary_n, 0) AS primary_n, coalesce(reference_n, 0) AS reference_n,
 coalesce(primary_n + reference_n, 0) - coalesce(lag(coalesce(primary_n + reference_n, 0)) OVER (PARTITION BY p.paper ORDER BY d.day), 0) AS velocity
FROM d CROSS JOIN (SELECT DISTINCT paper FROM seen) p LEFT JOIN seen s ON s.day = d.day AND s.paper = p.paper"""
)
def a24_paper_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts of each paper by kind, gap-filled, with velocity."""
    rows = daily_events(spark, sf).withColumnRenamed("source_id", "paper")
    kind = lambda c: F.sum(F.when(c, 1).otherwise(0))
    seen = rows.groupBy("day", "paper").agg(kind(F.col("entity") == "view").alias("primary_n"), kind(F.col("entity") != "view").alias("reference_n"))
    days = seen.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    full = seen.select("paper").distinct().crossJoin(F.broadcast(days)).join(seen, ["day", "paper"], "left").fillna(0)
    total = F.col("primary_n") + F.col("reference_n")
    from pyspark.sql import Window

    return full.withColumn("velocity", total - F.coalesce(F.lag(total).over(Window.partitionBy("paper").orderBy("day")), F.lit(0)))


_RECENT = """r AS (SELECT {key}, count(*) FILTER (e - day BETWEEN 0 AND 6) AS recent, count(*) FILTER (e - day BETWEEN 7 AND 13) AS prior FROM {rows}, (SELECT max(day) AS e FROM {rows}) GROUP BY {key})"""


@query(f"WITH {_RECENT.format(key='source_id', rows='daily_events')} SELECT source_id, recent, prior, recent - prior AS score FROM r WHERE recent > 0 ORDER BY score DESC, recent DESC, source_id LIMIT 20")
def a26_hot_papers(spark: SparkSession, sf: str) -> DataFrame:
    hot = ts.recent_vs_prior(daily_events(spark, sf), ["source_id"]).where("recent > 0").withColumnRenamed("delta", "score")
    return hot.orderBy(F.col("score").desc(), F.col("recent").desc(), "source_id").limit(20)


@query(f"WITH {_RECENT.format(key='entity', rows='mentions')} SELECT entity, recent, prior, recent - prior AS delta FROM r ORDER BY delta DESC, recent DESC, entity LIMIT 8")
def a51_brief_gainers(spark: SparkSession, sf: str) -> DataFrame:
    return ts.recent_vs_prior(mentions(spark, sf), ["entity"]).orderBy(F.col("delta").desc(), F.col("recent").desc(), "entity").limit(8)


@query(f"WITH {_RECENT.format(key='entity', rows='mentions')} SELECT entity, recent, prior, recent - prior AS delta FROM r ORDER BY delta, recent DESC, entity LIMIT 8")
def a51_brief_losers(spark: SparkSession, sf: str) -> DataFrame:
    return ts.recent_vs_prior(mentions(spark, sf), ["entity"]).orderBy("delta", F.col("recent").desc(), "entity").limit(8)


@query(f"WITH {_RECENT.format(key='entity, category', rows='mentions')} SELECT entity, category, recent, prior, recent - prior AS delta FROM r")
def w13_recent_vs_prior(spark: SparkSession, sf: str) -> DataFrame:
    return ts.recent_vs_prior(mentions(spark, sf), ["entity", "category"])


_OBSERVED = """seen AS (SELECT {0} AS bucket, entity, count(*) AS count FROM mentions GROUP BY ALL), top AS (SELECT entity, sum(count)::BIGINT AS total FROM seen GROUP BY entity ORDER BY total DESC, entity LIMIT 15),
f AS (SELECT b.bucket, t.entity, t.total, coalesce(s.count, 0) AS count FROM top t CROSS JOIN (SELECT DISTINCT bucket FROM seen) b LEFT JOIN seen s ON s.bucket = b.bucket AND s.entity = t.entity)
SELECT bucket, entity, total, count, first_value(bucket) OVER (PARTITION BY entity ORDER BY count DESC, bucket) AS peak FROM f"""


@query("WITH " + _OBSERVED.format("strftime(day, '%G-W%V')"))
def a29_weekly_series(spark: SparkSession, sf: str) -> DataFrame:
    return ts.observed_series(mentions(spark, sf), iso_week(F.col("day")))


@query("WITH " + _OBSERVED.format("strftime(day, '%Y-%m')"))
def a29_monthly_series(spark: SparkSession, sf: str) -> DataFrame:
    return ts.observed_series(mentions(spark, sf), F.date_format("day", "yyyy-MM"))


@query("SELECT entity, max(day) AS day, max(n) AS n FROM (SELECT entity, day, count(*) AS n, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS k FROM mentions GROUP BY entity, day) WHERE k = 1 GROUP BY entity")
def w7_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ts.latest(mentions(spark, sf).groupBy("entity", "day").agg(F.count("*").alias("n")), ["entity"])


@query(
    """WITH a AS (SELECT entity, entity_type, count(*) AS before FROM mentions WHERE year(day) = 1999 AND month(day) = 3 GROUP BY ALL), b AS (SELECT entity, entity_type, count(*) AS after FROM mentions WHERE year(day) = 1999 AND month(day) = 4 GROUP BY ALL)
SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.entity_type, b.entity_type) AS entity_type, coalesce(before, 0) AS before, coalesce(after, 0) AS after,
 CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'gone' ELSE 'kept' END AS state, coalesce(after, 0) - coalesce(before, 0) AS swing FROM a FULL JOIN b ON a.entity = b.entity AND a.entity_type = b.entity_type"""
)
def w15_snapshot_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Two months as snapshots."""
    month = lambda m: mentions(spark, sf).where((F.year("day") == 1999) & (F.month("day") == m)).groupBy("entity", "entity_type").agg(F.count("*").alias("n"))
    return ts.snapshot_delta(month(3), month(4), "n")


SPANS = """d AS (SELECT source_id AS user_id, entity, day, count(*) AS n FROM daily_events GROUP BY ALL), g AS (SELECT *, coalesce(day - lag(day) OVER (PARTITION BY user_id, entity ORDER BY day) > {gap}, false)::INT AS new FROM d),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id, entity ORDER BY day) AS run FROM g)"""


@query(f"WITH {SPANS.format(gap=7)} SELECT user_id, entity, run::BIGINT AS run, min(day) AS start, max(day) AS \"end\", count(*) AS active_days, sum(n)::BIGINT AS mentions FROM r GROUP BY user_id, entity, run")
def w8_spans(spark: SparkSession, sf: str) -> DataFrame:
    return ts.spans(daily_events(spark, sf).withColumnRenamed("source_id", "user_id"), ["user_id", "entity"])


@query(
    f"WITH {SPANS.format(gap=3)}, s AS (SELECT user_id, entity, run, min(day) || '..' || max(day) AS t FROM r GROUP BY user_id, entity, run) SELECT user_id, entity, string_agg(t, ';' ORDER BY t) AS spans, count(*) AS n_spans FROM s GROUP BY user_id, entity"
)
def w8_span_text(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["user_id", "entity"]
    return ts.span_text(ts.spans(daily_events(spark, sf).withColumnRenamed("source_id", "user_id"), keys, gap=3), keys)


@query(
    """WITH d AS (SELECT entity AS brand, category, day, string_agg(DISTINCT entity_type, '+' ORDER BY entity_type) AS sources FROM mentions GROUP BY ALL), g AS (SELECT *, (day - lag(day) OVER (PARTITION BY brand, category ORDER BY day))::INT AS gap_days FROM d)
SELECT brand, category, day, sources, gap_days FROM g WHERE gap_days >= 21"""
)
def w9_revivals(spark: SparkSession, sf: str) -> DataFrame:
    return ts.revivals(mentions(spark, sf).withColumnRenamed("entity", "brand"), ["brand", "category"], "entity_type")


@query(
    """WITH p AS (SELECT strftime(a.day, '%Y-%m') AS month, a.entity AS concept, b.entity AS partner FROM mentions a JOIN mentions b ON a.article_id = b.article_id AND a.entity <> b.entity),
f AS (SELECT *, min(month) OVER (PARTITION BY concept, partner) AS first FROM p)
SELECT concept, month, count(DISTINCT partner) FILTER (month = first) AS new_partners, count(*) FILTER (month > first) AS repeat_hits FROM f GROUP BY concept, month"""
)
def w10_new_partners(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf).select("article_id", "day", "entity")
    pairs = m.select("article_id", F.date_format("day", "yyyy-MM").alias("month"), F.col("entity").alias("concept")).join(m.select("article_id", F.col("entity").alias("partner")), "article_id")
    return ts.new_partners(pairs.where("concept <> partner").select("month", "concept", "partner"))


WEEKS = """w AS (SELECT floor((datediff('day', DATE '0001-01-01', day) + 1) / 7)::BIGINT AS week, article_id, entity FROM mentions), pa AS (SELECT week, article_id, count(*) AS n, count(DISTINCT entity) AS k FROM w GROUP BY ALL),
s AS (SELECT week, sum(n)::BIGINT AS mentions, count(*) FILTER (k >= 2) AS multi_articles FROM pa GROUP BY week), ac AS (SELECT week, count(DISTINCT entity) AS active FROM w GROUP BY week),
weeks AS (SELECT g.week, coalesce(mentions, 0) AS mentions, coalesce(multi_articles, 0) AS multi_articles, coalesce(active, 0) AS active FROM (SELECT unnest(range((SELECT min(week) FROM w), (SELECT max(week) FROM w) + 1)) AS week) g LEFT JOIN s USING (week) LEFT JOIN ac USING (week))"""


def _weeks(spark: SparkSession, sf: str) -> DataFrame:
    return ts.weekly_density(mentions(spark, sf))


@query(f"WITH {WEEKS} SELECT week, mentions, multi_articles, active FROM weeks")
def a40_weekly_density(spark: SparkSession, sf: str) -> DataFrame:
    return _weeks(spark, sf)


@query(f"WITH {WEEKS} SELECT trunc(median(mentions))::INT AS median FROM (SELECT mentions FROM weeks WHERE mentions > 0 ORDER BY week DESC LIMIT 8)")
def a41_recent_median(spark: SparkSession, sf: str) -> DataFrame:
    return ts.recent_median(_weeks(spark, sf), "mentions")


@query(f"WITH {WEEKS}, t AS (SELECT max(week) FILTER (active < 25) AS t FROM weeks), n AS (SELECT count(*) FILTER (t IS NULL OR week > t) AS streak FROM weeks, t) SELECT streak, CASE WHEN streak >= 4 THEN 'GREEN' ELSE 'RED' END AS status FROM n")
def w11_dense_streak(spark: SparkSession, sf: str) -> DataFrame:
    return ts.dense_streak(_weeks(spark, sf), "active", 25)


@query("WITH d AS (SELECT day, (row_number() OVER (ORDER BY day) - 1) // 14 AS win FROM (SELECT DISTINCT day FROM mentions)) SELECT win::BIGINT AS win, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM d GROUP BY win")
def w12_active_day_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ts.active_day_windows(mentions(spark, sf))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 500")
def w16_first_slots(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 occurrences of each key, which is the list's length."""
    from lodestream.operators.entities import first_slots

    return first_slots(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 500).select("user_id", "event_id")


@query(
    f"""WITH {GRID} SELECT entity, entity_type, CASE WHEN velocity > 0 AND acceleration > 0 THEN 'rising' WHEN velocity > 0 THEN 'peaking' WHEN acceleration > 0 THEN 'recovering' ELSE 'falling' END AS phase, abs(round(burst, 9)) >= 2 AS bursting FROM bur WHERE day = (SELECT max(day) FROM bur)"""
)
def w17_quadrant(spark: SparkSession, sf: str) -> DataFrame:
    scored = ts.burst_scores(ts.acceleration(ts.velocity(_counts(spark, sf))))
    last = ts.latest(ts.quadrant(scored), ["entity", "entity_type"])
    return last.select("entity", "entity_type", "phase", "bursting")
