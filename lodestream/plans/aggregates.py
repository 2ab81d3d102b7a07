"""Queries of entities, keywords and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.corpus import articles, daily_events, mentions, table
from lodestream.functions import text as T
from lodestream.functions.text import iso_week
from lodestream.operators import entities as en
from lodestream.operators import stats as st
from lodestream.operators.joins import global_place
from lodestream.plans.scalars import TOKENS
from lodestream.registry import registry
from lodestream.session import cut

query, QUERIES, ORACLES = registry()

CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT day, count(*) AS n FROM articles GROUP BY day")
def a1_daily_articles(spark: SparkSession, sf: str) -> DataFrame:
    return st.counts(articles(spark, sf), "day")


@query("SELECT entity_type, entity, count(*) AS n FROM mentions GROUP BY ALL ORDER BY n DESC, entity_type, entity LIMIT 30")
def a2_top_entities(spark: SparkSession, sf: str) -> DataFrame:
    return st.counts(mentions(spark, sf), "entity_type", "entity").orderBy(F.col("n").desc(), "entity_type", "entity").limit(30)


@query("SELECT source_id, count(*) AS n FROM mentions GROUP BY source_id")
def a3_source_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return st.counts(mentions(spark, sf), "source_id")


@query("SELECT day, " + ", ".join(f"count(*) FILTER (category = '{c}') AS \"{c}\"" for c in CATEGORIES) + " FROM articles GROUP BY day")
def a4_category_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return st.category_pivot(articles(spark, sf), CATEGORIES)


_TAG_PAIRS = "tp AS (SELECT a.id AS article_id, a.cluster_id, a.day, a.category, x.t AS tag_a, y.t AS tag_b FROM articles a, unnest(tags) AS x(t), unnest(tags) AS y(t) WHERE x.t < y.t)"


@query(f"WITH {_TAG_PAIRS} SELECT tag_a, tag_b, count(*) AS n FROM tp GROUP BY ALL ORDER BY n DESC, tag_a, tag_b LIMIT 20")
def a5_top_tag_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return st.counts(en.tag_pairs(articles(spark, sf)), "tag_a", "tag_b").orderBy(F.col("n").desc(), "tag_a", "tag_b").limit(20)


@query("SELECT o_orderstatus AS phase, count(*) AS n FROM orders GROUP BY ALL")
def a6_dropped_by_phase(spark: SparkSession, sf: str) -> DataFrame:
    return st.counts(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "phase"), "phase")


@query(
    """WITH r AS (SELECT x.t AS tag, id, category, row_number() OVER (PARTITION BY x.t ORDER BY day DESC, id) AS n FROM articles, unnest(tags) AS x(t) WHERE (SELECT max(day) FROM articles) - day < 365),
c AS (SELECT tag, category, min(n) AS n FROM r GROUP BY ALL)
SELECT tag, count(*) AS count, array_to_string(list(id ORDER BY n) FILTER (n <= 500), ',') AS ids, (SELECT array_to_string(list(category ORDER BY c.n), ',') FROM c WHERE c.tag = r.tag) AS categories FROM r GROUP BY tag"""
)
def a7_tag_index(spark: SparkSession, sf: str) -> DataFrame:
    return en.tag_index(articles(spark, sf), 365).select("tag", "count", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"), F.concat_ws(",", "categories").alias("categories"))


@query("SELECT day, CASE WHEN x.t < 'Brand#15' THEN 'model' WHEN x.t < 'Brand#2' THEN 'lab' ELSE 'tag' END AS entity_type, x.t AS entity, id AS article_id, cluster_id, source_id, importance, category FROM articles, unnest(tags) AS x(t)")
def a8_entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return en.entity_mentions(articles(spark, sf), F.col("entity") < "Brand#15", F.col("entity") < "Brand#2")


@query(f"WITH {_TAG_PAIRS} SELECT day, tag_a, tag_b, cluster_id, article_id, category FROM tp")
def a9_tag_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return en.tag_pairs(articles(spark, sf))


_ENTITY_PAIRS = """dm AS (SELECT DISTINCT article_id, day, cluster_id, category, entity, entity_type FROM mentions),
ep AS (SELECT a.article_id, a.day, a.cluster_id, a.category, a.entity AS entity_a, a.entity_type AS type_a, b.entity AS entity_b, b.entity_type AS type_b FROM dm a JOIN dm b ON a.article_id = b.article_id AND (a.entity, a.entity_type) < (b.entity, b.entity_type) WHERE a.entity_type <> 'tag' OR b.entity_type <> 'tag')"""


@query(f"WITH {_ENTITY_PAIRS} SELECT * FROM ep")
def a10_entity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return en.entity_pairs(mentions(spark, sf))


@query(
    f"""WITH r AS (SELECT doc_id AS pos, unnest({TOKENS.format('text').replace('{{2,}}', '{2,}')}) AS keyword, generate_subscripts({TOKENS.format('text').replace('{{2,}}', '{2,}')}, 1) AS i FROM documents)
SELECT keyword, count(*) AS count FROM r GROUP BY keyword ORDER BY count DESC, min((pos, i)) LIMIT 15"""
)
def a11_trending(spark: SparkSession, sf: str) -> DataFrame:
    return en.trending(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text"))


@query(
    f"""WITH k AS (SELECT lang, unnest({TOKENS.format('text').replace('{{2,}}', '{2,}')}) AS keyword FROM documents), n AS (SELECT lang, keyword, count(*) AS c FROM k GROUP BY ALL) SELECT keyword, sum(c)::BIGINT AS count FROM n GROUP BY keyword ORDER BY count DESC, keyword LIMIT 50"""
)
def a12_trending_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of per-part keyword counts."""
    rows = table(spark, sf, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("keyword"))
    return rows.groupBy("lang", "keyword").agg(F.count("*").alias("c")).groupBy("keyword").agg(F.sum("c").alias("count")).orderBy(F.col("count").desc(), "keyword").limit(50)


_TOP = "list_transform(list_sort(list({{n: -n, v: {v}}})), lambda x: x.v)"


@query(
    """WITH o AS (SELECT cluster_id, count(DISTINCT x.o) AS outlets FROM articles, unnest(list_distinct(list_concat([source_id], also_covered_by))) AS x(o) GROUP BY cluster_id),
b AS (SELECT cluster_id, min((-importance, published, id))[3] AS rep_id, count(*) AS articles, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day, max(importance) AS mi FROM articles GROUP BY cluster_id),
tn AS (SELECT cluster_id, x.t AS tag, count(*) AS n FROM articles, unnest(tags) AS x(t) GROUP BY ALL), tk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, tag) AS k FROM tn),
t AS (SELECT cluster_id, list(tag ORDER BY k) AS top_tags FROM tk WHERE k <= 6 GROUP BY cluster_id),
cn AS (SELECT cluster_id, category, count(*) AS n FROM articles GROUP BY ALL), c AS (SELECT cluster_id, arg_min(category, (-n, category)) AS category FROM cn GROUP BY cluster_id)
SELECT cluster_id, rep_id, articles, days, first_day, last_day, greatest((last_day - first_day) + 1, 1)::INT AS day_span, outlets, category, top_tags, round(mi + 0.6 * (outlets - 1) + 0.8 * (days - 1), 6)::DOUBLE AS score
FROM b JOIN o USING (cluster_id) JOIN c USING (cluster_id) LEFT JOIN t USING (cluster_id)""".replace("min((-importance, published, id))[3]", "arg_min(id, (-importance, published, id))")
)
def a13_cluster_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """A13, A31, U1."""
    return st.cluster_rollup(articles(spark, sf))


@query("WITH d AS (SELECT cluster_id % 7 AS theme, day, count(*) AS n FROM articles GROUP BY ALL) SELECT theme, day, sum(n)::BIGINT AS count FROM d GROUP BY ALL")
def a14_theme_daily(spark: SparkSession, sf: str) -> DataFrame:
    """A theme's days are the sums of its clusters' days."""
    days = articles(spark, sf).groupBy("cluster_id", "day").agg(F.count("*").alias("n"))
    themes = days.select("cluster_id").distinct().withColumn("theme", F.col("cluster_id") % 7)
    return days.join(themes, "cluster_id").groupBy("theme", "day").agg(F.sum("n").alias("count"))


_BANDS = "CASE WHEN s <= 1 THEN '1' WHEN s <= 3 THEN '2~3' WHEN s <= 7 THEN '4~7' WHEN s <= 14 THEN '8~14' WHEN s <= 30 THEN '15~30' WHEN s <= 60 THEN '31~60' WHEN s <= 90 THEN '61~90' ELSE '91+' END"


@query(f"WITH c AS (SELECT user_id, event_type, (max(ts::DATE) - min(ts::DATE) + 1)::INT AS s FROM events GROUP BY ALL) SELECT {_BANDS} AS band, count(*) AS n FROM c GROUP BY ALL")
def a16_span_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by their span in days."""
    spans = daily_events(spark, sf).groupBy("source_id", "entity").agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("s"))
    return spans.groupBy(st.banded(F.col("s"), [1, 3, 7, 14, 30, 60, 90]).alias("band")).agg(F.count("*").alias("n"))


@query(
    "SELECT CASE WHEN l_quantity <= 2 THEN '0~2' WHEN l_quantity <= 4 THEN '3~4' WHEN l_quantity <= 6 THEN '5~6' WHEN l_quantity <= 8 THEN '7~8' WHEN l_quantity <= 10 THEN '9~10' WHEN l_quantity <= 12 THEN '11~12' ELSE '13+' END AS bucket, count(*) AS n FROM lineitem GROUP BY ALL"
)
def a17_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(st.banded(F.col("l_quantity"), [2, 4, 6, 8, 10, 12]).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """WITH q AS (SELECT year(day) || '-Q' || quarter(day) AS quarter, date_trunc('quarter', day)::DATE AS s, day, category, id FROM articles)
SELECT quarter, count(*) AS articles, count(DISTINCT day) AS n_days, (datediff('day', min(s), (min(s) + INTERVAL 3 MONTH)::DATE))::INT AS total_days, round(count(DISTINCT day) / datediff('day', min(s), (min(s) + INTERVAL 3 MONTH)::DATE), 3) AS coverage FROM q GROUP BY quarter"""
)
def a18_quarter_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("day")
    first, last = T.quarter_bounds(d)
    q = articles(spark, sf).select(T.quarter_key(d).alias("quarter"), "day", (F.datediff(last, first) + 1).alias("total"))
    return q.groupBy("quarter").agg(F.count("*").alias("articles"), F.count_distinct("day").alias("n_days"), F.first("total").alias("total_days")).withColumn("coverage", F.round(F.col("n_days") / F.col("total_days"), 3))


@query(
    """WITH f AS (SELECT p_brand AS model, p_type AS benchmark, o_orderdate AS day, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
n AS (SELECT model, benchmark, count(*) AS n, min((day, l_orderkey, l_linenumber, l_partkey)) AS first FROM f GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, first) AS k FROM n)
SELECT model, (SELECT max(day)::DATE FROM f WHERE f.model = k.model) AS latest_seen, (SELECT count(DISTINCT l_orderkey) FROM f WHERE f.model = k.model) AS articles, string_agg(benchmark, ',' ORDER BY k) AS top FROM k WHERE k <= 3 GROUP BY model"""
)
def a19_model_index(spark: SparkSession, sf: str) -> DataFrame:
    """Latest day, distinct articles and the three most frequent facts, ties by first sight."""
    facts = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    facts = facts.select(F.col("p_brand").alias("model"), F.col("p_type").alias("benchmark"), F.col("o_orderdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey")
    from lodestream.operators.ledger import model_index

    return model_index(facts)


@query(
    """WITH d AS (SELECT p_partkey, o_orderdate::DATE AS day, importance, category FROM (SELECT l_partkey AS p_partkey, o_orderdate, 6 - left(o_orderpriority, 1)::INT AS importance, o_orderpriority AS category FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
SELECT p_partkey AS paper, min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT day) AS seen_count, max(importance) AS importance_max, array_to_string(list_sort(list(DISTINCT category)), ',') AS tags FROM d GROUP BY p_partkey"""
)
def a20_paper_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of a paper over all its rows."""
    from lodestream.operators.ledger import paper_rollup

    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("l_partkey").alias("paper"), F.to_date("o_orderdate").alias("day"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("importance"), F.array("o_orderpriority").alias("tags"))
    return paper_rollup(rows).withColumn("tags", F.array_join(F.array_sort("tags"), ","))


@query(
    """WITH j AS (SELECT l_partkey AS paper, x.t AS tag, count(*) AS n FROM lineitem JOIN articles ON id = l_orderkey, unnest(tags) AS x(t) GROUP BY ALL) SELECT paper, tag, n FROM j"""
)
def a25_paper_topics(spark: SparkSession, sf: str) -> DataFrame:
    """A25, J25."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("paper"), "l_orderkey").join(articles(spark, sf), F.col("l_orderkey") == F.col("id"))
    return rows.select("paper", F.explode("tags").alias("tag")).groupBy("paper", "tag").agg(F.count("*").alias("n"))


@query(f"WITH {_TAG_PAIRS} SELECT tag_a AS a, tag_b AS b, count(DISTINCT cluster_id) AS weight FROM tp GROUP BY ALL HAVING weight >= 3")
def a27_edge_list(spark: SparkSession, sf: str) -> DataFrame:
    return en.edge_list(en.tag_pairs(articles(spark, sf)), "tag_a", "tag_b", 3)


_GRAPH = f"""{_TAG_PAIRS}, e AS (SELECT tag_a AS a, tag_b AS b, count(*) AS weight, count(DISTINCT cluster_id) AS clusters FROM tp GROUP BY ALL),
n AS (SELECT node, count(*) AS degree, sum(weight)::BIGINT AS total FROM (SELECT a AS node, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY node ORDER BY total DESC, node LIMIT 10)"""


@query(f"WITH {_GRAPH} SELECT node, degree, total FROM n")
def a28_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return en.cooccurrence_graph(en.tag_pairs(articles(spark, sf)), "tag_a", "tag_b", 10)[0]


@query(f"WITH {_GRAPH} SELECT a, b, weight, clusters FROM e WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)")
def a28_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return en.cooccurrence_graph(en.tag_pairs(articles(spark, sf)), "tag_a", "tag_b", 10)[1]


@query(
    """WITH p AS (SELECT cluster_id, count(DISTINCT source_id) AS s, count(*) AS n FROM articles GROUP BY cluster_id)
SELECT count(DISTINCT id) AS ids, count(*) AS rows, count(DISTINCT day) AS days, count(DISTINCT source_id) AS sources, count(DISTINCT category) AS categories, (max(day) - min(day) + 1)::INT AS span_days,
(SELECT count(*) FROM p) AS clusters, (SELECT floor(avg((s >= 2)::INT) * 1000 + 0.5) / 10 FROM p) AS multi_source_pct, (SELECT round(avg(n), 6) FROM p) AS avg_size FROM articles"""
)
def a30_corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return st.corpus_totals(articles(spark, sf))


@query("SELECT source_id, count(*) AS n FROM articles GROUP BY source_id ORDER BY n DESC, source_id LIMIT 5")
def a30_top_sources(spark: SparkSession, sf: str) -> DataFrame:
    return st.counts(articles(spark, sf), "source_id").orderBy(F.col("n").desc(), "source_id").limit(5)


@query("SELECT coalesce(importance::VARCHAR, 'missing') AS importance, count(*) AS n FROM articles GROUP BY ALL")
def a30_importance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return st.importance_histogram(articles(spark, sf))


@query("WITH d AS (SELECT day, count(*) AS n FROM articles GROUP BY day) SELECT (isodow(day) - 1)::INT AS weekday, floor(avg(n) * 10 + 0.5) / 10 AS average FROM d GROUP BY ALL")
def a30_weekday_averages(spark: SparkSession, sf: str) -> DataFrame:
    return st.weekday_averages(articles(spark, sf))


_MATRIX = """s AS (SELECT cluster_id, max(cluster_size) * max(importance) AS score FROM articles GROUP BY cluster_id ORDER BY score DESC, cluster_id LIMIT 12),
i AS (SELECT a.*, s.score FROM articles a JOIN s USING (cluster_id)), o AS (SELECT source_id, count(*) AS t FROM i GROUP BY source_id ORDER BY t DESC, source_id LIMIT 15)"""


@query(f"WITH {_MATRIX} SELECT cluster_id, source_id, score, count(*) AS n FROM i WHERE source_id IN (SELECT source_id FROM o) GROUP BY ALL")
def a32_coverage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A32, J22."""
    return st.coverage_matrix(articles(spark, sf))


@query("WITH c AS (SELECT strftime(day, '%G-W%V') AS week, source_id, category, count(*) AS n FROM articles GROUP BY ALL), t AS (SELECT *, (sum(n) OVER (PARTITION BY week, source_id))::BIGINT AS total FROM c) SELECT * FROM t WHERE total >= 3")
def a33_outlet_mix(spark: SparkSession, sf: str) -> DataFrame:
    return st.outlet_mix(articles(spark, sf), iso_week(F.col("day")))


def players(spark: SparkSession, sf: str) -> DataFrame:
    """Nations stand for players: three outlets, two tags and an institution each."""
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("player"),
        F.array(F.concat(F.lit("src"), (key % 20).cast("string"))).alias("sources"),
        F.array(F.concat(F.lit("Brand#"), key.cast("string")), F.concat(F.lit("Brand#"), (key + 7).cast("string"))).alias("tags"),
        F.array(F.concat(F.lit(" Small Ring"), F.lit(" brand#"), key.cast("string"))).alias("institutions"),
    )


_PLAYERS = """pl AS (SELECT n_name AS player, 'src' || (n_nationkey % 20) AS source, ['Brand#' || n_nationkey, 'Brand#' || (n_nationkey + 7)] AS ptags, 'small ring brand#' || n_nationkey AS inst FROM nation),
pm AS (SELECT player, id FROM pl JOIN articles ON source_id = source UNION SELECT player, id FROM pl, unnest(ptags) AS x(t), articles, unnest(tags) AS y(t) WHERE x.t = y.t UNION SELECT player, id FROM pl JOIN articles ON lower(trim(title)) = inst)"""


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return st.match_players(articles(spark, sf).withColumn("institution", F.col("title")), players(spark, sf))


@query(f"WITH {_PLAYERS} SELECT player, id FROM pm")
def p12_match_players(spark: SparkSession, sf: str) -> DataFrame:
    """P12, J19."""
    return _matched(spark, sf)


@query(f"WITH {_PLAYERS} SELECT player, count(*) AS n, round(count(*) / (SELECT count(*) FROM pm), 4) AS share FROM pm GROUP BY player")
def a34_share_of_voice(spark: SparkSession, sf: str) -> DataFrame:
    return st.share_of_voice(_matched(spark, sf))


@query(
    f"""WITH {_PLAYERS}, m AS (SELECT pm.player, a.id, a.cluster_id, a.tags FROM pm JOIN articles a USING (id)), c AS (SELECT DISTINCT player, cluster_id FROM m),
s AS (SELECT x.player, y.player AS other, 2 * count(*) AS s FROM c x JOIN c y ON x.cluster_id = y.cluster_id AND x.player <> y.player GROUP BY ALL UNION ALL SELECT m.player, pl.player, count(*) FROM m, unnest(m.tags) AS z(t), pl, unnest(pl.ptags) AS w(t) WHERE z.t = w.t AND m.player <> pl.player GROUP BY ALL)
SELECT player, other, sum(s)::BIGINT AS overlap FROM s GROUP BY ALL"""
)
def a34_co_mentions(spark: SparkSession, sf: str) -> DataFrame:
    # the articles are worked out once: four branches read them
    a = cut(articles(spark, sf).select("id", "source_id", "cluster_id", "tags", F.col("title").alias("institution")), "co-mentions")
    return st.co_mentions(st.match_players(a, players(spark, sf)), a, players(spark, sf))


@query(
    f"WITH {_PLAYERS}, d AS (SELECT unnest(generate_series((SELECT max(day) - 29 FROM articles)::TIMESTAMP, (SELECT max(day) FROM articles)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day), n AS (SELECT player, day, count(*) AS n FROM pm JOIN articles USING (id) GROUP BY ALL) SELECT pl.player, d.day, coalesce(n, 0) AS n FROM pl CROSS JOIN d LEFT JOIN n ON n.player = pl.player AND n.day = d.day"
)
def a34_player_days(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of each player on each of the last 30 days, zero-filled."""
    a = articles(spark, sf)
    n = _matched(spark, sf).join(a.select("id", "day"), "id").groupBy("player", "day").agg(F.count("*").alias("n"))
    days = a.agg(F.max("day").alias("e")).select(F.explode(F.sequence(F.date_sub("e", 29), F.col("e"))).alias("day"))
    return players(spark, sf).select("player").crossJoin(F.broadcast(days)).join(n, ["player", "day"], "left").fillna(0)


@query(
    f"""WITH {_TAG_PAIRS}, t AS (SELECT x.t AS tag, count(*) AS n FROM articles, unnest(tags) AS x(t) GROUP BY ALL ORDER BY n DESC, tag LIMIT 10) SELECT tag_a, tag_b, count(*) AS n FROM tp WHERE tag_a IN (SELECT tag FROM t) AND tag_b IN (SELECT tag FROM t) GROUP BY ALL"""
)
def a35_cloud_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs among the tags of the cloud."""
    a = articles(spark, sf)
    top = a.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag").limit(10).select("tag")
    pairs = en.tag_pairs(a).join(top.withColumnRenamed("tag", "tag_a"), "tag_a", "left_semi").join(top.withColumnRenamed("tag", "tag_b"), "tag_b", "left_semi")
    return st.counts(pairs, "tag_a", "tag_b")


@query("SELECT o_orderpriority AS kind, count(*) AS n, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS enriched_pct, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY ALL")
def a36_public_stats(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind"))
    done = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return o.agg(F.count("*").alias("n"), F.round(done * 100 / F.count("*"), 1).alias("enriched_pct"), F.count_distinct("o_custkey").alias("keys"))


@query("SELECT day, count(*) FILTER (entity = 'view') AS n_view, count(*) FILTER (entity = 'click') AS n_click FROM daily_events GROUP BY day")
def a37_conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    return st.conditional_counts(daily_events(spark, sf), "entity", ["view", "click"])


@query("SELECT entity, min(day) AS first_seen, count(*) AS n FROM mentions GROUP BY entity ORDER BY first_seen DESC, entity LIMIT 10")
def a38_newest_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("entity").agg(F.min("day").alias("first_seen"), F.count("*").alias("n")).orderBy(F.col("first_seen").desc(), "entity").limit(10)


@query("SELECT cluster_id, min(day) AS first_day FROM articles GROUP BY cluster_id HAVING strftime(min(day), '%Y-%m') = '1996-02'")
def a39_new_in_month(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).groupBy("cluster_id").agg(F.min("day").alias("first_day")).where(F.date_format("first_day", "yyyy-MM") == "1996-02")


@query(
    """WITH h AS (SELECT user_id AS source_id, ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS items FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY day DESC) AS k, min(day) OVER (PARTITION BY source_id) AS f FROM h)
SELECT source_id, min(f) AS first_day, max(day) AS last_day FROM k WHERE k <= 3 GROUP BY source_id HAVING count(*) = 3 AND max(items) = 0 AND (SELECT max(day) FROM h) - min(f) >= 3"""
)
def a42_dead_sources(spark: SparkSession, sf: str) -> DataFrame:
    health = daily_events(spark, sf).groupBy("source_id", "day").agg(F.sum(F.when(F.col("entity") == "purchase", 1).otherwise(0)).alias("items"))
    return st.dead_sources(health)


@query("WITH n AS (SELECT day, entity, count(*) AS n FROM mentions GROUP BY ALL), a AS (SELECT day, count(*) AS a FROM articles GROUP BY day) SELECT day, entity, n, round(n / a * 100, 2) AS rate FROM n LEFT JOIN a USING (day)")
def a43_daily_rate(spark: SparkSession, sf: str) -> DataFrame:
    """A43, J5."""
    return st.daily_rate(mentions(spark, sf), articles(spark, sf))


@query("WITH n AS (SELECT day, entity, count(DISTINCT article_id) AS n FROM mentions GROUP BY ALL), t AS (SELECT day, count(DISTINCT article_id) AS t FROM mentions GROUP BY day) SELECT day, entity, round(n / t, 6) AS rate FROM n JOIN t USING (day)")
def a44_robust_rate(spark: SparkSession, sf: str) -> DataFrame:
    return st.robust_rate(mentions(spark, sf))


@query("WITH n AS (SELECT entity_type, day, source_id, count(*) AS n FROM mentions GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY entity_type, day), 6) AS share FROM n")
def a45_source_share(spark: SparkSession, sf: str) -> DataFrame:
    return st.source_share(mentions(spark, sf))


_WORDS = "string_split(text, ' ')"


@query(
    f"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM w),
n AS (SELECT term, count(*) FILTER (doc_id % 2 = 0) AS recent, count(*) FILTER (doc_id % 2 = 1) AS prior FROM g GROUP BY term) SELECT term, recent, prior, ((200 * recent + prior + 1) // (2 * (prior + 1))) / 100 AS score FROM n WHERE recent >= 3"""
)
def a47_novelty_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ")
    b = table(spark, sf, "documents").withColumn("w", words)
    return st.novelty_ngrams(b, F.col("w"), F.col("doc_id") % 2 == 0)


@query("SELECT date_trunc('month', day)::DATE AS win, round(coalesce(avg((importance >= 4)::INT), 0), 6) AS share FROM articles GROUP BY ALL")
def a48_window_share(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).groupBy(F.to_date(F.date_trunc("month", "day")).alias("win")).agg(F.round(F.coalesce(F.avg((F.col("importance") >= 4).cast("int")), F.lit(0.0)), 6).alias("share"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey) AS place FROM orders")
def a49_prediction_order(spark: SparkSession, sf: str) -> DataFrame:
    """The whole list: resolved ones first, then the newest."""
    order = [(F.col("o_orderstatus") == "F").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return global_place(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), order, "n").select("o_orderkey", (F.col("n") + 1).cast("long").alias("place"))


@query("SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(value), 4) AS cost FROM events GROUP BY ALL")
def a50_usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("cost"))


@query(
    "WITH r AS (SELECT cluster_id, importance, day, id, row_number() OVER (PARTITION BY cluster_id ORDER BY day DESC, id) AS k FROM articles WHERE category = '1-URGENT' UNION ALL SELECT cluster_id, importance, day, id, 1000 + row_number() OVER (PARTITION BY cluster_id ORDER BY day DESC, id) FROM articles WHERE category <> '1-URGENT') SELECT cluster_id, arg_min(id, k) AS id FROM r GROUP BY cluster_id"
)
def a54_theme_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling rows (urgent ones) first, then archived ones newest first; one for each slug."""
    from lodestream.operators.ranking import representative

    a = articles(spark, sf).withColumn("part", F.when(F.col("category") == "1-URGENT", 0).otherwise(1))
    return representative(a, ["cluster_id"], [F.col("part"), F.col("day").desc(), F.col("id")]).select("cluster_id", "id")


@query("SELECT cluster_id, arg_min(id, (-importance, published, id)) AS representative, arg_min(id, (published, id)) AS originator FROM articles GROUP BY cluster_id")
def a55_story_page(spark: SparkSession, sf: str) -> DataFrame:
    return st.importance_weighted_days(articles(spark, sf))


@query("SELECT day, bool_or(len(tags) > 3) AS has FROM articles GROUP BY day")
def a56_digest_tags(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).groupBy("day").agg(F.bool_or(F.size("tags") > 3).alias("has"))


@query("SELECT l_partkey AS paper, min(l_shipdate::DATE) AS first_day FROM lineitem GROUP BY l_partkey")
def a57_first_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("paper")).agg(F.min(F.to_date("l_shipdate")).alias("first_day"))


@query("SELECT user_id, count(DISTINCT value) = 1 AS all_equal, count(*) AS n FROM events GROUP BY user_id")
def a58_honesty_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg((F.count_distinct("value") == 1).alias("all_equal"), F.count("*").alias("n"))


@query("SELECT source_id, count(*) AS articles, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day FROM articles GROUP BY source_id")
def a59_source_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).groupBy("source_id").agg(F.count("*").alias("articles"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


# --- what the other rows of the inventory read ---------------------------------------------------------------------


@query(
    """WITH m AS (SELECT cluster_id, id, source_id, category, day FROM articles), c AS (SELECT cluster_id, count(*) AS members, (max(day) - min(day) + 1)::INT AS span, count(DISTINCT source_id) AS outlets, count(DISTINCT category) AS categories FROM m GROUP BY cluster_id),
g AS (SELECT cluster_id, (day - lag(day) OVER (PARTITION BY cluster_id ORDER BY day, id))::INT AS gap FROM m), k AS (SELECT cluster_id, count(*) FILTER (gap <= 7) AS near, count(*) FILTER (gap > 7 AND gap <= 30) AS mid, count(*) FILTER (gap > 30) AS far FROM g GROUP BY cluster_id)
SELECT cluster_id, members, span, outlets, categories, near, mid, far FROM c JOIN k USING (cluster_id)"""
)
def a15_merge_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Members, span, outlets and categories of each cluster, and the gaps between its members by bucket."""
    from pyspark.sql import Window

    a = articles(spark, sf)
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("cluster_id").orderBy("day", "id")))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = F.col("gap")
    return a.withColumn("gap", gap).groupBy("cluster_id").agg(
        F.count("*").alias("members"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("span"),
        F.count_distinct("source_id").alias("outlets"),
        F.count_distinct("category").alias("categories"),
        n(g <= 7).alias("near"),
        n((g > 7) & (g <= 30)).alias("mid"),
        n(g > 30).alias("far"),
    )


@query(
    """WITH d AS (SELECT DISTINCT entity, strftime(day, '%Y-%m') AS month FROM mentions), b AS (SELECT m.entity, count(DISTINCT m.cluster_id) AS breadth, count(*) AS depth FROM mentions m GROUP BY m.entity) SELECT entity, breadth, depth, round(depth / breadth, 6) AS per_cluster, (SELECT count(*) FROM d WHERE d.entity = b.entity) AS months FROM b"""
)
def a39_breadth_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters and mentions of each concept, and the months it was seen in."""
    g = mentions(spark, sf).groupBy("entity").agg(F.count_distinct("cluster_id").alias("breadth"), F.count("*").alias("depth"), F.count_distinct(F.date_format("day", "yyyy-MM")).alias("months"))
    return g.withColumn("per_cluster", F.round(F.col("depth") / F.col("breadth"), 6))


@query("SELECT o_orderstatus AS phase, o_orderpriority AS reason, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY ALL")
def a52_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """What was skipped, by phase and reason."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("phase"), F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("keys"))


@query("SELECT x.t AS tag, count(*) AS n FROM articles, unnest(tags) AS x(t) GROUP BY ALL ORDER BY n DESC, tag LIMIT 16")
def a53_top_tags(spark: SparkSession, sf: str) -> DataFrame:
    """A53, P14."""
    return articles(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag").limit(16)


@query("WITH w AS (SELECT date_trunc('week', day)::DATE AS run, count(*) AS mentions FROM mentions GROUP BY ALL), b AS (SELECT arg_min(mentions, run) AS baseline FROM w) SELECT run, mentions, baseline FROM w, b ORDER BY run DESC LIMIT 50")
def a60_run_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last 50 runs with the baseline that the first one froze."""
    w = mentions(spark, sf).groupBy(F.to_date(F.date_trunc("week", "day")).alias("run")).agg(F.count("*").alias("mentions"))
    return w.crossJoin(F.broadcast(w.agg(F.min_by("mentions", "run").alias("baseline")))).orderBy(F.col("run").desc()).limit(50)


@query(
    """WITH g AS (SELECT d.day, e.entity FROM (SELECT DISTINCT ts::DATE AS day FROM events) d CROSS JOIN (SELECT DISTINCT entity FROM daily_events) e), c AS (SELECT day, entity, count(*) FILTER (value >= 10) AS title, count(*) FILTER (value < 10) AS body FROM daily_events GROUP BY ALL),
x AS (SELECT day, count(*) AS exposure FROM daily_events GROUP BY day) SELECT g.day, g.entity, coalesce(title, 0) AS title, coalesce(body, 0) AS body, exposure FROM g LEFT JOIN c ON c.day = g.day AND c.entity = g.entity LEFT JOIN x ON x.day = g.day"""
)
def j6_exposure_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Concept x day panel with pivoted counts and exposure, zero-filled."""
    e = daily_events(spark, sf)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = e.groupBy("day", "entity").agg(n(F.col("value") >= 10).alias("title"), n(F.col("value") < 10).alias("body"))
    days = e.groupBy("day").agg(F.count("*").alias("exposure"))  # a row for each day
    return e.select("entity").distinct().crossJoin(F.broadcast(days)).join(counts, ["day", "entity"], "left").fillna(0)


@query("SELECT cluster_id, list_sort(list_distinct(flatten(list(list_concat([source_id], also_covered_by))))) AS outlets FROM articles GROUP BY cluster_id")
def u1_outlets(spark: SparkSession, sf: str) -> DataFrame:
    """The outlets of each cluster, in order."""
    rows = articles(spark, sf).select("cluster_id", F.explode(F.array_union(F.array("source_id"), "also_covered_by")).alias("o")).groupBy("cluster_id")
    return rows.agg(F.array_sort(F.collect_set("o")).alias("outlets"))


@query("WITH d AS (SELECT DISTINCT day, entity, entity_type FROM mentions), l AS (SELECT max(day) AS b, max(day) FILTER (day < (SELECT max(day) FROM d)) AS a FROM d) SELECT entity, entity_type FROM (SELECT entity, entity_type FROM d, l WHERE day = a EXCEPT SELECT entity, entity_type FROM d, l WHERE day = b)")
def u3_gone_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Seen on the last day but one, not on the last."""
    days = mentions(spark, sf).select("day", "entity", "entity_type").distinct()
    last = days.select("day").distinct().orderBy(F.col("day").desc()).limit(2).agg(F.max("day").alias("b"), F.min("day").alias("a"))
    on = lambda c: days.join(F.broadcast(last.select(F.col(c).alias("day"))), "day").select("entity", "entity_type")  # noqa: E731  a day
    return on("a").join(on("b"), ["entity", "entity_type"], "left_anti")
