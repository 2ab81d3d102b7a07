"""Corpus statistics, cluster summaries, matrices and player shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import half_up_1


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def category_pivot(df: DataFrame, categories: list[str]) -> DataFrame:
    """A4: a column for each category, missing ones zero."""
    return df.groupBy("day").pivot("category", categories).agg(F.count(F.lit(1))).fillna(0)


def cluster_rollup(articles: DataFrame) -> DataFrame:
    """Of each cluster: best article, outlets, six top tags, main category, first and last day, days and score."""
    outlets = articles.select("cluster_id", F.explode(F.array_union(F.array("source_id"), "also_covered_by")).alias("o")).groupBy("cluster_id").agg(F.count_distinct("o").alias("outlets"))
    base = articles.groupBy("cluster_id").agg(
        F.min(F.struct((-F.col("importance")).alias("i"), "published", "id")).alias("r"),
        F.count("*").alias("articles"),
        F.count_distinct("day").alias("days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.max("importance").alias("max_importance"),
    )
    top = top_values(articles.select("cluster_id", F.explode("tags").alias("tag")), ["cluster_id"], "tag", 6, "top_tags")
    main = top_values(articles.select("cluster_id", "category"), ["cluster_id"], "category", 1, "c").select("cluster_id", F.col("c")[0].alias("category"))
    all_ = base.join(outlets, "cluster_id").join(main, "cluster_id").join(top, "cluster_id", "left")
    score = F.col("max_importance") + 0.6 * (F.col("outlets") - 1) + 0.8 * (F.col("days") - 1)
    span = F.greatest(F.datediff("last_day", "first_day") + 1, F.lit(1))
    return all_.select("cluster_id", F.col("r.id").alias("rep_id"), "articles", "days", "first_day", "last_day", span.alias("day_span"), "outlets", "category", "top_tags", F.round(score, 6).alias("score"))


def top_values(df: DataFrame, keys: list[str], value: str, k: int, out: str) -> DataFrame:
    """The k most frequent values of each group as an array, ties by value."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = n.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), value))).where(F.col("k") <= k)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda x: x[value]).alias(out))


def banded(value: Column, edges: list[int], unit: str = "") -> Column:
    """Closed bands 1, 2~3, ... from ascending upper edges; what lies beyond gets a plus."""
    out, low = None, None
    for edge in edges:
        label = f"{edge}" if low is not None and low == edge or low is None and edge in (0, 1) else f"{low if low is not None else 0}~{edge}"
        out = F.when(value <= edge, label) if out is None else out.when(value <= edge, label)
        low = edge + 1
    return out.otherwise(f"{low}+")


def corpus_totals(articles: DataFrame) -> DataFrame:
    """One row: distinct ids, rows, days, sources, categories, clusters, share of clusters with two sources or more (1 digit), average size, span."""
    per = articles.groupBy("cluster_id").agg(F.count_distinct("source_id").alias("s"), F.count("*").alias("n"))
    c = per.agg(F.count("*").alias("clusters"), half_up_1(F.avg((F.col("s") >= 2).cast("int")) * 100).alias("multi_source_pct"), F.round(F.avg("n"), 6).alias("avg_size"))
    t = articles.agg(
        F.count_distinct("id").alias("ids"),
        F.count("*").alias("rows"),
        F.count_distinct("day").alias("days"),
        F.count_distinct("source_id").alias("sources"),
        F.count_distinct("category").alias("categories"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"),
    )
    return t.crossJoin(c)  # one row each


def importance_histogram(articles: DataFrame) -> DataFrame:
    """Importance 1 to 5, and ``missing``."""
    return articles.groupBy(F.coalesce(F.col("importance").cast("string"), F.lit("missing")).alias("importance")).agg(F.count("*").alias("n"))


def weekday_averages(articles: DataFrame) -> DataFrame:
    """Articles of an average day by weekday (0 Monday), half up to one digit."""
    per_day = articles.groupBy("day").agg(F.count("*").alias("n"))
    return per_day.groupBy(F.weekday("day").alias("weekday")).agg(half_up_1(F.avg("n")).alias("average"))


def coverage_matrix(articles: DataFrame, clusters: int = 12, outlets: int = 15) -> DataFrame:
    """Articles of each outlet on each cluster, for the clusters of best size x importance and the outlets with most articles."""
    score = articles.groupBy("cluster_id").agg((F.max("cluster_size") * F.max("importance")).alias("score")).orderBy(F.col("score").desc(), "cluster_id").limit(clusters)
    inside = articles.join(score, "cluster_id")
    top = inside.groupBy("source_id").agg(F.count("*").alias("t")).orderBy(F.col("t").desc(), "source_id").limit(outlets)
    return inside.join(top, "source_id", "left_semi").groupBy("cluster_id", "source_id", "score").agg(F.count("*").alias("n"))


def outlet_mix(articles: DataFrame, week: Column, least: int = 3) -> DataFrame:
    """Articles of each outlet, week and category, for outlets with ``least`` in that week."""
    cells = articles.groupBy(week.alias("week"), "source_id", "category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("week", "source_id"))
    return cells.withColumn("total", total).where(F.col("total") >= least)


def match_players(articles: DataFrame, players: DataFrame) -> DataFrame:
    """(player, article) by source, by tag or by institution: three equi-joins and a distinct, no nested loop."""
    by = [
        articles.join(players.select("player", F.explode("sources").alias("source_id")), "source_id").select("player", "id"),
        articles.select("id", F.explode("tags").alias("tag")).join(players.select("player", F.explode("tags").alias("tag")), "tag").select("player", "id"),
        articles.select("id", F.lower(F.trim("institution")).alias("i")).join(players.select("player", F.explode(F.transform("institutions", lambda x: F.lower(F.trim(x)))).alias("i")), "i").select("player", "id"),
    ]
    return by[0].unionByName(by[1]).unionByName(by[2]).distinct()


def share_of_voice(matched: DataFrame) -> DataFrame:
    """Each player's articles and their share of all matches (4 digits)."""
    n = matched.groupBy("player").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("player", "n", F.round(F.col("n") / F.col("t"), 4).alias("share"))


def co_mentions(matched: DataFrame, articles: DataFrame, players: DataFrame) -> DataFrame:
    """For two players 2 for each shared cluster, and 1 for each article of one that has a tag of the other."""
    m = matched.join(articles.select("id", "cluster_id", "tags"), "id")
    c = m.select("player", "cluster_id").distinct()
    shared = c.join(c.select(F.col("player").alias("other"), "cluster_id"), "cluster_id").where("player <> other").groupBy("player", "other").agg((F.count("*") * 2).alias("s"))
    tagged = m.select("player", "id", F.explode("tags").alias("tag")).join(players.select(F.col("player").alias("other"), F.explode("tags").alias("tag")), "tag").where("player <> other")
    tagged = tagged.groupBy("player", "other").agg(F.count("*").alias("s"))
    return shared.unionByName(tagged).groupBy("player", "other").agg(F.sum("s").alias("overlap"))


def dead_sources(health: DataFrame, last: int = 3, age: int = 3) -> DataFrame:
    """Sources whose last rows are all zero and whose first row is ``age`` days old or more."""
    w = Window.partitionBy("source_id").orderBy(F.col("day").desc())
    end = health.agg(F.max("day").alias("__end"))
    rows = health.withColumn("__n", F.row_number().over(w)).withColumn("__first", F.min("day").over(Window.partitionBy("source_id"))).where(F.col("__n") <= last)
    s = rows.groupBy("source_id").agg(F.count("*").alias("n"), F.max("items").alias("most"), F.first("__first").alias("first_day"), F.max("day").alias("last_day"))
    return s.crossJoin(F.broadcast(end)).where((F.col("n") == last) & (F.col("most") == 0) & (F.datediff("__end", "first_day") >= age)).select("source_id", "first_day", "last_day")


def daily_rate(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Mentions of an entity for each hundred articles of the day, 2 digits."""
    n = rows.groupBy("day", "entity").agg(F.count("*").alias("n"))
    per = articles.groupBy("day").agg(F.count("*").alias("articles"))
    return n.join(per, "day", "left").select("day", "entity", "n", F.round(F.col("n") / F.col("articles") * 100, 2).alias("rate"))


def robust_rate(rows: DataFrame) -> DataFrame:
    """Distinct articles of an entity's day over distinct articles of the day."""
    n = rows.groupBy("day", "entity").agg(F.count_distinct("article_id").alias("n"))
    per = rows.groupBy("day").agg(F.count_distinct("article_id").alias("total"))
    return n.join(per, "day").select("day", "entity", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


def source_share(rows: DataFrame) -> DataFrame:
    """Each source's share of a type's mentions on a day."""
    n = rows.groupBy("entity_type", "day", "source_id").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("entity_type", "day")), 6))


def conditional_counts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows of each day by value."""
    return rows.groupBy("day").agg(*[F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(f"n_{v}") for v in values])


def novelty_ngrams(texts: DataFrame, words: Column, recent: Column, most: int = 3, least: int = 3) -> DataFrame:
    """Distinct 1- to ``most``-grams of each text; those in ``least`` recent texts, score recent / (prior + 1), 2 digits, rounded by whole numbers."""
    def grams(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, each).otherwise(F.array().cast("array<string>"))

    rows = texts.select(recent.alias("recent"), F.explode(F.array_distinct(F.concat(*[grams(n) for n in range(1, most + 1)]))).alias("term"))
    n = rows.groupBy("term").agg(F.sum(F.when(F.col("recent"), 1).otherwise(0)).alias("recent"), F.sum(F.when(F.col("recent"), 0).otherwise(1)).alias("prior"))
    return n.where(F.col("recent") >= least).withColumn("score", F.expr("(200 * recent + prior + 1) div (2 * (prior + 1))") / 100)


def importance_weighted_days(articles: DataFrame) -> DataFrame:
    """Of each cluster the representative (importance down, published up) and the originator (earliest)."""
    return articles.groupBy("cluster_id").agg(
        F.min(F.struct((-F.col("importance")).alias("i"), "published", "id")).alias("r"), F.min(F.struct("published", "id")).alias("o")
    ).select("cluster_id", F.col("r.id").alias("representative"), F.col("o.id").alias("originator"))
