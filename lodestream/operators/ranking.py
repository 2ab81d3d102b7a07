"""Ranking, search and related items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestream.operators.joins import global_place


def rank_score(importance: Column, published: Column, cluster_size: Column, as_of: Column) -> Column:
    """0.6 importance / 5 + 0.3 freshness over 48 hours + 0.1 size / 5; missing: 3, 48 hours, 1; the future is fresh."""
    hours = F.coalesce(F.greatest((F.unix_timestamp(as_of) - F.unix_timestamp(published)) / 3600, F.lit(0.0)), F.lit(48.0))
    fresh = F.greatest(1 - hours / 48, F.lit(0.0))
    return F.coalesce(importance, F.lit(3)) / 5 * 0.6 + fresh * 0.3 + F.least(F.coalesce(cluster_size, F.lit(1)) / 5, F.lit(1.0)) * 0.1


def hotness(importance: Column, cluster_size: Column, published: Column, as_of: Column) -> Column:
    """T3."""
    days = F.greatest((F.unix_timestamp(as_of) - F.unix_timestamp(published)) / 86400, F.lit(0.0))
    return importance / 5 * 0.6 + F.log2(F.greatest(cluster_size, F.lit(1)) + 1) / 4 * 0.15 + F.greatest(1 - days / 7, F.lit(0.0)) * 0.25


def greedy_top(df: DataFrame, order: list[Column], keys: list[str], k: int = 5) -> DataFrame:
    """Rows in order, each taken unless one that was taken shares a key with it; empty keys are never shared.

    A row that is blocked by a row that was dropped must not be blocked, so no window decides this. Each of the k
    rounds takes the first row that is left, which every task reduces to one, and filters by its keys.
    """
    left, taken = df, []
    while len(taken) < k and (rows := left.orderBy(*order).limit(1).collect()):
        taken.append(rows[0])
        for c in keys:
            value = rows[0][c]
            if value is not None and value != "":
                left = left.where(F.col(c).isNull() | (F.col(c) != F.lit(value)))
        if all(rows[0][c] in (None, "") for c in keys):
            raise ValueError("a row without any key can't be told from itself")
    schema = StructType([*df.schema.fields, StructField("rank", IntegerType())])
    return df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(taken, 1)], schema)


def representative(members: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """T4: the first member of each group in an order that ends with a tie-break."""
    return members.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def evidence(candidates: DataFrame, keywords: Column, hay: Column, newest: list[Column], k: int) -> DataFrame:
    """The k candidates with most keyword hits minus 0.001 of their place; without any hit the k newest."""
    rows = global_place(candidates, newest, "__i").withColumn("__h", F.size(F.filter(keywords, lambda w: F.contains(hay, w))))
    any_hit = rows.agg(F.max("__h").alias("__any"))
    rows = rows.crossJoin(F.broadcast(any_hit)).where((F.col("__h") > 0) | (F.col("__any") == 0))
    scored = rows.withColumn("score", F.when(F.col("__any") > 0, F.col("__h") - F.col("__i") * 0.001).otherwise(-F.col("__i") * 0.001))
    return scored.orderBy(F.col("score").desc(), "__i").limit(k).drop("__i", "__h", "__any")


def capped_with_seeds(df: DataFrame, seed: Column, newest: list[Column], cap: int = 50) -> DataFrame:
    """All seeds, then the newest others, ``cap`` in all."""
    return df.orderBy(F.when(seed, 0).otherwise(1), *newest).limit(cap)


def search(articles: DataFrame, terms: list[str], k: int = 200) -> DataFrame:
    """Articles that hold all terms; a term weighs 6 in the title, 3 in the summary, 3 in a tag, 1 in the source."""
    fields = [(F.lower("title"), 6), (F.lower("summary"), 3), (F.lower(F.array_join("tags", " ")), 3), (F.lower("source_id"), 1)]
    per_term = [sum((F.when(F.contains(f, F.lit(t.lower())), w).otherwise(0) for f, w in fields), F.lit(0)) for t in terms]
    hit = F.lit(True)
    for s in per_term:
        hit = hit & (s > 0)
    return articles.where(hit).withColumn("score", sum(per_term, F.lit(0))).orderBy(F.col("score").desc(), F.col("published").desc(), "id").limit(k)


def with_neighbours(hits: DataFrame, neighbours: DataFrame, first: int = 30) -> DataFrame:
    """Ids that are neighbours of the first hits and no hits themselves, with their best score."""
    near = hits.orderBy(F.col("score").desc(), "id").limit(first).select("id").join(neighbours, "id").groupBy("neighbour").agg(F.max("similarity").alias("similarity"))
    return near.join(hits.select(F.col("id").alias("neighbour")), "neighbour", "left_anti")


def containing(articles: DataFrame, keyword: str, days: int) -> DataFrame:
    """P10: articles of the last ``days`` days whose title, summary or tags hold a keyword, whatever its case."""
    end = articles.agg(F.max("day").alias("__end"))
    text = F.lower(F.concat_ws("\n", "title", "summary", F.array_join("tags", "\n")))
    return articles.crossJoin(F.broadcast(end)).where((F.datediff("__end", "day") < days) & F.contains(text, F.lit(keyword.lower()))).drop("__end")


def related_by_tags(clusters: DataFrame, k: int = 6, horizon: int = 14) -> DataFrame:
    """Clusters that share a tag: Jaccard of their tags x (0.6 + 0.4 max(0, 1 - days apart / 14)), the k best."""
    tags = clusters.select("cluster_id", F.col("tags"), "last_day", F.explode(F.array_distinct("tags")).alias("tag"))
    other = tags.select(F.col("cluster_id").alias("other"), F.col("last_day").alias("other_day"), F.size("tags").alias("other_n"), "tag")
    shared = tags.join(other, "tag").where("cluster_id <> other")
    common = shared.groupBy("cluster_id", "other").agg(F.count("*").alias("c"), F.first(F.size("tags")).alias("n"), F.first("other_n").alias("m"), F.first("last_day").alias("d"), F.first("other_day").alias("e"))
    jaccard = F.col("c") / (F.col("n") + F.col("m") - F.col("c"))
    near = F.greatest(1 - F.abs(F.datediff("d", "e")) / horizon, F.lit(0.0))
    scored = common.withColumn("score", jaccard * (0.6 + 0.4 * near))
    # ties by nine digits: equal scores can differ in their last bits
    best = Window.partitionBy("cluster_id").orderBy(F.round("score", 9).desc(), "other")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("cluster_id", "other", "score", "rank")
