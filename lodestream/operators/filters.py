"""Predicates, validators and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(items: DataFrame, day: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): what was published before ``day`` minus ``days`` goes; an unknown date stays. The dropped rows say why."""
    keep = F.col("published").isNull() | (F.to_date("published") >= F.date_sub(day, days))
    return items.where(keep), items.where(~keep).withColumn("phase", F.lit("dedupe")).withColumn("reason", F.lit("stale"))


def unseen(items: DataFrame, seen: DataFrame, key: str, order: list[Column], cap: int) -> DataFrame:
    """Rows whose key was not seen, the first ``cap`` of them."""
    return items.join(seen.select(key).distinct(), key, "left_anti").orderBy(*order).limit(cap)


def valid_results(results: DataFrame, categories: list[str], vocabulary: list[str]) -> DataFrame:
    """Results that keep the schema, their tags cleaned: in the vocabulary, first occurrences, five at most.

    2 or 3 insights, a known category, a score from 1 to 5; a subtitle loses its final stop and is cut to 200
    characters; institution and authors only in the research category, and never the word null.
    """
    ok = F.col("summary").isNotNull() & (F.trim("summary") != "") & F.size("insights").between(2, 3) & F.col("category").isin(*categories) & F.col("importance").between(1, 5)
    tags = F.slice(F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isin(*vocabulary))), 1, 5)
    subtitle = F.nullif(F.substring(F.regexp_replace(F.trim("subtitle"), r"[.。]+$", ""), 1, 200), F.lit(""))
    only = lambda c: F.when((F.col("category") == categories[0]) & ~F.lower(F.trim(c)).isin("null", ""), F.trim(c))
    return results.where(F.coalesce(ok, F.lit(False))).withColumn("tags", tags).withColumn("subtitle", subtitle).withColumn("institution", only("institution")).withColumn("authors", only("authors"))


def map_indices(picks: Column, ids: Column) -> Column:
    """Numbers from one become ids; out of range ones and repeats go."""
    n = F.size(ids)
    return F.transform(F.array_distinct(F.filter(picks, lambda i: (i >= 1) & (i <= n))), lambda i: F.element_at(ids, i.cast("int")))


def relevant(tags: Column, title: Column, names: list[str]) -> Column:
    """A tag is a name, or the title holds one."""
    in_title = F.lit(False)
    for n in names:
        in_title = in_title | F.contains(F.lower(title), F.lit(n.lower()))
    return F.arrays_overlap(tags, F.array(*map(F.lit, names))) | in_title


def vocabulary_gaps(articles: DataFrame, hints: list[str], names: list[str], known: DataFrame) -> DataFrame:
    """Titles with a hint and no name among the tags, once for each (day, id, hint); of several hints the least one."""
    found = F.array_min(F.filter(F.array(*map(F.lit, sorted(hints))), lambda h: F.contains(F.lower("title"), F.lower(h))))
    rows = articles.where(~F.arrays_overlap("tags", F.array(*map(F.lit, names)))).withColumn("hint", found).where("hint IS NOT NULL").select("day", "id", "hint").distinct()
    return rows.join(known, ["day", "id", "hint"], "left_anti")


def needs_resolution(status: Column, made: Column, horizon: Column, today: Column, days: int = 60) -> Column:
    """Pending, and old or past its horizon's month."""
    return (status == "pending") & ((F.datediff(today, made) >= days) | (horizon < F.date_format(today, "yyyy-MM")))


def story_eligible(members: Column, day_span: Column, largest: Column, least: int) -> Column:
    """P13."""
    return (members >= least) | (day_span >= 2) | (largest > 1)


def week_overlaps(monday: Column, first: Column, last: Column) -> Column:
    """The ISO week that starts on ``monday`` touches the days first to last."""
    return ~((F.date_add(monday, 6) < first) | (monday > last))


def reannounced(era: Column, published: Column, lead: int) -> Column:
    """The YYMM month of an id lies more than ``lead`` days before the publication."""
    month = F.make_date(2000 + F.substring(era, 1, 2).cast("int"), F.substring(era, 3, 2).cast("int"), F.lit(1))
    return F.datediff(published, month) > lead


def repeat_failures(steps: DataFrame, threshold: int) -> DataFrame:
    """Steps that failed in ``threshold`` runs or more, most first."""
    n = steps.where("failed").groupBy("step").agg(F.count_distinct("run").alias("runs"))
    return n.where(F.col("runs") >= threshold).orderBy(F.col("runs").desc(), "step")


def anomalies(clusters: DataFrame, span: int = 30, far: int = 5) -> DataFrame:
    """Clusters of mixed categories over a long span, or with many far merges at a small distance."""
    rules = F.array_compact(F.array(F.when((F.col("categories") > 1) & (F.col("day_span") >= span), "mixed_long"), F.when(F.col("far_close") >= far, "far_merges")))
    return clusters.withColumn("anomaly", F.array_join(rules, ",")).where("anomaly <> ''")


def accept_body(body: Column, summary: Column, least: int = 300, marker: str = "[summary] ") -> tuple[Column, Column]:
    """P20: (text, state): a short body gives way to the feed's summary with a marker; without either it is skipped, a short one alone stays."""
    n = F.length(F.coalesce(body, F.lit("")))
    has = F.coalesce(F.trim(summary), F.lit("")) != ""
    text = F.when(n >= least, body).when(has, F.concat(F.lit(marker), summary)).when(n > 0, body)
    state = F.when(n >= least, "body").when(has, "rss_fallback").when(n > 0, "body").otherwise("body_too_short")
    return text, state


def recent_once(articles: DataFrame, days: int, newest: bool) -> DataFrame:
    """Articles of the last days, one for each id: its newest or its oldest copy."""
    end = articles.agg(F.max("day").alias("__end"))
    order = F.col("day").desc() if newest else F.col("day").asc()
    rows = articles.crossJoin(F.broadcast(end)).where(F.datediff("__end", "day") < days)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("__n = 1").drop("__n", "__end")
