"""Drivers that put operators together: panels, disambiguation, network reports, collection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators import graph as gr
from lodestream.operators import inference as inf
from lodestream.operators import vectors as vec


def velocity_stats(velocities: DataFrame) -> DataFrame:
    """Each velocity beside its entity's mean and sample deviation (none for a single day: zero)."""
    stats = velocities.groupBy("entity", "entity_type").agg(F.avg("velocity").alias("mean"), F.coalesce(F.stddev_samp("velocity"), F.lit(0.0)).alias("deviation"))
    return velocities.join(stats, ["entity", "entity_type"], "left")


def panel_findings(series: DataFrame, keys: list[str], day: str, count: str, rate: str, least_days: int = 8, reduction: float = 0.3) -> DataFrame:
    """Of each series with enough active days its level shift, number of burst days and whether it takes off, by its rates."""
    active = series.groupBy(*keys).agg(F.sum(F.when(F.col(count) > 0, 1).otherwise(0)).alias("active_days")).where(F.col("active_days") >= least_days)
    rates = series.join(active.select(*keys), keys, "left_semi")
    bursts = inf.burst_days(rates, keys, rate).groupBy(*keys).agg(F.count("*").alias("burst_days"))
    shifts = inf.level_shift(rates, keys, day, rate).select(*keys, "shift", "sse_reduction")
    out = active.join(shifts, keys, "left").join(bursts, keys, "left").fillna(0, ["burst_days"])
    return out.withColumn("takes_off", F.coalesce((F.col("shift") > 0) & (F.round("sse_reduction", 9) >= reduction), F.lit(False)))


def panel_report(series: DataFrame, key: str, day: str, count: str, rate: str, least_days: int = 8, reduction: float = 0.3) -> DataFrame:
    """M22 with the mean of each series' smoothed velocity (M8)."""
    found = panel_findings(series, [key], day, count, rate, least_days, reduction)
    smooth = inf.smooth_velocities(series.select(key, F.col(day).alias("day"), F.col(rate).alias("n")), key, "n").groupBy(key).agg(F.avg("velocity").alias("mean_velocity"))
    return found.join(smooth, key, "left")


def exemplar_pool(vectors: DataFrame, labelled: DataFrame, concept: str, id_col: str, most: int = 25) -> DataFrame:
    """The first ``most`` vectors of each concept that aren't in the label set."""
    free = vectors.join(labelled.select(id_col).distinct(), id_col, "left_anti")
    return free.withColumn("__n", F.row_number().over(Window.partitionBy(concept).orderBy(id_col))).where(F.col("__n") <= most).drop("__n")


def label_scores(vectors: DataFrame, labelled: DataFrame, concept: str, id_col: str, vector: str, most: int = 25) -> DataFrame:
    """Of each labelled row (id, concept that is claimed, truth, split) the cosine to the claimed concept's prototype."""
    protos = vec.prototypes(exemplar_pool(vectors, labelled, concept, id_col, most), concept, vector)
    rows = labelled.join(vectors.select(id_col, vector), id_col)
    return vec.prototype_scores(rows, protos, concept, vector).select(id_col, concept, "truth", "split", "score")


def disambiguation(scored: DataFrame, recall: float = 0.9) -> DataFrame:
    """One row: the threshold of the training split, its precision and recall there and on the test split, and mean scores."""
    of = lambda split: scored.where(F.col("split") == split)
    cal = inf.calibrate_threshold(of("train"), "score", "truth", recall).select(F.col("threshold").alias("tau"), F.col("precision").alias("train_precision"), F.col("recall").alias("train_recall"))
    test = of("test").crossJoin(F.broadcast(cal.select("tau")))
    said = inf.evaluate(test, F.col("score") >= F.col("tau"), F.col("truth")).select(F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"))
    apart = scored.agg(F.avg(F.when(F.col("truth"), F.col("score"))).alias("true_mean"), F.avg(F.when(~F.col("truth"), F.col("score"))).alias("false_mean"))
    return cal.crossJoin(said).crossJoin(apart)


def largest_fraction(communities: DataFrame, key: str) -> DataFrame:
    """Of each snapshot the share of its nodes that are in the largest community, and the number of communities."""
    sizes = communities.groupBy(key, "community").agg(F.count("*").alias("n"))
    return sizes.groupBy(key).agg((F.max("n") / F.sum("n")).alias("largest_fraction"), F.count("*").alias("communities"))


def fixed_density_modularity(edges: DataFrame, key: str, k: int) -> DataFrame:
    """Q of greedy communities on the ``k`` heaviest edges of each snapshot; snapshots of fewer than three edges have none."""
    top = gr.top_edges(edges, k, [key])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        g = gr.adjacency(f)
        rows = [(f[key].iloc[0], gr.graph_modularity(g, gr.greedy_modularity(g)))] if k >= 3 and len(f) >= 3 else []
        return pd.DataFrame(rows, columns=[key, "fixed_q"])

    return top.groupBy(key).applyInPandas(run, f"{key} {dict(edges.dtypes)[key]}, fixed_q double")


def network_snapshots(edges: DataFrame, key: str, n: int = 200) -> DataFrame:
    """Of each snapshot nodes, edges, communities, largest fraction, q, z, p, and q at the density of the sparsest one."""
    sizes = edges.groupBy(key).agg(F.count("*").alias("edges"))
    nodes = edges.select(key, F.explode(F.array("a", "b")).alias("node")).groupBy(key).agg(F.count_distinct("node").alias("nodes"))
    tested = gr.significance(edges, key, n)
    least = sizes.join(tested.select(key), key, "left_semi").agg(F.min("edges").alias("k")).first()["k"] or 0  # one number
    found = largest_fraction(gr.communities(edges, key), key)
    return nodes.join(sizes, key).join(found, key).join(tested, key, "left").join(fixed_density_modularity(edges, key, least), key, "left")


def network_trends(snapshots: DataFrame, key: str) -> DataFrame:
    """Spearman's trend over snapshots of raw modularity, z, modularity at fixed density and number of communities."""
    metrics = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("q", "z", "fixed_q", "communities")]))
    rows = snapshots.where("q IS NOT NULL").select(key, metrics.alias("m")).select(key, "m.*").where("value IS NOT NULL")
    return inf.spearman(rows, ["metric"], key, "value")


def life_totals(communities: DataFrame, key: str) -> DataFrame:
    """Births, deaths, splits and merges over all pairs of snapshots that follow one another by ``key``."""
    place = communities.select(key).distinct()
    place = place.withColumn("__k", F.dense_rank().over(Window.orderBy(key)))  # a row for each snapshot
    c = communities.join(F.broadcast(place), key).withColumn("community", F.col("community").cast("string"))
    name = lambda k: F.concat_ws("/", k.cast("string"), F.col("community"))
    last = place.agg(F.max("__k").alias("__last"))
    before = c.crossJoin(F.broadcast(last)).where("__k < __last").select(F.concat_ws("/", F.col("__k").cast("string"), "node").alias("node"), name(F.col("__k")).alias("community"))
    after = c.where("__k > 1").select(F.concat_ws("/", (F.col("__k") - 1).cast("string"), "node").alias("node"), name(F.col("__k") - 1).alias("community"))
    return gr.life_events(before, after).groupBy("event").agg(F.count("*").alias("n"))


def window_share(papers: DataFrame, windows: DataFrame, reannounced: Column) -> DataFrame:
    """Of each window (win, lo, hi) the share of its papers (day) that are announced again; 0 for none."""
    # an equality join on days: a window lists its days, some hundred
    days = windows.select("win", F.explode(F.sequence("lo", "hi")).alias("day"))
    seen = papers.join(days, "day").groupBy("win").agg(F.avg(reannounced.cast("double")).alias("share"))
    return windows.select("win").join(seen, "win", "left").select("win", F.coalesce("share", F.lit(0.0)).alias("share"))


def panel_trends(pairs: DataFrame, windows: DataFrame, excluded: dict[str, Column], n: int = 200) -> DataFrame:
    """The trend of modularity's z over windows on several panels, each of the pairs that a condition keeps."""
    out = None
    for name, keep in excluded.items():
        edges = gr.windowed_edges(pairs.where(keep).select("day", "a", "b"), windows)
        tested = gr.significance(edges, "win", n).withColumn("panel", F.lit(name))
        rows = inf.spearman(tested, ["panel"], "win", "z")
        out = rows if out is None else out.unionByName(rows)
    return out


def collect_papers(primary: DataFrame, persisted: DataFrame, persisted_days: DataFrame, raw: DataFrame) -> DataFrame:
    """(paper, day, kind) rows: primary ones, and references from a day's persisted list where the day has one, even an empty one, else from its raw items."""
    fallback = raw.join(persisted_days.select("day").distinct(), "day", "left_anti")
    refs = persisted.select("paper", "day").unionByName(fallback.select("paper", "day")).distinct()
    own = primary.select("paper", "day").distinct()
    return own.withColumn("kind", F.lit("primary")).unionByName(refs.join(own, ["paper", "day"], "left_anti").withColumn("kind", F.lit("reference")))


def days_to_collect(days: DataFrame, explicit: str | None = None, backfill: bool = False) -> DataFrame:
    """All days, a stated one if there is such a day, or the newest."""
    if backfill:
        return days.select("day").distinct()
    if explicit:
        return days.where(F.col("day") == F.lit(explicit).cast("date")).select("day").distinct()
    return days.agg(F.max("day").alias("day")).where("day IS NOT NULL")


def reference_status(days: DataFrame, lists: DataFrame) -> DataFrame:
    """Of each day how many references its list has, and whether there is one: an empty list isn't an absent one; a null list is a broken one and counts as absent."""
    fine = lists.where("refs IS NOT NULL").select("day", F.size("refs").alias("n"))
    return days.select("day").distinct().join(fine, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("refs"), F.when(F.col("n").isNull(), "absent").when(F.col("n") == 0, "empty").otherwise("listed").alias("state"))
