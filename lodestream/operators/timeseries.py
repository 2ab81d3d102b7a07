"""Gap-filled series and what is computed along them: velocity, acceleration, bursts, rollups, streaks, spans.

Series are long frames (day, entity, entity_type, count) over an explicit calendar. Windows are partitioned by entity,
so a series must fit a task, days of one entity at most; no operator pivots or collects.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import iso_week, ordinal_week

KEYS = ("entity", "entity_type")


def daily_counts(mentions: DataFrame) -> DataFrame:
    """Count of each entity and day, zero-filled over the whole calendar between the corpus' first and last day."""
    seen = mentions.groupBy("day", *KEYS).agg(F.count("*").alias("count"))
    span = seen.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = seen.select(*KEYS).distinct().crossJoin(F.broadcast(days))  # a calendar has some thousand days
    return grid.join(seen, ["day", *KEYS], "left").fillna(0, ["count"])


def _by(order: str = "day") -> Window:
    return Window.partitionBy(*KEYS).orderBy(order)


def velocity(counts: DataFrame) -> DataFrame:
    """Count minus the day's before; the first day keeps its count."""
    return counts.withColumn("velocity", (F.col("count") - F.coalesce(F.lag("count").over(_by()), F.lit(0))).cast("double"))


def acceleration(velocities: DataFrame) -> DataFrame:
    """Velocity minus the day's before; the first day is zero."""
    return velocities.withColumn("acceleration", F.coalesce(F.col("velocity") - F.lag("velocity").over(_by()), F.lit(0.0)))


def ema(df: DataFrame, value: str, span: int, out: str) -> DataFrame:
    """e0 = x0, e = a x + (1 - a) e with a = 2 / (span + 1), a grouped map over each entity's series."""

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("day")
        return f.assign(**{out: f[value].astype(float).ewm(span=span, adjust=False).mean()})

    return df.groupBy(*KEYS).applyInPandas(fold, df.withColumn(out, F.lit(0.0)).schema)


def burst_scores(velocities: DataFrame) -> DataFrame:
    """(velocity - mean) / max(sample deviation, 1), to nine digits.

    The deviation comes from the sums of velocities and of their squares, which are exact for whole numbers, so the
    score doesn't depend on the order in which rows or partial sums meet; nine digits keep a comparison with a
    threshold from turning on a last bit.
    """
    w = Window.partitionBy(*KEYS)
    n, total, squares = F.count("velocity").over(w), F.sum("velocity").over(w), F.sum(F.col("velocity") * F.col("velocity")).over(w)
    spread = F.when(n > 1, F.sqrt(F.greatest((n * squares - total * total) / (n * (n - 1)), F.lit(0.0)))).otherwise(F.lit(0.0))
    return velocities.withColumn("burst", F.round((F.col("velocity") - total / n) / F.greatest(spread, F.lit(1.0)), 9))


def top_movers(scored: DataFrame, day: Column, k: int, by: str = "velocity", down: bool = False) -> DataFrame:
    """The k largest (or smallest) on a day, ties by entity."""
    order = F.col(by).asc() if down else F.col(by).desc()
    return scored.where(F.col("day") == day).orderBy(order, *KEYS).limit(k)


def rollup(counts: DataFrame, period: Column) -> DataFrame:
    """Sums of a period with their velocity, the first period's being its sum."""
    sums = counts.groupBy(period.alias("period"), *KEYS).agg(F.sum("count").alias("count"))
    return sums.withColumn("velocity", F.col("count") - F.coalesce(F.lag("count").over(_by("period")), F.lit(0)))


def weekly(counts: DataFrame) -> DataFrame:
    return rollup(counts, iso_week(F.col("day")))


def monthly(counts: DataFrame) -> DataFrame:
    return rollup(counts, F.date_format("day", "yyyy-MM"))


def observed_series(mentions: DataFrame, bucket: Column, k: int = 15) -> DataFrame:
    """Sums by bucket, zero-filled over the buckets that occur, with total and first peak; the k largest entities."""
    seen = mentions.groupBy(bucket.alias("bucket"), "entity").agg(F.count("*").alias("count"))
    top = seen.groupBy("entity").agg(F.sum("count").alias("total")).orderBy(F.col("total").desc(), "entity").limit(k)
    grid = top.crossJoin(seen.select("bucket").distinct())
    full = grid.join(seen, ["bucket", "entity"], "left").fillna(0, ["count"])
    first = F.max_by("bucket", F.struct("count", _negated_order("bucket"))).over(Window.partitionBy("entity"))
    return full.withColumn("peak", first)


def _negated_order(c: str) -> Column:
    """Orders strings of equal length backwards: translated to their complements."""
    return F.translate(c, "0123456789W-", "9876543210A~")


def latest(df: DataFrame, keys: list[str], order: str = "day") -> DataFrame:
    """The last row of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")


def snapshot_delta(old: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """Full outer join of two snapshots' values, missing ones zero, with state new, gone or kept."""
    a = old.select(*KEYS, F.col(value).alias("before"))
    b = new.select(*KEYS, F.col(value).alias("after"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").otherwise("kept")
    both = a.join(b, list(KEYS), "full_outer").withColumn("state", state).fillna(0, ["before", "after"])
    return both.withColumn("swing", F.col("after") - F.col("before"))


def recent_vs_prior(df: DataFrame, keys: list[str], days: int = 7, anchor: Column | None = None) -> DataFrame:
    """Rows in (anchor - days, anchor] against those in the days before, anchored at the corpus' last day."""
    end = df.agg(F.max("day").alias("__end")) if anchor is None else None
    rows = df.crossJoin(F.broadcast(end)) if end is not None else df.withColumn("__end", anchor)
    ago = F.datediff("__end", "day")
    sums = rows.groupBy(*keys).agg(
        F.sum(F.when((ago >= 0) & (ago < days), 1).otherwise(0)).alias("recent"), F.sum(F.when((ago >= days) & (ago < 2 * days), 1).otherwise(0)).alias("prior")
    )
    return sums.withColumn("delta", F.col("recent") - F.col("prior"))


def spans(days: DataFrame, keys: list[str], gap: int = 7) -> DataFrame:
    """Runs of active days with gaps of ``gap`` days at most: start, end, days and mentions of each."""
    d = days.groupBy(*keys, "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("day")
    new = F.when(F.datediff("day", F.lag("day").over(w)) > gap, 1).otherwise(0)
    runs = d.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "run").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("active_days"), F.sum("n").alias("mentions"))


def span_text(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``a..b`` of all spans of a key, joined by ``;``."""
    one = F.concat_ws("..", F.col("start").cast("string"), F.col("end").cast("string"))
    return runs.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("spans"), F.count("*").alias("n_spans"))


def revivals(rows: DataFrame, keys: list[str], source: str, gap: int = 21) -> DataFrame:
    """Days that end a silence of ``gap`` days or more, with the source types seen then, joined by ``+``."""
    d = rows.groupBy(*keys, "day").agg(F.array_join(F.array_sort(F.collect_set(source)), "+").alias("sources"))
    silence = F.datediff("day", F.lag("day").over(Window.partitionBy(*keys).orderBy("day")))
    return d.withColumn("gap_days", silence).where(F.col("gap_days") >= gap)


def new_partners(pairs: DataFrame) -> DataFrame:
    """Of (month, concept, partner) rows, how many partners are new in a month and how many rows repeat earlier ones."""
    first = F.min("month").over(Window.partitionBy("concept", "partner"))
    rows = pairs.withColumn("first", first)
    new = F.count_distinct(F.when(F.col("month") == F.col("first"), F.col("partner")))
    again = F.sum(F.when(F.col("month") > F.col("first"), 1).otherwise(0))
    return rows.groupBy("concept", "month").agg(new.alias("new_partners"), again.alias("repeat_hits"))


def weekly_density(rows: DataFrame) -> DataFrame:
    """By ordinal week, gap-filled: mentions, articles with two concepts or more, active concepts."""
    w = rows.withColumn("week", ordinal_week(F.col("day")))
    per_article = w.groupBy("week", "article_id").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("k"))
    sums = per_article.groupBy("week").agg(F.sum("n").alias("mentions"), F.sum(F.when(F.col("k") >= 2, 1).otherwise(0)).alias("multi_articles"))
    active = w.groupBy("week").agg(F.count_distinct("entity").alias("active"))
    weeks = w.agg(F.min("week").alias("a"), F.max("week").alias("b")).select(F.explode(F.sequence("a", "b")).alias("week"))
    return weeks.join(sums, "week", "left").join(active, "week", "left").fillna(0)


def recent_median(weeks: DataFrame, value: str, n: int = 8) -> DataFrame:
    """The median of the last n weeks that aren't zero, cut to a whole number."""
    return weeks.where(F.col(value) > 0).orderBy(F.col("week").desc()).limit(n).agg(F.median(value).cast("int").alias("median"))


def dense_streak(weeks: DataFrame, value: str, floor: int, need: int = 4) -> DataFrame:
    """How many weeks at the end are dense in a row, and GREEN if they are ``need`` or more."""
    thin = weeks.agg(F.max(F.when(F.col(value) < floor, F.col("week"))).alias("__t"))
    n = F.sum(F.when(F.col("__t").isNull() | (F.col("week") > F.col("__t")), 1).otherwise(0))
    return weeks.crossJoin(F.broadcast(thin)).agg(F.coalesce(n, F.lit(0)).alias("streak")).withColumn("status", F.when(F.col("streak") >= need, "GREEN").otherwise("RED"))


def active_day_windows(rows: DataFrame, size: int = 14) -> DataFrame:
    """Windows over the sorted distinct days that occur, ``size`` of them each: window, first and last day, days."""
    days = rows.select("day").distinct()
    # the calendar of a corpus is small: one row for each day
    place = F.row_number().over(Window.orderBy("day")) - 1
    return days.withColumn("win", F.floor(place / size)).groupBy("win").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))


def quadrant(scored: DataFrame, burst: float = 2.0) -> DataFrame:
    """The phase of each entity by the signs of velocity and acceleration, and whether its burst score reaches ``burst`` either way."""
    v, a = F.col("velocity"), F.col("acceleration")
    phase = F.when((v > 0) & (a > 0), "rising").when((v > 0) & (a <= 0), "peaking").when((v <= 0) & (a > 0), "recovering").otherwise("falling")
    return scored.withColumn("phase", phase).withColumn("bursting", F.abs(F.round("burst", 9)) >= burst)
