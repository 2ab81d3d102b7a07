"""Change points, lags, intervals, allocation, bootstrap and small regressions.

What fits a group is an expression or a window; regressions and smoothers are grouped maps over one entity's series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.joins import running
from lodestream.session import cut


def level_shift(series: DataFrame, keys: list[str], order: str, value: str, least: int = 4) -> DataFrame:
    """M1: the split with least squared error, ``least`` points on either side, first of equals; by prefix sums.

    index (points before the split), shift (mean after minus mean before) and sse_reduction.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    all_ = Window.partitionBy(*keys)
    y = F.col(value).cast("double")
    s = series.select(*keys, F.row_number().over(w).alias("__k"), F.sum(y).over(w).alias("__s"), F.sum(y * y).over(w).alias("__q"), F.count("*").over(all_).alias("__n"), F.sum(y).over(all_).alias("__ts"), F.sum(y * y).over(all_).alias("__tq"))
    k, n = F.col("__k"), F.col("__n")
    sse = (F.col("__q") - F.col("__s") ** 2 / k) + ((F.col("__tq") - F.col("__q")) - (F.col("__ts") - F.col("__s")) ** 2 / (n - k))
    splits = s.where((k >= least) & (n - k >= least)).withColumn("__sse", F.round(sse, 9))
    best = splits.groupBy(*keys).agg(F.min(F.struct("__sse", "__k", "__s", "__n", "__ts", "__tq")).alias("__b"))
    b = lambda c: F.col(f"__b.{c}")
    total = b("__tq") - b("__ts") ** 2 / b("__n")
    shift = (b("__ts") - b("__s")) / (b("__n") - b("__k")) - b("__s") / b("__k")
    return best.select(*keys, b("__k").alias("index"), shift.alias("shift"), F.when(total > 1e-12, 1 - b("__sse") / total).otherwise(0.0).alias("sse_reduction"))


def burst_days(series: DataFrame, keys: list[str], value: str, z: float = 2.0) -> DataFrame:
    """M2: days above mean + z population deviations, by more than 1e-9; a constant series has none."""
    w = Window.partitionBy(*keys)
    m, sd = F.avg(value).over(w), F.stddev_pop(value).over(w)
    return series.withColumn("__m", m).withColumn("__s", sd).where((F.col("__s") > 1e-12) & (F.round(F.col(value) - F.col("__m") - z * F.col("__s"), 9) > 0)).drop("__m", "__s")


def correlation(x: str, y: str) -> Column:
    """Pearson's, null where a series is constant (corr() itself fails there under ANSI rules)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def take_offs(shifts: DataFrame, active_days: Column, least_days: int = 8, reduction: float = 0.3) -> DataFrame:
    """M3: entities whose level rose clearly, with enough active days."""
    return shifts.where((F.col("shift") > 0) & (F.col("sse_reduction") >= reduction) & (active_days >= least_days))


def lag_correlation(pairs: DataFrame, keys: list[str], x: str, y: str, most: int = 7) -> DataFrame:
    """M9: of lags 0 to ``most``, the first with the greatest correlation of x(t) and y(t + lag); constant series have none."""
    lags = pairs.select(*keys, F.col("t"), F.col(x).cast("double").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag"))
    later = pairs.select(*keys, F.col("t").alias("u"), F.col(y).cast("double").alias("y"))
    joined = lags.withColumn("u", F.col("t") + F.col("lag")).join(later, [*keys, "u"])
    r = joined.groupBy(*keys, "lag").agg(F.when((F.stddev_pop("x") > 1e-12) & (F.stddev_pop("y") > 1e-12), correlation("x", "y")).alias("r")).where("r IS NOT NULL")
    return r.groupBy(*keys).agg(F.max(F.struct(F.round("r", 9).alias("r"), (-F.col("lag")).alias("l"))).alias("b")).select(*keys, (-F.col("b.l")).alias("lag"), F.col("b.r").alias("corr"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(p, low, high); zeros if n is zero."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    ok = lambda c: F.when(n > 0, c).otherwise(0.0)
    return F.struct(ok(p).alias("p"), ok(F.greatest(centre - half, F.lit(0.0))).alias("low"), ok(F.least(centre + half, F.lit(1.0))).alias("high"))


def hamilton(strata: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """N seats by largest remainder, ties by key."""
    total = strata.agg(F.sum(size).alias("__t"))
    q = strata.crossJoin(F.broadcast(total)).withColumn("__q", F.col(size) * F.lit(n) / F.col("__t")).withColumn("__f", F.floor("__q"))
    rest = q.agg((F.lit(n) - F.sum("__f")).alias("__r"))
    # strata are few: their remainders are ordered in one task
    place = F.row_number().over(Window.orderBy(F.round(F.col("__q") - F.col("__f"), 12).desc(), key))
    return q.withColumn("__p", place).crossJoin(F.broadcast(rest)).select(key, (F.col("__f") + F.when(F.col("__p") <= F.col("__r"), 1).otherwise(0)).cast("long").alias("seats"))


def stratified_sample(rows: DataFrame, stratum: str, seats: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Of each stratum as many rows as it has seats, by a seeded hash of the id."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), id_col), id_col))
    return rows.withColumn("__p", place).join(seats, stratum).where(F.col("__p") <= F.col("seats")).drop("__p", "seats")


#: Clusters that one task resamples, about.
RESAMPLED = 50_000


def clustered_bootstrap(clusters: DataFrame, hits: str, total: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """Share of hits with a 95 % interval, resampling clusters with replacement, as many as there are.

    Clusters lie in buckets by a hash. How many of a replicate's draws fall into each bucket is a multinomial draw (the
    driver holds a number for each bucket and replicate); within a bucket the draws are uniform. That is the law of
    drawing from all clusters, no task needs more than a bucket of them, and the seed fixes the result.
    """
    own = cut(clusters.select(F.col("cluster").cast("string").alias("c"), F.col(hits).cast("double").alias("h"), F.col(total).cast("double").alias("t")), "bootstrap")
    n = own.count()
    buckets = max(1, -(-n // RESAMPLED))
    own = own.withColumn("b", F.pmod(F.xxhash64("c"), F.lit(buckets)).cast("int"))
    sizes = {r["b"]: r["n"] for r in own.groupBy("b").agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes)
    drawn = np.random.default_rng(seed).multinomial(n, [sizes[b] / n for b in order], size=replicates) if n else np.zeros((replicates, 0), dtype=np.int64)
    of_bucket = {b: drawn[:, i] for i, b in enumerate(order)}

    def resample(f: pd.DataFrame) -> pd.DataFrame:
        f, b = f.sort_values(["c", "h", "t"], kind="stable"), int(f["b"].iloc[0])
        rng, h, t = np.random.default_rng([seed, b]), f["h"].to_numpy(), f["t"].to_numpy()
        sums = np.zeros((replicates, 2))
        for i, k in enumerate(of_bucket[b].tolist()):
            at = rng.integers(len(h), size=k)
            sums[i] = h[at].sum(), t[at].sum()
        return pd.DataFrame({"rep": np.arange(replicates), "h": sums[:, 0], "t": sums[:, 1]})

    sums = own.groupBy("b").applyInPandas(resample, "rep int, h double, t double").groupBy("rep").agg((F.sum("h") / F.nullif(F.sum("t"), F.lit(0.0))).alias("share"))
    ends = sums.agg(F.percentile("share", 0.025).alias("low"), F.percentile("share", 0.975).alias("high"))
    return own.agg((F.sum("h") / F.sum("t")).alias("share")).crossJoin(ends)


def sign_test(k: Column, n: Column) -> Column:
    """P(X >= k) for n fair coins, from a sum of exp(log binomial)."""

    @F.pandas_udf("double")
    def tail(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([sum(math.comb(int(b), i) for i in range(int(a), int(b) + 1)) / 2 ** int(b) for a, b in zip(ks, ns, strict=True)], dtype="float64")

    return tail(k, n)


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks from one, ties averaged."""
    w = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(same) - 1) / 2)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation; null under three points or for a constant series."""
    r = average_ranks(average_ranks(df, keys, x, "__a"), keys, y, "__b")
    ok = (F.count("*") >= 3) & (F.stddev_pop("__a") > 0) & (F.stddev_pop("__b") > 0)
    return r.groupBy(*keys).agg(F.when(ok, correlation("__a", "__b")).alias("rho"), F.count("*").alias("n"))


def calibrate_threshold(scored: DataFrame, score: str, truth: str, recall: float = 0.9) -> DataFrame:
    """V5: the threshold of best precision whose recall is enough, ties by recall; keeps all if there is none.

    Counts by distinct score come first, so the ordered pass runs over scores, not over rows.
    """
    by = scored.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("int")).alias("t"))
    cum = running(by, [F.col("s").desc()], {"cn": "n", "ct": "t"}).select("s", F.col("cn").alias("n"), F.col("ct").alias("t"))
    total = by.agg(F.sum("t").alias("all"))
    p, r = F.col("t") / F.col("n"), F.col("t") / F.col("all")
    fit = cum.crossJoin(F.broadcast(total)).select("s", p.alias("p"), r.alias("r")).where(F.col("r") >= recall)
    best = fit.agg(F.max(F.struct("p", "r", "s")).alias("b"))
    return best.select(F.coalesce("b.s", F.lit(float("-inf"))).alias("threshold"), F.col("b.p").alias("precision"), F.col("b.r").alias("recall"))


def evaluate(scored: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """V6: precision, recall and counts."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = scored.agg(n(predicted & truth).alias("tp"), n(predicted & ~truth).alias("fp"), n(~predicted & truth).alias("fn"))
    return c.withColumn("precision", F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).withColumn("recall", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))


# --- grouped maps over one series ---------------------------------------------------------------------------------


def nb_fit(y: np.ndarray, x: np.ndarray, exposure: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Negative binomial regression (log link, variance mu + alpha mu^2) by Newton's method: weights, errors, log likelihood."""
    w = np.zeros(x.shape[1])
    w[0] = math.log(max(y.sum(), 0.5) / max(exposure.sum(), 1e-9))
    for _ in range(50):
        mu = np.exp(np.clip(x @ w + np.log(exposure), -30, 30))
        h = x.T @ (x * (mu / (1 + alpha * mu))[:, None]) + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ ((y - mu) / (1 + alpha * mu)))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    mu = np.exp(np.clip(x @ w + np.log(exposure), -30, 30))
    lg = np.vectorize(math.lgamma)
    if alpha < 1e-9:
        ll = float((y * np.log(mu) - mu - lg(y + 1)).sum())
    else:
        r = 1 / alpha
        ll = float((lg(y + r) - lg(np.array(r)) - lg(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))).sum())
    return w, np.sqrt(np.diag(np.linalg.inv(h))), ll


def overdispersion(y: np.ndarray, x: np.ndarray, exposure: np.ndarray) -> tuple[float, float, float]:
    """M5: (alpha, likelihood ratio, p) of negative binomial against Poisson; p is half of chi-square's tail with one degree."""
    poisson = nb_fit(y, x, exposure, 0.0)[2]
    grid = np.exp(np.linspace(math.log(1e-4), math.log(20), 60))
    fits = [nb_fit(y, x, exposure, a)[2] for a in grid]
    k = int(np.argmax(fits))
    lr = max(0.0, 2 * (fits[k] - poisson))
    return (float(grid[k]) if lr > 0 else 0.0), lr, 0.5 * math.erfc(math.sqrt(lr / 2))


def nb_trends(panel: DataFrame, key: str, least: int = 5) -> DataFrame:
    """M5, M6: for each entity of (key, t, n, exposure): trend, its error, alpha and p; ``least`` nonzero days needed."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        y, e = f["n"].to_numpy(float), np.maximum(f["exposure"].to_numpy(float), 0.5)
        if (y > 0).sum() < least:
            return pd.DataFrame({key: [], "trend": [], "error": [], "alpha": [], "p": []})
        t = f["t"].to_numpy(float)
        x = np.stack([np.ones_like(t), (t - t.mean()) / max(t.std(), 1e-9)], axis=1)
        alpha, _, p = overdispersion(y, x, e)
        w, se, _ = nb_fit(y, x, e, alpha)
        return pd.DataFrame({key: [f[key].iloc[0]], "trend": [w[1] / max(t.std(), 1e-9)], "error": [se[1] / max(t.std(), 1e-9)], "alpha": [alpha], "p": [p]})

    kind = dict(panel.dtypes)[key]
    return panel.groupBy(key).applyInPandas(fit, f"{key} {kind}, trend double, error double, alpha double, p double")


def smooth_velocity(y: np.ndarray, knots: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """M8: penalised radial smoother of a series: level, velocity, velocity's error and effective degrees of freedom; GCV picks the penalty."""
    n = len(y)
    t = np.arange(n, dtype=float)
    centres = np.linspace(0, n - 1, min(knots, n))
    width = max((n - 1) / max(1, len(centres) - 1), 1.0) * 1.5
    g = np.exp(-0.5 * ((t[:, None] - centres) / width) ** 2)
    b = np.concatenate([np.ones((n, 1)), t[:, None] / n, g], axis=1)
    db = np.concatenate([np.zeros((n, 1)), np.full((n, 1), 1 / n), -g * (t[:, None] - centres) / width**2], axis=1)
    pen = np.diag([0.0, 0.0, *np.ones(len(centres))])
    best = None
    for lam in 10.0 ** np.arange(-4, 5):
        inv = np.linalg.inv(b.T @ b + lam * pen + 1e-9 * np.eye(b.shape[1]))
        w = inv @ b.T @ y
        edf = float(np.trace(b @ inv @ b.T))
        rss = float(((y - b @ w) ** 2).sum())
        gcv = (rss + 1e-12) / max(n - edf, 1e-6) ** 2
        if best is None or gcv < best[0] * (1 - 1e-9):
            best = (gcv, w, inv, edf, rss)
    _, w, inv, edf, rss = best
    var = rss / max(n - edf, 1.0)
    cov = var * inv @ b.T @ b @ inv
    return b @ w, db @ w, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", db, cov, db), 0)), edf


def smooth_velocities(series: DataFrame, key: str, value: str, least: int = 5) -> DataFrame:
    """M8: (key, day, level, velocity, error) of each entity's series, ordered by day."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("day")
        if len(f) < least:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in (key, "day", "level", "velocity", "error")})
        level, v, e, _ = smooth_velocity(f[value].to_numpy(float))
        return pd.DataFrame({key: f[key], "day": f["day"], "level": level, "velocity": v, "error": e})

    return series.groupBy(key).applyInPandas(fit, f"{key} {dict(series.dtypes)[key]}, day date, level double, velocity double, error double")
