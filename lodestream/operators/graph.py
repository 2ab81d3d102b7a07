"""Graphs of co-mentions: measures that are joins and sums run on Spark; kernels take one small graph each.

A graph is an edge frame (a, b, weight), a < b. Kernels (betweenness, communities, permutation tests) run as grouped
maps over the edges of one snapshot, so that snapshots run in parallel; a snapshot's entity graph has thousands of
edges. Ties are broken by name, so that results don't depend on the order of rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.components import components
from lodestream.session import cut


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree and strength."""
    return endpoints(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Weighted PageRank of the undirected graph, until the ranks move by less than tolerance x nodes in sum."""
    both = cut(endpoints(edges), "pagerank-edges")
    out = both.groupBy("node").agg(F.sum("weight").alias("out"))
    n = out.count()
    if not n:
        return out.select("node", F.lit(0.0).alias("rank"))
    share = cut(both.join(out, "node").select("node", "other", (F.col("weight") / F.col("out")).alias("p")), "pagerank-shares")
    ranks = out.select("node", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        got = share.join(ranks, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("r"))
        new = cut(got.select("node", (F.lit((1 - alpha) / n) + alpha * F.col("r")).alias("rank")), "pagerank-ranks")
        moved = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).first()["d"]
        ranks = new
        if moved < n * tolerance:
            break
    return ranks


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component), the least name of each component; contraction goes on until no edge is left."""
    rooted = components(edges.select("a", "b"))
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return rooted.join(least, "root").select("node", "component")


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z, product of the three weights over the greatest weight cubed), x < y < z, once each."""
    top = edges.agg(F.max("weight").alias("m"))
    e = edges.crossJoin(F.broadcast(top)).select("a", "b", (F.col("weight") / F.col("m")).alias("w"))
    two = e.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("w").alias("w1")).join(e.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("w").alias("w2")), "y")
    return two.join(e.select(F.col("a").alias("x"), F.col("b").alias("z"), F.col("w").alias("w3")), ["x", "z"]).select("x", "y", "z", (F.col("w1") * F.col("w2") * F.col("w3")).alias("w"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density, average weighted clustering, components, largest, and how far to trust them."""
    d = degrees(edges)
    corners = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("node"), F.cbrt("w").alias("w")).groupBy("node").agg(F.sum("w").alias("t"))
    c = d.join(corners, "node", "left").select(F.when(F.col("degree") > 1, 2 * F.coalesce("t", F.lit(0.0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("c"))
    comp = connected_components(edges).groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("components"), F.max("size").alias("largest"))
    n = c.agg(F.count("*").alias("nodes"), F.avg("c").alias("clustering")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(comp)
    density = F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    flag = F.when(F.col("nodes") == 0, "empty").when((F.col("nodes") >= 5) & (F.col("edges") >= 10), "ok").otherwise("small_graph")
    return n.select("nodes", "edges", density.alias("density"), F.coalesce("clustering", F.lit(0.0)).alias("clustering"), "components", F.coalesce("largest", F.lit(0)).alias("largest"), flag.alias("trust_flag"))


def windowed_edges(pairs: DataFrame, windows: DataFrame, least: int = 2) -> DataFrame:
    """(win, a, b, weight) by rows within a window of days, by equality of the window's number."""
    return pairs.join(windows, "day").groupBy("win", "a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Weighted modularity Q of (node, community)."""
    total = edges.agg(F.sum("weight").alias("m"))
    c = communities.select("node", "community")
    inside = edges.join(c.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside = inside.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    strength = degrees(edges).join(c, "node").groupBy("community").agg(F.sum("strength").alias("k"))
    q = strength.join(inside, "community", "left").crossJoin(F.broadcast(total))
    return q.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - (F.col("k") / (2 * F.col("m"))) ** 2).alias("q"))


def top_edges(edges: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """The k heaviest edges of each snapshot, ties by name."""
    w = Window.partitionBy(*(keys or [])).orderBy(F.col("weight").desc(), "a", "b")
    if not keys:
        return edges.orderBy(F.col("weight").desc(), "a", "b").limit(k)
    return edges.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def life_events(previous: DataFrame, current: DataFrame, overlap: float = 0.5) -> DataFrame:
    """(event, community): birth, death, split, merge by the overlap coefficient of members."""
    p = previous.select("node", F.col("community").alias("p"))
    c = current.select("node", F.col("community").alias("c"))
    np_, nc = p.groupBy("p").agg(F.count("*").alias("np")), c.groupBy("c").agg(F.count("*").alias("nc"))
    match = p.join(c, "node").groupBy("p", "c").agg(F.count("*").alias("n")).join(np_, "p").join(nc, "c").where(F.col("n") / F.least("np", "nc") >= overlap)
    of_p = np_.select("p").join(match.groupBy("p").agg(F.count("*").alias("k")), "p", "left").select(F.col("p").alias("community"), F.coalesce("k", F.lit(0)).alias("k"))
    of_c = nc.select("c").join(match.groupBy("c").agg(F.count("*").alias("k")), "c", "left").select(F.col("c").alias("community"), F.coalesce("k", F.lit(0)).alias("k"))
    gone = of_p.where("k <> 1").select(F.when(F.col("k") == 0, "death").otherwise("split").alias("event"), "community")
    came = of_c.where("k <> 1").select(F.when(F.col("k") == 0, "birth").otherwise("merge").alias("event"), "community")
    return gone.unionByName(came)


def same_partition(x: DataFrame, y: DataFrame) -> bool:
    """Whether two labellings group the nodes alike, whatever the labels."""
    groups = lambda d: d.groupBy("community").agg(F.array_sort(F.collect_set("node")).alias("m")).select("m")
    a, b = groups(x), groups(y)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


# --- kernels over one small graph ---------------------------------------------------------------------------------


def adjacency(f: pd.DataFrame) -> dict[str, dict[str, float]]:
    g: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in sorted(zip(f["a"], f["b"], f["weight"], strict=True)):
        g[a][b] = g[a].get(b, 0.0) + float(w)
        g[b][a] = g[b].get(a, 0.0) + float(w)
    return g


def betweenness(g: dict[str, dict[str, float]]) -> dict[str, float]:
    """Brandes' sums over Dijkstra's paths, weights as distances, normalised; zero under three nodes."""
    score = dict.fromkeys(g, 0.0)
    n = len(g)
    if n < 3:
        return score
    for s in g:
        dist, paths, before, order, heap = {}, defaultdict(float, {s: 1.0}), defaultdict(list), [], [(0.0, s, s)]
        seen = {s: 0.0}
        while heap:
            d, via, v = heapq.heappop(heap)
            if v in dist:
                continue
            if v != s:
                paths[v] += paths[via]
            dist[v] = d
            order.append(v)
            for u, w in g[v].items():
                there = d + w
                if u not in dist and (u not in seen or there < seen[u] - 1e-12):
                    seen[u] = there
                    heapq.heappush(heap, (there, v, u))
                    paths[u], before[u] = 0.0, [v]
                elif u not in dist and abs(there - seen[u]) <= 1e-12:
                    paths[u] += paths[v]
                    before[u].append(v)
        back = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                back[u] += paths[u] / paths[v] * (1 + back[v])
            if v != s:
                score[v] += back[v]
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def greedy_modularity(g: dict[str, dict[str, float]]) -> list[set[str]]:
    """Merges the pair of communities of greatest gain until none is left; ties by name."""
    m = sum(sum(r.values()) for r in g.values()) / 2
    members = {v: {v} for v in sorted(g)}
    k = {v: sum(g[v].values()) / (2 * m) for v in members}
    e = {v: {u: w / m for u, w in g[v].items() if u != v} for v in members}
    while True:
        gains = [(w - 2 * k[a] * k[b], a, b) for a, row in e.items() for b, w in row.items() if a < b]
        best = max((x[0] for x in gains), default=0.0)
        if best <= 1e-12:
            return sorted(members.values(), key=lambda s: (-len(s), min(s)))
        _, a, b = max((x for x in gains if x[0] == best), key=lambda x: [-ord(c) for c in x[1] + " " + x[2]])
        for u, w in e.pop(b).items():
            del e[u][b]
            if u != a:
                e[a][u] = e[a].get(u, 0.0) + w
                e[u][a] = e[a][u]
        k[a] += k.pop(b)
        members[a] |= members.pop(b)


def louvain(g: dict[str, dict[str, float]], seed: int = 42) -> list[set[str]]:
    """Local moves in a seeded order, then the same on the graph of communities, until nothing moves."""
    rng = np.random.default_rng(seed)
    groups = {v: {v} for v in sorted(g)}
    level = {v: dict(g[v]) for v in sorted(g)}
    m2 = sum(sum(r.values()) for r in g.values())
    while True:
        nodes = sorted(level)
        home = {v: v for v in nodes}
        k = {v: sum(level[v].values()) for v in nodes}
        tot = dict(k)
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in rng.permutation(len(nodes)):
                v = nodes[i]
                links: dict[str, float] = defaultdict(float)
                for u, w in level[v].items():
                    if u != v:
                        links[home[u]] += w
                own = home[v]
                tot[own] -= k[v]
                gain = lambda c, links=links, v=v: links.get(c, 0.0) - tot[c] * k[v] / m2
                best = max(sorted({*links, own}), key=lambda c: (round(gain(c), 12), c == own))
                tot[best] += k[v]
                if best != own and gain(best) is not None:
                    home[v] = best
                    moved = moved_any = True
        if not moved_any:
            return sorted(groups.values(), key=lambda s: (-len(s), min(s)))
        names = {c: min(v for v in nodes if home[v] == c) for c in set(home.values())}
        new: dict[str, dict[str, float]] = {n: defaultdict(float) for n in names.values()}
        merged: dict[str, set[str]] = {n: set() for n in names.values()}
        for v in nodes:
            merged[names[home[v]]] |= groups[v]
            for u, w in level[v].items():
                new[names[home[v]]][names[home[u]]] += w
        groups, level = merged, {v: dict(r) for v, r in new.items()}


def graph_modularity(g: dict[str, dict[str, float]], communities: list[set[str]]) -> float:
    m2 = sum(sum(r.values()) for r in g.values())
    q = 0.0
    for c in communities:
        q += sum(w for v in c for u, w in g[v].items() if u in c) / m2 - (sum(sum(g[v].values()) for v in c) / m2) ** 2
    return q


def rewired_q(g: dict[str, dict[str, float]], seed: int, number: int) -> float:
    """Q of greedy communities of the graph after double edge swaps, with its weights dealt anew; fixed by seed and number."""
    edges = sorted((a, b) for a in g for b in g[a] if a < b)
    rng = np.random.default_rng([seed, number])
    now, have, tries = list(edges), set(edges), 4 * len(edges)
    for (i, j), turned in zip(rng.integers(0, len(now), (tries, 2)).tolist(), (rng.random(tries) < 0.5).tolist(), strict=True):
        (a, b), (c, d) = now[i], now[j]
        if turned:
            c, d = d, c
        x, y = (a, d) if a < d else (d, a), (c, b) if c < b else (b, c)
        if len({a, b, c, d}) < 4 or x in have or y in have:
            continue
        have -= {now[i], now[j]}
        now[i], now[j] = x, y
        have |= {x, y}
    weights = rng.permutation([g[a][b] for a, b in edges])
    h: dict[str, dict[str, float]] = defaultdict(dict)
    for (a, b), w in zip(now, weights, strict=True):
        h[a][b] = h[b][a] = float(w)
    return graph_modularity(h, greedy_modularity(h))


def large_enough(g: dict[str, dict[str, float]]) -> bool:
    """Three nodes and edges."""
    return len(g) >= 3 and sum(map(len, g.values())) >= 6


def against_null(q: float, null: list[float]) -> dict[str, float]:
    sd = float(np.std(null))
    return {"q": q, "z": (q - float(np.mean(null))) / sd if sd > 1e-12 else 0.0, "p": (sum(x >= q for x in null) + 1) / (len(null) + 1)}


def permutation_null(g: dict[str, dict[str, float]], n: int = 200, seed: int = 0) -> dict[str, float] | None:
    """Q of greedy communities against n rewired graphs (double edge swaps): q, z and p; None under three nodes or edges."""
    if not large_enough(g):
        return None
    return against_null(graph_modularity(g, greedy_modularity(g)), [rewired_q(g, seed, i) for i in range(n)])


def node_betweenness(edges: DataFrame, key: str) -> DataFrame:
    """G3 over each snapshot."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        b = betweenness(adjacency(f))
        return pd.DataFrame({key: f[key].iloc[0], "node": list(b), "betweenness": list(b.values())})

    return edges.groupBy(key).applyInPandas(run, f"{key} {dict(edges.dtypes)[key]}, node string, betweenness double")


def communities(edges: DataFrame, key: str, method: str = "greedy", seed: int = 42) -> DataFrame:
    """G6, G8 over each snapshot: (key, node, community), numbered by size and least member."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        g = adjacency(f)
        found = louvain(g, seed) if method == "louvain" else greedy_modularity(g)
        rows = [(f[key].iloc[0], v, i) for i, c in enumerate(found) for v in sorted(c)]
        return pd.DataFrame(rows, columns=[key, "node", "community"])

    return edges.groupBy(key).applyInPandas(run, f"{key} {dict(edges.dtypes)[key]}, node string, community int")


#: Rewired graphs that one task works out at a time.
REWIRED = 10


def significance(edges: DataFrame, key: str, n: int = 200, seed: int = 0) -> DataFrame:
    """G10 over each snapshot: permutation_null, its rewired graphs spread over tasks as well."""
    kind = dict(edges.dtypes)[key]
    names = [key, "number", "q"]

    def rewire(f: pd.DataFrame) -> pd.DataFrame:
        g, start = adjacency(f), int(f["start"].iloc[0])
        if not large_enough(g):
            return pd.DataFrame([], columns=names)
        rows = [(-1, graph_modularity(g, greedy_modularity(g)))] if start == 0 else []
        rows += [(i, rewired_q(g, seed, i)) for i in range(start, min(n, start + REWIRED))]
        return pd.DataFrame([(f[key].iloc[0], *r) for r in rows], columns=names)

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        q = f.sort_values("number")["q"].tolist()
        r = against_null(q[0], q[1:])
        return pd.DataFrame([(f[key].iloc[0], r["q"], r["z"], r["p"])], columns=[key, "q", "z", "p"])

    starts = F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1), F.lit(REWIRED)))
    # a number of partitions that adaptive execution leaves: the edges are few bytes and much work
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * edges.sparkSession.sparkContext.defaultParallelism)
    spread = edges.select(key, "a", "b", "weight", starts.alias("start")).repartition(tasks, key, "start")
    null = spread.groupBy(key, "start").applyInPandas(rewire, f"{key} {kind}, number int, q double")
    return null.groupBy(key).applyInPandas(compare, f"{key} {kind}, q double, z double, p double")
