"""Operators without an SQL form, and edge cases, against plain models."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators import dedupe as dd
from lodestream.operators import filters as fl
from lodestream.operators import graph as gr
from lodestream.operators import inference as inf
from lodestream.operators import joins, ranking
from lodestream.operators import ledger as lg
from lodestream.operators import timeseries as ts
from lodestream.plans import graphs, inference
from lodestream.sources import feeds, sinks


def days(*offsets: int) -> list[dt.date]:
    return [dt.date(2025, 1, 1) + dt.timedelta(days=o) for o in offsets]


def test_near_titles_are_near_and_others_far(spark) -> None:
    rows = [("OpenLab releases the new Zephyr 5 reasoning model",), ("OpenLab releases new Zephyr 5 reasoning model",), ("Regulators fine a search company over its ad practices",)]
    got = dd.with_simhash(spark.createDataFrame(rows, "title string")).collect()
    bits = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    assert bits(got[0]["simhash"], got[1]["simhash"]) <= 12 < bits(got[0]["simhash"], got[2]["simhash"])


def test_tokens_keep_english_words(spark) -> None:
    df = spark.createDataFrame([("GPT-5 발표: the Mixture-of-Experts. ab",)], "t string")
    assert df.select(T.tokens(F.col("t")).alias("x")).first()["x"] == ["gpt-5", "mixture-of-experts"]


@pytest.mark.parametrize("seed", range(3))
def test_same_day_groups_are_first_fit(spark, seed: int) -> None:
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    hashes = []
    for _ in range(40):
        h = rng.choice(base)
        for _ in range(rng.randrange(10)):
            h ^= 1 << rng.randrange(64)
        hashes.append(h - (1 << 64) if h >> 63 else h)
    df = spark.createDataFrame([(dt.date(2025, 1, 1), i, h) for i, h in enumerate(hashes)], "day date, pos int, simhash bigint")
    got = {r["pos"]: r["grp"] for r in dd.same_day_groups(df).collect()}
    groups: list[list[int]] = []
    for i, h in enumerate(hashes):
        for k, g in enumerate(groups):
            if any(bin((h ^ m) & ((1 << 64) - 1)).count("1") <= 12 for m in g):
                break
        else:
            groups.append([])
            k = len(groups) - 1
        groups[k].append(h)
        assert got[i] == k


def test_near_pairs_equal_all_pairs(spark) -> None:
    rng = random.Random(5)
    hashes = [rng.getrandbits(63) for _ in range(20)]
    hashes += [h ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for h in hashes]
    df = spark.createDataFrame([(0, i, h) for i, h in enumerate(hashes)], "day int, pos int, simhash bigint")
    got = {(r["pos"], r["pos_b"], r["bits"]) for r in dd.near_pairs(df, 6, ["day"]).collect()}
    assert got == {(i, j, (a ^ b).bit_count()) for (i, a), (j, b) in itertools.combinations(enumerate(hashes), 2) if (a ^ b).bit_count() <= 6}


def test_near_documents_are_whole_and_not_squared(spark, tmp_path) -> None:
    base = [" ".join(f"{c}{i}word{i * 7 % 13}" for i in range(60)) for c in "abc"]
    texts = [base[0]] * 30 + [base[0] + " x", base[1], base[2], base[1] + " y", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = dd.with_simhash(spark.read.parquet(str(tmp_path / "documents.parquet")).withColumnRenamed("doc_id", "pos"), "text")
    got = {(r["pos"], r["pos_b"]): r["bits"] for r in dd.near_groups(docs, 8).collect()}
    h = [dd.with_simhash(spark.createDataFrame([(t,)], "title string")).first()["simhash"] if t not in texts[:i] else None for i, t in enumerate(texts[:-1])]
    h = [h[texts.index(t)] for t in texts[:-1]]
    bits = lambda i, j: ((h[i] ^ h[j]) & ((1 << 64) - 1)).bit_count()
    near = {(i, j) for i, j in itertools.combinations(range(len(h)), 2) if bits(i, j) <= 8}
    own = [h.index(x) for x in h]
    assert near == {(i, j) for i, j in itertools.combinations(range(len(h)), 2) if own[i] == own[j] or tuple(sorted((own[i], own[j]))) in got}
    assert all(b == bits(*k) for k, b in got.items()) and (0, 29) in got and len(got) < 40


@pytest.mark.parametrize("chunks", [1, 8])
def test_near_documents_are_counted_and_not_listed(spark, tmp_path, monkeypatch, chunks: int) -> None:
    rng, words = random.Random(chunks), [f"w{i * 37 % 101}" for i in range(80)]
    texts = [" ".join(words[:60] + rng.sample(words, 20)) for _ in range(300)] + [" ".join(rng.sample("abcdefghijk", 8)) for _ in range(60)]
    texts += [texts[0]] * 40 + texts[5:9] + ["", " ", None, None]
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(dd, "FEW", chunks)
    monkeypatch.setattr(dd, "SMALL", 4)
    monkeypatch.setattr(dd, "HEAVY", 20)
    got = graphs.j14_near_pairs(spark, str(tmp_path)).collect()
    h = {r["pos"]: r["simhash"] for r in dd.with_simhash(spark.createDataFrame(rows, "pos bigint, title string")).collect()}
    near = lambda a, b: a is not None and b is not None and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 8
    want = {p: (min([q for q in h if h[q] == x and x is not None], default=p), sum(near(x, y) for q, y in h.items() if q != p)) for p, x in h.items()}
    assert len(got) == len(rows) and {r["pos"]: (r["class_id"], r["links"]) for r in got} == want
    assert sum(n for _, n in want.values()) > 5 * len(rows)


@pytest.mark.parametrize("hashes", [[], [None, None], [5, 5, None], [*range(0, 1 << 20, 99991), 1, None]])
def test_links_of_few_items_and_of_chunks_without_any(spark, monkeypatch, hashes: list) -> None:
    monkeypatch.setattr(dd, "FEW", 12)
    monkeypatch.setattr(dd, "SMALL", 1)
    rows = list(enumerate(hashes, 1))
    got = dd.near_links(spark.createDataFrame([*rows, (None, 5)] if 5 in hashes else rows, "pos bigint, simhash bigint"), 8).collect()
    near = lambda a, b: a is not None and b is not None and (a ^ b).bit_count() <= 8
    want = {i: sum(near(h, x) for j, x in rows if j != i) for i, h in rows}
    if 5 in hashes:  # an item without a pos is another one of the class
        want = {1: 2, 2: 2, None: 2, 3: 0}
    assert {r["pos"]: r["links"] for r in got} == want and len(got) == len(want)
    assert all(r["class_id"] == (1 if 5 in hashes and r["pos"] != 3 else r["pos"]) for r in got)


@pytest.mark.parametrize("copies", [1, 1 << 25])
def test_links_between_chunks_are_those_of_all_pairs(copies: int) -> None:
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 5), dtype=np.uint64), axis=1)
    a, b = (np.unique(base[rng.integers(0, 4, n)] ^ flips(n)) for n in (700, 3000))
    groups = dd.leaves(a, 50)
    assert max(map(len, groups)) <= 50 and sorted(np.concatenate(groups).tolist()) == list(range(len(a)))
    a, ends = a[np.concatenate(groups)], np.cumsum([len(g) for g in groups])
    of_a, of_b = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b)) + copies
    near = (np.bitwise_count(a[:, None] ^ b[None, :]) <= 8).astype(np.int64)
    got = dd.near_counts(a, ends, of_a, b, of_b, 8)
    assert (got[0] == near @ of_b).all() and (got[1] == of_a @ near).all() and 0 < near.mean() < 0.5
    assert [len(g) for g in dd.leaves(np.zeros(9, dtype=np.uint64), 3)] and not len(dd.leaves(a[:0])[0])


def test_continuity_tiers() -> None:
    state = dd.Continuity()
    d = days(0, 5, 40, 45, 200)
    group = lambda h, *t: {"simhash": h, "tokens": list(t), "first": "x"}
    assert state.step(d[0], [group(0, "a", "b"), group(1 << 40 | 0x3FF, "c")])[0] == ["k000001", "k000002"]
    ids, events = state.step(d[1], [group(0xFF, "a", "z"), group(0, "a", "b")])
    assert ids == ["k000001", "k000003"], "an id is given once a day"
    assert events[0]["kind"] == "cross_near" and events[0]["hamming"] == 8
    assert state.step(d[2], [group(0x3F, "q")])[0] == ["k000004"], "after 30 days titles must agree as well"
    ids, events = state.step(d[3], [group(0x3, "a", "z")])
    assert ids[0] in ("k000001", "k000004")
    assert state.step(d[4], [group(0, "a", "b")])[0] == ["k000005"], "after 90 days an entry is gone"


def test_stream_and_batch_continuity_agree(spark) -> None:
    from lodestream.plans import graphs, io

    sf = "/root/testdata/sf0.001"
    batch = {(r["day"], r["grp"]): r["cluster_id"] for r in graphs.d3_continuity(spark, sf).collect()}
    stream = {(r["day"], r["grp"]): r["cluster_id"] for r in io.stream_continuity(spark, sf).collect()}
    assert batch == stream and batch


def test_stream_identity_goes_on_after_a_restart_and_a_repeated_batch(spark, tmp_path) -> None:
    from lodestream.streaming import twins

    d, rng = days(*range(0, 120, 4)), random.Random(9)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = [(day, g, rng.choice(base) ^ (1 << rng.randrange(60)), [f"t{rng.randrange(5)}"], "x") for day in d for g in range(3)]
    groups = lambda part: spark.createDataFrame(part, "day date, grp int, rep_hash bigint, tokens array<string>, first string")
    want = {(r["day"], r["grp"]): r["cluster_id"] for r in dd.fold_days(groups(rows)).where("entry IS NULL").collect()}
    for i in (0, 1, 1, 2, 2):  # a new writer each time, as after a restart; batches 1 and 2 are run again
        twins.continuity_writer(str(tmp_path))(groups(rows[i * 30 : (i + 1) * 30]), i)
    got = {(r["day"], r["grp"]): r["cluster_id"] for r in twins.continuity_ids(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 90 and 6 <= len(set(got.values())) < 60


def test_identity_equals_a_plain_fold(spark) -> None:
    """The step over all entries at a time against one that looks at each entry in turn."""
    rng, d = random.Random(11), days(*sorted({0, *[random.Random(k).randrange(300) for k in range(60)]}))
    base = [rng.getrandbits(64) for _ in range(5)]
    state, plain, next_id = dd.Continuity(), [], 1
    for day in d:
        groups = []
        for _ in range(rng.randrange(4)):
            h = rng.choice(base)
            for _ in range(rng.randrange(9)):
                h ^= 1 << rng.randrange(64)
            groups.append({"simhash": h, "tokens": rng.sample("abcdefg", 3), "first": "x"})
        ids, _ = state.step(day, groups)
        plain = [e for e in plain if (day - e["seen"]).days <= 90]
        taken, want = set(), []
        for g in groups:
            for e in plain:
                bits, gap = (e["h"] ^ g["simhash"]).bit_count(), (day - e["seen"]).days
                alike = max(len(set(t) & set(g["tokens"])) / len(set(t) | set(g["tokens"])) for t in e["titles"])
                if e["id"] not in taken and (bits <= 8 if gap <= 30 else bits <= 6 and alike >= 0.4):
                    e["seen"] = day
                    if g["tokens"] not in e["titles"]:
                        e["titles"] = [*e["titles"], g["tokens"]][-3:]
                    break
            else:
                e = {"id": f"k{next_id:06d}", "h": g["simhash"], "seen": day, "titles": [g["tokens"]]}
                next_id += 1
                plain.append(e)
            taken.add(e["id"])
            want.append(e["id"])
        assert ids == want


def test_shrink_guard() -> None:
    dd.shrink_guard(100, 75, 0)
    dd.shrink_guard(100, 60, 20)
    with pytest.raises(RuntimeError):
        dd.shrink_guard(100, 60, 5)


def test_level_shift_and_bursts(spark) -> None:
    rows = [("a", i, 0.1 if i < 10 else 0.9) for i in range(20)] + [("short", i, 1.0) for i in range(3)]
    got = {r["k"]: r for r in inf.level_shift(spark.createDataFrame(rows, "k string, t int, y double"), ["k"], "t", "y").collect()}
    assert set(got) == {"a"} and got["a"]["index"] == 10 and got["a"]["shift"] > 0.5 and got["a"]["sse_reduction"] > 0.8
    spike = spark.createDataFrame([("s", i, 9.0 if i == 10 else 1.0) for i in range(20)] + [("c", i, 1.0) for i in range(20)], "k string, t int, y double")
    assert [(r["k"], r["t"]) for r in inf.burst_days(spike, ["k"], "y").collect()] == [("s", 10)]


def test_lag_correlation(spark) -> None:
    x = [0, 1, 0, 5, 0, 0, 2, 0, 7, 0, 1, 0, 0, 4, 0, 0, 0, 3, 0, 0]
    rows = [("three", t, float(x[t]), float(x[t - 3]) if t >= 3 else 0.0) for t in range(20)] + [("same", t, float(x[t]), float(x[t])) for t in range(20)] + [("flat", t, 1.0, 1.0) for t in range(20)]
    got = {r["k"]: r for r in inf.lag_correlation(spark.createDataFrame(rows, "k string, t int, x double, y double"), ["k"], "x", "y").collect()}
    assert got["three"]["lag"] == 3 and got["three"]["corr"] > 0.99 and got["same"]["lag"] == 0 and "flat" not in got


def test_hamilton_and_wilson(spark) -> None:
    seats = lambda rows, n: [r["seats"] for r in inf.hamilton(spark.createDataFrame(rows, "k string, n int"), "k", "n", n).orderBy("k").collect()]
    assert seats([("a", 50), ("b", 30), ("c", 20)], 10) == [5, 3, 2]
    assert seats([("a", 10), ("b", 10), ("c", 10)], 11) == [4, 4, 3]
    w = spark.createDataFrame([(5, 10), (0, 0), (0, 20), (20, 20)], "k int, n int").select(inf.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert w[0]["w"]["low"] + w[0]["w"]["high"] == pytest.approx(1.0) and tuple(w[1]["w"]) == (0, 0, 0) and w[2]["w"]["low"] == 0 and w[3]["w"]["high"] == pytest.approx(1.0)


def test_bootstrap_is_fixed_by_its_seed(spark) -> None:
    c = spark.createDataFrame([(1, 2, 3), (2, 1, 2), (3, 1, 2), (4, 1, 2)], "cluster int, h int, t int")
    a, b = (inf.clustered_bootstrap(c, "h", "t", 300, seed=3).first() for _ in range(2))
    assert a == b and a["share"] == pytest.approx(5 / 9) and a["low"] <= a["share"] <= a["high"]


def test_bootstrap_in_buckets_follows_plain_resampling(spark, monkeypatch) -> None:
    monkeypatch.setattr(inf, "RESAMPLED", 25)
    rng = np.random.default_rng(1)
    t = rng.integers(1, 9, 200)
    h = rng.binomial(t, 0.3)
    c = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(h, t, strict=True))], "cluster int, h int, t int")
    got = inf.clustered_bootstrap(c, "h", "t", 2000).first()
    at = rng.integers(200, size=(20_000, 200))
    low, high = np.percentile(h[at].sum(axis=1) / t[at].sum(axis=1), [2.5, 97.5])
    assert got["low"] == pytest.approx(low, abs=0.004) and got["high"] == pytest.approx(high, abs=0.004) and got["share"] == pytest.approx(h.sum() / t.sum())


def test_bootstrap_query_has_all_replicates(spark, tmp_path) -> None:
    rows = [(i % 40, "F" if i * i % 7 < 3 else "O") for i in range(400)]
    spark.createDataFrame(rows, "o_custkey int, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    clusters = [(k, sum(s == "F" for c, s in rows if c == k), sum(c == k for c, _ in rows)) for k in range(40)]
    c = spark.createDataFrame(clusters, "cluster int, h bigint, t bigint")
    got = inference.m18_bootstrap(spark, str(tmp_path)).collect()
    assert got == inf.clustered_bootstrap(c, "h", "t", 2000).collect() != inf.clustered_bootstrap(c, "h", "t", 500).collect()


def test_sign_test(spark) -> None:
    p = spark.createDataFrame([(32, 35), (5, 10)], "k int, n int").select(inf.sign_test(F.col("k"), F.col("n")).alias("p")).collect()
    assert p[0]["p"] == pytest.approx(2.1e-7, rel=0.05) and p[1]["p"] == pytest.approx(0.623, abs=0.001)


def test_smoother_follows_lines_and_tents() -> None:
    _, v, _, edf = inf.smooth_velocity(0.1 * np.arange(31))
    assert abs(v.mean() - 0.1) < 0.03 and edf < 6
    _, v, _, _ = inf.smooth_velocity(np.concatenate([np.arange(15), 15 - np.arange(16)]).astype(float))
    assert v[5] > 0 > v[25]


def test_negative_binomial_finds_trend_and_spread() -> None:
    rng = np.random.default_rng(0)
    t = np.linspace(-1.5, 1.5, 200)
    mu = np.exp(1.0 + 0.5 * t)
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, 200)).astype(float)
    x = np.stack([np.ones(200), t], axis=1)
    alpha, lr, p = inf.overdispersion(y, x, np.ones(200))
    w, se, _ = inf.nb_fit(y, x, np.ones(200), alpha)
    assert abs(w[1] - 0.5) < 3 * se[1] and 0.2 < alpha < 1.2 and p < 0.01 and lr > 0
    assert inf.overdispersion(rng.poisson(mu).astype(float), x, np.ones(200))[2] > 0.001


def two_cliques() -> pd.DataFrame:
    rows = [(f"a{i}", f"a{j}", 1) for i, j in itertools.combinations(range(5), 2)] + [(f"b{i}", f"b{j}", 1) for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0", 1)]
    return pd.DataFrame(rows, columns=["a", "b", "weight"])


def test_communities_find_planted_parts() -> None:
    g = gr.adjacency(two_cliques())
    want = [{f"a{i}" for i in range(5)}, {f"b{i}" for i in range(5)}]
    assert gr.greedy_modularity(g) == want and gr.louvain(g) == want
    null = gr.permutation_null(g, 30, 1)
    assert null["z"] > 2 and null["p"] < 0.1 and null == gr.permutation_null(g, 30, 1)
    assert gr.permutation_null(gr.adjacency(two_cliques().head(2)), 5) is None


def test_significance_takes_whole_windows(spark, monkeypatch) -> None:
    rng = random.Random(7)
    pairs = list(itertools.combinations([f"n{i:02d}" for i in range(12)], 2))
    edges = pd.DataFrame([(w, a, b, rng.randint(2, 9)) for w in (1, 2) for a, b in sorted(rng.sample(pairs, 45))] + [(3, "x", "y", 2)], columns=["win", "a", "b", "weight"])
    monkeypatch.setattr(graphs, "window_edges", lambda *_: spark.createDataFrame(edges, "win int, a string, b string, weight bigint"))
    got = {r["win"]: (r["q"], r["z"], r["p"]) for r in graphs.g10_significance(spark, "").collect()}
    assert got == {w: tuple(gr.permutation_null(gr.adjacency(edges[edges["win"] == w]), 200).values()) for w in (1, 2)}


def brute_betweenness(g: dict) -> dict:
    """All simple paths of each pair."""
    out = dict.fromkeys(g, 0.0)
    for s, t in itertools.combinations(sorted(g), 2):
        best, paths = float("inf"), []
        todo = [(0.0, [s])]
        while todo:
            d, p = todo.pop()
            if d > best + 1e-12:
                continue
            if p[-1] == t:
                if d < best - 1e-12:
                    best, paths = d, []
                paths.append(p)
                continue
            todo += [(d + w, [*p, u]) for u, w in g[p[-1]].items() if u not in p]
        paths = [p for p in paths if abs(sum(g[x][y] for x, y in zip(p, p[1:])) - best) < 1e-9]
        for p in paths:
            for v in p[1:-1]:
                out[v] += 1 / len(paths)
    n = len(g)
    return {v: 2 * x / ((n - 1) * (n - 2)) for v, x in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_betweenness_equals_brute_force(seed: int) -> None:
    rng = random.Random(seed)
    rows = [(f"n{i}", f"n{j}", rng.randint(1, 3)) for i, j in itertools.combinations(range(7), 2) if rng.random() < 0.5]
    g = gr.adjacency(pd.DataFrame(rows, columns=["a", "b", "weight"]))
    assert gr.betweenness(g) == pytest.approx(brute_betweenness(g))


def test_components_and_life_events(spark) -> None:
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(40)] + [("x", "y", 1)], "a string, b string, weight int")
    got = {r["node"]: r["component"] for r in gr.connected_components(e).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 43
    part = lambda rows: spark.createDataFrame(rows, "node string, community int")
    events = gr.life_events(part([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("q", 3)]), part([("a", 7), ("b", 7), ("c", 7), ("d", 7), ("z", 8)]))
    assert {(r["event"], r["community"]) for r in events.collect()} == {("merge", 7), ("birth", 8), ("death", 3)}


def test_greedy_top_is_not_blocked_by_a_dropped_row(spark) -> None:
    rows = [("1", "A", "t", 9), ("2", "A", "u", 8), ("3", "B", "u", 7), ("4", "", "v", 6), ("5", "", "w", 5)]
    df = spark.createDataFrame(rows, "id string, cluster string, title string, s int")
    got = ranking.greedy_top(df, [F.col("s").desc()], ["id", "cluster", "title"], 4).collect()
    assert [r["id"] for r in got] == ["1", "3", "4", "5"], "2 is dropped, so its title doesn't block 3"


def test_dense_streak(spark) -> None:
    weeks = spark.createDataFrame(list(enumerate([200, 200, 5, 200, 200, 200])), "week int, n int")
    got = ts.dense_streak(weeks, "n", 150).first()
    assert (got["streak"], got["status"]) == (3, "RED")


def test_spans_keep_a_gap_of_seven_days(spark) -> None:
    df = spark.createDataFrame([("a", d) for d in days(0, 7, 15)], "k string, day date")
    assert sorted((str(r["start"]), str(r["end"])) for r in ts.spans(df, ["k"]).collect()) == [("2025-01-01", "2025-01-08"), ("2025-01-16", "2025-01-16")]


def test_band_join_equals_between(spark) -> None:
    rng = random.Random(1)
    p = [(rng.randrange(100),) for _ in range(50)]
    r = [(i, a, a + rng.randrange(30)) for i, a in enumerate(rng.randrange(90) for _ in range(10))]
    got = joins.band_join(spark.createDataFrame(p, "x int"), spark.createDataFrame(r, "i int, lo int, hi int"), "x", "lo", "hi", 10)
    assert got.count() == sum(lo <= x <= hi for (x,) in p for _, lo, hi in r)


def test_feeds(spark, tmp_path) -> None:
    rss = "<rss><channel><item><title>A  b</title><link>https://x/1</link><description>d</description></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>P</title><link href="https://x/2"/><summary>s</summary></entry></feed>'
    (tmp_path / "a.xml").write_text(rss)
    (tmp_path / "b.xml").write_text(atom)
    (tmp_path / "c.xml").write_text("<broken")
    spark.dataSource.register(feeds.FeedDataSource)
    df = spark.read.format("feed").option("paths", f"a={tmp_path}/a.xml;b={tmp_path}/b.xml;c={tmp_path}/c.xml;d={tmp_path}/none.xml").load()
    assert sorted((r["source_id"], r["title"], r["url"]) for r in df.collect()) == [("a", "A b", "https://x/1"), ("b", "P", "https://x/2")]


def test_link_titles(spark) -> None:
    page = '<a href="/news/">All</a><a href="/news/big-model-day?x=1">Hi</a><a href="https://h/news/other#z">A longer title</a><a href="/news/big-model-day">Again</a><a href="/else">No</a>'
    got = feeds.scrape_links(spark.createDataFrame([(1, page)], "id int, html string"), "html", "/news/", 5, "id").collect()
    assert {(r["path"], r["title"]) for r in got} == {("/news/big-model-day", "Big Model Day"), ("/news/other", "A longer title")}


def test_jsonl_skips_broken_lines(spark, tmp_path) -> None:
    d = tmp_path / "2025-01-02"
    d.mkdir()
    (d / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in feeds.read_jsonl(spark, str(d / "x.jsonl"), "a int").collect()) == [1, 2]
    got = feeds.read_day_files(spark, str(tmp_path), "x.jsonl", "a int", multiline=False).collect()
    assert {str(r["day"]) for r in got} == {"2025-01-02"}


def test_upsert_twice_changes_nothing(spark, tmp_path) -> None:
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    patch = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    sinks.upsert_path(spark, first, path, ["k"])
    for _ in range(2):
        sinks.upsert_path(spark, patch, path, ["k"])
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_a_table_survives_a_replacement_that_stops(spark, tmp_path) -> None:
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)

    def fails(frames):  # noqa: ANN001, ANN202
        yield from frames
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        sinks.replace_table(spark.range(5).mapInPandas(fails, "id bigint"), path)
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "t").rename(tmp_path / "t.old")  # stopped between the two renames
    sinks.upsert_path(spark, spark.createDataFrame([(9,)], "id bigint"), path, ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 9] and not (tmp_path / "t.old").exists()


def test_a_cluster_needs_a_shared_folder() -> None:
    from types import SimpleNamespace

    from lodestream.session import shared_dir

    on = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(on("local[2]"))
    with pytest.raises(ValueError):
        shared_dir(on("spark://host:7077"))


def test_export_manifest_and_counts(spark, tmp_path) -> None:
    counts = sinks.export_tables({"t": (spark.range(5), ["id"])}, str(tmp_path))
    sinks.verify_counts(spark, str(tmp_path), counts)
    with pytest.raises(ValueError):
        sinks.verify_counts(spark, str(tmp_path), {"t": 4})
    assert sinks.manifest(spark, str(tmp_path / "t.csv")).where("bytes > 0").count() >= 1


def test_leak_guard(spark) -> None:
    df = spark.createDataFrame([("we met ACME  corp today",), ("acmecorp is one word",)], "t string")
    assert lg.guard_terms(df.where("t LIKE '%one word%'"), "t", ["Acme corp"]).count() == 1
    with pytest.raises(lg.LeakError):
        lg.guard_terms(df, "t", ["Acme corp"])


def test_broken_alias_stops_the_run() -> None:
    with pytest.raises(ValueError):
        lg.check_patterns([("c", "(")])


def test_validator_rejects(spark) -> None:
    schema = "id int, summary string, insights array<string>, category string, importance int, tags array<string>, subtitle string, institution string, authors string"
    ok = (1, "s", ["a", "b"], "r", 3, ["x", "y", "x", "z"], "Sub. ", "null", "A")
    bad = [(2, "s", ["a"], "r", 3, None, None, None, None), (3, "s", ["a", "b"], "?", 3, None, None, None, None), (4, "s", ["a", "b"], "r", 6, None, None, None, None), (5, None, ["a", "b"], "r", 3, None, None, None, None)]
    got = fl.valid_results(spark.createDataFrame([ok, *bad], schema), ["r", "o"], ["x", "z"]).collect()
    assert len(got) == 1 and got[0]["tags"] == ["x", "z"] and got[0]["subtitle"] == "Sub" and got[0]["institution"] is None and got[0]["authors"] == "A"


def test_boundary_calls_batches_and_gives_up(spark) -> None:
    from lodestream.sources import boundary

    articles = spark.createDataFrame([(i, dt.date(2025, 1, 1), "t", "s" if i != 3 else "  ") for i in range(10)], "id int, day date, title string, summary string").coalesce(1)
    done = spark.createDataFrame([(1,)], "id int")
    got = boundary.embed_pending(articles, done, lambda texts: [[float(len(t))] for t in texts], "m", size=4).collect()
    assert sorted(r["id"] for r in got) == [0, 2, 4, 5, 6, 7, 8, 9] and got[0]["vector"] == [3.0]

    def fails(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["id"] >= 4).any():
            raise OSError("down")
        return batch[["id"]]

    left = boundary.call_in_batches(spark.range(12).coalesce(1), fails, "id bigint", "id", size=2, tries=2, wait=0.01)
    said = {r["id"]: r["error"] for r in left.collect()}
    assert len(said) == 12 and [said[i] for i in range(4)] == [None] * 4 and [said[i] for i in range(4, 8)] == ["OSError: down"] * 4 and all("not called" in said[i] for i in range(8, 12))


def test_seed_twice_changes_nothing(spark) -> None:
    versions = spark.createDataFrame([], "version int, note string, concept_count bigint")
    concepts = spark.createDataFrame([("a", "A", 1)], "concept_id string, canonical_name string, first_lexicon_version int")
    aliases = spark.createDataFrame([("a", "aa", 1)], "concept_id string, pattern string, added_version int")
    seed = spark.createDataFrame([("a", "A", "aa"), ("b", "B", "bb"), ("b", "B", "b2")], "concept_id string, canonical_name string, pattern string")
    one = lg.load_seed(versions, concepts, aliases, 2, "n", seed)
    two = lg.load_seed(*one, 2, "n", seed)
    for x, y in zip(one, two, strict=True):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    assert lg.patterns_of(two[2], 1).count() == 1 and two[2].count() == 3 and two[0].first()["concept_count"] == 2


def test_running_sums_over_partitions(spark) -> None:
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("x"), (F.col("id") % 5).alias("v"))
    got = joins.running(df, ["x"], {"s": "v"}, "i").orderBy("x").collect()
    assert [r["i"] for r in got] == list(range(1000)) and [r["s"] for r in got] == list(itertools.accumulate(r["v"] for r in got))
