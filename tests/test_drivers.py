"""Composed drivers against plain models, and collection that stops and goes on."""

from __future__ import annotations

import json
import random

import pytest

from lodestream.operators import drivers as dr
from lodestream.operators import graph as gr
from lodestream.session import read_text
from lodestream.sources import backfill as bf


def edges_of(spark, seed: int, windows: int = 6):
    rng = random.Random(seed)
    rows = []
    for w in range(windows):
        names = [f"n{i:02d}" for i in range(8 + w)]
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                near = names.index(a) // 4 == names.index(b) // 4
                if rng.random() < (0.8 if near else 0.15):
                    rows.append((w, a, b, rng.randint(1, 9)))
    return rows, spark.createDataFrame(rows, "win int, a string, b string, weight int")


def graph_of(rows, win: int, most: int | None = None) -> dict:
    own = sorted((r for r in rows if r[0] == win), key=lambda r: (-r[3], r[1], r[2]))[:most]
    g: dict[str, dict[str, float]] = {}
    for _, a, b, w in own:
        g.setdefault(a, {})[b] = float(w)
        g.setdefault(b, {})[a] = float(w)
    return g


def test_network_snapshots_equal_plain_ones(spark) -> None:
    rows, df = edges_of(spark, 1)
    got = {r["win"]: r for r in dr.network_snapshots(df, "win", 10).collect()}
    least = min(sum(r[0] == w for r in rows) for w in range(6))
    for w in range(6):
        g = graph_of(rows, w)
        found = gr.greedy_modularity(g)
        fixed = graph_of(rows, w, least)
        assert got[w]["nodes"] == len(g) and got[w]["edges"] == sum(r[0] == w for r in rows) and got[w]["communities"] == len(found)
        assert got[w]["largest_fraction"] == pytest.approx(max(map(len, found)) / len(g))
        assert got[w]["q"] == pytest.approx(gr.graph_modularity(g, found))
        assert got[w]["fixed_q"] == pytest.approx(gr.graph_modularity(fixed, gr.greedy_modularity(fixed)))


def test_trends_of_snapshots(spark) -> None:
    rows = [(w, float(w), 5.0 - w, None if w == 3 else 1.0 + w * w, 2) for w in range(6)]
    df = spark.createDataFrame(rows, "win int, q double, z double, fixed_q double, communities int")
    got = {r["metric"]: (r["rho"], r["n"]) for r in dr.network_trends(df, "win").collect()}
    assert got["q"] == (pytest.approx(1.0), 6) and got["z"] == (pytest.approx(-1.0), 6) and got["fixed_q"] == (pytest.approx(1.0), 5) and got["communities"][0] is None


def test_life_totals_equal_sums_over_neighbours(spark) -> None:
    rng, rows = random.Random(2), []
    for w in (1, 4, 9, 11):
        rows += [(w, f"n{i}", rng.randrange(4)) for i in range(20)]
    got = {r["event"]: r["n"] for r in dr.life_totals(spark.createDataFrame(rows, "win int, node string, community int"), "win").collect()}
    want: dict[str, int] = {}
    for a, b in ((1, 4), (4, 9), (9, 11)):
        parts = [{c: {n for w, n, k in rows if w == x and k == c} for c in {k for w, _, k in rows if w == x}} for x in (a, b)]
        meets = [(p, c) for p, m in parts[0].items() for c, n in parts[1].items() if len(m & n) / min(len(m), len(n)) >= 0.5]
        for side, none, many in ((0, "death", "split"), (1, "birth", "merge")):
            for c in parts[side]:
                k = sum(m[side] == c for m in meets)
                if k != 1:
                    name = none if k == 0 else many
                    want[name] = want.get(name, 0) + 1
    assert got == want


def test_panel_report_has_every_active_series(spark) -> None:
    rows = [(k, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", 5 if i < 10 or k == "flat" else 50, 0.1 if i < 10 or k == "flat" else 1.0) for k in ("step", "flat") for i in range(20)] + [("short", "2024-01-01", 1, 0.5)]
    df = spark.createDataFrame(rows, "k string, day string, n int, r double").selectExpr("k", "to_date(day) AS day", "n", "r")
    got = {r["k"]: r for r in dr.panel_report(df, "k", "day", "n", "r").collect()}
    assert set(got) == {"step", "flat"} and got["step"]["takes_off"] and not got["flat"]["takes_off"]
    assert got["step"]["shift"] == pytest.approx(0.9) and got["step"]["mean_velocity"] > 0.01 and abs(got["flat"]["mean_velocity"]) < 1e-6


def test_a_harvest_goes_on_where_it_stopped(spark, tmp_path) -> None:
    page = lambda n: f"<record><id>{n}</id><title>t</title><created>2024-01-0{n}</created><categories>a b</categories></record><resumptionToken>{n + 1 if n < 5 else ''}</resumptionToken>"
    asked, root = [], str(tmp_path / "h")

    def fetch(token: str | None) -> str:
        n = int(token or 1)
        asked.append(n)
        if n == 3 and asked.count(3) == 1:
            raise OSError("down")
        return page(n)

    with pytest.raises(OSError):
        bf.harvest(spark, fetch, root)
    assert json.loads(read_text(spark, f"{root}/progress.json"))["pages"] == 2
    state = bf.harvest(spark, fetch, root)
    assert state["done"] and state["seen"] == 5 and asked == [1, 2, 3, 3, 4, 5]
    assert bf.harvest(spark, fetch, root) == state and asked[-1] == 5  # nothing is left to ask for
    assert sorted(r["id"] for r in bf.harvested(spark, root, "2024-01-02", "2024-01-04", ["b", "z"]).collect()) == ["2", "3", "4"]


def test_registry_lines(spark) -> None:
    text = "# sources\nsources:\n  - id: a\n    type: arxiv # kind\n    trust: 5\n\n  - id: 'b'\n    name: \"x: y\"\n  - name: no id\n"
    assert sorted(map(tuple, bf.source_registry(spark, text).collect())) == [("a", "arxiv", 5, 50), ("b", "rss", 3, 50)]


def test_an_empty_database_table(spark, tmp_path) -> None:
    import sqlite3

    con = sqlite3.connect(tmp_path / "d.db")
    con.execute("CREATE TABLE t (a INTEGER)")
    con.commit()
    con.close()
    assert bf.read_database(spark, str(tmp_path / "d.db"), "t", "a bigint").count() == 0
