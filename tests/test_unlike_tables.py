"""Queries and their operators against their SQL on tables that the small ones don't resemble: long keys, ties, copies."""

from __future__ import annotations

import hashlib
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_oracle import SF, TABLES, compare, database

import __spark_entry__ as entry
from lodestream.functions import text as T
from lodestream.operators import vectors as vec
from lodestream.sources import backfill as bf

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def tables(at: Path, **own: str) -> Path:
    """The smallest tables under ``at``, but those of ``own`` as their SQL over the others has it."""
    con = database(SF)
    for t in TABLES:
        if t in own:
            con.execute(f"COPY ({own[t]}) TO '{at}/{t}.parquet'")
        else:
            (at / f"{t}.parquet").symlink_to(SF / f"{t}.parquet")
    return at


def test_long_keys_make_well_formed_ids(spark, tmp_path) -> None:
    sf = tables(tmp_path, part="SELECT * REPLACE (CASE WHEN p_partkey <> 7 THEN p_partkey * 5000001 END AS p_partkey) FROM part")
    compare(spark, database(sf), sf, "c9_integrity")


def test_a_brief_has_no_sign_where_nothing_changed(spark, tmp_path) -> None:
    orders = "SELECT o.* REPLACE (i AS o_orderkey, TIMESTAMP '1995-01-01' + to_days(i::INT) AS o_orderdate) FROM range(14) r(i), (SELECT * FROM orders LIMIT 1) o"
    lineitem = "SELECT l.* REPLACE (i AS l_orderkey, p_partkey AS l_partkey) FROM range(14) r(i), part, (SELECT * FROM lineitem LIMIT 1) l WHERE p_partkey < 40 OR i = 10 AND p_partkey < 43"
    sf = tables(tmp_path, orders=orders, lineitem=lineitem)
    con = database(sf)
    sql = entry.oracle_sql()["s34_brief"]
    assert con.execute(f"SELECT count(*) FROM ({sql}) WHERE line LIKE '%(0)'").fetchone()[0]
    compare(spark, con, sf, "s34_brief")


def test_near_vectors_are_multiplied_in_tiles() -> None:
    m = np.random.default_rng(1).normal(size=(6000, 16))
    m[:50], m[50], m[100:200] = m[3], 0, np.round(m[100:200])
    f = pd.DataFrame({"id": np.arange(6000) * 3, "v": list(m.astype(np.float32))})
    q = vec._matrix(f["v"])
    tracemalloc.start()
    got = pd.concat(vec._nearest(f["id"].to_numpy(), q, iter([f[:10], f[10:]]), 9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 6000 * 4, "all products were held at a time"
    unit = q / np.where((norm := np.linalg.norm(q, axis=1)) == 0, 1, norm)[:, None]
    by = {i: g for i, g in got.groupby("rep")}
    for i in (0, 3, 49, 50, 51, 150, 5999):
        score = unit @ unit[i]
        want = -np.sort(-score)[:9]
        assert by[3 * i]["score"].to_numpy() == pytest.approx(want[want >= 0], abs=1e-12)
        assert by[3 * i]["neighbour"].is_unique
    assert by[0]["neighbour"].tolist() == list(range(0, 27, 3))


def test_pairs_of_near_copies_are_scored_in_parts() -> None:
    m = 1 + np.random.default_rng(2).normal(size=(vec.COLUMNS, 8)) * 1e-7
    f = pd.DataFrame({"id": np.arange(len(m)), "v": list(m)})
    q = vec._matrix(f["v"].iloc[: vec.ROWS])
    tracemalloc.start()
    got = pd.concat(vec._nearest(np.arange(vec.ROWS), q, iter([f]), 9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * vec.ROWS * vec.COLUMNS, "all pairs were scored at a time"
    assert (got.groupby("rep").size() == 9).all()


def test_one_block_of_vectors_is_held_and_a_query_keeps_its_nearest(spark, tmp_path, monkeypatch) -> None:
    monkeypatch.setattr(vec, "SENT_BYTES", 64 * 8 * 90)  # six blocks
    sent, states = [], []
    broadcast, parquet = spark.sparkContext.broadcast, type(spark.range(1).write).parquet
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(broadcast(x)) or sent[-1])
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, *a, **b: states.append(path) or parquet(self, path, *a, **b))
    compare(spark, database(SF), SF, "v3_related_clusters")
    assert len(sent) == 6
    assert [Path(b._path).exists() for b in sent] == [False] * 5 + [True], "blocks were held at the same time"
    nearest = [x for x in states if "/nearest-" in x]
    assert len(nearest) == 5
    assert [Path(x).exists() for x in nearest] == [False] * 4 + [True]


@pytest.mark.parametrize("name", ["v2_cosine_top_k", "v3_related_clusters"])
def test_copies_and_many_clusters_of_vectors(spark, tmp_path, name: str) -> None:
    at = "[cos(i / 800), sin(i / 800), 0.25]::FLOAT[]"
    own = f"SELECT 2 * i AS vec_id, {at} AS embedding, 0 AS label FROM range(1100) r(i) UNION ALL SELECT 2 * i + 1, {at}, i::INT + 1 FROM range(1100) r(i) UNION ALL SELECT 5000 + i, {at.replace('i', '7').replace('s7n', 'sin')}, 1 FROM range(40) r(i)"
    sf = tables(tmp_path, embeddings=own)
    compare(spark, database(sf), sf, name)


def test_a_harvest_starts_no_jobs_for_its_pages(spark, tmp_path) -> None:
    page = lambda n: f"<record><id>{n}</id><created></created><categories>a</categories></record><record><id>x{n}</id><created>2024-01-02</created><categories>a</categories></record><resumptionToken>{n + 1 if n < 29 else ''}</resumptionToken>"
    root = str(tmp_path / "h")
    try:
        spark.sparkContext.setJobGroup("harvest", "pages")
        state = bf.harvest(spark, lambda token: page(int(token or 0)), root)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("harvest")) < 5
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert state == {"token": None, "pages": 30, "seen": 60, "done": True}
    (tmp_path / "h/pages/page-3.xml.left").write_text(page(40))
    assert {r["id"] for r in bf.harvested(spark, root, "2024-01-01", "2024-01-03", ["a"]).collect()} == {f"x{n}" for n in range(30)}


def test_a_harvest_of_ids_with_gaps_and_rows_without_a_day(spark, tmp_path) -> None:
    sf = tables(tmp_path, events="SELECT * REPLACE (event_id + event_id % 3 * 1000000000000 AS event_id, CASE WHEN event_id % 5 > 0 THEN ts END AS ts) FROM events")
    compare(spark, database(sf), sf, "s13_harvest")


def test_a_simhash_looks_each_trigram_up_once(monkeypatch) -> None:
    rng, calls, md5 = np.random.default_rng(4), [], hashlib.md5
    texts = ["", "a", "abc", "abcd", "가나다라마 가나다", "".join(rng.choice(list("ab가나"), 4000))]
    want = []
    for s in texts:
        grams = [s[i : i + 3] for i in range(max(1, len(s) - 2))]
        low = [int.from_bytes(md5(g.encode()).digest()[8:], "big") for g in grams]
        h = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in low) > len(low))
        want.append(h - (1 << 64) if h >> 63 else h)
    monkeypatch.setattr(hashlib, "md5", lambda x: calls.append(x) or md5(x))
    assert T._gram_simhash.func(pd.Series([*texts, None])).tolist()[:-1] == want
    assert len(calls) <= 4 ** 3 + 12


def test_a_simhash_of_any_text_is_that_of_its_normalised_trigrams(spark) -> None:
    rng = np.random.default_rng(5)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i : i + 97]) for i in range(0, len(points), 97)] + [f"a{c}b C{c}d{c}" for c in points[:400] + list("İKςΣſ가힣\ud7a4\u115f")]
    texts += ["", " ", "A", "aB", "ab c", "가", "".join(rng.choice(list("abcXYZ 019é"), 100_000)), "".join(rng.choice(list("ab"), 66_000))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = T._gram_simhash(F.replace(T.normalize(F.col("t")), F.lit(" "), F.lit("")))
    got = df.select("t", F.replace(T.normalize(F.col("t")), F.lit(" "), F.lit("")).alias("bare"), T.title_simhash(F.col("t")).alias("h"), plain.alias("plain")).collect()
    for r in got:
        assert r["h"] == r["plain"]
        if r["t"] is None:
            assert r["h"] is None
            continue
        assert "".join(map(chr, T._bare(r["t"]).tolist())) == r["bare"]
        if len(r["bare"]) > 30_000:
            grams = Counter(r["bare"][i : i + 3] for i in range(len(r["bare"]) - 2))
            low = {g: int.from_bytes(hashlib.md5(g.encode()).digest()[8:], "big") for g in grams}
            h = sum(1 << b for b in range(64) if 2 * sum(n for g, n in grams.items() if low[g] >> b & 1) > grams.total())
            assert r["h"] & ((1 << 64) - 1) == h
