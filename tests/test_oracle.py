"""Every query that has an SQL form against DuckDB, on the smallest tables; those that turn on thresholds on larger ones too."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LARGER = Path("/root/testdata/sf0.01")
#: Comparisons of floats with a threshold, for which a last bit could decide.
THRESHOLDS = ["w17_quadrant", "m2_burst_days", "m3_take_offs", "top_gainers", "w4_burst", "p19_anomalies"]
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")))


def plain(x: object) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if hasattr(x, "isoformat"):
        return str(pd.Timestamp(x))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def database(sf: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def db() -> duckdb.DuckDBPyConnection:
    return database(SF)


def compare(spark, db: duckdb.DuckDBPyConnection, sf: Path, name: str) -> None:
    df = entry.queries()[name](spark, str(sf))
    found = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    keys = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(k)]) for k in keys) for r in found.fetchall())
    got = sorted(tuple(plain(r[k]) for k in keys) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name: str) -> None:
    compare(spark, db, SF, name)


@pytest.mark.skipif(not LARGER.exists(), reason="no test tables")
@pytest.mark.parametrize("partitions", ["3", "8"])
@pytest.mark.parametrize("name", THRESHOLDS)
def test_thresholds_do_not_turn_on_a_last_bit(spark, name: str, partitions: str) -> None:
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        compare(spark, database(LARGER), LARGER, name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_entry_has_rows(spark) -> None:
    assert entry.entry(spark).count() > 0
