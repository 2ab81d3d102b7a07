"""Harvests, back-catalogues and databases as tables."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestream.functions.text import url_hash
from lodestream.operators.ledger import match_aliases
from lodestream.session import read_text, write_text_atomic
from lodestream.sources.feeds import RECORD, harvest_window, next_token, paper_record

RECORDS = "id string, title string, created string, categories array<string>"


def harvest(spark: SparkSession, fetch: Callable[[str | None], str], root: str, most_pages: int | None = None) -> dict:
    """Pages from ``fetch(token)`` one after another, as tokens follow from pages; they go whole to ``root``/pages/page-n.xml.

    The progress (token, pages, seen, done) is replaced after each page has been written, so a run that stops anywhere
    goes on with the page that it hadn't noted, which overwrites itself. What is held is one page; only its token and
    the number of its records are looked up here, the rest is left to the tasks that read it (``harvested``).
    """
    said = read_text(spark, f"{root}/progress.json")
    state = json.loads(said) if said else {"token": None, "pages": 0, "seen": 0, "done": False}
    taken = 0
    while not state["done"] and (most_pages is None or taken < most_pages):
        content = fetch(state["token"])
        write_text_atomic(spark, f"{root}/pages/page-{state['pages']}.xml", content)
        token, found = next_token(content), sum(1 for _ in re.finditer(RECORD, content, re.S))
        state = {"token": token, "pages": state["pages"] + 1, "seen": state["seen"] + found, "done": token is None}
        write_text_atomic(spark, f"{root}/progress.json", json.dumps(state))
        taken += 1
    return state


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame(list(map(paper_record, f["r"])), columns=["id", "title", "created", "categories"])


def harvested(spark: SparkSession, root: str, first: str, last: str, tracked: list[str]) -> DataFrame:
    """The harvested records of a window of days in a tracked category, each id once; a record without a day is in no window."""
    pages = spark.read.text(f"{root}/pages/*.xml", wholetext=True)  # not what an interrupted write has left
    records = pages.select(F.explode(F.regexp_extract_all("value", F.lit(f"(?s){RECORD}"))).alias("r"))
    rows = records.mapInPandas(_records, RECORDS).withColumn("day", F.try_to_date("created"))
    return harvest_window(rows, first, last, tracked).dropDuplicates(["id"])


def back_catalogue(items: DataFrame, aliases: list[tuple[str, str]], known: DataFrame, first: str, last: str, version: int) -> DataFrame:
    """New mentions (concept, article_id, day, match_text, version) in the titles of a feed's old items (title, url, day).

    Items outside the window and without a day go; a mention that the ledger has by its key stays as it is.
    """
    rows = items.where(F.col("day").between(first, last)).select(url_hash(F.col("url")).alias("article_id"), "day", F.trim("title").alias("title"))
    found = match_aliases(rows, aliases, "title").select("concept", "article_id", "day", "match_text", F.lit(version).alias("version"))
    key = ["concept", "article_id", "day", "version"]
    return found.dropDuplicates(key).join(known.select(*key), key, "left_anti")


def parse_registry(text: str) -> list[dict[str, str]]:
    """The entries of a registry file: a list of flat mappings, ``- key: value`` and ``  key: value`` lines; comments and other lines go."""
    out: list[dict[str, str]] = []
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#") or ":" not in bare:
            continue
        key, value = bare.strip().removeprefix("- ").split(":", 1)
        if bare.lstrip().startswith("- "):
            out.append({})
        if out and value.strip():
            out[-1][key.strip()] = value.strip().strip("\"'")
    return out


def source_registry(spark: SparkSession, text: str) -> DataFrame:
    """(source_id, type, trust, cap): a row for each source; trust is 3 and the cap 50 where they aren't stated, entries without an id go."""
    rows = [(e["id"], e.get("type", "rss"), int(e.get("trust", 3)), int(e.get("max_results", 50))) for e in parse_registry(text) if e.get("id")]
    return spark.createDataFrame(rows, "source_id string, type string, trust int, cap int")


class DatabaseSource(DataSource):
    """``spark.read.format("sqlite")`` over a database file that all executors can open: options path, table, partitions; a schema is needed.

    Partitions are ranges of rowids; only the columns of the schema are read.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return DatabaseReader(self.options, [f.name for f in schema.fields])


class RowRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class DatabaseReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        self.path, self.table = options["path"], quoted(options["table"])
        self.parts, self.columns = int(options.get("partitions", "4")), ", ".join(map(quoted, columns))

    def partitions(self) -> list[InputPartition]:
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()  # noqa: S608
        con.close()
        if low is None:
            return [RowRange(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from con.execute(f"SELECT {self.columns} FROM {self.table} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (partition.low, partition.high))  # noqa: S608
        finally:
            con.close()


def read_database(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(DatabaseSource)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", table).option("partitions", partitions).load()
