"""Feeds, link pages and other files as tables."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ITEM_SCHEMA = "source_id string, pos int, title string, url string, published string, summary string"
#: Characters of a summary that are kept: of a feed, of a paper feed, and of a scraped title.
FEED_SUMMARY, PAPER_SUMMARY, LINK_TITLE = 1000, 1500, 300
_ATOM = "{http://www.w3.org/2005/Atom}"


def _child(e: ET.Element, *names: str) -> str:
    for n in names:
        found = e.find(n)
        if found is not None:
            return (found.text or found.get("href") or "").strip()
    return ""


def parse_feed(source_id: str, content: str, papers: bool = False) -> list[tuple]:
    """Items of an RSS or Atom document; those without a link or title go, a broken document has none."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return []
    out = []
    for e in [*root.iter("item"), *root.iter(f"{_ATOM}entry")]:
        link = _child(e, "link")
        if not link:
            links = e.findall(f"{_ATOM}link")
            best = next((x for x in links if x.get("rel", "alternate") == "alternate"), links[0] if links else None)
            link = best.get("href", "") if best is not None else ""
        title = " ".join(_child(e, "title", f"{_ATOM}title").split())
        if not link or not title:
            continue
        summary = _child(e, "description", f"{_ATOM}summary", f"{_ATOM}content")
        when = _child(e, "pubDate", f"{_ATOM}published", f"{_ATOM}updated") or None
        out.append((source_id, len(out), title, link, when, summary[: PAPER_SUMMARY if papers else FEED_SUMMARY]))
    return out


class FeedDataSource(DataSource):
    """``spark.read.format("feed").option("paths", "id=path;id=path")``: a partition for each feed file.

    A feed that can't be read or parsed gives no rows and leaves the others alone.
    """

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return ITEM_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return FeedReader(self.options)


class FeedPartition(InputPartition):
    def __init__(self, source_id: str, path: str) -> None:
        super().__init__((source_id, path))
        self.source_id, self.path = source_id, path


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.papers = options.get("papers", "false").lower() == "true"
        self.feeds = [tuple(p.split("=", 1)) for p in options["paths"].split(";") if p]

    def partitions(self) -> list[InputPartition]:
        return [FeedPartition(s, p) for s, p in self.feeds]

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        try:
            with open(partition.path, encoding="utf-8") as f:
                content = f.read()
        except OSError:
            return iter(())
        return iter(parse_feed(partition.source_id, content, self.papers))


def read_feed_table(raw: DataFrame, papers: bool = False) -> DataFrame:
    """S1, S2 over (source_id, content) rows, wherever Spark read them from."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for s, c in zip(f["source_id"], f["content"], strict=True) for r in parse_feed(s, c or "", papers)]
            yield pd.DataFrame(rows, columns=["source_id", "pos", "title", "url", "published", "summary"])

    return raw.select("source_id", "content").mapInPandas(run, ITEM_SCHEMA)


def capped(items: DataFrame, cap: int = 50) -> DataFrame:
    """The first items of each source in feed order."""
    return items.withColumn("__n", F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))).where(F.col("__n") <= cap).drop("__n")


def scrape_links(pages: DataFrame, html: str, prefix: str, cap: int, key: str) -> DataFrame:
    """S3: anchors under a path prefix, relative or absolute, without query and fragment, each path once, the listing itself not.

    The title is the anchor's text, or the slug in title case if that is under eight characters.
    """
    links = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?href=["']([^"']+)["'][^>]*>.*?</a>"""), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?href=["'][^"']+["'][^>]*>(.*?)</a>"""), F.lit(1))
    rows = pages.select(key, F.posexplode(F.arrays_zip(links.alias("href"), texts.alias("text"))).alias("pos", "l"))
    path = F.regexp_replace(F.regexp_replace(F.col("l.href"), r"[?#].*$", ""), r"^https?://[^/]+", "")
    rows = rows.select(key, "pos", path.alias("path"), F.trim(F.regexp_replace(F.regexp_replace(F.col("l.text"), "<[^>]+>", " "), r"\s+", " ")).alias("text"))
    rows = rows.where(F.startswith("path", F.lit(prefix)) & (F.rtrim(F.col("path"), F.lit("/")) != F.lit(prefix.rstrip("/"))))
    first = rows.groupBy(key, "path").agg(F.min(F.struct("pos", "text")).alias("f")).select(key, "path", F.col("f.pos").alias("pos"), F.col("f.text").alias("text"))
    slug = F.initcap(F.regexp_replace(F.regexp_extract("path", r"([^/]+)/?$", 1), "[-_]+", " "))
    titled = first.withColumn("title", F.substring(F.when(F.length("text") >= 8, F.col("text")).otherwise(slug), 1, LINK_TITLE))
    return titled.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("__n") <= cap).select(key, "path", "title")


def read_day_files(spark: SparkSession, root: str, name: str, schema: str, multiline: bool = True) -> DataFrame:
    """``root/<day>/<name>``; the day comes from the directory, malformed files and rows go."""
    df = spark.read.schema(schema).option("multiLine", multiline).option("mode", "DROPMALFORMED").json(f"{root}/*/{name}")
    return df.withColumn("day", F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2}-\d{2})/[^/]+$", 1)))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A row for each line that can be read; the others go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Compressed vector lines, the first row of an article by file name and place."""
    rows = read_jsonl(spark, path, "article_id string, day string, source string, model string, dim int, vector array<float>")
    rows = rows.withColumn("__f", F.col("_metadata.file_path")).withColumn("__i", F.monotonically_increasing_id())
    w = Window.partitionBy("article_id").orderBy("__f", "__i")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__f", "__i")


def clean_body(text: Column, marker: str = "[summary] ") -> Column:
    """Tags and a fallback's marker go, white space is one space, 6000 characters at most."""
    bare = F.when(F.startswith(text, F.lit(marker)), F.substring(text, len(marker) + 1, 1 << 30)).otherwise(text)
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " ")), 1, 6000)


def harvest_window(rows: DataFrame, first: str, last: str, tracked: list[str]) -> DataFrame:
    """Harvested rows within a window of days whose categories meet the tracked ones."""
    return rows.where(F.col("day").between(first, last) & F.arrays_overlap("categories", F.array(*map(F.lit, tracked))))


def snapshot_union(snapshots: DataFrame) -> DataFrame:
    """Of the archived copies of a page the first one by snapshot."""
    w = Window.partitionBy("url").orderBy("snapshot", "pos")
    return snapshots.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def english_corpus(bodies: DataFrame, articles: DataFrame) -> DataFrame:
    """Cleaned bodies of a day's articles; where one has no body its summary, as a teaser."""
    b = bodies.select("url_hash", clean_body(F.col("body")).alias("text"))
    a = articles.select("url_hash", clean_body(F.col("summary")).alias("teaser"))
    joined = a.join(b, "url_hash", "left")
    return joined.select("url_hash", F.coalesce("text", "teaser").alias("text"), F.when(F.col("text").isNull(), "teaser").otherwise("body").alias("kind")).where("text <> ''")


RECORD = r"<record>(.*?)</record>"


def paper_record(r: str) -> dict:
    """The fields of one record of a harvest page."""
    get = lambda tag: (m[1].strip() if (m := re.search(rf"<{tag}[^>]*>(.*?)</{tag}>", r, re.S)) else None)
    return {"id": get("id"), "title": " ".join((get("title") or "").split()), "created": get("created"), "categories": (get("categories") or "").split()}


def next_token(content: str) -> str | None:
    """The token to go on with."""
    token = re.search(r"<resumptionToken[^>]*>([^<]+)</resumptionToken>", content)
    return token[1] if token else None


def paper_pages(content: str) -> tuple[list[dict], str | None]:
    """Records of a harvest page and the token to go on with."""
    return [paper_record(r) for r in re.findall(RECORD, content, re.S)], next_token(content)
