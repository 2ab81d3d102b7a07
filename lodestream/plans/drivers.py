"""Queries of collection, backfills, reports, ledgers and composed drivers."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.corpus import articles, mentions, table
from lodestream.functions import text as T
from lodestream.operators import dedupe as dd
from lodestream.operators import drivers as dr
from lodestream.operators import ledger as lg
from lodestream.operators import report as rp
from lodestream.operators import timeseries as ts
from lodestream.plans.graphs import window_edges
from lodestream.plans.timeseries import GRID
from lodestream.registry import registry
from lodestream.session import read_text, shared_dir, write_text_atomic
from lodestream.sources import backfill as bf
from lodestream.sources import boundary as bd
from lodestream.sources import feeds, sinks

query, QUERIES, ORACLES = registry()


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources ------------------------------------------------------------------------------------------------------


@query("SELECT 's' || s_suppkey AS source_id, CASE s_suppkey % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'arxiv' ELSE 'scrape_links' END AS type, CASE WHEN s_suppkey % 4 = 0 THEN 3 ELSE (1 + s_suppkey % 5)::INT END AS trust, CASE WHEN s_suppkey % 2 = 0 THEN 50 ELSE 20 END AS cap FROM supplier")
def s5_source_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The registry's file, written from the suppliers and read back; missing trust is 3, a missing cap 50."""
    root = _root(spark, "registry")
    entry = F.concat(
        F.format_string("- id: s%d  # a source\n  type: %s\n", "s_suppkey", F.element_at(F.array(*map(F.lit, ("rss", "arxiv", "scrape_links"))), (F.col("s_suppkey") % 3 + 1).cast("int"))),
        F.when(F.col("s_suppkey") % 4 != 0, F.format_string('  trust: "%d"\n', 1 + F.col("s_suppkey") % 5)).otherwise(""),
        F.when(F.col("s_suppkey") % 2 == 1, F.lit("  max_results: 20\n")).otherwise(""),
    )
    text = table(spark, sf, "supplier").agg(F.concat_ws("", F.sort_array(F.collect_list(entry))).alias("t")).first()["t"]  # a registry is one file
    write_text_atomic(spark, f"{root}/sources.yaml", "# registry\nsources:\n" + text)
    return bf.source_registry(spark, read_text(spark, f"{root}/sources.yaml"))


@query(r"SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\t\n\v\f\r ]+', ' ', 'g')), 1, 6000) AS body, CASE WHEN page_id % 7 = 3 THEN 'OSError: 404' END AS error FROM pages WHERE page_id % 7 <> 3 UNION ALL SELECT page_id, NULL, 'OSError: 404' FROM pages WHERE page_id % 7 = 3")
def s6_article_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of at most 6000 characters through the caller of services; a page that can't be fetched is marked."""

    def fetch(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["page_id"] % 7 == 3).any():
            raise OSError("404")
        return batch[["page_id", "html"]]

    got = bd.call_in_batches(table(spark, sf, "pages").select("page_id", "html"), fetch, "page_id bigint, html string", "page_id", size=1, tries=1, give_up=1 << 30)
    return got.select("page_id", T.strip_html(F.col("html"), 6000).alias("body"), "error")


@query("SELECT event_id, ts::DATE AS day, event_type FROM events")
def s7_day_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder for each day, its JSON rows read back with the day of their folder."""
    root = _root(spark, "days")
    rows = table(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").alias("d"))
    rows.select("event_id", "event_type", F.col("d").cast("string").alias("day")).write.partitionBy("day").json(root)
    got = spark.read.schema("event_id bigint, event_type string, day date").option("mode", "DROPMALFORMED").json(root)
    return got.select("event_id", "day", "event_type")


@query("SELECT event_id, event_type FROM events")
def s9_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines, each followed by a broken one that goes."""
    root = _root(spark, "jsonl")
    good = F.to_json(F.struct("event_id", "event_type"))
    table(spark, sf, "events").select(F.concat(good, F.lit('\n{"event_id": 1, "event_ty')).alias("value")).write.text(root)
    return feeds.read_jsonl(spark, root, "event_id bigint, event_type string")


@query("SELECT vec_id::VARCHAR AS article_id, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def s11_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed vector lines in two files, the second one with other vectors of the same articles, which lose."""
    root = _root(spark, "vectors")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("article_id"), F.lit("2024-01-01").alias("day"), F.lit("s").alias("source"), F.lit("m").alias("model"), F.size("embedding").alias("dim"), F.col("embedding").alias("vector"))
    rows.coalesce(1).write.option("compression", "gzip").json(f"{root}/a")
    rows.withColumn("vector", F.slice("vector", 1, 1)).coalesce(1).write.option("compression", "gzip").json(f"{root}/b")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return feeds.read_vectors(spark, f"{root}/*").select("article_id", "dim", F.round(total, 4).alias("total"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s12_database_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A table of a database file, in ranges of rows."""
    import os
    import sqlite3

    path = f"{_root(spark, 'database').removeprefix('file:')}.db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_comment TEXT, n_regionkey INTEGER)")
    con.executemany("INSERT INTO nation VALUES (?, ?, '', ?)", [tuple(r) for r in table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])  # 25 rows
    con.commit()
    con.close()
    return bf.read_database(spark, path, "nation", "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT event_id::VARCHAR AS id, ts::DATE AS day FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND event_type IN ('view', 'purchase')")
def s13_harvest(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a service's pages; the harvest stops after two pages and is taken up again from its progress."""
    root, size, ahead = _root(spark, "harvest"), 5_000, 32
    day = F.coalesce(F.to_date("ts").cast("string"), F.lit(""))
    record = F.format_string("<record><id>%d</id><title> T  %d</title><created>%s</created><categories>%s x.%s</categories></record>", "event_id", "event_id", day, "event_type", "event_type")
    rows = table(spark, sf, "events").select(F.floor(F.col("event_id") / size).alias("p"), record.alias("r")).repartitionByRange("p")
    rows.groupBy("p").agg(F.concat_ws("", F.collect_list("r")).alias("xml")).sortWithinPartitions("p").write.parquet(f"{root}/service")
    served = spark.read.schema("p bigint, xml string").parquet(f"{root}/service")
    numbers = [r["p"] for r in served.where("p IS NOT NULL").select("p").orderBy("p").collect()]  # one for each page
    place, held = {p: i for i, p in enumerate(numbers)}, {}

    def fetch(token: str | None) -> str:
        i = place[int(token)] if token else 0
        if numbers and numbers[i] not in held:  # the service reads some pages ahead
            held.clear()
            held.update(served.where(F.col("p").between(numbers[i], numbers[min(i + ahead, len(numbers)) - 1])).collect())
        more = f"<resumptionToken>{numbers[i + 1]}</resumptionToken>" if i + 1 < len(numbers) else "<resumptionToken/>"
        return f"<ListRecords>{held[numbers[i]] if numbers else ''}{more}</ListRecords>"

    bf.harvest(spark, fetch, root, most_pages=2)
    bf.harvest(spark, fetch, root)
    return bf.harvested(spark, root, "2024-01-05", "2024-01-20", ["view", "purchase"]).select("id", "day")


@query("SELECT url, arg_min(title, (snapshot, pos)) AS title FROM (SELECT 'u' || l_partkey AS url, l_shipdate AS snapshot, l_orderkey * 10 + l_linenumber AS pos, 't' || l_orderkey || '.' || l_linenumber AS title FROM lineitem WHERE l_shipdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1996-12-31') GROUP BY url")
def s14_archived_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Items of archived copies within a window, each URL from the first copy that has it."""
    li = table(spark, sf, "lineitem").where(F.to_date("l_shipdate").between("1994-01-01", "1996-12-31"))
    rows = li.select(F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), F.col("l_shipdate").alias("snapshot"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.format_string("t%d.%d", "l_orderkey", "l_linenumber").alias("title"))
    return feeds.snapshot_union(rows).select("url", "title")


_ALIASES = [("widget", r"\bwidget\b"), ("red", r"\bred\w*")]


@query(
    r"""WITH i AS (SELECT substr(sha256('https://x.test/' || id), 1, 16) AS article_id, day, title FROM articles WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND title <> ''),
m AS (SELECT 'widget' AS concept, article_id, day, lower(regexp_extract(title, '(?i)\bwidget\b')) AS match_text FROM i WHERE regexp_matches(title, '(?i)\bwidget\b') UNION ALL SELECT 'red', article_id, day, lower(regexp_extract(title, '(?i)\bred\w*')) FROM i WHERE regexp_matches(title, '(?i)\bred\w*'))
SELECT concept, article_id, day, match_text, 6 AS version FROM m WHERE NOT (concept = 'red' AND month(day) = 3)"""
)
def s15_back_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions in the titles of old items; the ledger has those of ``red`` in March already."""
    a = articles(spark, sf).where("title <> ''")
    items = a.select(F.concat(F.lit("https://x.test/"), F.col("id").cast("string")).alias("url"), "title", "day")
    known = items.where(F.month("day") == 3).select(F.lit("red").alias("concept"), T.url_hash(F.col("url")).alias("article_id"), "day", F.lit(6).alias("version"))
    return bf.back_catalogue(items, _ALIASES, known, "1995-01-01", "1996-06-30", 6).withColumn("match_text", F.lower("match_text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'abstract of ' || p_partkey END AS abstract, p_partkey % 3 <> 0 AS enriched FROM part")
def s32_enrich_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Abstracts of those that have none, 25 ids a request, written where there was nothing."""
    papers = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("abstract"))
    todo = papers.where("abstract IS NULL").select("p_partkey")
    got = bd.call_in_batches(todo, lambda b: pd.DataFrame({"p_partkey": b["p_partkey"], "abstract": "abstract of " + b["p_partkey"].astype(str)}), "p_partkey bigint, abstract string", "p_partkey", size=25)
    patch = got.where("error IS NULL").select("p_partkey", "abstract")
    out = lg.coalesce_update(papers, patch, "p_partkey", ["abstract"])
    return out.join(patch.select("p_partkey", F.lit(True).alias("e")), "p_partkey", "left").select("p_partkey", "abstract", F.coalesce("e", F.lit(False)).alias("enriched"))


@query(
    """WITH m AS (SELECT page_id, page_id % 5 = 4 AS fails FROM pages WHERE page_id % 2 = 0 ORDER BY page_id DESC LIMIT 60)
SELECT count(*) FILTER (NOT fails) AS filled, count(*) FILTER (fails) AS failures, (SELECT count(*) FROM pages WHERE page_id % 2 = 0) - count(*) FILTER (NOT fails) AS missing FROM m"""
)
def s33_backfill_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images for the newest sixty rows without one; failures are counted and stay missing."""
    rows = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 1, F.lit("have")).alias("image"))
    todo = rows.where("image IS NULL").orderBy(F.col("page_id").desc()).limit(60).select("page_id")

    def call(b: pd.DataFrame) -> pd.DataFrame:
        if (b["page_id"] % 5 == 4).any():
            raise OSError("no image")
        return b.assign(image="https://cdn.test/" + b["page_id"].astype(str))

    got = bd.call_in_batches(todo, call, "page_id bigint, image string", "page_id", size=1, tries=1, give_up=1 << 30)
    filled = lg.coalesce_update(rows, got.select("page_id", "image"), "page_id", ["image"])
    n = got.agg(F.sum(F.when(F.col("error").isNull(), 1).otherwise(0)).alias("filled"), F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("failures"))
    return n.crossJoin(filled.where("image IS NULL").agg(F.count("*").alias("missing")))


_REFS = "d AS (SELECT DISTINCT day FROM articles), l AS (SELECT day, CASE WHEN day(day) % 5 = 0 THEN 0 WHEN day(day) % 5 = 1 THEN NULL ELSE day(day) % 5 END AS n FROM d WHERE day(day) % 5 <> 4)"


@query(f"WITH {_REFS} SELECT d.day, coalesce(l.n, 0)::INT AS refs, CASE WHEN l.n IS NULL THEN 'absent' WHEN l.n = 0 THEN 'empty' ELSE 'listed' END AS state FROM d LEFT JOIN l USING (day)")
def s35_reference_status(spark: SparkSession, sf: str) -> DataFrame:
    """Days with a list, an empty one, a broken one (null) or none."""
    days = articles(spark, sf).select("day").distinct()
    n = F.dayofmonth("day") % 5
    lists = days.where(n != 4).select("day", F.when(n == 0, F.array().cast("array<string>")).when(n > 1, F.array_repeat(F.lit("r"), n)).alias("refs"))
    return dr.reference_status(days, lists)


@query(
    """WITH p AS (SELECT DISTINCT l_partkey AS paper, o_orderdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT l_partkey AS paper, o_orderdate::DATE AS day, o_orderpriority LIKE '1%' AS persisted FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'),
f AS (SELECT DISTINCT paper, day FROM r WHERE CASE WHEN day(day) % 2 = 0 THEN persisted ELSE true END)
SELECT paper, day, 'primary' AS kind FROM p UNION ALL SELECT paper, day, 'reference' FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.paper = f.paper AND p.day = f.day)"""
)
def s36_collect_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Even days have a persisted list (of the urgent orders' parts), odd ones are scanned."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("l_partkey").alias("paper"), F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_orderpriority")
    raw = rows.where("o_orderstatus <> 'F'")
    even = F.dayofmonth("day") % 2 == 0
    return dr.collect_papers(rows.where("o_orderstatus = 'F'"), raw.where(even & F.col("o_orderpriority").startswith("1")), raw.where(even).select("day"), raw)


# --- sinks and ledgers --------------------------------------------------------------------------------------------


@query("SELECT 'articles' AS name, count(*) AS n FROM articles UNION ALL SELECT 'suppliers', count(*) FROM supplier UNION ALL SELECT 'nations', count(*) FROM nation")
def s23_archive_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tables written in order, their counts verified and told by a table of the build."""
    root = _root(spark, "archive")
    tables = {"articles": (articles(spark, sf).select("id", "day", "title"), ["id"]), "suppliers": (table(spark, sf, "supplier"), ["s_suppkey"]), "nations": (table(spark, sf, "nation"), ["n_nationkey"])}
    counts = sinks.export_tables(tables, root)
    sinks.verify_counts(spark, root, counts)
    return spark.createDataFrame(list(counts.items()), "name string, n bigint")


@query("SELECT n_name AS file, CASE WHEN n_nationkey % 4 = 0 THEN 'new' ELSE 'changed' END AS state FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey % 5 = 1")
def s26_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Of a manifest the files that the other side lacks or has with other content."""
    n = table(spark, sf, "nation")
    sha = lambda c: F.sha2(c.cast("binary"), 256).alias("sha256")
    here = n.select(F.col("n_name").alias("file"), sha(F.col("n_name")))
    there = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("file"), sha(F.when(F.col("n_nationkey") % 5 == 1, F.lit("old")).otherwise(F.col("n_name"))))
    return sinks.sync_plan(here, there)


_BRIEF = "r AS (SELECT entity, count(*) FILTER ((SELECT max(day) FROM mentions) - day < 7) AS recent, count(*) FILTER ((SELECT max(day) FROM mentions) - day BETWEEN 7 AND 13) AS prior FROM mentions GROUP BY entity), t AS (SELECT *, recent - prior AS delta, row_number() OVER (ORDER BY recent - prior DESC, recent DESC, entity) AS k FROM r)"


@query(f"WITH {_BRIEF} SELECT 0 AS n, '# Brief' AS line UNION ALL SELECT 1, '' UNION ALL SELECT (k + 1)::INT, '- ' || entity || ': ' || recent || ' (' || (CASE WHEN delta > 0 THEN '+' ELSE '' END) || delta || ')' FROM t WHERE k <= 8")
def s34_brief(spark: SparkSession, sf: str) -> DataFrame:
    """The brief's gainers as lines; the file is replaced as one and read again."""
    top = ts.recent_vs_prior(mentions(spark, sf), ["entity"]).orderBy(F.col("delta").desc(), F.col("recent").desc(), "entity").limit(8)
    signed = F.when(F.col("delta") == 0, "0").otherwise(T.signed(F.col("delta")))  # no sign where nothing changed
    line = F.concat(F.lit("- "), "entity", F.lit(": "), F.col("recent").cast("string"), F.lit(" ("), signed, F.lit(")"))
    rows = rp.lines(top, [F.col("delta").desc(), F.col("recent").desc(), F.col("entity")], line, ["# Brief", ""])
    path = f"{_root(spark, 'brief')}/brief.md"
    for said in ("old text", "\n".join(r["line"] for r in rows.orderBy("n").collect())):  # ten lines
        write_text_atomic(spark, path, said)
    return spark.createDataFrame(list(enumerate(read_text(spark, path).split("\n"))), "n int, line string")


@query("WITH t AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL) SELECT 0 AS n, '| o_orderpriority | orders |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT (1 + row_number() OVER (ORDER BY p))::INT, '| ' || p || ' | ' || n || ' |' FROM t")
def s34_audit_table(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate as a table of an audit."""
    t = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))
    return rp.markdown_table(t, [F.col("o_orderpriority")], ["o_orderpriority", "orders"])


@query("WITH t AS (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) SELECT 0 AS n, '<tr><th>r_name</th><th>nations</th></tr>' AS line UNION ALL SELECT row_number() OVER (ORDER BY r_name)::INT, '<tr><td>' || r_name || ' &amp; &lt;all&gt;</td><td>' || n || '</td></tr>' FROM t")
def s31_dashboard_rows(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate as rows of a static page."""
    t = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations"))
    return rp.html_table(t.withColumn("r_name", F.concat("r_name", F.lit(" & <all>"))), [F.col("r_name")], ["r_name", "nations"])


@query("SELECT n_name AS file, 2 AS expected, CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 4 = 0 THEN 1 ELSE 2 END AS got, n_nationkey % 6 <> 0 AND n_nationkey % 4 <> 0 AS ok FROM nation")
def s38_manifest_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Of each expected file the version that the manifest has."""
    n = table(spark, sf, "nation")
    m = n.where("n_nationkey % 6 <> 0").select(F.col("n_name").alias("file"), F.when(F.col("n_nationkey") % 4 == 0, 1).otherwise(2).alias("schema_version"))
    return lg.versions(m, n.select(F.col("n_name").alias("file"), F.lit(2).alias("schema_version")))


@query("SELECT 'articles' AS part, max(day) AS newest, max(published) AS last_run, (SELECT max(day) FROM articles) - max(day) AS lag FROM articles WHERE id % 2 = 0 UNION ALL SELECT 'mentions', max(day), NULL, (SELECT max(day) FROM articles) - max(day) FROM mentions")
def s39_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """The newest day of each part, its last heartbeat and how far it lags behind the newest day of all."""
    a, m = articles(spark, sf), mentions(spark, sf)
    parts = a.where("id % 2 = 0").agg(F.lit("articles").alias("part"), F.max("day").alias("newest"), F.max("published").alias("last_run"))
    parts = parts.unionByName(m.agg(F.lit("mentions").alias("part"), F.max("day").alias("newest"), F.lit(None).cast("timestamp_ntz").alias("last_run")).withColumn("last_run", F.col("last_run").cast(dict(parts.dtypes)["last_run"])))
    return lg.frontier(parts, a.agg(F.max("day").alias("as_of")))


@query("SELECT o_custkey AS cluster_id, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def c6_replace_derived(spark: SparkSession, sf: str) -> DataFrame:
    """A derived table that takes the place of an older one as one step."""
    path, o = f"{_root(spark, 'derived')}/clusters", table(spark, sf, "orders")
    of = lambda rows: rows.groupBy(F.col("o_custkey").alias("cluster_id")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    sinks.replace_table(of(o.where("o_orderstatus = 'F'")), path)
    sinks.replace_table(of(o), path)
    return spark.read.schema("cluster_id bigint, n bigint, top double").parquet(path)


@query("SELECT p_brand AS concept_id, CASE WHEN ascii(substr(p_brand, length(p_brand))) % 2 = 0 THEN 'own ' || p_brand ELSE 'name ' || p_brand END AS canonical_name FROM (SELECT DISTINCT p_brand FROM part)")
def c7_lexicon_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon exported as JSON lines and imported into one that has some of its concepts, which keep their rows."""
    root = _root(spark, "lexicon")
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("concept_id")).distinct()
    lg.export_lexicon({"concepts": brands.withColumn("canonical_name", F.concat(F.lit("name "), "concept_id"))}, root)
    own = brands.where(F.ascii(F.substring("concept_id", -1, 1)) % 2 == 0).withColumn("canonical_name", F.concat(F.lit("own "), "concept_id"))
    return lg.import_lexicon(spark, {"concepts": (own, ["concept_id"])}, root)["concepts"]


@query("SELECT p_brand AS concept_id, CASE WHEN p_brand < 'Brand#3' THEN 1 ELSE 2 END AS first_lexicon_version FROM (SELECT DISTINCT p_brand FROM part)")
def c11_load_seed(spark: SparkSession, sf: str) -> DataFrame:
    """C11: the concepts of a seed, of which some stand in version 1; loaded twice."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("concept_id")).distinct()
    concepts = brands.where("concept_id < 'Brand#3'").select("concept_id", F.col("concept_id").alias("canonical_name"), F.lit(1).alias("first_lexicon_version"))
    versions = spark.createDataFrame([(1, "first", 5)], "version int, note string, concept_count bigint")
    aliases = spark.createDataFrame([], "concept_id string, pattern string, added_version int")
    seed = brands.select("concept_id", F.col("concept_id").alias("canonical_name"), F.lower("concept_id").alias("pattern"))
    once = lg.load_seed(versions, concepts, aliases, 2, "second", seed)
    return lg.load_seed(*once, 2, "second", seed)[1].select("concept_id", "first_lexicon_version")


@query("SELECT p_partkey AS id, 'b' || (p_partkey % 4) AS pattern FROM part WHERE 1 + p_partkey % 3 <= 2")
def c12_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """The aliases that version 2 knows; all must compile."""
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.format_string("b%d", F.col("p_partkey") % 4).alias("pattern"), (1 + F.col("p_partkey") % 3).alias("added_version"))
    own = lg.patterns_of(a, 2)
    lg.check_patterns([("c", r["pattern"]) for r in own.select("pattern").distinct().collect()])  # patterns of a lexicon, some hundred
    return own.select("id", "pattern")


@query("SELECT n_nationkey, n_name FROM nation")
def c13_public_export(spark: SparkSession, sf: str) -> DataFrame:
    """Written only if no text holds a forbidden term."""
    root = _root(spark, "public")
    sinks.public_export(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name", ["secret term"], root)
    return feeds.read_jsonl(spark, root, "n_nationkey int, n_name string")


@query("WITH s AS (SELECT count(*) AS b, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 10 <> 0) AS a FROM orders) SELECT b AS before, a AS after, p AS pruned, (b - p - a) / b < 0.3 AS fine FROM s")
def d8_shrink(spark: SparkSession, sf: str) -> DataFrame:
    """A state that loses some entries beyond those that were pruned."""
    o = table(spark, sf, "orders")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    done = F.col("o_orderstatus") == "F"
    s = o.agg(F.count("*").alias("before"), n(~done & (F.col("o_orderkey") % 10 != 0)).alias("after"), n(done).alias("pruned"))
    return dd.shrinkage(s)


@query("SELECT id, day, 'm' AS model, 2 AS dim, length(title || chr(10) || summary)::DOUBLE AS first FROM articles WHERE summary <> '' AND id % 4 <> 0 ORDER BY day DESC, id LIMIT 1500")
def v1_embed_pending(spark: SparkSession, sf: str) -> DataFrame:
    """V1: vectors of the newest 1500 articles without one; the model is a measure of length."""
    a = articles(spark, sf).select("id", "day", "title", "summary")
    done = a.where("id % 4 = 0").select("id")
    got = bd.embed_pending(a, done, lambda texts: [[float(len(t)), 1.0] for t in texts], "m", chars=1 << 20)
    return got.select("id", "day", "model", "dim", F.col("vector")[0].cast("double").alias("first"))


# --- composed drivers ---------------------------------------------------------------------------------------------


@query(f"WITH {GRID}, s AS (SELECT entity, entity_type, avg(velocity) AS mean, coalesce(stddev_samp(velocity), 0) AS deviation FROM vel GROUP BY ALL) SELECT day, entity, entity_type, velocity, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM vel LEFT JOIN s USING (entity, entity_type)")
def j4_velocity_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = dr.velocity_stats(ts.velocity(ts.daily_counts(mentions(spark, sf))))
    return out.select("day", "entity", "entity_type", "velocity", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


_PANEL = """x AS (SELECT date_trunc('month', day)::DATE AS day, count(DISTINCT article_id) AS x FROM mentions GROUP BY ALL), c AS (SELECT entity, date_trunc('month', day)::DATE AS day, count(DISTINCT article_id) AS n FROM mentions GROUP BY ALL),
s AS (SELECT entity, day, n AS count, n / x AS rate FROM c JOIN x USING (day)), a AS (SELECT entity, count(*) AS active_days FROM s GROUP BY entity HAVING active_days >= 8),
b AS (SELECT entity, count(*) AS burst_days FROM (SELECT *, avg(rate) OVER w AS m, stddev_pop(rate) OVER w AS sd FROM s WINDOW w AS (PARTITION BY entity)) WHERE sd > 1e-12 AND round(rate - m - 2 * sd, 9) > 0 GROUP BY entity),
p AS (SELECT entity, row_number() OVER w AS k, sum(rate) OVER w AS s, sum(rate * rate) OVER w AS q, count(*) OVER z AS n, sum(rate) OVER z AS tot, sum(rate * rate) OVER z AS totq FROM s WINDOW w AS (PARTITION BY entity ORDER BY day), z AS (PARTITION BY entity)),
e AS (SELECT *, round((q - s * s / k) + ((totq - q) - (tot - s) ** 2 / (n - k)), 9) AS sse FROM p WHERE k >= 4 AND n - k >= 4),
l AS (SELECT entity, (tot - s) / (n - k) - s / k AS shift, CASE WHEN totq - tot * tot / n > 1e-12 THEN 1 - sse / (totq - tot * tot / n) ELSE 0 END AS r FROM e QUALIFY row_number() OVER (PARTITION BY entity ORDER BY sse, k) = 1)"""


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf).select("entity", "article_id", F.to_date(F.date_trunc("month", "day")).alias("day"))
    x = m.groupBy("day").agg(F.count_distinct("article_id").alias("x"))
    n = m.groupBy("entity", "day").agg(F.count_distinct("article_id").alias("count"))
    return n.join(x, "day").select("entity", "day", "count", (F.col("count") / F.col("x")).alias("rate"))


@query(f"WITH {_PANEL} SELECT entity, active_days, round(shift, 6) AS shift, round(r, 4) AS sse_reduction, coalesce(burst_days, 0) AS burst_days, coalesce(shift > 0 AND round(r, 9) >= 0.1, false) AS takes_off FROM a LEFT JOIN l USING (entity) LEFT JOIN b USING (entity)")
def m22_panel_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly coverage-robust rates; the threshold is one that these series can meet."""
    out = dr.panel_findings(_panel(spark, sf), ["entity"], "day", "count", "rate", reduction=0.1)
    return out.withColumn("shift", F.round("shift", 6)).withColumn("sse_reduction", F.round("sse_reduction", 4))


@query()
def m22_panel_report(spark: SparkSession, sf: str) -> DataFrame:
    """M22 with mean smoothed velocities (no SQL form; its parts have one or a test)."""
    return dr.panel_report(_panel(spark, sf), "entity", "day", "count", "rate", reduction=0.1)


_LABELLED = "lab AS (SELECT vec_id, ((label + (vec_id % 3 = 0)::INT) % 10)::INT AS label, vec_id % 3 <> 0 AS truth, CASE WHEN vec_id % 10 < 5 THEN 'train' ELSE 'test' END AS split FROM embeddings WHERE vec_id % 5 = 0)"
_SCORED = f"""{_LABELLED}, nv AS (SELECT vec_id, label, list_transform(embedding, lambda x: x / nullif(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))), 0)) AS v FROM embeddings),
pool AS (SELECT * FROM nv WHERE vec_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 25), d AS (SELECT label, i, avg(v[i]) AS x FROM pool, range(1, 65) r(i) GROUP BY ALL), pr AS (SELECT label, list(x ORDER BY i) AS p FROM d GROUP BY label),
sc AS (SELECT lab.vec_id, lab.label, truth, split, round(list_cosine_similarity(v, p), 6) AS score FROM lab JOIN nv USING (vec_id) JOIN pr ON pr.label = lab.label)"""


def _label_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    claimed = ((F.col("label") + F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)) % 10).cast("int")
    labelled = e.where("vec_id % 5 = 0").select("vec_id", claimed.alias("label"), (F.col("vec_id") % 3 != 0).alias("truth"), F.when(F.col("vec_id") % 10 < 5, "train").otherwise("test").alias("split"))
    return dr.label_scores(e, labelled, "label", "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query(f"WITH {_SCORED} SELECT vec_id, label, truth, split, score FROM sc")
def m23_label_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the label set claims another concept than its own; prototypes come from outside it."""
    return _label_scores(spark, sf)


@query(
    f"""WITH {_SCORED}, b AS (SELECT score AS s, count(*) AS n, count(*) FILTER (truth) AS t FROM sc WHERE split = 'train' GROUP BY score), c AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS n, sum(t) OVER (ORDER BY s DESC) AS t FROM b),
f AS (SELECT s AS tau, t / n AS p, t / (SELECT sum(t) FROM b) AS r FROM c WHERE t / (SELECT sum(t) FROM b) >= 0.9 ORDER BY p DESC, r DESC, s DESC LIMIT 1), e AS (SELECT count(*) FILTER (score >= tau AND truth) AS tp, count(*) FILTER (score >= tau) AS n, count(*) FILTER (truth) AS t FROM sc, f WHERE split = 'test')
SELECT tau, round(p, 6) AS train_precision, round(r, 6) AS train_recall, round(tp / n, 6) AS test_precision, round(tp / t, 6) AS test_recall, (SELECT round(avg(score) FILTER (truth), 6) FROM sc) AS true_mean, (SELECT round(avg(score) FILTER (NOT truth), 6) FROM sc) AS false_mean FROM f, e"""
)
def m23_disambiguation(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold of the training half, reported on the other one."""
    out = dr.disambiguation(_label_scores(spark, sf))
    return out.select("tau", *[F.round(c, 6).alias(c) for c in out.columns if c != "tau"])


@query()
def g11_largest_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """G11 of each window's communities (a kernel's; tested against a plain model)."""
    from lodestream.operators import graph as gr

    return dr.largest_fraction(gr.communities(window_edges(spark, sf), "win"), "win")


_WINS = "k AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM mentions)), w AS (SELECT ((k - 1) // 56)::BIGINT AS win, min(day) AS lo, max(day) AS hi FROM k GROUP BY ALL)"


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return ts.active_day_windows(mentions(spark, sf), 56).select("win", F.col("first_day").alias("lo"), F.col("last_day").alias("hi"))


@query(f"WITH {_WINS}, p AS (SELECT l_partkey AS paper, min(o_orderdate::DATE) AS day, l_partkey % 4 = 0 AS again FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey) SELECT win, round(coalesce(avg(again::INT::DOUBLE), 0), 6) AS share FROM w LEFT JOIN p ON p.day BETWEEN lo AND hi GROUP BY win")
def g12_window_share(spark: SparkSession, sf: str) -> DataFrame:
    """The share of papers that are announced again, by window of their first day; 0 for a window without papers."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    papers = rows.groupBy("l_partkey").agg(F.min(F.to_date("o_orderdate")).alias("day"))
    return dr.window_share(papers, _windows(spark, sf), F.col("l_partkey") % 4 == 0).select("win", F.round("share", 6).alias("share"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf).select("article_id", "day", "entity").distinct()
    return m.withColumnRenamed("entity", "a").join(m.select("article_id", F.col("entity").alias("b")), "article_id").where("a < b")


@query()
def g12_panel_trends(spark: SparkSession, sf: str) -> DataFrame:
    """The trend of modularity against its null on the whole panel, without what is announced again, and with only that."""
    wins = _windows(spark, sf)
    days = wins.select("win", F.explode(F.sequence("lo", "hi")).alias("day"))
    again = F.col("article_id") % 4 == 0
    return dr.panel_trends(_pairs(spark, sf), days, {"full": F.lit(True), "originals": ~again, "again": again})


@query()
def m24_network_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Trends over windows of raw modularity, z, modularity at fixed density, and number of communities."""
    wins = _windows(spark, sf)
    days = wins.select("win", F.explode(F.sequence("lo", "hi")).alias("day"))
    from lodestream.operators import graph as gr

    return dr.network_trends(dr.network_snapshots(gr.windowed_edges(_pairs(spark, sf).select("day", "a", "b"), days), "win"), "win")


@query()
def m24_life_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Births, deaths, splits and merges of communities over all windows."""
    from lodestream.operators import graph as gr

    return dr.life_totals(gr.communities(window_edges(spark, sf), "win"), "win")
