"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.corpus import articles, table
from lodestream.functions import text as T
from lodestream.registry import registry

query, QUERIES, ORACLES = registry()

_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9가-힣\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def f1_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


_GRAMS = "CASE WHEN length(s) < 3 THEN [s] ELSE list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) END"


@query(f"SELECT id, array_to_string({_GRAMS}, ',') AS grams FROM (SELECT id, replace({_NORM.format('title')}, ' ', '') AS s FROM articles)")
def f2_char_grams(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("id", F.array_join(T.char_grams(F.col("title")), ",").alias("grams"))


_SIM = f"""
f AS (SELECT item_id, unnest({_GRAMS}) AS g FROM (SELECT item_id, replace({_NORM.format('text')}, ' ', '') AS s FROM benchmark)),
h AS (SELECT item_id, ('0x' || substr(md5(g), 17, 16))::UBIGINT AS h FROM f),
b AS (SELECT item_id, i, sum(((h >> i) & 1)::INT) * 2 > count(*) AS set FROM h, range(0, 64) AS r(i) GROUP BY ALL),
sims AS (SELECT item_id, sum(CASE WHEN set THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END)::UBIGINT AS u FROM b GROUP BY item_id)"""


@query(f"WITH {_SIM.strip()} SELECT item_id, printf('%016x', u) AS simhash FROM sims")
def f3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    sims = table(spark, sf, "benchmark").select("item_id", T.title_simhash(F.col("text")).alias("h"))
    return sims.select("item_id", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("simhash"))


@query("SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN '' ELSE substr(sha256(url), 1, 16) END AS url_hash FROM pages")
def f4_url_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.url_hash(F.col("url")).alias("url_hash"))


@query("SELECT conv_id, turn, substr(sha256(conv_id || chr(1) || text), 1, 12) AS pred_id FROM conversations")
def f5_prediction_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.prediction_id(F.col("conv_id").cast("string"), F.col("text")).alias("pred_id"))


@query(r"SELECT id, trim(regexp_replace(lower(title), '[^\w]+', ' ', 'g')) AS key FROM articles")
def f6_title_key(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("id", T.title_key(F.col("title")).alias("key"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)
TOKENS = rf"list_filter(list_transform(regexp_extract_all({{0}}, '[A-Za-z][A-Za-z0-9\-+.]{{{{2,}}}}'), lambda x: regexp_replace(lower(x), '\.+$', '')), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))"


@query(f"SELECT doc_id, array_to_string({TOKENS.format('text').replace('{{2,}}', '{2,}')}, ' ') AS tokens FROM documents")
def f7_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split({_NORM.format('title')}, ' '), lambda x: length(x) >= 2))), ' ') AS tokens FROM articles")
def f8_title_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("id", F.array_join(F.array_sort(T.title_tokens(F.col("title"))), " ").alias("tokens"))


@query(
    r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\-.]*|[가-힣]{2,}'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ('the', 'of')))), ' ') AS keywords FROM conversations"
)
def f9_claim_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.claim_keywords(F.col("text"), ("the", "of"))), " ").alias("keywords"))


@query(
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'link:' ELSE 'text:' END || printf('%04d.%05d', 1000 + page_id % 9000, page_id % 90000) AS ids FROM pages"
)
def f10_paper_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids are put into links (even pages, in the text as well) and texts (odd ones), with versions, and found again."""
    number = F.format_string("%04d.%05d", 1000 + F.col("page_id") % 9000, F.col("page_id") % 90000)
    even = F.col("page_id") % 2 == 0
    link = F.when(even, F.concat(F.lit("https://arxiv.org/abs/"), number, F.lit("v2"))).otherwise(F.col("url"))
    rows = table(spark, sf, "pages").select("page_id", link.alias("u"), F.concat(F.lit("see arXiv: "), number, F.lit("v1 and 2401.00001")).alias("t"))
    return rows.select("page_id", F.array_join(F.transform(T.paper_ids(F.col("u"), F.col("t")), lambda x: F.concat_ws(":", x["where"], x["id"])), " ").alias("ids"))


@query("SELECT event_id, epoch_us(ts)::BIGINT AS us FROM events")
def f11_parse_utc(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return table(spark, sf, "events").select("event_id", F.unix_micros(T.parse_utc(text)).alias("us"))


@query("SELECT l_orderkey, l_linenumber, coalesce(abs(datediff('day', o_orderdate, l_shipdate)), 10000)::INT AS gap FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def f12_day_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", T.day_gap(F.col("l_shipdate"), F.col("o_orderdate")).alias("gap"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, date_trunc('week', o_orderdate)::DATE AS monday, (date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::DATE AS sunday FROM orders")
def f13_iso_week(spark: SparkSession, sf: str) -> DataFrame:
    monday = F.to_date(F.date_trunc("week", "o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", T.iso_week(F.col("o_orderdate")).alias("week"), monday.alias("monday"), F.date_add(monday, 6).alias("sunday"))


@query("SELECT o_orderkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, date_trunc('quarter', o_orderdate)::DATE AS first_day, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS last_day FROM orders")
def f14_quarter(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    first, last = T.quarter_bounds(d)
    return table(spark, sf, "orders").select("o_orderkey", T.quarter_key(d).alias("quarter"), first.alias("first_day"), last.alias("last_day"))


@query(
    r"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM s) SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM n"""
)
def f15_unique_slug(spark: SparkSession, sf: str) -> DataFrame:
    from lodestream.operators.identity import unique_suffix

    return unique_suffix(table(spark, sf, "part").select("p_partkey", T.slug(F.col("p_name")).alias("base")), "base", "p_partkey", "slug").select("p_partkey", "slug")


@query("SELECT event_id, props AS found FROM events")
def f16_balanced_json(spark: SparkSession, sf: str) -> DataFrame:
    noisy = F.concat(F.lit('said {not json} then "x}" '), F.col("props"), F.lit(" } end"))
    return table(spark, sf, "events").select("event_id", T.balanced_json(noisy).alias("found"))


@query(r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\t\n\v\f\r ]+', ' ', 'g')))::INT AS n_chars FROM pages")
def f17_strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.length(T.strip_html(F.col("html"))).alias("n_chars"))


@query(
    """WITH h AS (SELECT doc_id, text, greatest(strpos(lower(text), 'th') - 20, 1) AS s FROM documents)
SELECT doc_id, (CASE WHEN s > 1 THEN '…' ELSE '' END) || substr(text, s, 40) || (CASE WHEN s + 39 < length(text) THEN '…' ELSE '' END) AS snippet FROM h"""
)
def f18_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("TH"), 40).alias("snippet"))


@query(r"SELECT p_partkey, regexp_matches(p_name, '(?i)\bred\s+widget\b') AS has FROM part")
def f19_has_term(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.has_term(F.col("p_name"), F.lit("Red widget")).alias("has"))


@query(
    r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://cdn.test/' || page_id WHEN 1 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/i/' || page_id ELSE NULL END AS image FROM pages"""
)
def f20_image_url(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(F.col("page_id") % 3 == 0, F.format_string('<meta property="og:image" content="//cdn.test/%d">', "page_id")).when(
        F.col("page_id") % 3 == 1, F.format_string("<meta content='/i/%d' name='twitter:image'>", "page_id")
    )
    return table(spark, sf, "pages").select("page_id", T.image_url(F.concat_ws("", tag, "html"), F.col("url")).alias("image"))


@query(r"SELECT DISTINCT p_name AS name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part")
def f21_title_from_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_name").alias("name"), T.title_from_slug(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("title")).distinct()


@query(r"SELECT conv_id, turn, md5(lower(regexp_replace(trim(text), '[\t\n\v\f\r ]+', ' ', 'g'))) AS key FROM conversations")
def f22_collapsed_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.collapsed_key(F.col("text")).cast("binary")).alias("key"))


@query("SELECT doc_id, substr(text, greatest(strpos(text, 'th') - 90, 1), strpos(text, 'th') + 2 + 90 - greatest(strpos(text, 'th') - 90, 1)) AS span FROM documents WHERE contains(text, 'th')")
def f25_around(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.instr("text", F.lit("th"))
    return table(spark, sf, "documents").where(hit > 0).select("doc_id", T.around(F.col("text"), hit, F.lit(2)).alias("span"))


@query("SELECT o_orderkey, floor((datediff('day', DATE '0001-01-01', o_orderdate::DATE) + 1) / 7)::BIGINT AS week FROM orders")
def f26_ordinal_week(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", T.ordinal_week(F.to_date("o_orderdate")).alias("week"))


@query("SELECT event_id, round((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 3600, 6) AS hours FROM events")
def f27_age_hours(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(T.age_hours(F.col("ts"), F.to_timestamp(F.lit("2024-02-01 00:00:00"))), 6).alias("hours"))


@query("SELECT p_partkey, round_even(p_size / 2.0, 0)::DOUBLE AS half_even, floor(p_size / 4.0 * 10 + 0.5) / 10.0 AS half_up FROM part")
def f28_rounding(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", T.half_even(size / 2, 0).alias("half_even"), T.half_up_1(size / 4).alias("half_up"))


@query(
    r"""SELECT DISTINCT p_name AS name, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '-') END AS concept_id, CASE WHEN p_size % 2 = 0 THEN '\b' || p_name || '\b' END AS pattern FROM part"""
)
def f29_approved_pattern(spark: SparkSession, sf: str) -> DataFrame:
    row = F.concat(F.lit("| ["), F.when(F.col("p_size") % 2 == 0, "x").otherwise(" "), F.lit("] "), F.col("p_name"), F.lit(" | note |"))
    concept, pattern = T.approved_pattern(row)
    return table(spark, sf, "part").select(F.col("p_name").alias("name"), concept.alias("concept_id"), pattern.alias("pattern")).distinct()


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f31_json_value(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.json_value(F.col("props"), "k").alias("k"))


@query("SELECT id, '[' || id || '] (' || category || ') ' || title || chr(10) || source_id || chr(10) || summary AS block FROM articles")
def f32_numbered_block(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    return a.select("id", T.numbered_block(F.col("id"), F.col("category"), F.col("title"), F.col("source_id"), F.col("summary")).alias("block"))


@query("SELECT id, lower(title || ' ' || summary || ' ' || source_id) AS hay FROM articles")
def f33_haystack(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("id", T.haystack(F.col("title"), F.col("summary"), F.col("source_id")).alias("hay"))


@query("SELECT p_partkey, CASE WHEN p_size - 25 >= 0 THEN '+' ELSE '' END || (p_size - 25) AS delta FROM part")
def f34_signed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.signed(F.col("p_size") - 25).alias("delta"))
