"""One query opN_<name> for each operator of the subpackage: its whole table, production parameters, full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, chat, decontaminate, html_text, langid, linedup, quality, shards, simhash, topk
from lodestream.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learnt from those whose remainder is not 2."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    own = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(own.unionByName(extra))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents into which a benchmark item leaks: doc_id, item_id, score, start_word, end_word."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the line chunks that stand in an earlier one: doc_id, text, removed_chunks, removed_lines."""
    return linedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 8 shards whose row counts differ by one at most (law ``rows``). Null text: size 1, CRC-32 of nothing."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")
    )
    dealt = shards.shuffle_to_shards(docs, 8, seed=20)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document: doc_id, score, keep, text_score, meta_score."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text by the 50k ranks, encoded and decoded again."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector id against all other rows."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_chat_format, op4_decontaminate, op5_line_dedup, op6_html_extract, op7_shard, op8_quality, op9_bpe, op10_topk)}

_ESCAPED = """replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>')"""

ORACLES: dict[str, str] = {
    "op3_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 13))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op10_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e, row_number() OVER () AS r FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score, q.r AS qr FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 20
""",
}
