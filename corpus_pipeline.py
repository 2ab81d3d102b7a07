"""From raw documents to token ids in five stages; part of the subpackage llm, which it needs.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the
last one returns counts and digests of token ids. ``run`` writes each stage's result as Parquet to the shared folder
and reads it again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, decontaminate, langid, linedup, simhash
from lodestream.llm.common import table
from lodestream.session import cut

#: A document goes if no language has this share of its windows' probability.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labels, by a network that is trained on them; ``und`` and unclear ones go."""
    net = langid.fit(docs, F.coalesce(langid.remainder("id") != 2, F.lit(False)))
    kept = langid.predict(docs, net, keep=docs.columns, names=("__lang", "__score"))
    return kept.where((F.col("__lang") != langid.UND) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated line chunks; a document that loses all its lines goes, n_chars follows the text."""
    cut_docs = linedup.remove_repeated(docs)
    left = cut_docs.where((F.col("removed_chunks") == 0) | (F.length(F.trim("text")) > 0))
    n_chars = F.when(F.col("removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return left.select(*[n_chars if c == "n_chars" else F.col(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text, encoded and decoded."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Neither the network, the fingerprints' linking nor the merges have an SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
