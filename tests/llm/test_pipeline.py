"""The pipeline's stages against plain versions of what they keep."""

from __future__ import annotations

import hashlib
import itertools

import public_tokenizers
import pytest

import corpus_pipeline
from lodestream.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append((name, docs.collect(), docs.columns))
    return out


def test_all_but_the_last_stage_keep_the_columns(spark, stages) -> None:
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(columns == want for _, _, columns in stages[:-1]) and [n for n, _, _ in stages] == [n for n, _ in corpus_pipeline.STAGES]


def test_each_stage_does_its_work(spark, stages) -> None:
    from test_llm import plain_components, plain_fingerprint, plain_line_dedup

    kept = {name: {r["doc_id"]: r for r in rows} for name, rows, _ in stages}
    first = kept["language_id"]
    lines = dict(zip(sorted(first), plain_line_dedup([(i, first[i]["text"]) for i in sorted(first)]), strict=True))
    after = kept["line_dedup"]
    assert all(after[i]["text"] == lines[i] for i in after) and all(not lines[i].strip() for i in set(first) - set(after))
    ids = sorted(after)
    names = plain_components([plain_fingerprint(after[i]["text"]) for i in ids], ids)
    assert set(kept["simhash_dedup"]) == {i for i, c in zip(ids, names, strict=True) if i == c}
    bench = {r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = kept["decontamination"]
    assert not any(b in r["text"] for r, b in itertools.product(clean.values(), bench))
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    last = kept["bpe_encoding"]
    assert set(last) == set(clean)
    for i, r in last.items():
        assert r["n_tokens"] == len(enc.encode_ordinary(clean[i]["text"])) and r["decoded_sha256"] == hashlib.sha256(clean[i]["text"].encode()).hexdigest()


def test_run_gives_the_rows_of_the_stages(spark, stages) -> None:
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1]))


def test_stages_take_odd_rows_clashing_columns_and_no_rows(spark) -> None:
    from pyspark.sql import functions as F
    from test_llm import odd

    df = odd(spark).withColumn("score", F.lit("own")).withColumn("fp", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, SF).collect()
        assert all(r["score"] == "own" and r["fp"] == 1 for r in got), name
        assert stage(spark, df.limit(0), SF).count() == 0, name
