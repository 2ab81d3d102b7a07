"""The registered queries on the smallest tables, against plain versions of their results."""

from __future__ import annotations

import html
import itertools
import math
import zlib
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import plain_co_training, plain_sw

from lodestream.llm import decontaminate, langid, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def table(spark, name: str) -> list:
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_op1_predicts_held_out_documents(spark) -> None:
    lang = {r["doc_id"]: r["lang"] for r in table(spark, "documents")}
    got = queries.op1_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != langid.UND]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_op4_equals_all_alignments(spark) -> None:
    items = {r["item_id"]: decontaminate.words(r["text"]) for r in table(spark, "benchmark") if r["text"]}
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.op4_decontaminate(spark, SF).collect()}
    short = [r for r in table(spark, "documents") if len(r["text"] or "") < 4000]
    for r, (i, w) in itertools.product(short, items.items()):
        d = decontaminate.words(r["text"])
        if len(set(d) & set(w)) * 2 < decontaminate.need(len(w)) - 2 * (len(w) - len(set(w))):
            continue  # too few words in common for any alignment
        code = {x: n for n, x in enumerate(dict.fromkeys(w))}
        points, _ = decontaminate.smith_waterman(np.array([code[x] for x in w]), np.array([code.get(x, -1) for x in d]))
        assert (points >= decontaminate.need(len(w))) == ((r["doc_id"], i) in found)
        if (r["doc_id"], i) in found:
            assert found[r["doc_id"], i] == pytest.approx(points / (2 * len(w)))
            assert plain_sw([code[x] for x in w], [code.get(x, -1) for x in d][:400]) <= points
    assert found


class Article(HTMLParser):
    """The blocks of a page's article, as these pages are made: one article element, blocks that end with the next tag of one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.text = 0, [], ""

    def flush(self) -> None:
        if said := " ".join(self.text.split()):
            self.blocks.append(said)
        self.text = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag == "article"
        if tag == "br":
            self.text += " " if self.depth else ""
        elif tag not in ("b", "i", "a", "em", "strong", "span"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.text += data


def test_op6_gives_the_articles(spark) -> None:
    pages = {r["page_id"]: r["html"] or "" for r in table(spark, "pages")}
    got = {r["page_id"]: r for r in queries.op6_html_extract(spark, SF).collect()}
    assert set(got) == set(pages) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    for i, page in pages.items():
        p = Article()
        p.feed(page)
        p.flush()
        assert got[i]["text"] == "\n".join(p.blocks), html.escape(page[:200])


def test_op7_deals_rows_evenly(spark) -> None:
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, "documents")}
    got = queries.op7_shard(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {len(docs) // 8, -(-len(docs) // 8)}
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_op8_equals_plain_co_training(spark) -> None:
    rows = [(r["doc_id"], r["text"] or "", r["source"], r["lang"]) for r in table(spark, "documents")]
    labels = {r["doc_id"]: float(r["quality"]) for r in table(spark, "labels")}
    part = F.xxhash64(F.lit("quality"), "id").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    held = {r["id"] for r in spark.createDataFrame([(i,) for i in labels], "id bigint").where(part < 0.25).collect()} & {i for i, *_ in rows}
    known = {i: y for i, y in labels.items() if i in {i for i, *_ in rows}}
    want = plain_co_training(rows, known, held)
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, SF).collect()}
    assert set(got) == set(want)
    assert all((got[i]["score"], got[i]["text_score"], got[i]["meta_score"]) == pytest.approx(want[i], abs=1e-6) for i in want)
    assert math.isclose(np.mean([r["keep"] for r in got.values()]), np.mean([w[0] >= 0.5 for w in want.values()]))
