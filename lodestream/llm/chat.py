"""Conversations formatted by a compiled template, with marks of what a model generates.

Control strings inside texts and roles are escaped by a backslash after their first character, and backslashes by
another one; dropping each escaping backslash gives the text back. The reader takes the formatted text apart again by
its turn marks, piece by piece, so that neither side holds more than one turn.

Conversations are brought together and ordered in Spark's sort, which can spill; a task streams over its rows.

Defined results: null text and null role are empty; rows without a conversation id are one conversation; turns are
ordered by turn (null first), then role, then text; repeated rows are turns each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import small_batches
from lodestream.llm.template import Sink, compile_template

TEMPLATE = (
    "<s>{% for m in messages %}<|{{ m.role | escape_control }}|>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape_control }}{% endgeneration %}{% else %}{{ m.text | escape_control }}{% endif %}"
    "<|end|>\n{% endfor %}"
)
#: What a model or its tokenizer may take for control.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BEGINS = re.compile("(?=(?:" + "|".join(map(re.escape, CONTROL)) + "))(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape_control(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _BEGINS.sub(r"\1\\", text) if "<" in text or "[" in text or "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted text, whole turns only."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith("<|", at):
            raise ValueError("no turn begins here")
        role_end = text.index("|>\n", at)
        end = text.index("<|end|>\n", role_end)
        out.append((unescape(text[at + 2 : role_end]), unescape(text[role_end + 3 : end])))
        at = end + 8
    return out


class Reader(Sink):
    """Reads the output back turn by turn and keeps digests only."""

    def __init__(self) -> None:
        super().__init__()
        self.turns, self.chars, self.loss_chars, self.begun = 0, 0, 0, False
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def pause(self) -> None:
        text = "".join(t for t, _ in self.pieces)
        self.chars += len(text)
        for role, said in read_turns(text if self.begun else text.removeprefix("<s>")):
            self.turns += 1
            self.turns_sha.update(f"{role}\n{said}\n".encode())
        self.begun = True
        for t, generated in self.pieces:
            if generated:
                t = unescape(t)
                self.loss_chars += len(t)
                self.loss_sha.update(t.encode())
        self.pieces, self.size = [], 0


def formatted(messages: list[dict[str, str]], template: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """One conversation's text and the spans under the loss mask."""
    from lodestream.llm.template import render

    return render(template, {"messages": messages}, {"escape_control": escape_control})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            yield from zip(*[part.column(i).to_pylist() for i in range(3)], strict=True)


def _ordered(df: DataFrame) -> DataFrame:
    small_batches(df.sparkSession)
    own = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted (text), loss_spans (array of start and end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            text, spans = formatted([{"role": r, "text": t} for _, r, t in rows], template)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in spans]], kind)], names=["conv_id", "formatted", "loss_spans"])

    return _ordered(df).mapInArrow(run, "conv_id bigint, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def digests(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What is read back from each formatted conversation: counts and digests."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = compile_template(template, {"escape_control": escape_control})
        out: list[tuple] = []
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            sink = Reader()
            write({"messages": ({"role": r, "text": t} for _, r, t in rows)}, sink)
            out.append((conv, sink.turns, sink.turns_sha.hexdigest(), sink.loss_chars, sink.loss_sha.hexdigest(), sink.chars))
            if len(out) == 1000:
                yield _batch(out, names)
                out = []
        if out:
            yield _batch(out, names)

    return _ordered(df).mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if any(v is not None for v in c) else pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
