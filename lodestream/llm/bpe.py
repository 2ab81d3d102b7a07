"""Byte-level BPE encoding and decoding by a local rank file.

The tiktoken library does the merges. Long texts are first cut by a regular expression at safe boundaries, places
where no match of the splitting pattern can reach across, so that the ids are those of the whole text. Runs of white space
of RUN characters and more, which the library's matcher can't take (its stack is bounded), are matched here by the
pattern's own rule: all but the last character of a run that something follows, the whole of a run that ends the text.
Decoding joins the raw bytes of the ids, which need not be valid UTF-8 one by one.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; repeated rows are
encoded each for itself; columns other than those named are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow_map

#: A letter or digit, then a space or a line feed: every alternative of the pattern ends between the two.
SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])")
#: Characters of a piece, about, and of a run of white space that is a piece of its own.
PIECE, RUN = 20_000, 1_000


@functools.cache
def long_spaces(run: int) -> re.Pattern:
    """Runs of white space as the library's matcher knows it (Python's own class has four control characters more)."""
    return re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{run},}}")


@functools.cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, one for each Python worker and file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at the first safe boundary after every ``size`` characters; a run without one stays whole."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while (cut := SAFE.search(text, start + size)) and cut.start() < len(text):
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode(enc: tiktoken.Encoding, text: str | None, size: int = PIECE, run: int = RUN) -> list[int]:
    """The ids of a whole text. Expects a pattern of which only ``\\s+(?!\\S)|\\s+`` match white space, and others one space before them."""
    if not text:
        return []
    if len(text) <= min(size, run):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for m in long_spaces(run).finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if start < m.start():
            ids += _encode_pieces(enc, text[start : m.start()], size)
        ids += enc._encode_single_piece(text[m.start() : end])
        start = end
    return ids + _encode_pieces(enc, text[start:], size)


def _encode_pieces(enc: tiktoken.Encoding, text: str, size: int) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, size) for i in enc.encode_ordinary(p)]


def decode(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    return enc.decode_bytes(ids)


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: its id and ``ids``, the token ids of its text."""

    def rows(c: dict) -> dict:
        enc = encoding(path, pattern)
        return {id_col: c["id"], "ids": [encode(enc, t) for t in c["text"]]}

    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, f"`{id_col}` bigint, ids array<int>")


def decode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row for each row of ``df``: its id and ``bytes``, the joined bytes of its ids (null: none)."""

    def rows(c: dict) -> dict:
        enc = encoding(path, pattern)
        return {id_col: c["id"], "bytes": [decode(enc, ids or []) for ids in c["ids"]]}

    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), rows, f"`{id_col}` bigint, bytes binary")


@functools.cache
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass; returns counts and digests of both, so that no ids are shuffled."""

    def rows(c: dict) -> dict:
        enc = encoding(path, pattern)
        says = _decimals(enc.n_vocab)
        n, ids_sha, back_sha = [], [], []
        for t in c["text"]:
            ids = encode(enc, t)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join([says[i] for i in ids]).encode()).hexdigest())
            back_sha.append(hashlib.sha256(decode(enc, ids)).hexdigest())
        return {id_col: c["id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": back_sha}

    schema = f"`{id_col}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, schema)
