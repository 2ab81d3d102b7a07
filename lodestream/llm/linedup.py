"""Removal of line chunks that repeat across the corpus.

A text is its lines. Two kinds of chunks are compared. Windows: from each line with words forwards, and from each one
backwards, the shortest stretch that may go by itself (two lines with words and MIN_WORDS words, or LONG_WORDS words).
They depend on nothing outside, and together they cover every line with words of every stretch that may go, wherever
it stands and whatever is around it. And the pieces between borders, where a rolling hash over the hashes of the last
WINDOW lines decides whether one ends after a line, so that the borders depend on what stands there and not on what
was inserted before; a line of LONG_WORDS words or more is a piece of its own. Equal chunks are found by grouping on
their bytes: the hash only shortens the keys of later joins, and where one hash stands for different bytes nothing is
removed. Of equal chunks the first one, by id and place, is the keeper.

What is marked together goes if it may go by itself. Each line that goes stands in a chunk whose bytes stand at an
earlier place, so one copy of everything stays; lines without words beside a chunk stay too.

Bytes are only shuffled where a chunk may repeat: hashes that occur twice set bits of a bitmap of bounded size, which
goes to the tasks. Other chunks that meet a set bit, more of them the larger the corpus, come along and change nothing.
Hot chunks are summed before their shuffle; the join from a hash to its occurrences can be split by Spark.

Defined results: null text stays null; a text that loses all lines becomes empty; a document is an id with a text, so
that rows that share both are one document (equal chunks at equal places stay or go together), and rows of one id, or
without one, that differ in their texts are several, in the order of a hash of the text; a null id comes last among
keepers; other columns are untouched.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow_map
from lodestream.session import cut

#: Lines under the rolling hash; a chunk ends where it is a multiple of this.
WINDOW, DIVISOR = 2, 2
#: Words of a line that is a piece of its own and goes alone, of what goes, and of a piece that is compared at all.
LONG_WORDS, MIN_WORDS, CHUNK_WORDS = 20, 10, 5
#: Bits of the bitmap for each hash that repeats, and of the bitmap at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _enough(words: int, lines: int) -> bool:
    """Whether so many words on so many lines with words may go."""
    return words >= LONG_WORDS or words >= MIN_WORDS and lines >= 2


class Lines:
    """A text's lines with their hashes and numbers of words."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.hashes = [xxhash.xxh3_64_intdigest(x.encode()) for x in self.lines]
        self.words = [len(x.split()) for x in self.lines]

    def chunks(self) -> list[tuple[int, int]]:
        """(first line, line after the last) of each piece, in order and without gaps."""
        out, start, rolling, power = [], 0, 0, pow(_BASE, WINDOW, 1 << 64)
        for i, h in enumerate(self.hashes):
            # polynomial in the last WINDOW hashes: the newest comes in, the oldest goes out
            gone = self.hashes[i - WINDOW] if i >= WINDOW else 0
            rolling = (rolling * _BASE + h - gone * power) & _MASK
            if self.words[i] >= LONG_WORDS:
                if start < i:
                    out.append((start, i))
                out.append((i, i + 1))
                start = i + 1
            elif (rolling >> 32) % DIVISOR == 0:
                out.append((start, i + 1))
                start = i + 1
        if start < len(self.lines):
            out.append((start, len(self.lines)))
        return out

    def windows(self) -> set[tuple[int, int]]:
        """(first line, line after the last) of the shortest stretch from each line with words, either way, that goes."""
        out = set()
        at = [i for i, w in enumerate(self.words) if w]
        for step in (1, -1):
            order = at[::step]
            end = total = 0
            for i, first in enumerate(order):
                while end < len(order) and not _enough(total, end - i):
                    total += self.words[order[end]]
                    end += 1
                if not _enough(total, end - i):
                    break
                low, high = sorted((first, order[end - 1]))
                out.add((low, high + 1))
                total -= self.words[first]
        return out

    def compared(self) -> list[tuple[int, int]]:
        return sorted(self.windows().union((a, b) for a, b in self.chunks() if sum(self.words[a:b]) >= CHUNK_WORDS))

    def goes(self, a: int, b: int) -> bool:
        own = self.words[a:b]
        return _enough(sum(own), sum(w > 0 for w in own))


def _key(chunk: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(chunk.encode())
    return _signed(h >> 64), _signed(h & _MASK)


def _document(id_col: str, text_col: str) -> list:
    """What tells documents from each other: the id, and a hash of the text for rows without one or with the same one."""
    return [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row")]


def chunk_rows(df: DataFrame, id_col: str, text_col: str, may_repeat: Broadcast | None) -> DataFrame:
    """(h1) of the chunks that are compared; or (id, row, start, h1, h2, chunk) of those that may repeat."""
    names = ["h1"] if may_repeat is None else ["id", "row", "start", "h1", "h2", "chunk"]

    def rows(c: dict) -> dict:
        out: dict[str, list] = {n: [] for n in names}
        for i, row, text in zip(c["id"], c["row"], c["text"], strict=True):
            if not text:
                continue
            own = Lines(text)
            for a, b in own.compared():
                chunk = "\n".join(own.lines[a:b])
                h1, h2 = _key(chunk)
                if may_repeat is None:
                    out["h1"].append(h1)
                    continue
                bit = h1 & (64 * len(may_repeat.value) - 1)
                if not int(may_repeat.value[bit >> 6]) >> (bit & 63) & 1:
                    continue
                for name, value in zip(names, (i, row, a, h1, h2, chunk), strict=True):
                    out[name].append(value)
        return out

    schema = "h1 bigint" if may_repeat is None else "id bigint, row bigint, start int, h1 bigint, h2 bigint, chunk string"
    return arrow_map(df.select(*_document(id_col, text_col), F.col(text_col).alias("text")), rows, schema)


def repeat_bitmap(df: DataFrame, id_col: str, text_col: str) -> Broadcast:
    """A bitmap, as 64-bit words, with a bit for the low bits of each hash that occurs twice."""
    twice = cut(chunk_rows(df, id_col, text_col, None).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "line-repeats")
    bits = 64
    while bits < min(MOST_BITS, BITS_EACH * twice.count()):
        bits *= 2
    bit = F.col("h1").bitwiseAND(bits - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    words = twice.groupBy(F.call_function("shiftright", bit, F.lit(6)).alias("w")).agg(F.bit_or(one).alias("v")).toPandas()  # MOST_BITS / 64 rows at most
    bitmap = np.zeros(bits // 64, dtype=np.uint64)
    bitmap[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(bitmap)


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, gone): of each document the places of its repeated chunks that aren't keepers."""
    last = F.lit((1 << 63) - 1)
    place = F.struct(F.coalesce("id", last).alias("id"), "row", "start")
    found = cut(chunk_rows(df, id_col, text_col, repeat_bitmap(df, id_col, text_col)), "line-chunks")
    # grouped by the bytes themselves, with the hash in front
    same = found.groupBy("h1", "h2", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("k")).drop("chunk")
    once = same.groupBy("h1", "h2").agg(F.count("*").alias("variants"), F.sum("n").alias("n"), F.min("k").alias("k")).where("variants = 1 AND n > 1")
    # written, so that the join shuffles both sides itself and Spark can split a hot hash
    once = cut(once.select("h1", "h2", "k"), "line-keepers")
    hits = found.select("id", "row", "start", "h1", "h2").join(once, ["h1", "h2"]).where(place != F.col("k"))
    return hits.groupBy("id", "row").agg(F.collect_set(F.struct("start", "h1", "h2")).alias("gone"))


def without(text: str, gone: list[dict]) -> tuple[str, int, int]:
    """The text without what repeats, and how many stretches and lines went."""
    own, places = Lines(text), {(g["start"], g["h1"], g["h2"]) for g in gone}
    marked = [False] * len(own.lines)
    for a, b in own.compared():
        if (a, *_key("\n".join(own.lines[a:b]))) in places:
            marked[a:b] = [True] * (b - a)
    kept, stretches, n_lines, i = [], 0, 0, 0
    while i < len(marked):
        j = i
        while j < len(marked) and marked[j] == marked[i]:
            j += 1
        if marked[i] and own.goes(i, j):
            stretches, n_lines = stretches + 1, n_lines + j - i
        else:
            kept += own.lines[i:j]
        i = j
    return "\n".join(kept), stretches, n_lines


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its texts cut, and ``removed_chunks`` and ``removed_lines`` (replaced if ``df`` has them)."""
    own = df.drop("removed_chunks", "removed_lines")
    gone = removals(own, id_col, text_col).withColumnsRenamed({"id": "__id", "row": "__row", "gone": "__gone"})
    joined = own.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__row")), "left").drop("__id", "__row")
    kinds, own_columns = dict(own.dtypes), own.columns

    def rows(c: dict) -> dict:
        out = {k: c[k] for k in own_columns}
        texts, n_chunks, n_lines = [], [], []
        for text, g in zip(c[text_col], c["__gone"], strict=True):
            t, x, y = without(text, g) if text and g else (text, 0, 0)
            texts.append(t)
            n_chunks.append(x)
            n_lines.append(y)
        return out | {text_col: texts, "removed_chunks": n_chunks, "removed_lines": n_lines}

    return arrow_map(joined, rows, ", ".join(f"`{k}` {kinds[k]}" for k in own_columns) + ", removed_chunks int, removed_lines int")
