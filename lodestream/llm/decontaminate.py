"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and marks, lower-cased. The score of a place is the best local alignment's (MATCH,
MISMATCH, GAP) of an item's words with the text's; an item leaks where it reaches ``need``: THRESHOLD of the item's
score against itself, and LEAST points at least (a shorter item whole).

Seeds are word pairs: of two words of an item that follow one another, or have one word between them, and stand so in
the text. Whatever is changed, an alignment of ``need`` points has at least need / 2 - 1 steps from one matched word
to the next that cost one point at most, and each of them is such a pair (its cost is twice the matches less the
points, and a step without a pair costs two). So the commonest places of an item, by the pairs' counts over the whole
corpus, can go without a seed, as many as leave a leak MET seeds or all that it has. Seeds join texts to items; a text
with fewer of an item's seeds is out, and a place around seeds is aligned if it has pairs enough of the item, common
ones counted too. What is found is what alignments of all texts with all items would find.

The texts are read once: their words are written as numbers (two bytes a word for vocabularies of items that fit), with
the counts of the items' pairs; from these the seeds are chosen, and the numbers are searched and aligned. Nothing is
joined within a group of documents, so copies and common passages cost what their rows cost. The test items go to the
tasks in parts of PART_CHARS characters, so that what is sent is bounded whatever the benchmark's size, at a pass over
the texts for each part.

Defined results: items whose words are equal count once, under their least id; an item of one word leaks into texts
that are this word and nothing else; items without words, and null items, leak nowhere; null texts hold nothing; for a
document with several places of an item the best one is returned, the first where they tie (rows of one id are one
document); null ids are returned as null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import SLICE, arrow_map, small_batches
from lodestream.session import cut

WORD, WORD_WITHOUT_MARKS, MARK = regex.compile(r"[\p{L}\p{N}\p{M}]+"), re.compile(r"[^\W_]+"), regex.compile(r"\p{M}")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Of an item's own score. Unrelated texts reach 0.2; copies with a share c of their words changed about 1 - 1.5 c, so
#: those with four tenths changed 0.4.
THRESHOLD = 0.35
#: Points that an item of any length needs, or all of its own: six words in a row.
LEAST = 12
#: Seeds that a leak has at least, if its points ask for so many pairs.
MET = 3
PART_CHARS = 4_000_000
#: Words that are searched at one time, about.
BLOCK = 300_000


def words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return (WORD_WITHOUT_MARKS if low.isascii() or not MARK.search(low) else WORD).findall(low)


def need(n: int) -> int:
    """The points from which an item of ``n`` words leaks."""
    return max(math.ceil(THRESHOLD * MATCH * n - 1e-9), min(LEAST, MATCH * n))


def least_pairs(n: int) -> int:
    """How many places of an item of ``n`` words are pairs in any leak of it."""
    return math.ceil(need(n) / 2) - 1


class Items:
    """Distinct test items of a part: their words as numbers, and their pairs."""

    def __init__(self, rows: list[tuple[int, list[str]]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        self.single: dict[int, int] = {}  # word -> item
        for item, w in sorted(rows):
            numbers = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], dtype=np.int64)
            if len(w) == 1:
                self.single[int(numbers[0])] = item
            elif len(w) > 1:
                self.ids.append(item)
                self.words.append(numbers)
        self.base = len(self.vocabulary) + 1
        keys = [np.concatenate([self.keys(w, 1), self.keys(w, 2)]) for w in self.words]
        self.pairs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
        #: For each item and place, the pairs that begin there: with the next word, and the one after it (-1: none).
        self.steps = []
        for w, k in zip(self.words, keys, strict=True):
            found = np.searchsorted(self.pairs, k)
            second = np.full(len(w) - 1, -1)
            second[: len(w) - 2] = found[len(w) - 1 :]
            self.steps.append(np.stack([found[: len(w) - 1], second], axis=1))
        #: A bit for the low bits of each pair's hash: most pairs of a text end here.
        self.bits = 1 << max(10, int(16 * len(self.pairs)).bit_length())
        self.may = np.zeros(self.bits, dtype=bool)
        self.may[self.slot(self.pairs)] = True

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.bits - 1)

    def keys(self, w: np.ndarray, gap: int) -> np.ndarray:
        return w[:-gap] * self.base + w[gap:]

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The words of texts as numbers (-1 for those of no item), BLOCK of them at a time, and where each text begins.

        Two numbers -1 part a text from the next one, so that no pair reaches across; the last start is past the end.
        """
        get, numbers, starts = self.vocabulary.get, [], [0]
        for text in texts:
            numbers += [get(x, -1) for x in words(text)]
            numbers += (-1, -1)
            starts.append(len(numbers))
            if len(numbers) >= BLOCK:
                yield np.array(numbers, dtype=np.int64), np.array(starts)
                numbers, starts = [], [0]
        if len(starts) > 1:
            yield np.array(numbers, dtype=np.int64), np.array(starts)

    @property
    def kind(self) -> str:
        """What a written word takes: its number from one, zero for those of no item."""
        return "<u2" if len(self.vocabulary) < (1 << 16) - 1 else "<u4"

    def written_blocks(self, rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same blocks from written words."""
        parts, starts, gap = [], [0], np.full(2, -1, dtype=np.int64)
        for row in rows:
            w = np.frombuffer(row, dtype=self.kind).astype(np.int64) - 1
            parts += (w, gap)
            starts.append(starts[-1] + len(w) + 2)
            if starts[-1] >= BLOCK:
                yield np.concatenate(parts), np.array(starts)
                parts, starts = [], [0]
        if parts:
            yield np.concatenate(parts), np.array(starts)

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the items' pairs in numbered words, by place."""
        places, pairs = [], []
        for gap in (1, 2):
            if len(w) <= gap or not len(self.pairs):
                continue
            at = np.flatnonzero((w[:-gap] >= 0) & (w[gap:] >= 0))
            k = w[at] * self.base + w[at + gap]
            may = self.may[self.slot(k)]
            at, k = at[may], k[may]
            n = np.minimum(np.searchsorted(self.pairs, k), len(self.pairs) - 1)
            found = self.pairs[n] == k
            places.append(at[found])
            pairs.append(n[found])
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at, n = np.concatenate(places), np.concatenate(pairs)
        order = np.argsort(at, kind="stable")
        return at[order], n[order]


class Seeds:
    """The places of items that are looked for, by pair: of pair p, ``item`` and ``place`` from first[p] to first[p + 1]."""

    def __init__(self, items: Items, counts: np.ndarray) -> None:
        pair, item, place, self.met = [], [], [], []
        for k, (w, steps) in enumerate(zip(items.words, items.steps, strict=True)):
            common = counts[steps[:, 0]] + np.where(steps[:, 1] >= 0, counts[steps[:, 1]], 0)
            n_pairs = least_pairs(len(w))
            self.met.append(min(MET, n_pairs))
            kept = np.argsort(common, kind="stable")[: len(steps) - n_pairs + self.met[-1]]
            for j in (0, 1):
                own = kept[steps[kept, j] >= 0]
                pair.append(steps[own, j])
                item.append(np.full(len(own), k))
                place.append(own)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        pairs = join(pair)
        order = np.argsort(pairs, kind="stable")
        self.item, self.place = join(item)[order], join(place)[order]
        self.first = np.searchsorted(pairs[order], np.arange(len(items.pairs) + 1))

    def candidates(self, at: np.ndarray, pairs: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(text, item, places where it would begin, in order) of the texts with seeds enough of an item."""
        n = self.first[pairs + 1] - self.first[pairs]
        if not n.sum():
            return []
        seed = np.repeat(self.first[pairs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, place, at = self.item[seed], self.place[seed], np.repeat(at, n)
        text = np.searchsorted(starts, at, side="right") - 1
        order = np.lexsort((at - place, item, text))
        item, place, at, text = item[order], place[order], at[order], text[order]
        border = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0), [True]]))
        enough = np.flatnonzero(np.diff(border) >= np.array(self.met)[item[border[:-1]]])
        return [(int(text[a]), int(item[a]), (at - place)[a:b]) for a, b in zip(border[enough].tolist(), border[enough + 1].tolist(), strict=True)]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local score of ``a`` in ``b`` and the place after its end in ``b``; -1 matches nothing."""
    steps = np.arange(len(b) + 1) * -GAP
    row, best, end = np.zeros(len(b) + 1, dtype=np.int64), 0, 0
    for x in a:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where((b == x) & (x >= 0), MATCH, MISMATCH))
        row = np.maximum.accumulate(new + steps) - steps  # gaps along b
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j
    return best, end


def align(items: Items, seeds: Seeds, w: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, item id, score, first word, word after the last) for the items that leak into the texts of a block."""
    out = []
    if items.single:
        for t in np.flatnonzero(np.diff(starts) == 3).tolist():
            if (one := items.single.get(int(w[starts[t]]))) is not None:
                out.append((t, one, 1.0, 0, 1))
    at, pairs = items.hits(w)
    for t, k, begin in seeds.candidates(at, pairs, starts) if len(at) else ():
        own, first, past = items.words[k], int(starts[t]), int(starts[t + 1]) - 2
        points, n_pairs, best = need(len(own)), least_pairs(len(own)), None
        # an alignment inserts no more words than its points allow, so none reaches beyond these windows
        slack = MATCH * len(own) - points
        for near in np.split(begin, np.flatnonzero(np.diff(begin) > 2 * slack + len(own)) + 1):
            low, high = max(first, int(near[0]) - slack), min(past, int(near[-1]) + len(own) + slack)
            a, b = np.searchsorted(at, (low, high))
            if b - a < n_pairs or np.isin(items.steps[k], pairs[a:b]).any(axis=1).sum() < n_pairs:
                continue
            score, end = smith_waterman(own, w[low:high])
            if score >= points and (best is None or score > best[0]):
                back = smith_waterman(own[::-1], w[low : low + end][::-1])[1]
                best = (score, low + end - back - first, low + end - first)
        if best:
            out.append((t, items.ids[k], best[0] / (MATCH * len(own)), best[1], best[2]))
    return out


def numbered(df: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(id, words) of the texts that have pairs enough for the least item, and (pair, n) counts of the pairs of all texts.

    A task ends with a row for each pair that it has met.
    """
    small_batches(df.sparkSession)
    n_pairs, fewest = len(items.pairs), min((least_pairs(len(w)) for w in items.words), default=1 << 62)
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def batch_of(*columns: list | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["id", "words", "pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, dtype=np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part, before = batch.slice(first, SLICE), 0
                ids = part.column(0).to_pylist()
                for w, starts in items.blocks(part.column(1).to_pylist()):
                    at, pairs = items.hits(w)
                    total += np.bincount(pairs, minlength=n_pairs)
                    enough = np.diff(np.searchsorted(at, starts)) >= fewest
                    if items.single:
                        enough |= np.diff(starts) == 3
                    keep, code = np.flatnonzero(enough).tolist(), (w + 1).astype(items.kind)
                    none = [None] * len(keep)
                    yield batch_of([ids[before + t] for t in keep], [code[starts[t] : starts[t + 1] - 2].tobytes() for t in keep], none, none)
                    before += len(starts) - 1
        seen = np.flatnonzero(total)
        none = [None] * len(seen)
        yield batch_of(none, none, seen, total[seen])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, words binary, pair bigint, n bigint")


def pair_counts(held: DataFrame, items: Items) -> np.ndarray:
    found = held.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # a row for each pair of the part's items, at most
    counts = np.zeros(len(items.pairs), dtype=np.int64)
    counts[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, score, start_word, end_word) for each document and item that leaks into it."""
    named = lambda c: {"item": c["item"], "words": [" ".join(words(t)) for t in c["text"]]}
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    # items of equal words are one; what they are dealt to parts by is their words
    distinct = cut(arrow_map(tests, named, "item bigint, words string").where("words <> ''").groupBy("words").agg(F.min("item").alias("item")), "leak-items")
    size = distinct.agg(F.sum(F.length("words")).alias("n")).first()["n"] or 0
    parts, out = -(-size // PART_CHARS), None
    for part in range(parts):
        own = distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part)
        found = _part_leaks(df, Items([(r["item"], r["words"].split(" ")) for r in own.collect()]), id_col, text_col)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return df.sparkSession.createDataFrame([], f"`{id_col}` bigint, item_id bigint, score double, start_word bigint, end_word bigint")
    best = out.groupBy("id", "item_id").agg(F.max(F.struct("score", (-F.col("start_word")).alias("s"), "end_word")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", F.col("b.score").alias("score"), (-F.col("b.s")).alias("start_word"), F.col("b.end_word").alias("end_word"))


def _part_leaks(df: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    held = cut(numbered(df, items, id_col, text_col), "leak-words")
    seeds = Seeds(items, pair_counts(held, items))

    def rows(c: dict) -> dict:
        out: dict[str, list] = {"id": [], "item_id": [], "score": [], "start_word": [], "end_word": []}
        before = 0
        for w, starts in items.written_blocks(c["words"]):
            for t, *leak in align(items, seeds, w, starts):
                for name, value in zip(out, (c["id"][before + t], *leak), strict=True):
                    out[name].append(value)
            before += len(starts) - 1
        return out

    return arrow_map(held.where("words IS NOT NULL").select("id", "words"), rows, "id bigint, item_id bigint, score double, start_word bigint, end_word bigint")


def remove_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` into whose document no item leaks."""
    bad = leaks(df, benchmark, id_col, text_col).select(F.col(id_col).alias("__bad")).distinct()
    return df.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")
