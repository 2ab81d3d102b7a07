"""Quality classifier by co-training of two views.

The text view sees what a document says: hashed words, and measures of its characters and words in bins. The metadata
view sees what is known about it without its words: source, language, and its sizes (characters, lines, characters a
line) in bins. Both are naive Bayes classifiers, whose training is counting: exact whole numbers that tasks sum up, so
that the result doesn't depend on how rows are dealt, and that cover as many documents as there are.

First both views learn from the labelled documents. In each round all documents without a label are read: those of
which one view is sure, by its calibrated probability, are counted under that label in the other view, which so learns
from labelled documents and from all that its teacher is sure of at that round. Calibration is a logistic regression
of a view's log odds on labelled documents that neither view learns from (a fourth of them, by a hash of the id, but
HELD at most, the one bounded sample). The calibrated log odds are added, weighted by how well each view ranks
those documents. All documents are scored, over their whole texts.

Defined results: null text is empty; null or unseen source and language say nothing; without labels of both kinds
every score is 0.5; labels of one id are averaged and 0.5 counts as bad; repeated rows get equal scores and count each;
a null id is scored and has no label.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import SLICE, arrow_map, small_batches
from lodestream.session import cut

#: Labelled documents that calibration takes, at most, about.
HELD = 2_000
#: Rounds of exchange, and the calibrated probability from which a view is sure.
ROUNDS, SURE = 3, 0.95
KEEP = 0.5
#: Labels up to which they go to the tasks; beyond, documents are joined with them once, as a written table.
SENT_LABELS = 4_000_000
WORD_BITS, NAME_BITS = 12, 10
#: A document's words share this among them, in whole numbers.
MASS = 1 << 16
#: What each bin, and each word, has been seen before it is.
BIN_PRIOR, WORD_PRIOR = 1.0, 0.05 * MASS
#: Lower ends of the bins of the text view's measures, and of the sizes.
_SHARES = (0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5)
_BINS = {"upper": _SHARES, "symbols": _SHARES, "digits": _SHARES, "stops": _SHARES, "repeated": (0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8), "letters": (2, 3, 4, 5, 6, 8, 12), "words": (1, 5, 20, 60, 200, 600, 2000)}
_SIZES = (1, 64, 256, 1024, 4096, 16384, 65536)
_TEXT_BINS, _META_BINS = 8 * len(_BINS), 8 * 3 + 2 * (1 << NAME_BITS)

_UPPER, _LOWER, _DIGIT, _SPACE = (np.array([chr(i) in s if i < 128 else False for i in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \n\t\r"))
_HIGH = np.arange(256) >= 128
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,'?;:-"])


def text_view(text: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The bins of the measures, and the hashed words with their shares of MASS."""
    words = text.lower().split()
    chars = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    size, n = max(1, int(chars.sum())), max(1, len(words))
    upper, stops, digits = (int(chars[x].sum()) for x in (_UPPER, _STOP, _DIGIT))
    letters = upper + int(chars[_LOWER].sum()) + int(chars[_HIGH].sum())
    symbols = size - letters - digits - stops - int(chars[_SPACE].sum())
    measures = (upper / max(1, letters), symbols / size, digits / size, stops / size, 1 - len(set(words)) / n, size / n, len(words))
    bins = [8 * i + int(np.searchsorted(ends, x, side="right")) for i, (ends, x) in enumerate(zip(_BINS.values(), measures, strict=True))]
    crc = zlib.crc32
    buckets, counts = np.unique(np.array([crc(w) for w in words], dtype=np.int64) & ((1 << WORD_BITS) - 1), return_counts=True)
    return bins, buckets, counts * MASS // n


def meta_view(text: bytes, source: str | None, lang: str | None) -> list[int]:
    """The bins of the sizes, then source and language by hash."""
    lines = text.count(b"\n") + 1
    out = [8 * i + int(np.searchsorted(_SIZES, x, side="right")) for i, x in enumerate((len(text), lines, len(text) // lines))]
    for i, value in enumerate((source, lang)):
        if value is not None:
            out.append(24 + (i << NAME_BITS) + zlib.crc32(value.encode()) % (1 << NAME_BITS))
    return out


#: Places of the views in one array of counts: documents; bins of the text view; words; bins of the metadata view.
_TEXT, _WORDS, _META = 1, 1 + _TEXT_BINS, 1 + _TEXT_BINS + (1 << WORD_BITS)
_SIZE = _META + 1 + _META_BINS


class Counts:
    """Whole numbers for each label: documents and features of the text view, then those of the metadata view."""

    def __init__(self, n: np.ndarray | None = None) -> None:
        self.n = np.zeros((2, _SIZE), dtype=np.int64) if n is None else n

    def add_text(self, y: int, seen: tuple[list[int], np.ndarray, np.ndarray]) -> None:
        bins, buckets, shares = seen
        self.n[y, 0] += 1
        self.n[y, [_TEXT + b for b in bins]] += 1
        self.n[y, _WORDS + buckets] += shares

    def add_meta(self, y: int, bins: list[int]) -> None:
        self.n[y, _META] += 1
        self.n[y, [_META + 1 + b for b in bins]] += 1


@dataclass
class Model:
    #: Log odds of each bin and word, in the places of Counts; whether there are labels of both kinds.
    weights: np.ndarray
    #: Slopes and offset of the log odds of each view, and the views' parts in the sum.
    text: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    meta: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    parts: tuple[float, float] = (0.5, 0.5)

    @staticmethod
    def of(counts: Counts) -> Model:
        n, w = counts.n.astype(float), np.zeros(_SIZE)
        for first, size, documents in ((_TEXT, 8 * len(_BINS), 0), (_META + 1, _META_BINS, _META)):
            # a bin against the documents of its label, so that features with many bins are as any other
            p = (n[:, first : first + size] + BIN_PRIOR) / (n[:, [documents]] + 8 * BIN_PRIOR)
            w[first : first + size] = np.log(p[1] / p[0])
        own = n[:, _WORDS : _WORDS + (1 << WORD_BITS)] + WORD_PRIOR
        own /= own.sum(axis=1, keepdims=True)
        w[_WORDS : _WORDS + (1 << WORD_BITS)] = np.log(own[1] / own[0])
        # what no label has been seen with says nothing
        w[n.sum(axis=0) == 0] = 0
        return Model(w)

    def text_odds(self, seen: tuple[list[int], np.ndarray, np.ndarray]) -> tuple[float, float]:
        """Of the measures, and of the words: the mean of their log odds."""
        bins, buckets, shares = seen
        return float(self.weights[[_TEXT + b for b in bins]].sum()), float(self.weights[_WORDS + buckets] @ shares) / MASS

    def meta_odds(self, bins: list[int]) -> float:
        return float(self.weights[[_META + 1 + b for b in bins]].sum())

    def odds(self, text: tuple, meta: list[int]) -> tuple[float, float]:
        """The calibrated log odds of both views."""
        return float(self.text[:2] @ self.text_odds(text) + self.text[2]), float(self.meta[0] * self.meta_odds(meta) + self.meta[1])

    def calibrated(self, held: list[tuple]) -> Model:
        """With slopes, offsets and parts from (text view, bins of the metadata view, label) rows."""
        y = np.array([t for _, _, t in held])
        x = np.array([self.text_odds(a) for a, _, _ in held]), np.array([[self.meta_odds(b)] for _, b, _ in held])
        text, meta = (logistic(v, y) for v in x)
        skill = [max(auc(v @ c[:-1], y) - 0.5, 0.0) ** 2 for v, c in zip(x, (text, meta), strict=True)]
        total = sum(skill)
        return Model(self.weights, text, meta, (skill[0] / total, skill[1] / total) if total else (0.5, 0.5))

    def scores(self, text: tuple, meta: list[int]) -> tuple[float, float, float]:
        """Combined, of the text view, of the metadata view."""
        a, b = self.odds(text, meta)
        return sigmoid(self.parts[0] * a + self.parts[1] * b), sigmoid(a), sigmoid(b)


def sigmoid(z: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes, none below zero, and offset, by Newton's method with a small ridge; targets are smoothed as by Platt."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    use = np.ones(x.shape[1], dtype=bool)
    while True:
        a, w = np.column_stack([x[:, use], np.ones(len(x))]), np.zeros(int(use.sum()) + 1)
        for _ in range(50):
            p = sigmoid(a @ w)
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w)), a.T @ (p - target) + 1e-3 * w)
            w = w - step / max(1.0, float(abs(step).max()) / 5)
            if abs(step).max() < 1e-9:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[:-1][use], out[-1] = w[:-1], w[-1]
            return out
        use[np.flatnonzero(use)[w[:-1] < 0]] = False


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs that are ranked right, ties by half."""
    good, bad = np.sort(score[y == 1]), score[y == 0]
    if not len(good) or not len(bad):
        return 0.5
    return float(1 - (np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")).mean() / 2 / len(good))


def _own(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("binary").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))


def _views(c: dict) -> Iterator[tuple[tuple, list[int]]]:
    for text, source, lang in zip(c["text"], c["source"], c["lang"], strict=True):
        yield text_view(text or b""), meta_view(text or b"", source, lang)


def _counted(df: DataFrame, count) -> Counts:  # noqa: ANN001
    """The sum over all tasks of what ``count(counts, columns)`` adds for rows; a task returns a row for each feature it has met."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                count(counts, {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
        flat = counts.n.ravel()
        seen = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(flat[seen])], names=["k", "n"])

    found = df.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # a row for each feature and label
    n = np.zeros(2 * _SIZE, dtype=np.int64)
    n[found["k"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return Counts(n.reshape(2, _SIZE))


def count_labelled(counts: Counts, c: dict) -> None:
    for (text, meta), y in zip(_views(c), c["y"], strict=True):
        counts.add_text(int(y > 0.5), text)
        counts.add_meta(int(y > 0.5), meta)


def count_sure(model: Model, counts: Counts, c: dict) -> None:
    """Documents of which one view is sure count for the other one."""
    sure = float(np.log(SURE / (1 - SURE)))
    for text, meta in _views(c):
        by_text, by_meta = model.odds(text, meta)
        if abs(by_meta) >= sure:
            counts.add_text(int(by_meta > 0), text)
        if abs(by_text) >= sure:
            counts.add_meta(int(by_text > 0), meta)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """A model from labelled and all other documents; None without labels of both kinds to learn from and to calibrate by."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.avg("y").alias("y"))
    n = known.count()
    if n <= SENT_LABELS:  # 16 bytes a label
        docs = _own(df, id_col).join(F.broadcast(known), "id", "left")
    else:
        docs = cut(_own(df, id_col).join(known, "id", "left"), "quality-labelled")
    part = F.xxhash64(F.lit("quality"), "id").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    columns, share = ["text", "source", "lang", "y"], min(0.25, HELD / max(1, n))
    labelled = _counted(docs.where(F.col("y").isNotNull() & (part >= share)).select(*columns), count_labelled)

    def rows(c: dict) -> dict:
        seen = list(_views(c))
        return {"bins": [a[0] for a, _ in seen], "buckets": [a[1] for a, _ in seen], "shares": [a[2] for a, _ in seen], "meta": [b for _, b in seen], "y": c["y"]}

    some = docs.where(F.col("y").isNotNull() & (part < share)).select(*columns)
    got = arrow_map(some, rows, "bins array<int>, buckets array<int>, shares array<int>, meta array<int>, y double").collect()  # HELD rows, about
    held = [((r["bins"], np.array(r["buckets"], dtype=np.int64), np.array(r["shares"], dtype=np.int64)), r["meta"], int(r["y"] > 0.5)) for r in got]
    held.sort(key=lambda h: (h[0][0], h[0][1].tolist(), h[0][2].tolist(), h[1], h[2]))
    if len({y for *_, y in held}) < 2 or not labelled.n[:, 0].all():
        return None
    model = Model.of(labelled).calibrated(held)
    others, last = docs.where("y IS NULL").select(*columns[:3]), None
    for _ in range(ROUNDS):
        said = _counted(others, lambda counts, c, m=model: count_sure(m, counts, c))
        if last is not None and (said.n == last.n).all():
            break
        model, last = Model.of(Counts(labelled.n + said.n)).calibrated(held), said
    return model


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """id, ``score`` (0 to 1), ``keep``, and the calibrated score of each view, for every row."""

    def rows(c: dict) -> dict:
        p = [model.scores(*v) for v in _views(c)] if model else [(0.5, 0.5, 0.5)] * len(c["id"])
        return {id_col: c["id"], "score": [float(x[0]) for x in p], "keep": [bool(x[0] >= KEEP) for x in p], "text_score": [float(x[1]) for x in p], "meta_score": [float(x[2]) for x in p]}

    return arrow_map(_own(df, id_col), rows, f"`{id_col}` bigint, score double, keep boolean, text_score double, meta_score double")
