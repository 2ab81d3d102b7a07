"""Language identification by a byte convolutional network, trained in numpy on labelled texts.

A text is its UTF-8 bytes in consecutive windows of fixed length, the last one padded. A window passes an embedding of
its bytes, filters of several widths, a maximum over places and a softmax. The probabilities of a text are those of
its windows, weighted by their bytes; all windows of a text count.

Training takes a sample of labelled texts, PER_LANG for each language at most (chosen by a hash of the id, so that it
is the same in each run), and WINDOWS windows of each; the LANGS most frequent languages are learnt, so that a column
of dirty labels neither floods the driver nor the network.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if no labelled text
may be learnt from; repeated rows get equal results; rows without an id are never learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow_map

LENGTH, WIDTHS, FILTERS, DIM = 128, (2, 3, 4, 5), 8, 4
#: Texts of each language and windows of each text that are learnt from, at most.
PER_LANG, WINDOWS = 400, 6
#: Languages that are learnt, at most.
LANGS = 500
EPOCHS, RATE, AT_ONCE = 8, 0.01, 64
UND = "und"
LETTER = regex.compile(r"\p{L}")
_WIDEST = max(WIDTHS)


@dataclass
class Network:
    langs: list[str]
    emb: np.ndarray  # 256 x DIM
    conv: np.ndarray  # _WIDEST * DIM x all filters; beyond a filter's width its weights stay zero
    bias: np.ndarray
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray


def _mask() -> np.ndarray:
    """1 where a filter has a weight."""
    m = np.zeros((_WIDEST, DIM, len(WIDTHS) * FILTERS), dtype=np.float32)
    for i, w in enumerate(WIDTHS):
        m[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    return m.reshape(_WIDEST * DIM, -1)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (n x LENGTH bytes), their numbers of bytes, and how many windows each text has."""
    n = np.array([-(-len(t) // LENGTH) for t in texts], dtype=np.int64)
    joined = b"".join([t + b"\0" * (-len(t) % LENGTH) for t in texts])
    size = np.full(int(n.sum()), LENGTH, dtype=np.int64)
    last = np.cumsum(n)[n > 0] - 1
    size[last] = [len(t) - (k - 1) * LENGTH for t, k in zip(texts, n, strict=True) if k]
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, LENGTH), size, n


def _columns(emb: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each window and place, the embeddings of the _WIDEST bytes from there, zeros beyond the window."""
    e = np.zeros((len(x), LENGTH + _WIDEST - 1, DIM), dtype=emb.dtype)
    e[:, :LENGTH] = emb[x]
    return np.concatenate([e[:, k : k + LENGTH] for k in range(_WIDEST)], axis=2)


def forward(net: Network, x: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """Probabilities of each window."""
    out = np.empty((len(x), len(net.langs)))
    for i in range(0, len(x), 256):
        cols = _columns(net.emb.astype(kind, copy=False), x[i : i + 256])
        pooled = (cols.reshape(-1, cols.shape[2]) @ net.conv).reshape(len(cols), LENGTH, -1).max(axis=1)
        z = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[i : i + 256] = z / z.sum(axis=1, keepdims=True)
    return out


def start(n_langs: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Embedding, filters, their bias, output weights and bias before training."""
    mask, n_out = _mask(), len(WIDTHS) * FILTERS
    p = [rng.normal(0, 0.5, (256, DIM)), rng.normal(0, 0.3, mask.shape) * mask, np.zeros(n_out), rng.normal(0, 0.3, (n_out, n_langs)), np.zeros(n_langs)]
    return [a.astype(np.float32) for a in p]


def gradients(p: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy of windows ``x`` with language numbers ``y``, for each array of ``p``."""
    n_out = p[1].shape[1]
    cols = _columns(p[0], x)
    act = (cols.reshape(-1, cols.shape[2]) @ p[1]).reshape(len(x), LENGTH, -1)
    best = act.argmax(axis=1)
    pooled = np.take_along_axis(act, best[:, None, :], axis=1)[:, 0] + p[2]
    hidden = np.maximum(pooled, 0)
    z = hidden @ p[3] + p[4]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    dz = z / z.sum(axis=1, keepdims=True)
    dz[np.arange(len(y)), y] -= 1
    dz /= len(y)
    dh = (dz @ p[3].T) * (pooled > 0)
    # only the place of each maximum passes its gradient on
    at = np.take_along_axis(cols, best[:, :, None], axis=1)  # windows x filters x inputs
    d_conv = np.einsum("bf,bfi->if", dh, at) * _mask()
    d_in = (dh[:, :, None] * p[1].T[None]).reshape(len(x), n_out, _WIDEST, DIM)
    places = best[:, :, None] + np.arange(_WIDEST)
    inside = places < LENGTH
    byte = np.take_along_axis(x, np.minimum(places, LENGTH - 1).reshape(len(x), -1), axis=1).reshape(places.shape)
    d_emb = np.zeros_like(p[0])
    np.add.at(d_emb, byte[inside], d_in[inside])
    return [d_emb, d_conv, dh.sum(axis=0), hidden.T @ dz, dz.sum(axis=0)]


def train(x: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 0, epochs: int = EPOCHS) -> Network:
    """Adam on the cross-entropy of windows ``x`` with language numbers ``y``."""
    rng = np.random.default_rng(seed)
    p = start(len(langs), rng)
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), AT_ONCE):
            step += 1
            for k, g in enumerate(gradients(p, x[order[i : i + AT_ONCE]], y[order[i : i + AT_ONCE]])):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(langs, *p)


def sample(df: DataFrame, may_learn: Column, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and language numbers of the texts that are learnt from."""
    own = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(may_learn & F.col("lang").isNotNull())
    often = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGS)
    counts = {r["lang"]: r["n"] for r in often.collect()}
    langs = sorted(counts)
    if not langs:
        return np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), []
    part = (F.xxhash64("id", F.lit("langid")).bitwiseAND((1 << 53) - 1) / float(1 << 53)).alias("part")
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, PER_LANG / counts[lang])])
    chosen = own.select("lang", "text", part).where(F.col("lang").isin(langs) & (F.col("part") < rate[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))

    def cut(c: dict) -> dict:
        lang, part, window = [], [], []
        for la, p, t in zip(c["lang"], c["part"], c["text"], strict=True):
            x = windows([t.encode()])[0]
            for i in np.random.default_rng(int(p * (1 << 53))).permutation(len(x))[:WINDOWS]:
                lang.append(la)
                part.append(p)
                window.append(x[i].tobytes())
        return {"lang": lang, "part": part, "window": window}

    got = arrow_map(chosen, cut, "lang string, part double, window binary").toPandas()  # bounded by PER_LANG and WINDOWS
    got = got.sort_values(["part", "window"], kind="stable")
    kept = got[got.groupby("lang").cumcount() < PER_LANG * WINDOWS]
    x = np.frombuffer(b"".join(bytes(w) for w in kept["window"]), dtype=np.uint8).reshape(-1, LENGTH)
    number = {lang: i for i, lang in enumerate(langs)}
    return x, kept["lang"].map(number).to_numpy(np.int64), langs


def predict_many(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    pred, score = [UND] * len(texts), [0.0] * len(texts)
    if net is None:
        return pred, score
    has = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    at = 0
    while at < len(has):  # blocks of some 1,000 windows, or one long text
        block, size = [], 0
        while at < len(has) and (not block or size < 128_000):
            block.append(has[at])
            size += len(texts[has[at]])
            at += 1
        x, w, n = windows([texts[i].encode() for i in block])
        p = np.add.reduceat(forward(net, x) * w[:, None], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
        p /= p.sum(axis=1, keepdims=True)
        for i, k, s in zip(block, p.argmax(axis=1), p.max(axis=1), strict=True):
            pred[i], score[i] = net.langs[k], min(1.0, float(s))
    return pred, score


def fit(df: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from the rows of ``df`` for which ``may_learn`` (over the column ``id``) holds; None if there are none."""
    x, y, langs = sample(df, may_learn, id_col, text_col, lang_col)
    return train(x, y, langs) if len(x) else None


def predict(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The id of each row of ``df``, its language and score under ``names``; with ``keep``, also those columns unchanged."""
    also = [c for c in keep or [] if c not in (id_col, *names)]
    own = df.select(F.col(id_col), F.col(text_col).alias("__text"), *also)

    def rows(c: dict) -> dict:
        pred, score = predict_many(net, c["__text"])
        return {id_col: c[id_col], names[0]: pred, names[1]: score} | {k: c[k] for k in also}

    kinds = dict(own.dtypes)
    return arrow_map(own, rows, ", ".join([f"`{id_col}` {kinds[id_col]}, `{names[0]}` string, `{names[1]}` double", *(f"`{k}` {kinds[k]}" for k in also)]))


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows whose remainder is not 2 and predicts all: id, held_out, lang_pred, score."""
    net = fit(df, F.coalesce(remainder("id") != 2, F.lit(False)), id_col, text_col, lang_col)
    return predict(df, net, id_col, text_col).select(id_col, F.coalesce(remainder(id_col) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
