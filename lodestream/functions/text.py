"""Scalar text functions as column expressions; two pandas UDFs where Spark has no built-in."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


def normalize(title: Column) -> Column:
    """lower case, all but ASCII letters, digits, Hangul syllables and white space becomes a space; collapsed, trimmed."""
    kept = F.regexp_replace(F.lower(title), r"[^a-z0-9가-힣\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: inside a lambda an expression is worked out anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_grams(title: Column, n: int = 3) -> Column:
    """character n-grams of the normalised title without spaces; a shorter one is its own single feature."""

    def grams(s: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
        return F.when(F.length(s) < n, F.array(s)).otherwise(each)

    return bound(F.replace(normalize(title), F.lit(" "), F.lit("")), grams)


def _low(feature: str) -> bytes:
    return hashlib.md5(feature.encode()).digest()[:7:-1]


def _majority(lows: list[bytes], counts: np.ndarray) -> int:
    bits = np.unpackbits(np.frombuffer(b"".join(lows), dtype=np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(counts.astype(np.float64) @ bits * 2 > counts.sum(), bitorder="little").view("<i8")[0])


#: What F1 leaves of a code point once its spaces are gone: a letter in lower case, a digit or a syllable, else 0. Besides
#: A to Z only the dotted I and the Kelvin sign have an ASCII letter as their lower case.
_BARE = np.zeros(0xD7A5, dtype=np.uint16)
for _from, _to in (("09", "0"), ("az", "a"), ("AZ", "a"), ("가힣", "가"), ("İİ", "i"), ("\u212a\u212a", "k")):
    _BARE[ord(_from[0]) : ord(_from[1]) + 1] = np.arange(ord(_to), ord(_to) + ord(_from[1]) - ord(_from[0]) + 1)
#: Places of 0-9 and a-z in the table of trigrams, whose last row is empty; a byte for each bit of a trigram's hash.
_PLACE = np.full(128, -1, dtype=np.int32)
_PLACE[[*range(48, 58), *range(97, 123)]] = np.arange(36)
_TABLE, _KNOWN = np.zeros((36**3 + 1, 64), dtype=np.uint8), np.zeros(36**3, dtype=bool)
#: Trigrams that are added at a time.
_ADDED = 1 << 15
#: The hashes of other trigrams that a worker has met; emptied when it is full.
_GRAMS: dict[int, bytes] = {}
_MOST_GRAMS = 1 << 18


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _bare(s: str) -> np.ndarray:
    """The code points of the normalised text without spaces."""
    c = _BARE[np.minimum(_codes(s), len(_BARE) - 1)]
    return c[c != 0]


def _places_majority(at: np.ndarray) -> int:
    """The SimHash of the trigrams at these places of the table."""
    new = at[~_KNOWN[at]]
    if len(new):
        new, c = np.unique(new), "0123456789abcdefghijklmnopqrstuvwxyz"
        lows = b"".join(_low(c[k // 1296] + c[k // 36 % 36] + c[k % 36]) for k in new.tolist())
        _TABLE[new] = np.unpackbits(np.frombuffer(lows, dtype=np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        _KNOWN[new] = True
    words, sums = _TABLE.view(np.uint64), np.zeros(64, dtype=np.int64)
    for i in range(0, len(at), _ADDED):
        some = at[i : i + _ADDED]
        # rows beside each other, so that at most 255 are added in a byte
        wide = max(-(-len(some) // 255), min(16, len(some)))
        high = -(-len(some) // wide)
        padded = np.full(wide * high, 36**3, dtype=some.dtype)
        padded[: len(some)] = some
        sums += words.take(padded, axis=0).reshape(high, wide * 8).sum(axis=0).view(np.uint8).reshape(wide, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > len(at), bitorder="little").view("<i8")[0])


def _gram_majority(c: np.ndarray) -> int:
    """Each distinct trigram of a text's code points is hashed once and counts as often as it is there."""
    if len(c) <= 3:
        return _majority([_low("".join(map(chr, c.tolist())))], np.ones(1))
    if c.max() < 128:
        at = _PLACE[c]
        if at.min() >= 0:
            return _places_majority((at[:-2] * 36 + at[1:-1]) * 36 + at[2:])
    c = c.astype(np.int64)
    keys, counts = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)
    if len(_GRAMS) + len(keys) > _MOST_GRAMS:
        _GRAMS.clear()
    lows = []
    for k in keys.tolist():
        low = _GRAMS.get(k)
        if low is None:
            low = _GRAMS[k] = _low(chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF))
        lows.append(low)
    return _majority(lows, counts)


@F.pandas_udf(LongType())
def simhash64(features: pd.Series) -> pd.Series:
    """bit i is set where over half of the features' hashes (low half of their MD5) have it; a signed long.

    A column expression for this folds 64 counters in boxed arrays and took half a second a row on long texts.
    """
    # Int64: a null would turn the others to floats, which lose their low bits
    return pd.Series([None if fs is None else _majority([_low(f) for f in fs], np.ones(len(fs))) for fs in features], dtype="Int64")


@F.pandas_udf(LongType())
def _gram_simhash(bare: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else _gram_majority(_codes(s)) for s in bare], dtype="Int64")


@F.pandas_udf(LongType())
def title_simhash(titles: pd.Series) -> pd.Series:
    """the SimHash of a title's character trigrams."""
    return pd.Series([None if s is None else _gram_majority(_bare(s)) for s in titles], dtype="Int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def url_hash(url: Column) -> Column:
    """the first 16 hex digits of SHA-256; empty stays empty."""
    return F.when(url.isNull() | (url == ""), "").otherwise(F.substring(F.sha2(url, 256), 1, 16))


def prediction_id(article_id: Column, claim: Column) -> Column:
    """12 hex digits of SHA-256 over both, with U+0001 between."""
    return F.substring(F.sha2(F.concat_ws("\u0001", article_id, claim), 256), 1, 12)


@F.pandas_udf(StringType())
def title_key(title: pd.Series) -> pd.Series:
    """NFKC, lower case, character references and all but word characters become a space; trimmed."""
    entity, other = re.compile(r"&#?\w+;"), re.compile(r"[^\w]+")
    return title.map(lambda t: other.sub(" ", entity.sub(" ", unicodedata.normalize("NFKC", t).lower())).strip() if t else "")


# Words that are no keywords.
STOPWORDS = tuple(
    """
the and for with that this from have has had having are was were been being you your yours they them their there
these those will would could should what when where which while who whom whose how why but not all any can more most
such into than then out its it's also only just new old use used using make made get got say said see saw one two
three first second last many some other another much very still even yet ever never always often now today tomorrow
yesterday year month week day via vs per each both either neither between during without within through across about
above after before around over under again back down off up well way ways thing things ai company companies model
models user users tool tools feature features team teams research report reports study studies data based shows show
showed says according compared include includes including
""".split()
)


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """English tokens of three characters or more, without trailing dots and stopwords, in order."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9\-+.]{2,}"), F.lit(0)), lambda x: F.regexp_replace(F.lower(x), r"\.+$", ""))
    return F.filter(raw, lambda x: (F.length(x) >= 3) & ~x.isin(*stopwords))


def title_tokens(title: Column) -> Column:
    """F8: distinct words of the normalised title with two characters or more."""
    return F.array_distinct(F.filter(F.split(normalize(title), " "), lambda x: F.length(x) >= 2))


def claim_keywords(text: Column, stopwords: tuple[str, ...]) -> Column:
    """English words of two characters or more, and runs of Hangul, lower-cased, distinct, without stopwords."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9\-.]*|[가-힣]{2,}"), F.lit(0)), lambda x: F.lower(x))
    return F.array_distinct(F.filter(raw, lambda x: (F.length(x) >= 2) & ~x.isin(*stopwords)))


def paper_ids(url: Column, text: Column) -> Column:
    """sorted array of (id, where) for paper ids in links, and after ``arXiv:`` in texts, without versions; a link wins."""
    link = F.transform(F.regexp_extract_all(url, F.lit(r"(?i)arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5})"), F.lit(1)), lambda i: F.struct(i.alias("id"), F.lit("link").alias("where")))
    named = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)arxiv:\s*(\d{4}\.\d{4,5})"), F.lit(1)), lambda i: F.struct(i.alias("id"), F.lit("text").alias("where")))
    ids = F.transform(link, lambda x: x["id"])
    return F.array_sort(F.array_distinct(F.concat(link, F.filter(named, lambda x: ~F.array_contains(ids, x["id"])))))


def parse_utc(text: Column) -> Column:
    """ISO date-times to UTC; without an offset they are UTC; what can't be read is null."""
    return F.try_to_timestamp(text)


def day_gap(a: Column, b: Column, sentinel: int | None = 10_000) -> Column:
    """days between, without sign; ``sentinel`` where one is missing."""
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(sentinel))


def iso_week(d: Column) -> Column:
    """``YYYY-Www`` of the ISO week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def quarter_key(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def quarter_bounds(d: Column) -> tuple[Column, Column]:
    """first and last day of the quarter."""
    start = F.trunc(d, "quarter")
    return start, F.date_sub(F.add_months(start, 3), 1)


def slug(text: Column) -> Column:
    """lower case, runs of other characters become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


@F.pandas_udf(StringType())
def balanced_json(text: pd.Series) -> pd.Series:
    """F16: the first balanced {...} that is JSON, minding strings and escapes; null if there is none."""

    def first(t: str | None) -> str | None:
        decoder = json.JSONDecoder()
        at = (t or "").find("{")
        while at >= 0:
            try:
                return t[at : decoder.raw_decode(t, at)[1]]
            except ValueError:
                at = t.find("{", at + 1)
        return None

    return text.map(first)


def strip_html(text: Column, most: int | None = None) -> Column:
    """without tags, white space collapsed, trimmed, cut to ``most`` characters if given."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))
    return out if most is None else F.substring(out, 1, most)


def snippet(text: Column, term: Column, width: int = 160) -> Column:
    """``width`` characters around the first hit of a term, with dots where the text goes on."""
    hit = F.call_function("locate", F.lower(term), F.lower(text))
    start = F.greatest(hit - width // 2, F.lit(1))
    body = F.substring(text, start, F.lit(width))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + width - 1 < F.length(text), "…").otherwise(""))


def has_term(text: Column, term: Column) -> Column:
    """an ASCII term stands between word borders, white space in it is any; another is found literally."""
    quoted = F.regexp_replace(term, r"([.\\+*?\[^\]$(){}=!<>|:\-])", r"\\$1")
    bounded = F.concat(F.lit(r"(?i)\b"), F.regexp_replace(quoted, r"\s+", r"\\s+"), F.lit(r"\b"))
    return F.when(F.regexp_like(term, F.lit(r"^[\x00-\x7F]+$")), F.regexp_like(text, bounded)).otherwise(F.contains(text, term))


def image_url(page: Column, base: Column) -> Column:
    """the first social image of a page; // becomes https, a path is joined to the page's host."""
    patterns = [
        r"""(?i)<meta[^>]+property=["']og:image(?::secure_url|:url)?["'][^>]*content=["']([^"']+)["']""",
        r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]*property=["']og:image(?::secure_url|:url)?["']""",
        r"""(?i)<meta[^>]+name=["']twitter:image(?::src)?["'][^>]*content=["']([^"']+)["']""",
        r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]*name=["']twitter:image(?::src)?["']""",
    ]
    found = F.coalesce(*[F.nullif(F.regexp_extract(page, p, 1), F.lit("")) for p in patterns])
    host = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(found.startswith("//"), F.concat(F.lit("https:"), found)).when(found.startswith("/"), F.concat(host, found)).when(found.startswith("http"), found)


def title_from_slug(path: Column) -> Column:
    """F21."""
    return F.initcap(F.trim(F.regexp_replace(path, r"[-_]+", " ")))


def collapsed_key(text: Column) -> Column:
    """trimmed, lower case, white space collapsed."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def around(text: Column, start: Column, length: Column, margin: int = 90) -> Column:
    """the span of a match and ``margin`` characters on either side."""
    first = F.greatest(start - margin, F.lit(1))
    return F.substring(text, first, start + length + margin - first)


def ordinal_week(d: Column) -> Column:
    """Days since 0001-01-01, counted from one, by seven."""
    return F.floor((F.datediff(d, F.to_date(F.lit("0001-01-01"))) + 1) / 7)


def ordinal_week_start(week: Column) -> Column:
    return F.date_add(F.to_date(F.lit("0001-01-01")), (week * 7 - 1).cast("int"))


def age_hours(at: Column, as_of: Column) -> Column:
    """F27."""
    return (F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 3600


def half_even(x: Column, digits: int) -> Column:
    """rounds halves to even."""
    return F.bround(x, digits)


def half_up_1(x: Column) -> Column:
    """floor(10 x + 0.5) / 10."""
    return F.floor(x * 10 + 0.5) / 10


def approved_pattern(row: Column) -> tuple[Column, Column]:
    """concept id and word pattern of a ``| [x] term |`` row; null if it isn't approved."""
    term = F.nullif(F.trim(F.regexp_extract(row, r"^\|\s*\[[xX]\]\s*([^|]+)\|", 1)), F.lit(""))
    return F.when(term.isNotNull(), slug(term)), F.when(term.isNotNull(), F.concat(F.lit(r"\b"), term, F.lit(r"\b")))


def json_value(text: Column, key: str) -> Column:
    """F31."""
    return F.get_json_object(text, f"$.{key}")


def numbered_block(number: Column, category: Column, title: Column, tail: Column, summary: Column) -> Column:
    """F32: ``[i] (category) title``, outlet and tags, summary, a line each."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] ("), category, F.lit(") "), title, F.lit("\n"), tail, F.lit("\n"), summary)


def haystack(*columns: Column) -> Column:
    """F33."""
    return F.lower(F.concat_ws(" ", *columns))


def signed(x: Column) -> Column:
    """a sign in front, also of positive numbers."""
    return F.when(x >= 0, F.concat(F.lit("+"), x.cast("string"))).otherwise(x.cast("string"))
