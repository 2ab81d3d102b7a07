"""Main text of web pages by minimum cuts.

A tokenizer and a small tree builder give the blocks of a page in one pass: each with its text, the element it stands
in and shallow features of the text. The terminal capacities of a block are its log odds to be content: what a
classifier says of its features, and the evidence of the markup around it. Smoothness edges join blocks that follow
one another, weaker with their distance in the tree, and those that follow one another below one element; an edge
across a border that markup states is weaker too. The minimum cut, by max-flow (Dinic's), is the labelling of least
total cost.

Evidence is a number for each element, never a verdict: tags and roles, class and id tokens that consist of words for
other matter (strong), tokens that only have such a word among others (weak). The nearest element that says something
counts most and what is around it a quarter, so that an article inside a doubtful wrapper outweighs it; a form that
holds most of a page's words says nothing. Classes of any page can mislead, and many have none: there the classifier
and the edges decide.

The classifier is a logistic regression, trained in numpy on a bounded sample of pages (SAMPLE, by a hash) whose
blocks are labelled by clear evidence; each block is learnt from twice, with its tag and without. The scale of the
edges is the one of SCALES whose cuts of sampled pages without any markup evidence agree best with those labels.

Defined results: null html is empty and gives an empty text; repeated rows give equal results; whole pages count, in
time that is linear in tags however deep they are nested; elements that aren't closed end with what is around them.
"""

from __future__ import annotations

import functools
import html
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow_map

SAMPLE = 1_000
#: Characters of a page that is learnt from, at most (all pages are cut, whatever their length).
SAMPLE_CHARS = 200_000
SCALES = (0.5, 1.0, 1.5, 2.0, 3.0)
#: Parts of the scale: an edge loses half for each step of distance beyond siblings; the next block of one parent; a stated border.
FARTHER, SIBLING, BORDER = 0.5, 0.5, 0.4
#: Evidence, as log odds: an article; other matter by tag or role; by class; a form; a token with such a word; hidden; beside a marked article.
ARTICLE, TAG, NAMED, FORM, WEAK, HIDDEN, BESIDE = 2.5, -6.0, -6.0, -5.0, -1.0, -9.0, -2.5
#: What is left of the evidence around an element that says something itself; the most that the classifier says.
AROUND, SHALLOW = 0.25, 3.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<loose>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is inside is no text; the first group isn't even markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_SKIPPED = frozenset("head noscript template svg math select button object audio video canvas map datalist".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_OTHER_TAGS = frozenset("nav footer aside menu dialog".split())
_FORM_TAGS = frozenset("form fieldset".split())
_HEAD_TAGS = frozenset("base basefont bgsound link meta noscript script style template title".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Words of classes and ids for other matter, whole and as beginnings.
_OTHER_WORDS = frozenset("ad ads adv aside nav navi navbar menu menus topbar toolbar foot footer masthead gdpr toc tags rss login signin signup search form share legal copyright skip widget widgets notice alert rail respond replies reply teaser".split())
_OTHER_STARTS = tuple("advert adsense adslot adbox adbanner banner sidebar comment cookie consent newsletter breadcrumb footer navigation menu promo sponsor sharing social related recommend subscri popup modal paginat disqus outbrain taboola".split())
#: Words that say nothing beside those; words of a site's header; last words of an article's class.
_PLAIN_WORDS = frozenset(
    "a all area article articles bar block body bottom box btn button buttons center col container content entry group header holder icon icons inner item items left line links list main module more outer page panel post posts row right section site slot small sticky story text title top unit wrap wrapper".split()
)
_SITE_WORDS = frozenset("header site main top global bar container wrapper inner".split())
_MAIN_WORDS = frozenset("article story entry post content main".split())


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    own: float  # what it says by itself: positive for an article
    weak: float
    in_article: bool
    in_link: bool
    skipped: bool
    block: Element | None = None  # the nearest element that isn't inline, itself included
    words: int = 0  # before it; when it is closed, in it
    closed: bool = False
    hint: float = 0.0
    firm: bool = False
    by: Element | None = None  # the element that the hint comes from


@dataclass(slots=True)
class Block:
    tag: str
    element: Element
    text: str
    linked: int
    words: int
    hint: float = 0.0
    in_article: bool = False


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in _ATTR.finditer(source)}


def _other(word: str) -> bool:
    return word in _OTHER_WORDS or word.startswith(_OTHER_STARTS)


def _evidence(tag: str, source: str, in_article: bool) -> tuple[float, float]:
    """What an element says of what is in it: clearly, and by words among others."""
    said = ARTICLE if tag in ("article", "main") else TAG if tag in _OTHER_TAGS or tag == "header" and not in_article else FORM if tag in _FORM_TAGS else 0.0
    if not source or "=" not in source and "hidden" not in source:
        return said, 0.0
    a = _attributes(source)
    role = a.get("role", "").lower()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN_STYLE.search(a.get("style", "")):
        return HIDDEN, 0.0
    if role in _OTHER_ROLES:
        return (FORM if role == "form" else TAG), 0.0
    weak, last = 0.0, ""
    if tag not in ("html", "body"):
        for token in f"{a.get('class', '')} {a.get('id', '')}".split():
            words = _WORDS.findall(_CAMEL.sub(" ", token).lower())
            if any(map(_other, words)):
                named = all(_other(w) or w in _PLAIN_WORDS for w in words) and not ("content" in words and len(words) > 2)
                if named and said <= 0:
                    return min(said, NAMED), 0.0
                if named and tag == "article":  # a reader's comment or a teaser as an article of its own
                    return NAMED, 0.0
                weak = WEAK
            elif "header" in words and _SITE_WORDS.issuperset(words) and not in_article and said == 0:
                return NAMED, 0.0
            last = words[-1] if words else last
    if said == 0 and (role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody" or tag in ("div", "section", "td") and not weak and last in _MAIN_WORDS):
        said = ARTICLE
    return said, weak


class Page:
    """Builds the elements and blocks of a page."""

    def __init__(self, page: str) -> None:
        self.top = self.root = Element("", None, 0, 0.0, 0.0, False, False, False)
        self.root.block = self.root
        self.elements: list[Element] = [self.root]
        self.blocks: list[Block] = []
        self.open: dict[str, list[Element]] = {}
        self.text: list[str] = []
        self.linked = self.words = 0
        self.read(page)
        self.flush()
        self.close_to(self.root)
        self.weigh()

    def flush(self) -> None:
        if self.text:
            said = " ".join(html.unescape("".join(self.text)).split())
            if said:
                n = said.count(" ") + 1
                self.words += n
                self.blocks.append(Block(self.top.block.tag, self.top.block, said, min(self.linked, len(said)), n))
            self.text, self.linked = [], 0

    def put(self, piece: str) -> None:
        if self.top.skipped:
            if self.top.tag != "head" or piece.isspace() or not piece:
                return
            self.close_to(self.top.parent)  # text ends an open head
        self.text.append(piece)
        if self.top.in_link:
            self.linked += len(piece.strip())

    def close_to(self, e: Element) -> None:
        """Closes all that is open below ``e``."""
        while self.top is not e:
            own = self.top
            own.words, own.closed = self.words - own.words, True
            self.open[own.tag].pop()
            self.top = own.parent

    def start(self, tag: str, source: str) -> None:
        top = self.top
        if top.skipped and top.tag == "head" and tag not in _HEAD_TAGS:
            self.close_to(top.parent)  # so does an element that can't be in it
            top = self.top
        if top.skipped and source.rstrip().endswith("/"):
            return
        if tag in ("br", "wbr"):
            self.put(" " if tag == "br" else "")
            return
        inline = tag in _INLINE
        if not inline and not top.skipped:
            self.flush()
        if tag in _VOID:
            return
        if not inline and not top.skipped:
            # a block ends an open paragraph; items and cells end their like
            closes = {"p"} | ({"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {"td", "th", "tr"} if tag == "tr" else set())
            while self.top.block.tag in closes:
                self.close_to(self.top.block.parent)
            top = self.top
        own, weak = _evidence(tag, source, top.in_article)
        e = Element(tag, top, top.depth + 1, own, weak, top.in_article or own > 0, top.in_link or tag == "a", top.skipped or tag in _SKIPPED, words=self.words)
        e.block = top.block if inline else e
        self.elements.append(e)
        self.open.setdefault(tag, []).append(e)
        self.top = e

    def end(self, tag: str) -> None:
        match = self.open.get(tag)
        inline = tag in _INLINE
        if match and (not inline or match[-1].block is self.top.block):
            if not inline and not self.top.skipped:
                self.flush()
            self.close_to(match[-1].parent)
        elif tag == "p" and not self.top.skipped:
            self.flush()

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                self.put(page[at:])
                break
            if m.start() > at:
                self.put(page[at : m.start()])
            at = m.end()
            if m["cdata"] is not None:
                self.put(html.escape(m["cdata"], quote=False))
            elif name := m["start"] or m["loose"]:
                tag = name.lower()
                if tag in _RAW:
                    end = _raw_end(tag).search(page, at)
                    at = end.end() if end else n
                    if tag not in _INLINE and not self.top.skipped:
                        self.flush()
                else:
                    self.start(tag, m["attrs"] or "")
            elif m["end"]:
                self.end(m["end"].lower())

    def weigh(self) -> None:
        """Gives each element the evidence at its place; parents come before what is in them."""
        for e in self.elements[1:]:
            up, own = e.parent, e.own
            if own and (e.tag in _FORM_TAGS or own == FORM) and 2 * e.words > self.words:
                own = 0.0
            if own:
                # an article in a sidebar or menu is a teaser: a tag's evidence around it stays whole
                e.hint = own + (up.hint if own > 0 and up.firm else AROUND * up.hint) + e.weak
                e.firm, e.by = own < 0 and own in (TAG, HIDDEN) or own > 0 and up.firm, e
            elif e.weak:
                e.hint, e.firm, e.by = up.hint + e.weak, up.firm, up.by
            else:
                e.hint, e.firm, e.by = up.hint, up.firm, up.by
        for b in self.blocks:
            b.hint, b.in_article = b.element.hint, b.element.in_article


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order, with decoded text in which white space is one space."""
    return Page(page).blocks


def features(found: list[Block]) -> np.ndarray:
    """Shallow features, a row for each block; none of them says where an article was marked."""
    rows = np.zeros((len(found), 10))
    n = len(found)
    for i, b in enumerate(found):
        size = max(1, len(b.text))
        rows[i] = (
            1.0,
            b.linked / size,
            min(np.log1p(b.words) / 4, 1.5),
            sum(b.text.count(c) for c in ".,;!?") / max(1, b.words),
            b.text[-1] in ".!?:\"'»”",
            b.tag == "p",
            b.tag in ("li", "dd", "dt", "td"),
            b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            i / n,
            b.words <= 4,
        )
    return rows


#: Before any training, and where a sample has one kind of block only.
PRIOR = np.array([-0.6, -4.0, 2.0, 1.0, 0.8, 0.8, -0.8, 0.5, -0.3, -1.0])
#: Features that are the tag's.
_TAG_FEATURES = slice(5, 8)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=PRIOR.copy)
    scale: float = 1.0


def train(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights by gradient descent, drawn towards PRIOR."""
    w = PRIOR.copy()
    if len(x) == 0 or y.min() == y.max():
        return w
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ ((p - y) * weight) + 0.02 * (w - PRIOR))
    return w


def without_tags(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[:, _TAG_FEATURES] = 0
    return out


def f1(said: np.ndarray, y: np.ndarray) -> float:
    return 2 * float((said & y).sum()) / max(1, int(said.sum()) + int(y.sum()))


def fit_pages(sample: list[str]) -> Model:
    """A classifier of blocks with clear evidence, and the scale of the edges that serves best where there is none."""
    parsed = [(found, features(found)) for p in sample if (found := blocks(p))]
    clear = [np.array([abs(b.hint) >= ARTICLE / 2 for b in found]) for found, _ in parsed]
    y = [np.array([b.hint > 0 for b in found]) for found, _ in parsed]
    if not parsed or not sum(c.sum() for c in clear):
        return Model()
    x, t = np.concatenate([f[c] for (_, f), c in zip(parsed, clear, strict=True)]), np.concatenate([a[c] for a, c in zip(y, clear, strict=True)]).astype(float)
    w = train(np.concatenate([x, without_tags(x)]), np.concatenate([t, t]))
    pages = [(parsed[k], clear[k], y[k]) for k in range(len(parsed)) if clear[k].any()]
    best = max(SCALES, key=lambda s: (_agreement(pages, Model(w, s)), -s))
    return Model(w, best)


def _agreement(pages: list, model: Model) -> float:
    said = [np.array(cut_blocks(found, text_odds(without_tags(f), model), model.scale, stated=False))[c] for (found, f), c, _ in pages]
    return f1(np.concatenate(said), np.concatenate([y[c] for _, c, y in pages]))


def fit(df: DataFrame, html_col: str = "html") -> Model:
    """A model from SAMPLE pages, about, chosen by a hash of what is in them."""
    n = df.count()
    part = F.xxhash64(html_col).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    chosen = df.select(F.col(html_col).alias("html")).where(F.col("html").isNotNull() & (part < SAMPLE / max(1, n)))
    got = [r["html"] for r in chosen.where(F.length("html") <= SAMPLE_CHARS).collect()]  # SAMPLE pages, about
    return fit_pages(sorted(got))


# --- minimum cut --------------------------------------------------------------------------------------------------


class Flow:
    """Dinic's maximum flow over a small graph."""

    def __init__(self, n: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.edges[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for k in self.edges[a]:
                if self.room[k] > 1e-9 and level[self.to[k]] < 0:
                    level[self.to[k]] = level[a] + 1
                    todo.append(self.to[k])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """The nodes on the source's side of a minimum cut."""
        while (level := self.levels(source))[sink] >= 0:
            at = [0] * len(self.edges)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    least = min(self.room[k] for k in path)
                    cut = len(path)
                    for i, k in enumerate(path):
                        self.room[k] -= least
                        self.room[k ^ 1] += least
                        if self.room[k] <= 1e-9 and i < cut:
                            cut = i
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while at[a] < len(self.edges[a]):
                    k = self.edges[a][at[a]]
                    if self.room[k] > 1e-9 and level[self.to[k]] == level[a] + 1:
                        break
                    at[a] += 1
                else:
                    if not path:
                        break
                    k = path.pop()
                    a = self.to[k ^ 1]
                    at[a] += 1
                    continue
                path.append(k)
                a = self.to[k]
        return [x >= 0 for x in level]


def text_odds(x: np.ndarray, model: Model) -> np.ndarray:
    return np.clip(x @ model.weights, -SHALLOW, SHALLOW)


def odds_of(found: list[Block], model: Model) -> np.ndarray:
    """Log odds of each block: the classifier's, and the evidence around it."""
    marked = any(b.hint >= ARTICLE / 2 for b in found)
    beside = [BESIDE if marked and not b.in_article else 0.0 for b in found]  # where a page marks its article
    return text_odds(features(found), model) + np.array([b.hint for b in found]) + beside


def edges_of(found: list[Block], scale: float, stated: bool = True) -> list[tuple[int, int, float]]:
    """(block, later block, capacity); ``stated`` says whether borders that markup states count."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}

    def room(i: int, j: int, part: float) -> float:
        return scale * part * (BORDER if stated and found[i].element.by is not found[j].element.by else 1.0)

    for i, b in enumerate(found):
        if i:
            a, z, steps = found[i - 1].element, b.element, 0
            while a is not z:  # between all neighbours of a page together, no more steps than twice its elements
                if a.depth >= z.depth:
                    a = a.parent
                else:
                    z = z.parent
                steps += 1
            out.append((i - 1, i, room(i - 1, i, FARTHER ** min(max(0, steps - 2), 20))))
        up = id(b.element.parent)
        if up in last and last[up] < i - 1:
            out.append((last[up], i, room(last[up], i, SIBLING)))
        last[up] = i
    return out


def cut_blocks(found: list[Block], odds: np.ndarray, scale: float, stated: bool = True) -> list[bool]:
    """Which blocks lie on the content side of a minimum cut."""
    n = len(found)
    g = Flow(n + 2)
    for i, o in enumerate(odds.tolist()):
        g.add(n, i, max(o, 0.0))
        g.add(i, n + 1, max(-o, 0.0))
    for i, j, room in edges_of(found, scale, stated):
        g.add(i, j, room, room)
    return g.source_side(n, n + 1)[:n]


def label(found: list[Block], model: Model) -> list[bool]:
    """Which blocks are content."""
    return cut_blocks(found, odds_of(found, model), model.scale) if found else []


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, label(found, model), strict=True) if keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, ``text`` and ``n_chars`` of each page."""
    model = fit(df, html_col)

    def rows(c: dict) -> dict:
        text = [main_text(p, model) for p in c["html"]]
        return {id_col: c["id"], url_col: c["url"], "text": text, "n_chars": [len(t) for t in text]}

    own = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return arrow_map(own, rows, f"`{id_col}` bigint, `{url_col}` string, text string, n_chars bigint")
