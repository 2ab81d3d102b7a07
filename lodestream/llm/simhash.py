"""SimHash near-duplicates by vantage-point trees.

Fingerprints: words are runs of bytes other than ASCII white space, A-Z lower-cased; features are shingles of three
words, repeats included (fewer words: the whole sequence); a bit is set if it is set in over half of the features'
XXH64 (seed 42). Texts without words have fingerprint zero and are linked like any other.

Links: distinct fingerprints at 3 or fewer differing bits. Vantage-point trees over a bounded sample cut the space into
shards: a node keeps a vantage point and a distance, points up to it go left and the others right. A fingerprint lives
in one shard of a tree and visits, by the triangle bound, the later shards that can hold a point within reach, so each
pair meets in exactly one shard. In 64 dimensions most points lie near any border, and the visits of one tree grow
with its depth (157 rows a point at 260 million points). So there may be several trees, one for each block of bits: a
pair that differs in 3 bits differs in at most 1 in one of two halves, and in none in one of four quarters. The distance
over a block is a distance too, with a smaller reach: its tree bounds by the block or by all bits, whichever is
better at a node, and each link is found in one of the trees at least. The number of blocks (1, 2 or 4) is the one that
sends the fewest rows, by the sample: at most about 4 a point, whatever their number. A shard that no vantage point
cuts well is cut by hash instead, and its parts are compared two by two.

In a shard a second tree, over all its points, is searched by all its points and visitors at once. Where many points
lie within 3 bits of a vantage point, they are linked to it and not compared with each other: that keeps every
component and spares the square of a dense group. A shard returns a spanning star for each of its local components;
components of all shards are joined by contraction.

Defined results: null text has no words; a null id keeps its row, but never names a component with other members;
repeated ids are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow_map
from lodestream.operators.components import components
from lodestream.session import cut

BITS = 3
#: Fingerprints that live in one shard, about, and the size of the sample that the shards' trees are made from.
SHARD_ROWS, SAMPLE = 4_000, 262_144
#: Points of the sample that a shard has at least, points that a cut is chosen by, and vantage points that are tried.
FEWEST, SEEN, TRIED = 16, 4_096, 8
#: What a row in the largest shard counts when the number of trees is chosen: the tasks that wait for it.
WAITING = 8
#: Points up to which one or two trees can send fewer rows than four.
FEW = 1_000_000
#: Share of a node's points near a border from which it isn't cut there, and the least share of the smaller side.
NEAR, UNEVEN = 0.5, 0.1
#: Points of a tree's leaf, comparisons that are made at one time, and links that are held before they are joined.
LEAF, BLOCK, HELD = 64, 1 << 22, 500_000
#: Share of a node's points in one ball from which they are linked to its middle.
DENSE = 0.1


def features(text: bytes, words: int = 3) -> list[int]:
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = [e + i for i, e in enumerate(accumulate(map(len, found)))]
    starts = [0, *(e + 1 for e in ends)]
    xxh = xxhash.xxh64_intdigest
    return [xxh(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :], strict=False)]


def fingerprint_many(texts: list[bytes | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    out = np.zeros(len(texts), dtype=np.uint64)
    at = 0
    while at < len(texts):  # blocks of some 100,000 features
        hashes, sizes, first = [], [], at
        while at < len(texts) and len(hashes) < 100_000:
            h = features(texts[at] or b"")
            hashes += h
            sizes.append(len(h))
            at += 1
        if not hashes:
            continue
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n = np.array(sizes)
        full = np.flatnonzero(n)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])[full]
        set_in = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[first + full] = np.packbits(2 * set_in > n[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row, fp as a signed long with the fingerprint's bits."""

    def rows(c: dict) -> dict:
        return {id_col: c["id"], "fp": fingerprint_many(c["text"]).view(np.int64)}

    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), rows, f"`{id_col}` bigint, fp bigint")


def bits_between(points: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ v).astype(np.int16)


# --- the tree of shards -------------------------------------------------------------------------------------------


ALL = np.uint64((1 << 64) - 1)


@dataclass(slots=True)
class Node:
    """A cut: points whose bits under ``mask`` differ from the vantage point's in ``most`` places or fewer go left."""

    vantage: np.uint64
    mask: np.uint64
    reach: int
    most: int
    left: Node | Leaf
    right: Node | Leaf

    def distance(self, points: np.ndarray) -> np.ndarray:
        return bits_between(points & self.mask, self.vantage & self.mask)


@dataclass(slots=True)
class Leaf:
    """The shards from ``first`` on: one for each two of ``parts`` parts, by hash, of the points that live there."""

    first: int
    parts: int

    def shard(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
        return self.first + a * self.parts + b


def blocks(n: int) -> list[tuple[np.uint64, int]]:
    """(mask, bits that a link may differ in there) of n blocks, of which a link keeps to the bound in one at least."""
    width = 64 // n
    return [(np.uint64(((1 << width) - 1) << (width * i)), BITS // n) for i in range(n)]


def shard_tree(sample: np.ndarray, rows_each: float, block: tuple[np.uint64, int], rng: np.random.Generator, first: int = 0) -> tuple[Node | Leaf, int]:
    """A tree for points of which ``sample`` stands for ``rows_each`` each, and the number after its last shard."""
    best, target = None, max(SHARD_ROWS, FEWEST * rows_each)
    large = len(sample) * rows_each > 1.5 * target
    part = sample if len(sample) <= SEEN else rng.choice(sample, SEEN, replace=False)
    for v in rng.choice(part, min(TRIED, len(part)), replace=False) if large else ():
        for mask, reach in dict.fromkeys((block, (ALL, BITS))):
            up_to = np.cumsum(np.bincount(bits_between(part & mask, v & mask), minlength=65))
            left = up_to / len(part)
            # what lives to the left and visits the right side
            near = left - np.concatenate([np.zeros(reach), left[: len(left) - reach]])
            cost = np.where((left >= UNEVEN) & (left <= 1 - UNEVEN) & (near <= NEAR), near + abs(left - 0.5) / 2, np.inf)
            m = int(cost.argmin())
            if np.isfinite(cost[m]) and (best is None or cost[m] < best[0]):
                best = (cost[m], v, mask, reach, m)
    if best is None:
        parts = max(1, round(len(sample) * rows_each / target)) if large else 1
        return Leaf(first, parts), first + parts * parts
    _, v, mask, reach, m = best
    near = bits_between(sample & mask, v & mask) <= m
    left, first = shard_tree(sample[near], rows_each, block, rng, first)
    right, first = shard_tree(sample[~near], rows_each, block, rng, first)
    return Node(v, mask, reach, m, left, right), first


def visits(tree: Node | Leaf, points: np.ndarray) -> list[tuple[Leaf, np.ndarray, np.ndarray]]:
    """(leaf, places, lives there): where the points live, and the later leaves that can hold a point within their reach."""
    out, todo = [], [(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if isinstance(node, Leaf):
            out.append((node, at, home))
            continue
        d = node.distance(points[at])
        # what lives left visits the right side; a visitor, which lives before both, goes to either
        go = d <= node.most
        to_left = go | ~home & (d - node.reach <= node.most)
        todo.append((node.left, at[to_left], (home & go)[to_left]))
        to_right = d + node.reach > node.most
        todo.append((node.right, at[to_right], (home & ~go)[to_right]))
    return out


def placed(tree: Node | Leaf, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shards, places, lives there) of the points of one tree; in a shard each one that lives there meets all others."""
    for leaf, at, home in visits(tree, points):
        part = (((points[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(leaf.parts)).astype(np.int64)
        for j in range(leaf.parts):
            # part i lives in the shards (i, j) with j >= i; parts j > i and, where i = j, visitors come there
            own = home & (part <= j)
            yield leaf.shard(part[own], j), at[own], np.ones(int(own.sum()), dtype=bool)
            later = home & (part > j)
            yield leaf.shard(j, part[later]), at[later], np.zeros(int(later.sum()), dtype=bool)
            visitors = ~home
            yield np.full(int(visitors.sum()), leaf.shard(j, j)), at[visitors], np.zeros(int(visitors.sum()), dtype=bool)


def shard_trees(sample: np.ndarray, n: int) -> list[Node | Leaf]:
    """Trees for ``n`` points, as many as send the fewest rows of the sample and have no large shard."""
    best = None
    for k in (1, 2, 4) if n <= FEW else (4,):
        trees, first, sent, largest = [], 0, 0, 0
        for block in blocks(k):
            tree, first = shard_tree(sample, n / max(1, len(sample)), block, np.random.default_rng(k), first)
            trees.append(tree)
            shards = [s for s, _, _ in placed(tree, sample)]
            sent += sum(map(len, shards))
            largest = max(largest, *np.unique(np.concatenate(shards), return_counts=True)[1].tolist()) if sent else 0
        if best is None or sent + WAITING * largest < best[0]:
            best = (sent + WAITING * largest, trees)
        if first == k:  # a shard a tree
            break
    return best[1]


# --- links within a shard -----------------------------------------------------------------------------------------


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the edges a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


class Links:
    """The components of places of an array that edges join; edges within a known component go as they come."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        new = x != y
        if new.any():
            self.a.append(x[new])
            self.b.append(y[new])
            self.held += len(self.a[-1])
            if self.held > HELD:
                self.merge()

    def merge(self) -> None:
        if self.held:
            node, root = star(np.concatenate(self.a), np.concatenate(self.b))
            to = np.arange(len(self.label))
            to[node] = root
            self.label = to[self.label]
            self.a, self.b, self.held = [], [], 0

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, least place of its component) of those that are linked."""
        self.merge()
        node = np.flatnonzero(np.bincount(self.label, minlength=1)[self.label] > 1)
        return node, self.label[node]


def search(points: np.ndarray, kept: np.ndarray, asked: np.ndarray, links: Links, rng: np.random.Generator) -> None:
    """Links that join the components which pairs within BITS of ``asked`` x ``kept`` (places in ``points``) join."""
    todo = [(kept, asked, False)]  # and whether what is kept is one component already
    while todo:
        kept, asked, one = todo.pop()
        if one and len(kept) and len(asked):
            if links.held > len(asked) // 8:
                links.merge()
            asked = asked[links.label[asked] != links.label[kept[0]]]
        if not len(kept) or not len(asked):
            continue
        if len(kept) <= LEAF:
            step = max(1, BLOCK // len(kept))
            for i in range(0, len(asked), step):
                some = asked[i : i + step]
                near = np.bitwise_count(points[some][:, None] ^ points[kept][None, :]) <= BITS
                if one:
                    links.add(some[near.any(axis=1)], kept[:1].repeat(near.any(axis=1).sum()))
                elif np.count_nonzero(near) > 4 * len(some):
                    # a dense place: each to the first that is near it, and those that are near one another or a third
                    hit = near.any(axis=1)
                    links.add(some[hit], kept[near[hit].argmax(axis=1)])
                    p, q = np.nonzero(near.T.astype(np.float32) @ near.astype(np.float32))
                    links.add(kept[p], kept[q])
                else:
                    q, p = np.nonzero(near)
                    links.add(some[q], kept[p])
            continue
        few = points[rng.choice(kept, min(512, len(kept)), replace=False)]
        tries = rng.choice(kept, 8, replace=False)
        away = np.bitwise_count(points[tries][:, None] ^ few[None, :])
        dense = (away <= BITS).mean(axis=1)
        if not one and dense.max() >= DENSE:
            v = tries[int(dense.argmax())]
            dk, dq = bits_between(points[kept], points[v]), bits_between(points[asked], points[v])
            ball, near = kept[dk <= BITS], asked[dq <= BITS]
            links.add(ball, np.full(len(ball), v))
            links.add(near, np.full(len(near), v))
            # what lies around the ball may be near one of it; all others are as before
            todo += [(kept[dk > BITS], asked, False), (ball, asked[(dq > BITS) & (dq <= 2 * BITS)], True)]
            continue
        v = tries[int(away.std(axis=1).argmax())]
        dk, dq = bits_between(points[kept], points[v]), bits_between(points[asked], points[v])
        m = int(np.median(dk))
        if (dk <= m).all():
            m -= 1
        if not (dk <= m).any():  # all at one distance: halves, without a bound
            half = len(kept) // 2
            todo += [(kept[:half], asked, one), (kept[half:], asked, one)]
            continue
        todo += [(kept[dk <= m], asked[dq - BITS <= m], one), (kept[dk > m], asked[dq + BITS > m], one)]


def shard_links(fps: np.ndarray, home: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, fingerprint of its local component) for the linked points of one shard."""
    links = Links(len(fps))
    search(fps, np.flatnonzero(home), np.arange(len(fps)), links, np.random.default_rng(seed))
    node, root = links.forest()
    return fps[node], fps[root]


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints ``fps`` (fp long) with the components of all links."""
    n = fps.count()
    part = F.xxhash64("fp").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    # SAMPLE rows, about, by a hash
    sample = fps.where(part < SAMPLE / n).toPandas()["fp"].sort_values().to_numpy(np.int64).view(np.uint64) if n > SHARD_ROWS else np.zeros(0, dtype=np.uint64)
    trees = shard_trees(sample, n)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            points = f["fp"].to_numpy(np.int64).view(np.uint64)
            found = [x for tree in trees for x in placed(tree, points) if len(x[0])]
            if found:  # one frame for all shards: there are many, and a frame costs more than its few rows
                shard, at, home = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"shard": shard, "fp": points[at].view(np.int64), "home": home})

    def link(f: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(f["fp"].to_numpy(np.int64).view(np.uint64), f["home"].to_numpy(bool))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.mapInPandas(place, "shard bigint, fp bigint, home boolean").groupBy("shard").applyInPandas(link, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: id, ``fingerprint`` (16 hex digits), ``component_id`` (least id reachable)."""
    docs = cut(fingerprints(df, id_col, text_col), "simhash-fingerprints")
    first = cut(docs.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-distinct")
    roots = components(link_fingerprints(first.select("fp")))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the least of their component (a null id only where no member has another)."""
    stay = near_duplicates(df, id_col, text_col).where(F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("__stay")).distinct()
    return df.join(stay, F.col(id_col).eqNullSafe(F.col("__stay")), "left_semi")
