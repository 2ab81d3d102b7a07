"""The training-data operators against brute force, round trips and held-out accuracy, and on odd inputs."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import bpe, chat, decontaminate, html_text, langid, linedup, quality, shards, simhash, topk
from lodestream.llm import template as tpl
from lodestream.operators.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EN = "the cat and the dog were walking with that old man through this town and they said nothing at all "
FR = "le chat et le chien sont dans la maison avec une femme qui parle de la ville et des enfants "


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Null in every column, empty and long texts, repeated rows, ties."""
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "fr", "s", 4), (4, EN * 3000, "en", "s", 1), (5, "a b", "en", None, 3), (5, "a b", "en", None, 3), (None, "a b", "fr", "s", 3), (6, "日本語 éàü 🙂\n" * 5, None, "s", 3)]
    return spark.createDataFrame(rows, SCHEMA)


# --- 1 ------------------------------------------------------------------------------------------------------------


def test_language_id_is_right_on_held_out_texts(spark) -> None:
    rng = random.Random(0)
    words = {"en": EN.split(), "fr": FR.split()}
    texts, langs = zip(*[(" ".join(rng.choices(words[la], k=rng.randint(5, 200))), la) for la in ["en", "fr"] * 60], strict=True)
    got = langid.identify(docs(spark, texts, langs)).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)


def test_language_id_learns_nothing_from_held_out_rows(spark) -> None:
    texts, langs = [EN, FR] * 20, ["en", "fr"] * 20
    swapped = [("fr" if la == "en" else "en") if zlib.crc32(str(i).encode()) % 4 == 2 else la for i, la in enumerate(langs)]
    a, b = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs(spark, texts, la)).collect()) for la in (langs, swapped))
    assert a == b


def test_language_id_on_odd_rows(spark) -> None:
    got = langid.identify(odd(spark)).collect()
    assert len(got) == 9 and all(r["held_out"] is not None for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs(spark, [EN], [None])).collect()} == {"und"}


def test_network_equals_a_plain_one() -> None:
    """Convolutions, maximum and softmax, byte by byte."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 256, (3, langid.LENGTH)).astype(np.uint8)
    net = langid.train(x, np.array([0, 1, 2]), ["a", "b", "c"], epochs=2)
    for row, p in zip(x, langid.forward(net, x), strict=True):
        hidden = []
        for i in range(len(langid.WIDTHS) * langid.FILTERS):
            width, best = langid.WIDTHS[i // langid.FILTERS], -np.inf
            for at in range(langid.LENGTH):
                own = [net.emb[row[at + k]] if at + k < langid.LENGTH else np.zeros(langid.DIM) for k in range(width)]
                best = max(best, sum(float(e @ net.conv[k * langid.DIM : (k + 1) * langid.DIM, i]) for k, e in enumerate(own)))
            hidden.append(max(0.0, best + net.bias[i]))
        z = np.exp(np.array(hidden) @ net.out + net.out_bias)
        assert p == pytest.approx(z / z.sum(), abs=1e-5)


def test_gradients_equal_differences() -> None:
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 256, (5, langid.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    p = [a.astype(np.float64) for a in langid.start(3, rng)]
    p[2] += 0.3
    loss = lambda: float(-np.log(langid.forward(langid.Network(["a", "b", "c"], *p), x, np.float64)[np.arange(5), y]).mean())
    for a, g in zip(p, langid.gradients(p, x, y), strict=True):
        for at in [tuple(rng.integers(0, n) for n in a.shape) for _ in range(30)] + [np.unravel_index(abs(g).argmax(), a.shape)]:
            if a is p[1] and not langid._mask()[at]:
                continue
            was, step = a[at], 1e-5
            a[at] = was + step
            up = loss()
            a[at] = was - step
            down = loss()
            a[at] = was
            assert (up - down) / (2 * step) == pytest.approx(g[at], abs=2e-5)


def test_dirty_labels_are_bounded(spark, monkeypatch) -> None:
    monkeypatch.setattr(langid, "LANGS", 2)
    texts, langs = [EN, FR] * 20 + [EN] * 10, ["en", "fr"] * 20 + [f"x{i}" for i in range(10)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs(spark, texts, langs)).collect()}
    assert set(got.values()) == {"en", "fr"} and got[0] == "en" and got[1] == "fr"


def test_every_window_of_a_text_counts() -> None:
    x, size, n = langid.windows([b"a" * 300, b"", b"b" * 128])
    assert n.tolist() == [3, 0, 1] and size.tolist() == [128, 128, 44, 128] and x[2, 44:].sum() == 0


# --- 2 ------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(fps: list[int], ids: list) -> list:
    parent = list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[find(i)] = find(j)
    return [min((ids[j] for j in range(len(fps)) if find(j) == find(i) and ids[j] is not None), default=None) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark) -> None:
    rng = random.Random(1)
    base = [[rng.choice(EN.split()) + str(rng.randrange(50)) for _ in range(60)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "X" + str(rng.randrange(9))
            texts.append(" ".join(w).upper())
    texts += [None, "", "  x", "one", "one two", "\x0b\x0c", texts[0]]
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_components(fps, list(range(len(texts))))


@pytest.mark.parametrize("near", [-1, 0.5])
@pytest.mark.parametrize("blocks", [1, 2, 4])
@pytest.mark.parametrize("dense", [0, 900])
def test_trees_of_shards_find_all_links(dense: int, blocks: int, near: float, monkeypatch) -> None:
    monkeypatch.setattr(simhash, "SHARD_ROWS", 60)
    monkeypatch.setattr(simhash, "NEAR", near)  # below zero: no cut is good enough, all is cut by hash
    rng = np.random.default_rng(dense)
    flips = lambda x, k: x ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64) for _ in range(k)])
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    parts = [base, flips(base[:200], 1), flips(base[:200], 3), flips(base[:100], 4)]
    if dense:
        parts.append(flips(flips(np.full(dense, base[0]), 3), 2))
    points = np.unique(np.concatenate(parts))
    q, p = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3, 1))
    want = dict(zip(*map(np.ndarray.tolist, simhash.star(q, p)), strict=True))
    links, place, first = simhash.Links(len(points)), {int(x): i for i, x in enumerate(points)}, 0
    in_parts = 0
    for block in simhash.blocks(blocks):
        sample = rng.choice(points, len(points) // 2, replace=False)
        tree, after = simhash.shard_tree(sample, 2.0, block, np.random.default_rng(1), first)
        lives, sent = np.zeros(len(points), dtype=int), {}
        for leaf, at, home in simhash.visits(tree, points):
            lives[at[home]] += 1
            in_parts += leaf.parts > 1
        assert (lives == 1).all()  # in one leaf of each tree
        for shard, at, home in simhash.placed(tree, points):
            assert len(shard) == 0 or first <= shard.min() and shard.max() < after
            for x in np.unique(shard):
                sent.setdefault(int(x), []).append((at[shard == x], home[shard == x]))
        for found in sent.values():
            at, home = (np.concatenate(x) for x in zip(*found, strict=True))
            assert len(np.unique(at)) == len(at)  # no point comes twice
            a, b = simhash.shard_links(points[at], home)
            links.add(np.array([place[int(x)] for x in a], dtype=int), np.array([place[int(x)] for x in b], dtype=int))
        first = after
    assert dict(zip(*map(np.ndarray.tolist, links.forest()), strict=True)) == want
    assert near > 0 or in_parts


@pytest.mark.parametrize("n", [300, 2500, 20_000])
def test_a_dense_group_is_searched_in_little_time(n: int) -> None:
    """Fingerprints within six bits of one, where each point has many near ones."""
    rng = np.random.default_rng(n)
    points, k = np.full(n, rng.integers(0, 2**64, dtype=np.uint64)), rng.integers(1, 7, n)
    for j in range(6):
        points[k > j] ^= np.uint64(1) << rng.integers(0, 64, int((k > j).sum())).astype(np.uint64)
    points = np.unique(np.concatenate([points, rng.integers(0, 2**64, n // 4, dtype=np.uint64)]))
    home, began = rng.random(len(points)) < 0.7, time.process_time()
    a, b = simhash.shard_links(points, home)
    assert time.process_time() - began < 20
    if n <= 2500:
        q, p = np.nonzero((np.bitwise_count(points[:, None] ^ points[home][None, :]) <= 3))
        q, p = points[q], points[home][p]
        node, root = simhash.star(q[q != p], p[q != p])
        assert dict(zip(a.tolist(), b.tolist(), strict=True)) == dict(zip(node.tolist(), root.tolist(), strict=True))


def test_rows_sent_do_not_grow_with_the_points() -> None:
    rng = np.random.default_rng(3)
    sample, sent = rng.integers(0, 2**64, 16_384, dtype=np.uint64), {}
    for n in (10_000, 1_000_000, 260_000_000):
        trees = simhash.shard_trees(sample, n)
        sent[n] = sum(len(at) for tree in trees for _, at, _ in simhash.placed(tree, sample)) / len(sample)
    assert sent[10_000] <= 2 and sent[1_000_000] <= 4.5 and sent[260_000_000] <= 4.5


def test_components_of_paths_stars_and_nothing(spark) -> None:
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and len(set(got.values())) == 3 and len(got) == 93
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_on_odd_rows(spark) -> None:
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == 9 and {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {1}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one(odd(spark)).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 4 in kept


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_template_folds_and_renders() -> None:
    f = tpl.BASE_FILTERS | {"escape_control": chat.escape_control}
    tree = tpl.fold_block(tpl.parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% else %}d{% endif %}{{ x }}", f), f)
    assert tree == (tpl.Write(tpl.Const("ab1c")), tpl.Write(tpl.Name("x")))
    text, spans = tpl.render("{% for m in ms %}{{ loop.index0 }}{% generation %}{{ m.t|upper }}{% endgeneration %}{% if not loop.last %}, {% endif %}{% endfor %}", {"ms": [{"t": "a"}, {"t": "b"}]})
    assert text == "0A, 1B" and [text[a:b] for a, b in spans] == ["A", "B"]
    assert tpl.render("x {%- set y = 2 %} {{- y + 3 }}{# no #}", {})[0] == "x5"


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ x['__dict__'] }}", "{{ ''.format }}"])
def test_template_reaches_no_attributes(source: str) -> None:
    assert tpl.render(source, {"x": object()})[0] == ""


@pytest.mark.parametrize("source", ["{{ f() }}", "{{ x|nothing }}", "{% if x %}", "{% import os %}", "{{ 1 + }}", "{{ '" + "a" * 200_000 + "' }}", "{{ " + "(" * 80 + "1" + ")" * 80 + " }}"])
def test_template_refuses(source: str) -> None:
    with pytest.raises(tpl.TemplateError):
        tpl.compile_template(source)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|end|>", "a|", ""]), st.text(alphabet="ab\\<>|/[]INSTSYsen\n é", max_size=30)), max_size=6))
def test_chat_round_trip(turns: list[tuple[str, str]]) -> None:
    text, spans = chat.formatted([{"role": r, "text": t} for r, t in turns])
    assert chat.read_turns(text.removeprefix("<s>")) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    inside = [chat.escape_control(t) for _, t in turns]
    assert not any(c in t for c in chat.CONTROL for t in inside)


def test_chat_digests(spark) -> None:
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (2, None, None, "x\\|>"), (None, 0, "assistant", ""), (2, 5, "assistant", "🙂é"), (2, 5, "assistant", "🙂é")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 2 and got[1]["turns_sha256"] == sha("user\n\nassistant\n</s>[INST] ok [/INST]\n") and got[1]["loss_sha256"] == sha(rows[0][3]) and got[1]["loss_chars"] == len(rows[0][3])
    assert got[2]["loss_sha256"] == sha("🙂é🙂é") and got[2]["loss_chars"] == 4 and got[None]["loss_chars"] == 0
    full = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert all(len(full[k]["formatted"]) == got[k]["formatted_chars"] for k in got)
    assert chat.digests(df.limit(0)).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------


def plain_sw(a: list, b: list) -> int:
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] and a[i - 1] >= 0 else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-1, 4), min_size=1, max_size=12), st.lists(st.integers(-1, 4), min_size=1, max_size=12))
def test_alignment_equals_plain_one(a: list[int], b: list[int]) -> None:
    assert decontaminate.smith_waterman(np.array(a), np.array(b))[0] == plain_sw(a, b)


def test_decontamination_finds_edited_copies_and_leaves_others(spark) -> None:
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.sample(vocabulary, 40)) for _ in range(8)]
    filler = lambda n: " ".join(rng.choices(vocabulary, k=n))
    edited = items[1].split()
    for i in rng.sample(range(40), 8):
        edited[i] = "changed"
    del edited[5], edited[20]
    texts = [filler(300), filler(50) + " " + items[0].upper() + ". " + filler(50), filler(80) + " " + " ".join(edited) + "\n" + filler(20), filler(100) + " " + " ".join(items[2].split()[:12]), items[3], *[items[4] + " common"] * 30, None, ""]
    bench = spark.createDataFrame([*enumerate(items), (50, items[0]), (51, None), (52, "two words"), (None, items[5])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (4, 3), *((i, 4) for i in range(5, 35))}
    assert got[1, 0]["score"] == 1.0 and (got[1, 0]["start_word"], got[1, 0]["end_word"]) == (50, 90) and got[2, 1]["score"] >= 0.5
    left = {r["doc_id"] for r in decontaminate.remove_leaks(docs(spark, texts), bench).collect()}
    assert left == {0, 3, 35, 36}
    assert decontaminate.leaks(docs(spark, texts), bench.limit(0)).count() == 0 and decontaminate.leaks(docs(spark, []), bench).count() == 0


def found_leaks(items: decontaminate.Items, texts: list[str]) -> dict[tuple[int, int], float]:
    """Leaks of a corpus that consists of ``texts``, without Spark."""
    blocks = list(items.blocks(texts))
    counts = sum((np.bincount(items.hits(w)[1], minlength=len(items.pairs)) for w, _ in blocks), np.zeros(len(items.pairs), dtype=np.int64))
    seeds, out, before = decontaminate.Seeds(items, counts), {}, 0
    for w, starts in blocks:
        out |= {(before + t, item): score for t, item, score, _, _ in decontaminate.align(items, seeds, w, starts)}
        before += len(starts) - 1
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([6, 60, 2000]), st.sampled_from([20, 300, 10**6]))
def test_leaks_are_those_of_all_alignments(seed: int, n_words: int, block: int) -> None:
    """Seeds lose no leak, whatever is changed, put in or left out, and however common the words are."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(n_words)]
    own = {i: rng.choices(vocabulary, k=rng.randint(2, 30)) for i in range(6)}
    own = {i: w for i, w in own.items() if w not in [own[j] for j in range(i)]}
    texts = [[]]
    for w in own.values():
        every_third = ["new" if i % 3 == 2 else x for i, x in enumerate(w)]
        between = [y for x in w for y in ((x, "new") if rng.random() < 0.7 else (x,))]
        fewer = [x for x in w if rng.random() < 0.65]
        edited = ["new" if rng.random() < 0.4 else x for x in w]
        texts += [rng.choices(vocabulary, k=rng.randint(0, 20)) + x + rng.choices(vocabulary, k=rng.randint(0, 20)) for x in (w, every_third, between, fewer, edited)]
    items = decontaminate.Items(list(own.items()))
    want = {}
    for t, (i, w) in itertools.product(range(len(texts)), own.items()):
        points = plain_sw([items.vocabulary[x] for x in w], [items.vocabulary.get(x, -1) for x in texts[t]])
        if points >= decontaminate.need(len(w)):
            want[t, i] = points / (2 * len(w))
    was, decontaminate.BLOCK = decontaminate.BLOCK, block
    try:
        assert found_leaks(items, [" ".join(x) for x in texts]) == want
    finally:
        decontaminate.BLOCK = was


def test_edited_items_are_found() -> None:
    rng = random.Random(5)
    own = [(i, [f"w{rng.randrange(5000)}" for _ in range(rng.randint(15, 60))]) for i in range(100)]
    items = decontaminate.Items(own)
    for share in (0.2, 1 / 3, 0.4):
        texts = []
        for _, w in own:
            changed = set(rng.sample(range(len(w)), round(share * len(w))))
            texts.append(" ".join("new" if i in changed else x for i, x in enumerate(w)))
        got = found_leaks(items, texts)
        assert sum((i, i) in got for i in range(100)) >= 90 and all(t == i for t, i in got)


def test_decontamination_in_parts_is_the_same(spark, monkeypatch) -> None:
    items = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    texts = [f"before {t} after" for t in items] + ["Alone!", "not alone"]
    items += [items[0].upper(), items[1].replace(" ", ", ") + ".", "alone", "...", "Two words"]  # equal words count once, in whatever part
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs(spark, texts), bench).collect()))
    monkeypatch.setattr(decontaminate, "PART_CHARS", 300)
    assert sorted(map(tuple, decontaminate.leaks(docs(spark, texts), bench).collect())) == whole and [r[:2] for r in whole] == [*((i, i) for i in range(6)), (6, 8)]


def test_decontamination_on_odd_rows(spark) -> None:
    bench = spark.createDataFrame([(1, "日本語 éàü 日本語 éàü 日本語 éàü")], "item_id bigint, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(odd(spark), bench).collect()] == [6]


# --- 5 ------------------------------------------------------------------------------------------------------------


def plain_line_dedup(rows: list[tuple]) -> list:
    """Chunks by the operator's own borders; which lines go is worked out plainly, over all texts at once."""
    texts = {i: t.split("\n") for i, t in rows if t is not None}
    chunks = {i: linedup.Lines("\n".join(ls)).compared() for i, ls in texts.items() if ls != [""]}
    places: dict[str, list] = {}
    for i in chunks:
        for a, b in chunks[i]:
            places.setdefault("\n".join(texts[i][a:b]), []).append((i, a))
    out = []
    for i, text in rows:
        if text is None:
            out.append(None)
            continue
        ls, marked = texts[i], set()
        for a, b in chunks.get(i, []):
            k, at = min(places["\n".join(ls[a:b])])
            if (k, at) != (i, a):
                marked |= set(range(a, b))
        kept, run = [], []
        for n, line in enumerate([*ls, None]):
            if line is not None and n in marked:
                run.append(line)
                continue
            words = [len(x.split()) for x in run]
            if not (sum(words) >= linedup.LONG_WORDS or sum(words) >= linedup.MIN_WORDS and sum(w > 0 for w in words) >= 2):
                kept += run
            run = []
            kept += [line] if line is not None else []
        out.append("\n".join(kept))
    return out


def test_line_dedup_equals_plain_one(spark) -> None:
    rng = random.Random(3)
    lines = [" ".join(rng.choices(EN.split(), k=rng.randint(0, 30))) + str(i) for i in range(60)]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 12))) for _ in range(40)] + [None, ""]
    shared = "\n".join(lines[:6])
    texts += [f"{rng.random()} own\n{shared}\n{rng.random()} own" for _ in range(20)]
    got = {r["doc_id"]: r["text"] for r in linedup.remove_repeated(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_line_dedup(list(enumerate(texts)))


def test_line_dedup_keeps_one_copy_and_other_columns(spark) -> None:
    passage = " ".join(f"word{i}" for i in range(60))
    df = docs(spark, [f"own line {i}\n{passage}\nlast {i}" for i in range(5)]).withColumn("removed_lines", F.lit("old")).withColumn("gone", F.lit(1))
    got = linedup.remove_repeated(df).orderBy("doc_id").collect()
    assert [passage in r["text"] for r in got] == [True, False, False, False, False] and got[3]["removed_lines"] == 1 and got[3]["source"] == "s0" and got[0]["gone"] == 1


def test_chunk_borders_follow_content() -> None:
    rng = random.Random(4)
    lines = [" ".join(rng.choices(EN.split(), k=8)) + str(i) for i in range(200)]
    cuts = lambda ls: {"\n".join(ls[a:b]) for a, b in linedup.Lines("\n".join(ls)).chunks()}
    a, b = cuts(lines), cuts(["new line", *lines[:90], "another", *lines[90:]])
    assert len(a & b) > 0.9 * len(a)


def test_line_dedup_takes_whole_passages_of_short_lines(spark) -> None:
    fresh = (f"w{n}" for n in itertools.count())
    line = lambda k: " ".join(next(fresh) for _ in range(k))
    passages = ["\n".join(line(k) for _ in range(n)) for n, k in ((3, 18), (4, 14), (5, 11), (6, 9), (60, 1), (2, 5)) for _ in range(5)]
    alone = [line(19) for _ in range(5)]  # one line under LONG_WORDS stays
    around = lambda p: f"{line(7)}\n{line(9)}\n{p}\n{line(9)}\n{line(7)}"
    texts = [around(p) for _ in range(2) for p in passages + alone]
    got = [r["text"] for r in linedup.remove_repeated(docs(spark, texts)).orderBy("doc_id").collect()]
    n = len(passages + alone)
    assert got[:n] == texts[:n] and got[n + len(passages) :] == texts[n + len(passages) :]
    assert got[n : n + len(passages)] == [t.replace(p + "\n", "") for t, p in zip(texts[n:], passages, strict=False)]


def test_windows_are_the_shortest_stretches_that_go() -> None:
    rng = random.Random(6)
    for _ in range(200):
        own = linedup.Lines("\n".join(" ".join("w" * rng.choice([0, 0, 1, 2, 5, 12, 25])) for _ in range(rng.randint(1, 15))))
        going = [(a, b) for a, b in itertools.combinations(range(len(own.lines) + 1), 2) if own.goes(a, b) and own.words[a] and own.words[b - 1]]
        starts, ends = {a: min(b for x, b in going if x == a) for a, _ in going}, {b: max(a for a, x in going if x == b) for _, b in going}
        assert own.windows() == set(starts.items()) | {(a, b) for b, a in ends.items()}


def test_line_dedup_takes_every_stretch_that_may_go(spark) -> None:
    """Against all stretches of all texts, without the operator's borders."""
    rng = random.Random(8)
    pool = [" ".join(rng.choices(EN.split(), k=rng.choice([0, 1, 2, 4, 7, 11, 22]))) + ("" if i % 7 else f" {i}") for i in range(40)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(60)]
    got = [r["text"] for r in linedup.remove_repeated(docs(spark, texts)).orderBy("doc_id").collect()]
    first: dict[tuple, tuple] = {}
    seen: set[str] = set()
    for n, text in enumerate(texts):
        lines, must = text.split("\n"), set()
        words = [len(x.split()) for x in lines]
        for a, b in itertools.combinations(range(len(lines) + 1), 2):
            own = words[a:b]
            if own[0] and own[-1] and (sum(own) >= linedup.LONG_WORDS or sum(own) >= linedup.MIN_WORDS and sum(w > 0 for w in own) >= 2):
                if first.setdefault(tuple(lines[a:b]), (n, a)) != (n, a):
                    must |= set(range(a, b))
        left = got[n].split("\n") if got[n] else []
        rest = iter(lines)
        assert all(x in rest for x in left)  # what stays stands in the text's order
        assert len(left) <= len(lines) - len(must) and all(left.count(x) <= lines.count(x) - sum(lines[i] == x for i in must) for x in set(lines))
        gone = list(lines)
        for x in left:
            gone.remove(x)
        assert all(x in seen or lines.count(x) > 1 for x in gone)  # each has an equal one before it
        seen |= set(lines)
    assert {x for t in got for x in t.split("\n") if x.split()} == {x for t in texts for x in t.split("\n") if x.split()}


def test_line_dedup_without_ids(spark) -> None:
    """Rows without an id, or with the same one, are documents by their texts: one keeps a passage, and none acts on others."""
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(12)) for i in range(5))
    texts = [f"own {i} line\n{passage}\nlast {i}" for i in range(30)] + ["quite another text\nof two lines"]
    for key in (None, 7):
        df = docs(spark, texts).withColumn("doc_id", F.lit(key).cast("bigint"))
        got = [r["text"] for r in linedup.remove_repeated(df).collect()]
        assert sum(passage in t for t in got) == 1 and texts[-1] in got and len(got) == 31
        same = linedup.remove_repeated(df.unionByName(df)).collect()
        assert sum(passage in r["text"] for r in same) == 2  # both rows of one document keep it


def test_line_dedup_on_odd_rows(spark) -> None:
    got = linedup.remove_repeated(odd(spark)).collect()
    assert len(got) == 9 and sum(r["text"] is None for r in got) == 2
    assert linedup.remove_repeated(docs(spark, [])).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Please accept all of them.</div>
<article><h1>Head &amp; line</h1><p><b>First&nbsp;para.<br><p>Second   para, with
<a href="x">a link</a> and 1 &lt; 2.</p><div class="ad">Buy this now, it is very cheap.</div><ul><li>item one</li><li>item two</li></ul><form><p>Your mail</p><input></form></article>
<aside>Related stories</aside><section id="comments"><p>I do not agree with the writer at all, sorry.</p></section><!-- c --><footer>(c) us</footer></body></html>"""


MODEL = html_text.Model()


def test_main_text() -> None:
    assert html_text.main_text(PAGE, MODEL) == "Head & line\nFirst para.\nSecond para, with a link and 1 < 2.\nitem one\nitem two"
    assert html_text.main_text(None, MODEL) == "" == html_text.main_text("", MODEL)
    bare = '<div><a href=a>Home</a> <a href=b>About</a></div><div><p>A long paragraph of text, with commas, that ends here.</p><p>Another one of its kind, as you see, which ends too.</p></div>'
    assert html_text.main_text(bare, MODEL).count("\n") == 1


_STORY = "<h1>Title of it</h1><p>A text of some length, with commas, that ends here.</p><p>Yes.</p>"
_TEXT = "Title of it\nA text of some length, with commas, that ends here.\nYes."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><meta charset=utf-8><body><nav><a href=x>Home</a></nav><article>{_STORY}</article>",  # head isn't closed
        f"<head><title>t</title><article>{_STORY}</article>",
        f"<nav><a href=/>H</a></nav><article class='share-price-report'>{_STORY}</article><footer>c</footer>",
        f"<article><section id='social-history'>{_STORY}</section></article>",
        f"<article><div class='form-of-government'>{_STORY}</div></article>",
        f"<article><div class='search-result-body'>{_STORY}</div></article>",
        f"<body class='has-sidebar'><div class='content-sidebar-wrap'><article>{_STORY}</article><aside><p>Other news is here, read it.</p></aside></div>",
        f"<form action=x><nav><a href=a>A</a></nav><div>{_STORY}</div></form>",  # a form around the whole page
        f"<form action=x><nav><a href=a>A</a></nav><article>{_STORY}</article></form>",
        f"<article><div><button>Click here</div><div><svg><path d='x'/><text>no</div>{_STORY}</article>",  # skipped elements that aren't closed
        f"<article>{_STORY}</article><aside><article><h3>Other</h3><p>Read this other text, please, now.</p></article></aside>",
        f"<article>{_STORY}<section id=comments><article class='comment'><p>I do not agree, at all, with this.</p></article></section></article>",
        f"<div class='site-header'><p>My site, the best of all.</p></div><div class='entry-content'>{_STORY}<div class='ad-box'>Buy it now, it is cheap.</div></div><div class='cookie-notice'>We use them.</div>",
    ],
)
def test_evidence_misleads_no_article(page: str) -> None:
    assert html_text.main_text(page, MODEL) == _TEXT


def test_markup_takes_linear_time() -> None:
    began = time.process_time()
    for piece in ("<div>x ", "<i>x<hr>", "<b><div>", "<p><b>a b c.<br>"):
        assert html_text.main_text("<article>" + piece * 30_000 + "<p>The end.", MODEL).endswith("The end.")
    html_text.blocks("<i>" * 30_000 + "</b>" * 30_000 + "<div></div>" * 30_000)
    assert time.process_time() - began < 30


def _energy(found: list, odds: np.ndarray, scale: float, side: tuple) -> float:
    terminals = sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, side, strict=True))
    return terminals + sum(w for i, j, w in html_text.edges_of(found, scale) if side[i] != side[j])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<nav>", "</nav>", "<article>", "</article>", "<p>Some words, that end here.", "<p>Be.", "<li><a href=x>Go</a>", "<div class=ad>", "<h2>On</h2>"]), max_size=14), st.sampled_from(html_text.SCALES))
def test_labels_are_the_cheapest_of_all(parts: list[str], scale: float) -> None:
    found, model = html_text.blocks("".join(parts)), html_text.Model(scale=scale)
    if found:
        odds = html_text.odds_of(found, model)
        cheapest = min(_energy(found, odds, scale, side) for side in itertools.product([False, True], repeat=len(found)))
        assert _energy(found, odds, scale, tuple(html_text.label(found, model))) == pytest.approx(cheapest)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1/pages.parquet").exists(), reason="no test tables")
def test_cuts_are_better_than_their_terminals() -> None:
    """Pages without classes, tags and roles, other ones than were learnt from: the edges change labels, and for the better."""
    pages = [p for p in pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist() if p]
    model = html_text.fit_pages(sorted(pages[:800]))
    by_cut, alone, want, changed = [], [], [], 0
    for p in pages[800:]:
        found = html_text.blocks(p)
        odds = html_text.text_odds(html_text.without_tags(html_text.features(found)), model)
        side = html_text.cut_blocks(found, odds, model.scale, stated=False)
        changed += sum(a != (o > 0) for a, o in zip(side, odds, strict=True))
        by_cut, alone, want = by_cut + side, alone + [o > 0 for o in odds], want + [b.in_article for b in found]
    cut_f1, terminal_f1 = (html_text.f1(np.array(x), np.array(want)) for x in (by_cut, alone))
    assert changed > 100 and cut_f1 > terminal_f1 + 0.005 and cut_f1 > 0.9


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 7), st.randoms())
def test_cut_is_minimal(n: int, rng: random.Random) -> None:
    caps = [(rng.choice([0, 1, 2, 3.5]), rng.choice([0, 1, 2, 3.5])) for _ in range(n)]
    edges = [(i, j, rng.choice([0.5, 1])) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
    g = html_text.Flow(n + 2)
    for i, (a, b) in enumerate(caps):
        g.add(n, i, a)
        g.add(i, n + 1, b)
    for i, j, w in edges:
        g.add(i, j, w, w)
    cost = lambda side: sum(caps[i][0] if not s else caps[i][1] for i, s in enumerate(side)) + sum(w for i, j, w in edges if side[i] != side[j])
    side = g.source_side(n, n + 1)[:n]
    assert cost(side) == pytest.approx(min(cost(s) for s in itertools.product([False, True], repeat=n)))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ap=\"' bdivscriptlxm!-&;#19\n", max_size=80))
def test_any_html_is_read(page: str) -> None:
    html_text.main_text(page, MODEL)


def test_extract(spark) -> None:
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got) and got[0]["text"].startswith("Head & line\nFirst")
    assert html_text.extract(df.limit(0)).count() == 0


# --- 7 ------------------------------------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(1, 9), st.integers(0, 5))
def test_matrix_keeps_all_sums(counts: list[int], k: int, seed: int) -> None:
    sizes = shards.shard_sizes(sum(counts), k)
    m = shards.communication_matrix(counts, sizes, seed)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and (m >= 0).all() and max(sizes) - min(sizes) <= 1


def test_matrix_follows_the_law_of_permutations() -> None:
    """Against plain shuffles: how often each matrix comes."""
    counts, sizes, n = [3, 2, 1], [2, 2, 2], 6000
    rng, rows = random.Random(4), [p for p, c in enumerate(counts) for _ in range(c)]
    plain: dict[tuple, int] = {}
    drawn: dict[tuple, int] = {}
    for i in range(n):
        order = rng.sample(rows, len(rows))
        m = np.zeros((3, 3), dtype=int)
        for place, p in enumerate(order):
            m[p, place // 2] += 1
        plain[tuple(m.ravel())] = plain.get(tuple(m.ravel()), 0) + 1
        d = tuple(shards.communication_matrix(counts, sizes, i).ravel().tolist())
        drawn[d] = drawn.get(d, 0) + 1
    assert set(plain) == set(drawn)
    chi = sum((plain[k] - drawn[k]) ** 2 / (plain[k] + drawn[k]) for k in plain)
    assert chi < len(plain) + 4 * math.sqrt(2 * len(plain))


def test_every_place_is_as_likely(spark) -> None:
    """Over many seeds each row comes to each shard and each slot about as often."""
    df, n, seeds = spark.range(0, 16, numPartitions=3).select(F.col("id").alias("doc_id")), 16, 40
    seen = np.zeros((n, n))
    for seed in range(seeds):
        for r in shards.shuffle_to_shards(df, 4, seed=seed, cell_rows=3).collect():
            seen[r["doc_id"], r["shard"] * 4 + r["slot"]] += 1
    expected = seeds / n
    assert (seen.sum(axis=0) == seeds).all() and (seen.sum(axis=1) == seeds).all()
    assert ((seen - expected) ** 2 / expected).sum() < (n - 1) ** 2 + 5 * math.sqrt(2) * (n - 1)


def test_large_hypergeometric_has_the_right_moments() -> None:
    rng, (good, bad, n) = np.random.default_rng(0), (3 * 10**9, 5 * 10**9, 4 * 10**9)
    draws = [shards.hypergeometric(rng, good, bad, n) for _ in range(30)]
    p = good / (good + bad)
    sd = math.sqrt(n * p * (1 - p) * (good + bad - n) / (good + bad - 1))
    assert abs(np.mean(draws) - n * p) < 5 * sd / math.sqrt(30) and 0.5 < np.std(draws) / sd < 1.6


def test_shards_are_exact_and_uniform(spark) -> None:
    df = spark.range(0, 1003, numPartitions=7).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"))
    got = shards.shuffle_to_shards(df, 8, seed=3, cell_rows=40).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {len(v) for v in by.values()} == {125, 126} and len({r["doc_id"] for r in got}) == 1003
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, range(1003))[0, 1]) < 0.12
    assert shards.shuffle_to_shards(df.limit(0), 8).count() == 0
    assert shards.shuffle_to_shards(odd(spark), 8, seed=1).count() == 9


# --- 8 ------------------------------------------------------------------------------------------------------------


def test_co_training_ranks_held_out_documents(spark) -> None:
    rng = random.Random(5)
    good = lambda: " ".join(rng.choices(EN.split(), k=80)) + "."
    bad = lambda: " | ".join(w.upper() + "!!" for w in rng.choices(EN.split(), k=30))
    texts = [good() if i % 3 else bad() for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120)] + [(None, 1), (7, None)], "doc_id bigint, quality int")
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in quality.score(df, quality.fit(df, labels)).collect()}
    assert len(got) == 240 and np.mean([got[i]["keep"] == (i % 3 > 0) for i in range(120, 240)]) > 0.95
    assert all(0 <= got[i][c] <= 1 for i in got for c in ("score", "text_score", "meta_score"))


def plain_co_training(rows: list[tuple], labels: dict[int, float], held: set[int]) -> dict[int, tuple]:
    """(id, text, source, lang) rows: counts in dictionaries, each document looked at by itself."""
    views = {i: (quality.text_view(t.encode()), quality.meta_view(t.encode(), s, la)) for i, t, s, la in rows}

    def learn(text: list[tuple[int, int]], meta: list[tuple[int, int]]):
        n, bins, mass = [[0, 0], [0, 0]], [{}, {}], {}
        for view, taught in ((0, text), (1, meta)):
            for i, y in taught:
                n[view][y] += 1
                for b in views[i][0][0] if view == 0 else views[i][1]:
                    bins[view].setdefault(b, [0, 0])[y] += 1
        for i, y in text:
            for b, m in zip(views[i][0][1].tolist(), views[i][0][2].tolist(), strict=True):
                mass.setdefault(b, [0, 0])[y] += m
        total = [sum(m[y] for m in mass.values()) + quality.WORD_PRIOR * (1 << quality.WORD_BITS) for y in (0, 1)]
        odds = lambda view, b: math.log((bins[view][b][1] + 1) / (n[view][1] + 8) * (n[view][0] + 8) / (bins[view][b][0] + 1)) if b in bins[view] else 0.0
        word = lambda b: math.log((mass[b][1] + quality.WORD_PRIOR) / total[1] * total[0] / (mass[b][0] + quality.WORD_PRIOR)) if b in mass else 0.0
        z = {i: ([sum(odds(0, b) for b in v[0][0]), sum(word(b) * m for b, m in zip(v[0][1].tolist(), v[0][2].tolist(), strict=True)) / quality.MASS], [sum(odds(1, b) for b in v[1])]) for i, v in views.items()}
        order = sorted(held)
        y = np.array([int(labels[i] > 0.5) for i in order])
        fits = [quality.logistic(np.array([z[i][k] for i in order]), y) for k in (0, 1)]
        out = {i: tuple(float(np.dot(f[:-1], zi) + f[-1]) for f, zi in zip(fits, both, strict=True)) for i, both in z.items()}
        skill = [max(quality.auc(np.array([np.dot(f[:-1], z[i][k]) for i in order]), y) - 0.5, 0) ** 2 for k, f in enumerate(fits)]
        return out, [x / sum(skill) for x in skill]

    own = [(i, int(y > 0.5)) for i, y in labels.items() if i not in held]
    odds, parts = learn(own, own)
    for _ in range(quality.ROUNDS):
        sure = lambda k: [(i, int(odds[i][k] > 0)) for i in views if i not in labels and abs(odds[i][k]) >= math.log(quality.SURE / (1 - quality.SURE))]  # noqa: E731, B023
        odds, parts = learn(own + sure(1), own + sure(0))
    return {i: tuple(1 / (1 + math.exp(-x)) for x in (parts[0] * a + parts[1] * b, a, b)) for i, (a, b) in odds.items()}


def _mixed(rng: random.Random, n: int) -> list[tuple]:
    words = EN.split() + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(w if good or rng.random() < 0.5 else w.upper() + rng.choice(["!!", "#", "%%"]) for w in rng.choices(words, k=rng.randint(1, 60)))
        source = f"s{rng.randrange(3) + (0 if good else 2)}" if rng.random() < 0.9 else None
        rows.append((i, text, source, rng.choice(["en", "fr", None]), good != (rng.random() < 0.05)))
    return rows


def test_co_training_equals_a_plain_one(spark) -> None:
    rng = random.Random(12)
    rows = _mixed(rng, 300)
    df = spark.createDataFrame([(i, t, la, s, len(t)) for i, t, s, la, _ in rows], SCHEMA)
    labels = {i: float(g) for i, *_, g in rows if i % 2}
    part = F.xxhash64(F.lit("quality"), "id").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    held = {r["id"] for r in spark.createDataFrame([(i,) for i in labels], "id bigint").where(part < 0.25).collect()}
    known = spark.createDataFrame(list(labels.items()), "doc_id bigint, quality double")
    got = [{r["doc_id"]: (r["score"], r["text_score"], r["meta_score"]) for r in quality.score(d, quality.fit(d, known)).collect()} for d in (df, df.repartition(7))]
    assert got[0] == got[1], "however rows are dealt"
    want = plain_co_training([(i, t, s, la) for i, t, s, la, _ in rows], labels, held)
    assert all(got[0][i] == pytest.approx(want[i], abs=1e-6) for i in want) and 0 < len(held) < 80


def test_views_teach_each_other(spark, monkeypatch) -> None:
    """A source that no label knows: what the text view is sure of there tells the metadata view about it."""
    rng = random.Random(13)
    good = lambda: " ".join(rng.choices(EN.split(), k=60)) + "."
    bad = lambda: " | ".join(w.upper() + "##" for w in rng.choices(EN.split(), k=60))
    texts = [good() if i % 2 else bad() for i in range(300)] + [bad() for _ in range(100)]
    rows = [(i, t, "en", "spam" if i >= 300 else f"s{i % 3}", 1) for i, t in enumerate(texts)]
    df, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    after = quality.fit(df, labels)
    monkeypatch.setattr(quality, "ROUNDS", 0)
    before = quality.fit(df, labels)
    meta = lambda m, i: m.meta_odds(quality.meta_view(texts[i].encode(), rows[i][3], "en"))
    assert meta(after, 350) < meta(before, 350) - 1 and (after.weights != before.weights).any()
    views = quality.text_view(b"One TWO three."), quality.meta_view(b"One TWO three.", "s", None)
    assert views[1] == quality.meta_view(b"Six ten? eight", "s", None), "the metadata view doesn't read the words"


def test_quality_without_labels_and_on_odd_rows(spark) -> None:
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.score(odd(spark), quality.fit(odd(spark), none)).collect()
    assert len(got) == 9 and {r["score"] for r in got} == {0.5}
    assert quality.score(docs(spark, []), None).count() == 0


def test_auc_counts_ties_by_half() -> None:
    assert quality.auc(np.array([1.0, 1.0]), np.array([1, 0])) == 0.5 and quality.auc(np.array([2.0, 1.0]), np.array([1, 0])) == 1.0


# --- 9 ------------------------------------------------------------------------------------------------------------


def reference() -> tiktoken.Encoding:
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n\t'sre19.,! 　日🙂​", max_size=60), st.integers(1, 8))
def test_pieces_leave_ids_as_they_are(text: str, size: int) -> None:
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    assert "".join(bpe.pieces(text, size)) == text
    ids = bpe.encode(enc, text, size)
    assert ids == enc.encode_ordinary(text) and bpe.decode(enc, ids) == text.encode()


@pytest.mark.parametrize("gap", [" " * 2_000_000, "\n" * 2_000_000, " \n\t\u3000" * 400_000])
def test_very_long_white_space(gap: str) -> None:
    """The whole run but its last character is one match, which then begins the next one if it is a space."""
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    want = enc.encode_ordinary("so") + enc._encode_single_piece(gap[:-1]) + enc.encode_ordinary(gap[-1] + "it ends.") + enc._encode_single_piece(gap)
    ids = bpe.encode(enc, f"so{gap}it ends.{gap}")
    assert ids == want and bpe.decode(enc, ids) == f"so{gap}it ends.{gap}".encode()


def test_bpe_digests_and_round_trip(spark) -> None:
    enc, df = reference(), odd(spark)
    got = bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == 9
    for r, (_, text, *_rest) in zip(got, df.collect(), strict=True):
        ids = enc.encode_ordinary(text or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert [bytes(r["bytes"]).decode() for r in back.collect()] == [r["text"] or "" for r in df.collect()]
    assert bpe.digests(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


# --- 10 -----------------------------------------------------------------------------------------------------------


def plain_top_k(rows: list[tuple], k: int) -> set[tuple]:
    fine = [(i, r, [math.floor(64 * float(x)) for x in v]) for i, (r, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q, v in fine:
        if q is not None and q % 20 == 0:
            clamp = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
            scored = sorted((-clamp(sum(a * b for a, b in zip(v, w, strict=True))), c is None, c if c is not None else 0, j) for j, c, w in fine if j != i and len(w) == len(v))[:k]
            out |= {(q, n, None if null else c, -s) for n, (s, null, c, _) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize(("scale", "k"), [(1.0, 5), (3000.0, 3), (1e9, 4), (1e10, 150)])
def test_top_k_equals_brute_force(spark, scale: float, k: int) -> None:
    rng = np.random.default_rng(int(k))
    rows = [(i, (rng.integers(-3, 4, 6) / 7 * scale).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(1000, None), (1020, [float("nan")] * 6), (1040, [None] * 6), (1060, [float("inf")] * 6), (60, [1.0, 2.0]), (61, [2.0, 2.0]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).repartition(5)
    got = {tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, k).collect()}
    assert got == plain_top_k(rows, k)


def test_top_k_in_chunks_and_without_rows(spark, monkeypatch) -> None:
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = plain_top_k(rows, 3)
    monkeypatch.setattr(topk, "CHUNK", 7)
    assert {tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, 3).collect()} == want
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0
