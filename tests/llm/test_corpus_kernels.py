"""Kernels of the corpus operators against brute force, without Spark."""

import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featherloom.llm import bpe, decontaminate, golomb, html_text, paragraphs, quality, simhash
from featherloom.llm.fmindex import FMIndex, suffix_array
from featherloom.llm.html_text import main_text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300))
def test_golomb_round_trip(values):
    x = np.unique(np.array(values, np.uint64))
    assert golomb.decode(len(x), *golomb.encode(x)).tolist() == x.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index_counts_and_locates(text, pattern):
    t = np.array(text)
    whole = np.append(t, 0)
    assert suffix_array(whole, 2).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:].tolist())
    index = FMIndex(t, 2, every=4)
    lo, hi = index.search(np.array([pattern]), np.array([len(pattern)]))
    expected = [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == expected


def test_phrases_in_long_documents_are_found_across_segments():
    phrases = decontaminate.Phrases([("a", "one two three"), ("b", "four")], 10)
    text = ("x " * 30 + "one two three ") * 5 + "Four"
    raw = np.frombuffer(text.encode(), np.uint8)
    found = list(decontaminate.Searcher(phrases, shard_words=7).documents(raw, np.array([0, len(raw)])))
    n, _, _, covered, items = found[0]
    assert (n, int(covered.sum()), sorted(phrases.names[i] for i in items)) == (5 * 33 + 1, 16, ["a", "b"])


def test_words_do_not_join_across_documents():
    phrases = decontaminate.Phrases([("a", "one two")], 10)
    raw = np.frombuffer(b"oneone two two", np.uint8)
    found = list(decontaminate.Searcher(phrases).documents(raw, np.array([0, 3, 10, 14])))
    assert [(f[0], int(f[3].sum())) for f in found] == [(1, 0), (2, 2), (1, 0)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), unique=True, min_size=1, max_size=60), st.integers(0, 4))
def test_bk_tree_forest_has_the_links_of_brute_force(values, radius):
    x = np.array(values, np.uint64)
    edges = simhash.forest_edges(np.zeros(len(x), np.int64), x, radius)

    def components(pairs):
        up = list(range(len(x)))
        for a, b in pairs:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        out = []
        for i in range(len(x)):
            while up[i] != i:
                i = up[i]
            out.append(i)
        return out

    brute = [(i, j) for i in range(len(x)) for j in range(i) if int(np.bitwise_count(x[i] ^ x[j])) <= radius]
    assert components(edges) == components(brute)


def test_block_masks_cover_every_pair_within_the_radius():
    rng = random.Random(5)
    for blocks in (5, 6, 8):
        masks = simhash.block_masks(list(range(64)), blocks, blocks - 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_fingerprint_edge_cases():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == simhash.fingerprint("one  TWO\n")


@pytest.fixture(scope="module")
def tokenizers_and_own():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.public_vocabulary()
    return tokenizers.Tokenizer.from_file(path), bpe.ForcedBoundaryBPE(bpe.read_vocabulary(path))


def test_bpe_equals_the_library(tokenizers_and_own):
    theirs, own = tokenizers_and_own
    rng = random.Random(7)
    letters = "abc ABC  \n\n\t\r'sdtrell0129é漢字\x1c\x85\xa0 　ß–!!##${}|<>日本어ñ́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "a", " a", "à b", "a  b", "a<|endoftext|> b<|endoftext|>", "<|endoftext|>", "x " * 50, "z" * 5000, " " * 3000, "the cat's  hat \n sat. "]
    ids = [np.frombuffer(x, np.int32).tolist() for x in own.encode_batch(texts)]
    assert ids == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(i) for i in ids] == [theirs.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe_decodes_odd_ids(tokenizers_and_own):
    _, own = tokenizers_and_own
    assert own.decode([]) == "" and own.decode([10**6, -1]) == ""


def test_html_rules():
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href=x>Home</a></nav>
    <div class="ad">Buy the best of all that is and you will be glad for it.</div><article><h1>A title</h1><p>First&nbsp;&amp; <b>bold
    text.<br>next</p><p>As.</p><div class="comments"><p>I like the way that this is and was for all of the time.</p></div></article>
    <form><p>Sign up</p></form><footer>&copy; all of it is ours</footer>"""
    assert main_text(page) == "A title\n\nFirst & bold text. next\n\nAs."
    assert main_text(None) == main_text("") == main_text("<p") == ""
    assert main_text("<article><p>cut off in a tag <a hre") == "cut off in a tag"


class Clashing(decontaminate.Tokeniser):
    """With its first seed all words of one length share a hash."""

    def _hashes(self, raw, starts, ends):
        return (ends - starts).astype(np.uint64) if self.seed == 0 else super()._hashes(raw, starts, ends)


def test_benchmark_words_that_share_a_hash():
    phrases = decontaminate.Phrases([("a", "one two six"), ("b", "ten")], 10, Clashing)
    assert phrases.tokeniser.seed == 1 and len(set(phrases.hashes.tolist())) == 4
    raw = np.frombuffer(b"say one two six, not ten", np.uint8)
    (n, _, _, covered, items), = decontaminate.Searcher(phrases).documents(raw, np.array([0, len(raw)]))
    assert n == 6 and covered.tolist() == [False, True, True, True, False, True] and sorted(phrases.names[x] for x in items) == ["a", "b"]


def test_words_of_thue_morse_order_have_their_own_hashes():
    """Sums of powers modulo 2^64 give such words one hash, whatever the base."""
    t = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << 12))
    words = [t, t.translate(str.maketrans("ab", "ba"))]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    assert len(set(decontaminate.Tokeniser().words(raw, np.empty(0, np.int64))[2].tolist())) == 2
    assert len(set(paragraphs.Words(raw, np.array([0])).hashes.tolist())) == 2
    lines = "\n".join(" ".join(w) for w in words).encode()
    assert len(set(paragraphs.Words(np.frombuffer(lines, np.uint8), np.array([0])).lines().key.tolist())) == 2


PROSE = "The committee has agreed on the plan for the next year and it will be sent to all of the members of the council in the spring."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><h1>News</h1><section id="comment-on-the-budget"><p>{PROSE}</p><p>Short one.</p></section></article>', f"News\n\n{PROSE}\n\nShort one."),
        (f'<article><div class="legal-analysis"><p>{PROSE}</p></div></article>', PROSE),
        (f'<div class="sidebar-layout"><p>{PROSE}</p></div>', PROSE),
        (f"<article><p>{PROSE}</p><p><a href=x>The committee has published the full report on Monday.</a></p></article>", f"{PROSE}\n\nThe committee has published the full report on Monday."),
        (f"<article><p>{PROSE}</p><ul><li><a href=x>Other news</a></li></ul></article>", PROSE),
        ("<div><a href=/>ホーム</a></div><p>日本の首都である東京は、世界で最も人口の多い都市の一つであり、政治や経済の中心として知られている。</p><p>短い。</p>", "日本の首都である東京は、世界で最も人口の多い都市の一つであり、政治や経済の中心として知られている。\n\n短い。"),
        ("<div><a href=/>Strona</a></div><p>Rada miasta przyjęła wczoraj nowy plan budowy linii tramwajowej, która połączy centrum z północnymi dzielnicami już za trzy lata.</p>", "Rada miasta przyjęła wczoraj nowy plan budowy linii tramwajowej, która połączy centrum z północnymi dzielnicami już za trzy lata."),
        (f'<p>{PROSE}</p><section class="comments"><article class="comment"><p>{PROSE}</p></article></section><div class="cookie-notice"><p>{PROSE}</p></div><div id="user-comments-2">{PROSE}</div><aside>{PROSE}</aside>', PROSE),
        (f"<div><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div><div>Buy it now.</div><div><h1>News</h1><p>{PROSE}</p><p>So be it.</p></div><div>&copy; 2020 The News</div>", f"News\n\n{PROSE}\n\nSo be it."),
    ],
)
def test_html_evidence(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page", ["<div></section>" * 40_000, "<div><section>" * 40_000 + "x" + "</div>" * 40_000, "<p>" + "word " * 400_000, "<a href=x>" * 40_000 + "</a>" * 40_000])
def test_html_long_and_deep_pages(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5


def test_html_two_passes_by_a_second_implementation():
    """Weights summed one rule at a time, and neighbours sought outwards block by block, give the same labels on all pages."""
    h = html_text
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    bare = [re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", re.sub(r' (class|id|role)="[^"]*"', "", p)) for p in pages]
    kept = 0
    for page in pages + bare:
        found = h.blocks(page)
        counts = [h._measure(b.text) for b in found]
        known = sum(s for _, s in counts) >= h.KNOWN * sum(n for n, _ in counts)
        first = []
        for b, (n, stop) in zip(found, counts, strict=True):
            ends = bool(h.ENDS.search(b.text)) and n >= 5
            rules = [(b.inside, 1), (b.out, -6), (b.hints and b.inside, -b.hints), (b.hints and not b.inside, -2 * b.hints), (n >= 15, 1)]
            rules += [(n >= 15 and known and stop >= 0.1 * n, 2), (n >= 15 and not known and ends, 2), (n >= 15 and known and stop < 0.04 * n, -3)]
            links = 2 * b.linked > len(b.text)
            good = ends and (stop >= 0.1 * n if known else True)
            rules += [(links and good, -2), (links and not good, -4), (not b.inside and bool(h.RIGHTS_MARK.match(b.text)), -6)]
            first.append(sum(w for holds, w in rules if holds))
        want = []
        for k, b in enumerate(found):
            if abs(first[k]) >= 2:
                want.append(first[k] > 0)
                continue

            def told(j, b=b):
                return 0 <= j < len(found) and found[j].region == b.region and abs(first[j]) >= 2 and not (found[j].inside and found[j].out)

            sides = [next(((d, first[k + step * d] > 0) for d in range(1, len(found)) if told(k + step * d)), None) for step in (-1, 1)]
            if sides == [None, None]:
                label = b.inside or first[k] > 0
            elif None in sides:
                label = next(s for s in sides if s)[1]
            else:
                (d, x), (e, y) = sides
                label = x if d < e or x == y else y if e < d else b.inside or b.heading and y or bool(h.ENDS.search(b.text))
            if b.heading and not b.inside and sides[1]:
                label = sides[1][1]
            want.append(bool(label))
        assert h.labels(found) == want
    # with names and elements taken away, densities alone keep the text of nine pages in ten
    for page, plain in zip(pages, bare, strict=True):
        a, b = main_text(page), main_text(plain)
        kept += (b in a or a in b) and len(b) >= 0.9 * len(a)
    assert kept >= 0.9 * len(pages)


def test_trees_learn_and_fall_back():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    trees = quality.BoostedTrees.fit(x[:400], y[:400])
    assert ((trees.score(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    # the flattened trees, walked node by node
    for row, score in zip(x[:50], trees.score(x[:50]), strict=True):
        margin = np.log(trees.base / (1 - trees.base))
        for root in trees.roots:
            node = root
            while trees.child[node] != node:
                node = trees.child[node] + int(row[trees.feature[node]] > trees.threshold[node])
            margin += trees.value[node]
        assert score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-12)
    assert quality.BoostedTrees.fit(x[:0], y[:0]).score(x[:2]).tolist() == [1.0, 1.0]
    assert len(quality.statistics(None)) == len(quality.statistics("a b")) == len(quality.NAMES)
