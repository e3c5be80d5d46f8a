"""Benchmark decontamination with an FM-index per shard of the training texts.

Words are runs of ASCII letters and digits (A to Z in lower case) and of characters
beyond ASCII. The benchmark's windows are the test phrases: ``window`` consecutive
words of an item, or all of a shorter item. A task cuts its documents into shards of
bounded size, builds an FM-index of each shard's words, finds the phrases by backward
search through wavelet-tree ranks, locates their occurrences by sampled suffix
positions, checks the located words byte for byte, and merges them into removal spans.

Words outside the benchmark's vocabulary and the ends of documents share one symbol, a
run of them being one; it keeps phrases within a document. The benchmark is read in blocks of at most ``BLOCK_BYTES`` of
text, each broadcast to one pass, so nothing that is broadcast grows with a table; the
passes are chained without a shuffle. A document beyond a shard is indexed in segments
that overlap by a phrase less one word.

Cases. Null and empty texts have no words and no hits. An item without words has no
windows. Items of null id are searched under the id "". Benchmark words that share a hash
get other hashes; document words that share one with them are told apart by their bytes. Repeated items count once by id;
repeated documents each get a row. An empty benchmark hits nothing. Extra columns of
``docs`` pass through ``clean`` and are not read by ``contamination``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .fmindex import FMIndex

WINDOW = 10
#: Text bytes of a shard, and of the benchmark texts in a block.
SHARD_BYTES, BLOCK_BYTES = 6 << 20, 8 << 20
#: Bytes tokenised at once.
PIECE = 1 << 20
OTHER, FIRST = 1, 2

IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
ODD = 0x9E3779B97F4A7C15

SPANS = "array<struct<word_from:long,word_to:long,byte_from:long,byte_to:long>>"


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Tokeniser:
    """Words of byte buffers: their start, end and 64-bit hash, sums of mixes of letters and their places."""

    def __init__(self, seed: int = 0):
        self.seed, self.places = seed, np.empty(0, np.uint64)

    def _hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.uint64)
        long = ends - starts
        if long.max() > len(self.places):
            self.places = _mix(np.arange(2 * int(long.max()), dtype=np.uint64) * np.uint64(ODD) + np.uint64(2 * self.seed + 1))
        first = np.cumsum(long) - long
        place = np.arange(int(long.sum())) - np.repeat(first, long)
        letters = raw[place + np.repeat(starts, long)]
        return _mix(np.add.reduceat(_mix(self.places[place] + LOWER[letters]), first) + long.astype(np.uint64))

    def words(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of each word; no word goes across a position of ``cuts``."""
        found, at = [], 0
        while at < len(raw):
            stop = min(len(raw), at + PIECE)
            if stop < len(raw):
                gap = np.flatnonzero(~IS_WORD[raw[at:stop]])
                if len(gap):
                    stop = at + int(gap[-1]) + 1
                else:  # one word fills the piece: go on to its end
                    while stop < len(raw) and IS_WORD[raw[stop]]:
                        stop += 1
            piece = raw[at:stop]
            inside = IS_WORD[piece]
            begins = np.r_[True, ~inside[:-1]]
            begins[cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, stop)] - at] = True
            starts = np.flatnonzero(inside & begins)
            ends = np.flatnonzero(inside & np.r_[~inside[1:] | begins[1:], True]) + 1
            found.append((starts + at, ends + at, self._hashes(piece, starts, ends)))
            at = stop
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Phrases:
    """The windows of one block of benchmark items, over the block's own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int, tokeniser: type[Tokeniser] = Tokeniser):
        vocab, where, texts = {}, {}, []
        for item, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = tokeniser().words(raw, np.empty(0, np.int64))
            low = LOWER[raw].tobytes()
            spelt = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            texts.append((item, [vocab.setdefault(w, FIRST + len(vocab)) for w in spelt]))
        for item, ids in texts:
            for k in range(max(len(ids) - window, 0) + 1 if ids else 0):
                where.setdefault(tuple(ids[k : k + window]), set()).add(item)
        # words of the benchmark that share a hash are told apart by the next seed
        self.spelt = list(vocab)
        ends = np.cumsum(np.fromiter(map(len, vocab), np.int64, len(vocab)))
        starts = ends - np.diff(ends, prepend=0)
        for seed in itertools.count():
            self.tokeniser = tokeniser(seed)
            hashes = self.tokeniser._hashes(np.frombuffer(b"".join(vocab), np.uint8), starts, ends)
            if len(np.unique(hashes)) == len(hashes):
                break
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order + FIRST
        self.bits = max(2, (FIRST + len(vocab) - 1).bit_length())
        self.names = sorted({x for s in where.values() for x in s})
        number = {x: i for i, x in enumerate(self.names)}
        self.items = [[number[x] for x in s] for s in where.values()]
        self.lengths = np.array([len(w) for w in where], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        self.patterns = np.zeros((len(where), self.longest), np.int64)
        for i, w in enumerate(where):
            self.patterns[i, self.longest - len(w) :] = w

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), OTHER)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], OTHER)


def occurrences(phrases: Phrases, symbols: np.ndarray, spelt) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position) of all phrases in one shard; ``spelt(k)`` gives the bytes of its word k."""
    index = FMIndex(symbols, phrases.bits)
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    many = hi - lo
    which = np.repeat(np.arange(len(many)), many)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    place = index.locate(rows)
    # symbols come from hashes: make sure of the words themselves
    if len(place):
        diff = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(diff, place, 1)
        np.add.at(diff, place + phrases.lengths[which], -1)
        wrong = [k for k in np.flatnonzero(np.cumsum(diff[:-1])).tolist() if spelt(k) != phrases.spelt[symbols[k] - FIRST]]
        if wrong:
            bad = np.zeros(len(symbols) + 1, np.int64)
            bad[np.array(wrong) + 1] = 1
            upto = np.cumsum(bad)
            fine = upto[place + phrases.lengths[which]] == upto[place]
            which, place = which[fine], place[fine]
    return which, place


def _segments(n: int, most: int, overlap: int):
    """[from, to) parts of n words, each of at most ``most``, overlapping by ``overlap``."""
    at = 0
    while True:
        yield at, min(n, at + most)
        at += most
        if at >= n:
            return
        at = max(0, at - overlap)


class Searcher:
    """Hits of one block of phrases in groups of documents."""

    def __init__(self, phrases: Phrases, shard_words: int = SHARD_BYTES // 4):
        self.phrases, self.tokeniser, self.shard_words = phrases, phrases.tokeniser, shard_words

    def documents(self, raw: np.ndarray, offsets: np.ndarray):
        """Per document of the buffer: (number of words, starts, ends, hit words, item numbers)."""
        p = self.phrases
        starts, ends, hashes = self.tokeniser.words(raw, offsets)
        symbols = p.symbols(hashes)
        bounds = np.searchsorted(starts, offsets)
        n = len(offsets) - 1
        hit, items = np.zeros(len(starts) + 1, np.int64), [set() for _ in range(n)]
        if len(p.patterns) and len(starts):
            for words in self._shards(bounds, n):
                text = np.where(words < 0, OTHER, symbols[words])
                # no phrase has a foreign word or an end of document, so a run of them is one symbol
                broken = text == OTHER
                broken[1:] &= broken[:-1].copy()
                broken[0] = False
                words, text = words[~broken], text[~broken]

                def spelt(k, words=words):
                    w = words[k]
                    return LOWER[raw[starts[w] : ends[w]]].tobytes()

                which, place = occurrences(p, text, spelt)
                if len(which):
                    first = words[place]
                    np.add.at(hit, first, 1)
                    np.add.at(hit, first + p.lengths[which], -1)
                    doc = np.searchsorted(bounds, first, side="right") - 1
                    for d, w in np.unique(np.stack((doc, which)), axis=1).T.tolist():
                        items[d].update(p.items[w])
        covered = np.cumsum(hit[:-1]) > 0
        for d in range(n):
            a, b = bounds[d], bounds[d + 1]
            yield int(b - a), starts[a:b] - offsets[d], ends[a:b] - offsets[d], covered[a:b], items[d]

    def _shards(self, bounds: np.ndarray, n: int):
        """Word numbers of each shard, -1 between documents."""
        part, size = [], 0
        for d in range(n):
            for a, b in _segments(int(bounds[d + 1] - bounds[d]), self.shard_words, self.phrases.longest - 1):
                if size and size + b - a > self.shard_words:
                    yield np.concatenate(part)
                    part, size = [], 0
                part += [np.arange(a, b) + bounds[d], np.array([-1])]
                size += b - a
        if size:
            yield np.concatenate(part)


def spans(covered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Maximal runs of hit words, as word numbers and byte offsets, each [from, to)."""
    edge = np.diff(np.r_[False, covered, False].astype(np.int8))
    pairs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
    return [{"word_from": a, "word_to": b, "byte_from": int(starts[a]), "byte_to": int(ends[b - 1])} for a, b in pairs]


def _marked(held: list[dict], n: int) -> np.ndarray:
    covered = np.zeros(n, bool)
    for s in held:
        covered[s["word_from"] : s["word_to"]] = True
    return covered


def _pass(block, window: int, last: bool):
    """One pass over the documents with one block of the benchmark; the last hands on no text."""

    def run(batches):
        searcher = Searcher(Phrases(block.value, window))
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SHARD_BYTES)) - 1)
                to = min(to, len(text))
                part = batch.slice(at, to - at)
                own = offsets[at : to + 1]
                held, named = part.column(3).to_pylist(), part.column(4).to_pylist()
                n_words, found, items = [], [], []
                for k, (n, starts, ends, covered, numbers) in enumerate(searcher.documents(raw[own[0] : own[-1]], own - own[0])):
                    if held[k]:
                        covered = covered | _marked(held[k], n)
                    n_words.append(n)
                    found.append(spans(covered, starts, ends) if covered.any() else [])
                    items.append(sorted({*(named[k] or ()), *(searcher.phrases.names[x] for x in numbers)}))
                out = [pa.array(n_words, pa.int64()), pa.array(found, part.schema.field(3).type), pa.array(items, part.schema.field(4).type)]
                first = 1 if last else 2
                yield pa.RecordBatch.from_arrays([*part.columns[:first], *out], names=[*part.schema.names[:first], *part.schema.names[2:]])
                at = to

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The benchmark's (id, text) rows in lists of at most BLOCK_BYTES of text, with whether it is the last."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text.encode()) > BLOCK_BYTES:
            yield block, False
            block, size = [], 0
        block.append((item, text))
        size += len(text.encode())
    yield block, True


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, spans, items) for each document: hit spans and the ids of hit items, in string order."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for block, last in _blocks(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        rows = rows.mapInArrow(_pass(sent, window, last), f"id {kind}, {'' if last else 'text string, '}n_words long, spans {SPANS}, items array<string>")
    return rows


def without_spans(text: str, found: list) -> str:
    """``text`` less the byte ranges of its removal spans."""
    raw, at, kept = text.encode(), 0, []
    for s in found:
        kept.append(raw[at : s["byte_from"]])
        at = s["byte_to"]
    return b"".join([*kept, raw[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with their own columns in their own order."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    moved = docs.toDF(*names.values())
    packed = moved.select(F.struct(*names.values()).alias("row"), F.col(names[text_col]).alias("text"))
    found = contamination(packed, benchmark, "row", "text", window=window).where("size(spans) = 0")
    return found.select("id.*").toDF(*docs.columns)
