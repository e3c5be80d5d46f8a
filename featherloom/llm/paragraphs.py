"""Near-duplicate paragraphs by MinHash banding, across all documents.

Paragraphs are of two kinds, whose words are runs of characters other than ASCII white
space, A to Z in lower case. *Lines* of ``least`` words or more; and *units*, pieces of
``UNIT`` words cut from each text's words, across line ends, where the hash of the
shingle that begins there is the least of ``REACH`` places in a row. A unit begins where
its words say, not where a line does, so any ``UNIT + REACH`` (48) equal words in a row
hold an equal unit or one of a word's shift, and every passage of over 50 words that
repeats is found wherever it starts and ends, inside longer lines, in lines wrapped anew
or in texts without any.

Every shingle of five words is hashed; bands of ``ROWS`` minima key the buckets. Lines
have ``BANDS``, tuned so that two of Jaccard similarity 0.8 meet with probability 0.997,
units ``UNIT_BANDS``: a passage mostly holds several of them.

One shuffle deals (bucket, paragraph) to buckets, each paragraph once for every
``SEEN`` of its task, and one sorted pass over each bucket gives its leader, its members
and the paragraphs that occur again. Members are verified against the leader by exact
Jaccard, which is linear in the bucket. A bucket whose members are not all tied so, by its
own leader or another's, then has all pairs of its components compared, within tasks of
bounded size that give a forest of links, never the pairs. Components of the verified
links and equal paragraphs are the classes; of a class, the first paragraph by document
and place in it stays and the others are removed.

Paragraphs and shingles are told apart by 64-bit hashes of their words, sums and chains
of non-linear mixes: of n distinct ones about n * n / 2^65 pairs are taken for equal.

Rows have byte spans in the text's UTF-8, ``start`` to ``stop``.

Cases. Null and empty texts have no paragraphs. A paragraph shorter than a shingle is its
one shingle. Null ids sort before others and are reported like any id. Repeated rows are
repeated paragraphs of one id and place: ``copies`` counts all, and all of the id and
place that is first are marked as kept. Overlapping equal units, as in a word that
repeats, are one unit. Texts of any length are read whole. Extra columns are not read.
Empty tables give empty results.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import connected_components

WIDTH, SIMILARITY = 5, 0.8
#: Minima of a band; bands of a line, and of a unit.
ROWS, BANDS, UNIT_BANDS = 3, 8, 4
#: Words of a line by default: every line that has a word counts.
LEAST = 1
#: Words of a unit, and places of which the least hash begins one.
UNIT, REACH = 16, 32
#: Text bytes handled at once.
CHUNK = 1 << 20
#: Paragraphs among which a task sends each but once.
SEEN = 200_000
#: Members of a bucket's chunk, of which a task compares two; rows, and shingles, compared at once.
MEETING, BLOCK, COLUMNS = 1_000, 256, 4_096
#: Wanted paragraphs, and open buckets, up to these numbers are broadcast; beyond, they are joined by a shuffle.
WANTED_MOST, BUCKETS_MOST = 2_000_000, 500_000

IS_SPACE = np.array([b in b" \t\n\v\f\r" for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
ODD = 0x9E3779B97F4A7C15
NONE = np.empty(0, np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _placed(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of values at their places in a sequence; their sum stands for the sequence."""
    return _mix(_mix(place.astype(np.uint64) * np.uint64(ODD) + np.uint64(1)) + values)


class Paragraphs:
    """Paragraphs of one kind as ranges of words, with keys and shingle hashes, all in arrays."""

    def __init__(self, words: Words, first: np.ndarray, last: np.ndarray, text: np.ndarray, place: np.ndarray, key: np.ndarray, width: np.ndarray):
        self.words, self.first, self.last, self.text, self.place, self.key = words, first, last, text, place, key.view(np.int64)
        # shingles, paragraph after paragraph; a short paragraph is one shingle
        self.many = np.maximum(1, width - WIDTH + 1)
        self.edges = np.cumsum(self.many) - self.many
        at = np.arange(int(self.many.sum())) - np.repeat(self.edges, self.many) + np.repeat(first, self.many)
        self.shingles = words.grams[WIDTH - 1][at]
        for n in range(1, WIDTH):
            short = np.flatnonzero(width == n)
            self.shingles[self.edges[short]] = words.grams[n - 1][first[short]]

    def bands(self, bands: int, kind: int = 0, rows: int = ROWS) -> np.ndarray:
        """Bucket keys: an array of paragraphs by bands, other ones for each kind. Those of the first band are odd, the others even."""
        out = np.empty((len(self.key), bands), np.int64)
        if not len(self.key):
            return out
        for b in range(bands):
            key = np.full(len(self.key), kind << 32 | b + 1, np.uint64)
            for r in range(rows):
                seed = np.uint64((b * rows + r + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)
                least = np.minimum.reduceat((self.shingles ^ seed) * np.uint64(ODD) ^ (self.shingles >> np.uint64(29)), self.edges)
                key = _mix(key * np.uint64(ODD) + least)
            out[:, b] = ((key | np.uint64(1)) ^ np.uint64(b > 0)).view(np.int64)
        return out

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans within their texts."""
        at = self.words.cuts[self.text]
        return self.words.starts[self.first] - at, self.words.ends[self.last - 1] - at


class Words:
    """The words of a buffer of texts that begin at ``cuts``, with hashes of the one to WIDTH words from each on."""

    def __init__(self, raw: np.ndarray, cuts: np.ndarray):
        space = IS_SPACE[raw]
        inside = ~space
        begins = np.r_[True, space[:-1]]
        begins[cuts[cuts < len(raw)]] = True
        self.starts = starts = np.flatnonzero(inside & begins)
        self.ends = ends = np.flatnonzero(inside & np.r_[space[1:] | begins[1:], True]) + 1
        self.cuts, self.n = cuts, len(starts)
        long = ends - starts
        total = np.cumsum(long) - long
        at = np.arange(int(long.sum())) - np.repeat(total, long)
        letters = _placed(LOWER[raw[inside]], at)
        words = np.add.reduceat(letters, total) if self.n else np.empty(0, np.uint64)
        self.hashes = words = _mix(words + long.astype(np.uint64))
        self.grams = [_mix(words + np.uint64(ODD))]
        for k in range(1, WIDTH):
            longer, rest = self.grams[-1].copy(), max(0, self.n - k)
            longer[:rest] = _mix(longer[:rest] * np.uint64(ODD) + words[self.n - rest :])
            self.grams.append(longer)
        # lines, none across a text's end
        self.breaks = np.union1d(np.flatnonzero(raw == 10), cuts)
        self.line = np.searchsorted(self.breaks, starts, side="right")
        self.owner = np.searchsorted(cuts, starts, side="right") - 1

    def _place(self, first: np.ndarray) -> np.ndarray:
        """The line of the text, blank ones counted, in which a paragraph begins."""
        return self.line[first] - np.searchsorted(self.breaks, self.cuts[self.owner[first]], side="right")

    def lines(self, least: int = LEAST) -> Paragraphs:
        line = self.line
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if self.n else NONE
        last = np.append(first[1:], self.n) if self.n else NONE
        sums = np.add.reduceat(_placed(self.hashes, np.arange(self.n) - np.repeat(first, last - first)), first) if self.n else self.hashes
        keep = last - first >= least
        first, last, sums = first[keep], last[keep], sums[keep]
        return Paragraphs(self, first, last, self.owner[first], self._place(first), _mix(sums + (last - first).astype(np.uint64)), last - first)

    def units(self, unit: int = UNIT, reach: int = REACH) -> Paragraphs:
        """The units; neighbours of equal words that overlap, as in a word that repeats, are one."""
        first = NONE
        if self.n >= unit + reach - 1:
            begins = self.grams[WIDTH - 1][: self.n - unit + 1]
            least = np.arange(len(begins) - reach + 1) + np.lib.stride_tricks.sliding_window_view(begins, reach).argmin(1)
            first = np.unique(least[self.owner[: len(least)] == self.owner[unit + reach - 2 :]])
            # of a run of neighbours every other one: units one word apart are as similar as near copies
            chain = np.maximum.accumulate(np.where(np.diff(first, prepend=-2) > 1, np.arange(len(first)), 0))
            first = first[(np.arange(len(first)) - chain) % 2 == 0]
        sums = np.zeros(len(first), np.uint64)
        for k in range(unit):
            sums += _placed(self.hashes[first + k], np.full(1, k))
        key, text = _mix(~(sums + np.uint64(unit))), self.owner[first]
        again = np.zeros(len(first), bool)
        again[1:] = (key[1:] == key[:-1]) & (text[1:] == text[:-1]) & (first[1:] < first[:-1] + unit)
        last = (first + unit)[np.append(~again[1:], True)] if len(first) else first
        first, text, key = first[~again], text[~again], key[~again]
        return Paragraphs(self, first, last, text, self._place(first), key, np.full(len(first), unit))


def _chunks(batches):
    """(batch slice, raw bytes, offsets) of at most CHUNK bytes, a row at least."""
    for batch in batches:
        text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw, at = np.frombuffer(text.buffers()[2] or b"", np.uint8), 0
        while at < len(text):
            to = min(len(text), max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK)) - 1))
            own = offsets[at : to + 1]
            if own[-1] > own[0]:
                yield batch.slice(at, to - at), raw[own[0] : own[-1]], own - own[0]
            at = to


class _Kinds:
    """Which paragraphs count, and how many bands each kind has."""

    def __init__(self, least: int, units: bool):
        self.least, self.with_units = least, units

    def of(self, batches):
        """(column of ids, rows that have text, kind, bands, paragraphs) chunk by chunk."""
        for part, raw, offsets in _chunks(batches):
            some = np.flatnonzero(np.diff(offsets) > 0)
            words = Words(raw, offsets[some])
            yield part.column(0), some, "line", BANDS, words.lines(self.least)
            if self.with_units:
                yield part.column(0), some, "unit", UNIT_BANDS, words.units()


def _dealt(kinds: _Kinds):
    """(bucket, key) of each paragraph, once for every SEEN of them; the first band's a second time if it occurs again."""

    def run(batches):
        once: set[int] = set()
        twice: set[int] = set()
        for _, _, kind, bands, found in kinds.of(batches):
            keys, where, many = np.unique(found.key, return_index=True, return_counts=True)
            known = np.fromiter((k in once for k in keys.tolist()), bool, len(keys))
            again = (known | (many > 1)) & ~np.fromiter((k in twice for k in keys.tolist()), bool, len(keys))
            new = found.bands(bands, kind == "unit")[where]
            if len(once) > SEEN:
                once.clear()
                twice.clear()
            once.update(keys.tolist())
            twice.update(keys[again].tolist())
            buckets = np.concatenate([new[~known].ravel(), new[again, 0]])
            if len(buckets):
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.concatenate([np.repeat(keys[~known], bands), keys[again]]))], names=["bucket", "key"])

    return run


def _met(batches):
    """Over rows sorted by bucket and key: each bucket of two paragraphs or more as (bucket, key, leader), and (bucket, key, null) for one that occurs again."""
    bucket, key, leader, shown, was = None, 0, 0, False, False
    for batch in batches:
        b, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(b):
            continue
        same = np.r_[bucket is not None and b[0] == bucket, b[1:] == b[:-1]]
        dup = same & np.r_[k[0] == key, k[1:] == k[:-1]]
        starts, run = np.flatnonzero(~same), np.cumsum(~same)
        leaders, buckets = np.r_[np.int64(leader), k[starts]], np.r_[np.int64(bucket or 0), b[starts]]
        member = same & ~dup
        has = np.zeros(len(leaders), bool)
        has[run[member]] = True
        tell = has.copy()
        tell[0] &= not shown
        again = dup & ~np.r_[was, dup[:-1]] & ((b & 1) == 1)
        out = [np.concatenate(x) for x in ((buckets[tell], b[member], b[again]), (leaders[tell], k[member], k[again]), (leaders[tell], leaders[run[member]], k[again]))]
        if len(out[0]):
            void = np.arange(len(out[0])) >= len(out[0]) - int(again.sum())
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2], mask=void)], names=["bucket", "key", "leader"])
        shown = bool(has[run[-1]] or run[-1] == 0 and shown)
        bucket, key, leader, was = int(b[-1]), int(k[-1]), int(leaders[run[-1]]), bool(dup[-1])


def _among(wanted, keys: np.ndarray) -> np.ndarray:
    """Which keys are wanted: the sorted ones are searched, where np.isin would sort them again for each chunk."""
    known = wanted.value
    if known is None:
        return np.ones(len(keys), bool)
    return known[np.searchsorted(known, keys).clip(max=len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


class _All:
    """Stands for a broadcast: every key is wanted."""

    value = None


def _sent(keys: DataFrame):
    """The keys (one column, distinct) as a broadcast if they are few enough, else ``_All``."""
    if keys.count() > WANTED_MOST:
        return _All
    return keys.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy()))


def _shingles(kinds: _Kinds, wanted):
    def run(batches):
        for _, _, _, _, found in kinds.of(batches):
            keys, where = np.unique(found.key, return_index=True)
            where = where[_among(wanted, keys)]
            if len(where):
                sets = [np.unique(found.shingles[e : e + m]).view(np.int64) for e, m in zip(found.edges[where], found.many[where], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found.key[where]), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    return run


def _shingle_sets(rows: DataFrame, keys: DataFrame, kinds: _Kinds) -> DataFrame:
    """(key, shingles) of the wanted paragraphs, once each."""
    sent = _sent(keys)
    sets = rows.mapInArrow(_shingles(kinds, sent), "key long, shingles array<long>")
    if sent is _All:
        sets = sets.join(keys, "key", "left_semi")
    return sets.groupBy("key").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity is high enough."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def _compared(similarity: float):
    """Over partitions sorted by meeting: links between the components of each that have a similar pair, as stars."""

    def compare(keys: np.ndarray, own: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        sizes = np.array([len(x) for x in sets])
        _, codes, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = many > 1
        column, owner = (np.cumsum(shared) - 1)[codes], np.repeat(np.arange(len(sets)), sizes)
        column, owner = column[shared[codes]], owner[shared[codes]]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        # shared shingles of each two sets, COLUMNS shingles at once
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(shared.sum()), COLUMNS):
            part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[owner[part], column[part] - at] = 1
            both += has @ has.T
        # components are one node each: which two of them have a similar pair
        named, node = np.unique(own, return_inverse=True)
        order = np.argsort(node, kind="stable")
        firsts = np.searchsorted(node[order], np.arange(len(named)))
        tied = np.zeros((len(named), len(sets)), bool)
        for at in range(0, len(sets), BLOCK):
            some = both[at : at + BLOCK]
            fits = some >= similarity * (sizes[at : at + BLOCK, None] + sizes[None] - some) - 1e-6
            np.logical_or.at(tied, node[at : at + BLOCK], fits)
        tied = np.logical_or.reduceat(tied[:, order], firsts, axis=1)
        left, edges, key = np.ones(len(named), bool), [], keys[order][firsts]
        for k in np.flatnonzero(tied.sum(1) > 1).tolist():
            now = left & (np.arange(len(named)) == k)
            left &= ~now
            while now.any():
                now = tied[now].any(0) & left
                left &= ~now
                edges += [(int(key[k]), x) for x in key[now].tolist()]
        return edges

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [batch.column(k).to_numpy() for k in range(3)] + [[x.values.to_numpy() for x in batch.column(3)]]
                held = new if held is None else [*(np.concatenate(p) for p in zip(held[:3], new[:3], strict=True)), held[3] + new[3]]
            if held is None or not len(held[0]):
                continue
            stop = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
            if not stop:
                continue
            meet = held[0][:stop]
            firsts = np.flatnonzero(np.r_[True, meet[1:] != meet[:-1]])
            edges = [e for a, b in zip(firsts, np.append(firsts[1:], stop), strict=True) for e in compare(held[1][a:b], held[2][a:b], held[3][a:b])]
            held = [x[stop:] for x in held]
            if edges:
                ends = np.array(edges, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends.max(1)), pa.array(ends.min(1))], names=["a", "b"])

    return run


def _meetings(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links between components of the same bucket, as forests.

    A bucket beyond MEETING members is dealt to chunks, and every two chunks meet in a task
    of their own: all pairs are compared, no task holds more than two chunks, and no pair
    is a row.
    """
    chunks = F.ceil(F.col("n") / MEETING).cast("int")
    dealt = members.withColumns({"chunk": F.pmod(F.xxhash64("key"), chunks).cast("int"), "other": F.explode(F.sequence(F.lit(0), chunks - 1))})
    meet = F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("meet")
    rows = dealt.select(meet, "key", "own").join(sets, "key").select("meet", "key", "own", "shingles")
    return rows.repartition("meet").sortWithinPartitions("meet").mapInArrow(_compared(similarity), "a long, b long")


def _components(edges: DataFrame) -> DataFrame:
    return connected_components(edges).toDF("key", "class")


def _found(kinds: _Kinds, wanted):
    """Over (id, text): the paragraphs of the wanted keys."""

    def run(batches):
        for ids, some, kind, _, found in kinds.of(batches):
            keep = np.flatnonzero(_among(wanted, found.key))
            if len(keep):
                ints = [pa.array(x[keep].astype(np.int32)) for x in (found.place, found.last - found.first, *found.spans())]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some[found.text[keep]])), *ints, pa.array([kind] * len(keep)), pa.array(found.key[keep])], names=["id", "place", "words", "start", "stop", "kind", "key"])

    return run


def paragraph_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, similarity: float = SIMILARITY, units: bool = True) -> DataFrame:
    """(id, place, words, class, copies, kept, start, stop, kind) for each paragraph that has a copy or near copy elsewhere.

    ``kind`` is line or unit; without ``units`` only lines count. ``place`` is the line, from 0, in which it begins.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows, kinds = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), _Kinds(least, units)
    dealt = rows.mapInArrow(_dealt(kinds), "bucket long, key long")
    met = cut(dealt.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(_met, "bucket long, key long, leader long"))
    repeated = met.where("leader is null").select("key").distinct()
    members = met.where("leader is not null").select("bucket", "key", "leader")
    sets = cut(_shingle_sets(rows, cut(members.select("key").distinct()), kinds))
    pairs = members.where("key <> leader").select(F.greatest("key", "leader").alias("a"), F.least("key", "leader").alias("b")).distinct()
    edges = cut(_verified(pairs, sets, similarity))
    classes = cut(_components(edges))
    # buckets of which no leader tied all others: there all pairs count, compared within tasks
    tied = members.where("key <> leader").drop("leader").join(classes, "key", "left").withColumn("own", F.coalesce("class", "key")).drop("class")
    open_ = cut(tied.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select("bucket", "n"))
    near = F.broadcast(open_) if open_.count() <= BUCKETS_MOST else open_
    more = cut(_meetings(tied.select("bucket", "key", "own").join(near, "bucket"), sets, similarity))
    if not more.isEmpty():
        classes = cut(_components(edges.union(more)))
    wanted = cut(repeated.union(classes.select("key")).distinct())
    sent = _sent(wanted)
    found = rows.mapInArrow(_found(kinds, sent), f"id {id_type}, place int, words int, start int, stop int, kind string, key long")
    if sent is _All:
        found = found.join(wanted, "key", "left_semi")
    # written before the groups are counted, and those before they are joined: so Spark can split a class that many rows have
    named = cut(found.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key")).drop("key"))
    copies = cut(named.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "start")).alias("stays")).where("copies > 1"))
    kept = F.struct("id", "start").eqNullSafe(F.col("stays"))
    return named.join(copies, "class").select("id", "place", "words", "class", "copies", kept.alias("kept"), "start", "stop", "kind")


def _without(batches):
    """Over (row, text, spans): the text less its spans, which may overlap."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text is None or not spans:
                out.append(text)
                continue
            raw, at, kept = text.encode(), 0, []
            for s in sorted(spans, key=lambda s: s["start"]):
                kept.append(raw[at : max(at, s["start"])])
                at = max(at, s["stop"])
            out.append(b"".join([*kept, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every repeated paragraph taken out of the text, but for the one of its class that stays.

    Columns stay as they are, in their order. Ids must tell texts apart: rows of an equal id
    lose the spans of all of them. A text of repeats alone becomes white space or empty.
    """
    small_batches(docs.sparkSession)
    gone = paragraph_classes(docs, id_col, text_col, **options).where("not kept")
    spans = cut(gone.groupBy(F.col("id").alias("span_id")).agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    moved = docs.toDF(*names.values())
    joined = moved.join(spans, F.col(names[id_col]).eqNullSafe(F.col("span_id")), "left")
    others = [n for c, n in names.items() if c != text_col]
    packed = joined.select(F.struct(*others).alias("row"), F.col(names[text_col]).cast("string").alias("text"), "spans")
    done = packed.mapInArrow(_without, f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.{n}").alias(c) for c, n in names.items()))
