"""Near-duplicate classes by SimHash fingerprints and BK-trees.

Fingerprints: words are runs of characters other than ASCII white space, A to Z in
lower case; each shingle of ``width`` words (repeats included) is hashed by XXH64 with
seed 42 and a fingerprint bit is 1 if it is set in over half the hashes.

Links: fingerprints within ``radius`` bits. Two such fingerprints agree on at least
``blocks - radius`` of any ``blocks`` blocks of bits, so every choice of that many blocks
keys a shard, and a BK-tree per shard (children keyed by the integer Hamming distance
to their parent, laid out in flat arrays) finds the links of the shard's own
fingerprints by following only edges within the radius. A shard's tree goes to the one
task that holds its queries, through the shuffle; trees of the whole corpus grow with
it, so they are not broadcast. The number of blocks follows the number of distinct
fingerprints, so that shards stay small; a shard that is crowded all the same is split
by the same argument over the bits on which it does not yet agree. Each shard yields a
spanning forest of its links, not all pairs, and components are joined by connected
components over the whole.

Cases. Null and empty texts have no words: fingerprint zero, linked like any other.
Fewer words than a shingle: the whole sequence is the one shingle. Null ids: never the
smallest id of a class; a class of null ids only has a null component. Repeated rows
each get a row. Empty tables give empty results. Extra columns pass through.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import connected_components

WIDTH, RADIUS, SEED = 4, 4, 42
#: Shards are keyed so that one has about this many fingerprints, were they spread evenly.
SHARD_TARGET = 64
#: A shard beyond this is split further.
SHARD_MOST = 4_000
#: Pairs of a query and a tree node compared at once.
CHUNK_PAIRS = 1 << 20
#: A list of ids up to this length is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 500_000


# ---- fingerprints -------------------------------------------------------------


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(text: str, name: str, width: int, seed: int):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [fingerprint(x.as_py(), width, seed) for x in batch.column(at)]
            signed = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), signed], [*(batch.schema.names[i] for i in rest), name])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(id, fp): the signed 64-bit view of each text's fingerprint."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints("text", "fp", width, seed), f"id {kind}, fp long")


# ---- BK-trees -----------------------------------------------------------------


class ShardTrees:
    """BK-trees of many shards, built and searched together in flat arrays.

    ``shard`` numbers the shard of each value, ascending; values are distinct within a
    shard. Node i is value i. ``parent`` is -1 at a root and ``edge`` the distance to
    the parent; ``child`` lists all children, ascending by parent and edge, and ``key``
    is that parent and edge in one number, so a range of edges is a range of keys.
    """

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        n = len(values)
        self.values, self.parent, self.edge = values, np.full(n, -1), np.zeros(n, np.int64)
        group, rows = shard.astype(np.int64), np.arange(n)
        self.roots = rows[np.r_[True, group[1:] != group[:-1]]] if n else rows
        while len(rows):
            # the first of each group is its subtree's node; the rest goes below it by distance
            new = np.r_[True, group[1:] != group[:-1]]
            head = rows[new][np.cumsum(new) - 1]
            below = ~new
            rows, head = rows[below], head[below]
            edge = np.bitwise_count(values[rows] ^ values[head]).astype(np.int64)
            self.parent[rows], self.edge[rows] = head, edge
            key = head * 65 + edge
            order = np.argsort(key, kind="stable")
            rows, group = rows[order], key[order]
        placed = np.flatnonzero(self.parent >= 0)
        self.child = placed[np.lexsort((self.edge[placed], self.parent[placed]))]
        self.key = self.parent[self.child] * 65 + self.edge[self.child]

    def links(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Pairs (query, node) within the radius, in chunks; ``roots`` is each query's tree."""
        stack = [(queries, roots)]
        while stack:
            q, node = stack.pop()
            if len(q) > CHUNK_PAIRS:
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = np.bitwise_count(self.values[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(0, d - radius))
            hi = np.searchsorted(self.key, node * 65 + np.minimum(64, d + radius), side="right")
            many = hi - lo
            if total := int(many.sum()):
                at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                stack.append((np.repeat(q, many), self.child[at]))


def _forest(n: int):
    """Union-find over n items: find and join."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    return up, find


def forest_edges(shard: np.ndarray, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of indices, of the links within each shard."""
    trees = ShardTrees(shard, values)
    counts = np.diff(np.append(trees.roots, len(values)))
    queries = np.flatnonzero(np.repeat(counts > 1, counts))
    up, find = _forest(len(values))
    edges = []
    for a, b in trees.links(queries, np.repeat(trees.roots, counts)[queries], radius):
        keep = a > b
        for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                edges.append((x, y))
    return edges


def _search(radius: int):
    """Over partitions sorted by shard: the forest edges of each shard, in bounded batches."""

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                held = (key, fp) if held is None else (np.concatenate((held[0], key)), np.concatenate((held[1], fp)))
            if held is None or not len(held[0]):
                continue
            # the last shard may go on in the next batch
            whole = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
            if not whole:
                continue
            key, fp = held[0][:whole], held[1][:whole]
            held = (held[0][whole:], held[1][whole:])
            shard = np.cumsum(np.r_[True, key[1:] != key[:-1]])
            if pairs := forest_edges(shard, fp.view(np.uint64), radius):
                x = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(fp[x[:, 0]]), pa.array(fp[x[:, 1]])], ["a", "b"])

    return run


def block_masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks over ``bits``: the unions of ``agree`` of ``blocks`` nearly equal blocks."""
    parts = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), blocks)]
    return [sum(choice) for choice in itertools.combinations(parts, agree)]


def plan_blocks(n: int, radius: int) -> int:
    """The fewest blocks whose agreeing bits tell ``n / SHARD_TARGET`` shards apart."""
    need = np.log2(max(1.0, n / SHARD_TARGET))
    for blocks in range(radius + 1, 4 * radius + 1):
        if (blocks - radius) * (64 // blocks) >= need:
            return blocks
    return 4 * radius


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): fingerprints within the radius, as spanning forests of the shards.

    ``distinct`` has distinct fingerprints in column fp. The transitive closure of the
    result is that of all links.
    """
    if radius == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    blocks = plan_blocks(distinct.count(), radius)
    masks = [_signed(x) for x in block_masks(list(range(64)), blocks, blocks - radius)]
    every = F.array(*(F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("agreed")) for m in masks))
    keyed = distinct.select("fp", F.explode(every).alias("s")).select("fp", "s.mask", "s.agreed")
    found = None
    while True:
        sized = keyed.groupBy("mask", "agreed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        crowded = cut(sized.where(f"n > {SHARD_MOST}").select("mask", "agreed"))
        ready = keyed
        full = [r[0] for r in crowded.select("mask").distinct().collect()]  # masks, of which there are few
        if full:
            ready = keyed.join(crowded, ["mask", "agreed"], "left_anti")
        key = F.xxhash64("mask", "agreed").alias("key")
        # a key that two shards share would only compare more, never lose a link
        dealt = ready.select(key, "fp").distinct() if full else ready.select(key, "fp")
        edges = dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_search(radius), "a long, b long")
        found = edges if found is None else found.union(edges)
        if not full:
            return found
        split, closed = [], []
        for m in full:
            free = [b for b in range(64) if not m >> b & 1]
            if len(free) <= radius:
                closed.append(m)
                continue
            split += [(m, _signed((m | x) & (1 << 64) - 1)) for x in block_masks(free, min(len(free), radius + 1), max(1, min(len(free), radius + 1) - radius))]
        hot = keyed.join(crowded, ["mask", "agreed"], "left_semi")
        if closed:  # all of such a shard lies within the radius: a star holds its links
            star = hot.where(F.col("mask").isin(closed)).groupBy("mask", "agreed").agg(F.min("fp").alias("b"))
            found = found.union(hot.join(star, ["mask", "agreed"]).select(F.col("fp").alias("a"), "b"))
        if not split:
            return found
        finer = F.create_map(*(x for m in dict(split) for x in (F.lit(m), F.array(*(F.lit(y) for k, y in split if k == m)))))
        hot = hot.where(F.col("mask").isin([m for m, _ in split])).select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
        keyed = cut(hot.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("agreed")))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): each document's fingerprint and the smallest id that it reaches over links."""
    marked = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    joined = connected_components(links(distinct.select("fp"), radius))
    # written before they meet, so that Spark can split the join of a root that many fingerprints have
    rooted = cut(distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = rooted.join(least, "root").select("fp", "component")
    return marked.join(named, "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Of each class the document with the smallest id stays; all columns of ``docs`` pass through.

    Decisions are by id. Rows of null id stay, as no decision can name them. Rows that
    share an id stay if one of them is the smallest of its class; of those with equal
    texts one stays.
    """
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    moved, i, text = docs.toDF(*names.values()), names[id_col], names[text_col]
    classes = near_duplicate_classes(moved, i, text, width, radius).where("id is not null")
    ids = cut(classes.groupBy("id").agg(F.max((F.col("id") == F.col("component")).cast("int")).alias("stays"), F.count(F.lit(1)).alias("n")))
    gone, again = ids.where("stays = 0").select(F.col("id").alias(i)), ids.where("stays = 1 and n > 1").select(F.col("id").alias(i))
    kept = moved.join(_small(gone), i, "left_anti")
    if not again.isEmpty():
        once = Window.partitionBy(i, F.sha2(text, 256)).orderBy(F.lit(1))
        few = kept.join(_small(again), i, "left_semi").withColumn("rank", F.row_number().over(once)).where("rank = 1").drop("rank")
        kept = kept.join(_small(again), i, "left_anti").unionByName(few)
    return kept.select(*names.values()).toDF(*docs.columns)


def _small(ids: DataFrame) -> DataFrame:
    """A list of ids, broadcast when it is short."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
