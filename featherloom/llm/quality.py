"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text alone. Trees are grown on the driver over a bounded
sample of labelled rows (``FIT_ROWS``, those of the smallest id hashes), level by level
on histograms of binned statistics, and flattened into arrays of feature, threshold,
child and value; scoring walks all rows of a batch through those arrays with numpy.

Held-out rows, whose crc32 of the id as text is 2 modulo 4, are never learnt from; the
label, language, source and id never enter a score.

Cases. Null and empty texts are scored like any other text, by their statistics. Labels
that are null, or of an id without a document, are ignored; repeated labels count each.
A null id is not held out. Without labels of either kind the score is the smoothed share
of label 1, which is 1 with no labels at all, so nothing is rejected unlearnt. Repeated
rows each get a row; extra columns pass through ``accept``; empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled rows that the trees are fitted on, at most.
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, SHRINK = 60, 4, 0.2, 64, 10, 1.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

#: Frequent words of the corpus languages.
STOP_WORDS = frozenset(
    "the of and to in is that for it as was with be by on are this from or an at not "
    "le la les de des du un une et en est que qui dans pour par sur avec au aux "
    "der die das und ist von zu den dem mit im ein eine sich auf für nicht als auch "
    "el los las y del que en un una por con para se su al".split()
)

SYMBOLS = b"#$%&*!|<>{}[]_=+@~^\\/"
NAMES = (
    "bytes letters upper digits space lines beyond_ascii other "
    + " ".join(f"symbol_{b}" for b in SYMBOLS)
    + " words word_mean word_spread word_most stop unique upper_words plain_words symbol_ends repeated_words "
    "line_words line_repeats line_short line_ends"
).split()
_KIND = np.full(256, 6, np.int64)
for _b in range(256):
    _c = chr(_b)
    if _b >= 0x80:
        _KIND[_b] = 5
    elif _c == "\n":
        _KIND[_b] = 4
    elif _c.isspace():
        _KIND[_b] = 3
    elif _c.isdigit():
        _KIND[_b] = 2
    elif "A" <= _c <= "Z":
        _KIND[_b] = 1
    elif "a" <= _c <= "z":
        _KIND[_b] = 0
PLAIN = re.compile(r"[^\W\d_]+[.,;:?'’-]?")


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text, in the order of NAMES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    each = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=each, minlength=7)
    n = max(1, len(raw))
    out = [np.log1p(len(raw)), kinds[0] / n, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n]
    out += [each[b] / n for b in SYMBOLS]
    words = text.split()
    if words:
        m = len(words)
        lengths = np.fromiter(map(len, words), np.int64, m)
        distinct = {}
        for w in words:
            distinct[w] = distinct.get(w, 0) + 1
        stop = sum(c for w, c in distinct.items() if w.strip(".,;:!?").lower() in STOP_WORDS)
        upper = sum(c for w, c in distinct.items() if len(w) > 1 and w.isupper())
        plain = sum(c for w, c in distinct.items() if PLAIN.fullmatch(w))
        ends = sum(c for w, c in distinct.items() if w[-1] in "#$%&*!|@~^")
        out += [np.log1p(m), lengths.mean(), lengths.std(), lengths.max(), stop / m, len(distinct) / m, upper / m, plain / m, ends / m, max(distinct.values()) / m]
    else:
        out += [0.0] * 10
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        k = len(lines)
        counts = [len(x.split()) for x in lines]
        out += [sum(counts) / k, 1 - len(set(lines)) / k, sum(c < 4 for c in counts) / k, sum(x.rstrip()[-1] in ".!?" for x in lines) / k]
    else:
        out += [0.0] * 4
    return np.array(out, np.float64)


class BoostedTrees:
    """Histogram gradient boosting for a binary label, logistic loss."""

    def __init__(self, base: float):
        self.base = base
        self.feature, self.threshold, self.child, self.value = (np.empty(0, t) for t in (np.int32, np.float64, np.int32, np.float64))
        self.roots: list[int] = []

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        prior = (y.sum() + 1) / (len(y) + 1)
        if len(y) == 0 or y.min() == y.max():
            return cls(float(prior))
        self = cls(float(np.clip(prior, 0.01, 0.99)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
        nodes: list[list] = []
        margin = np.full(len(y), np.log(self.base / (1 - self.base)))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            margin += self._grow(nodes, edges, binned, p - y, p * (1 - p))
        self.feature = np.array([n[0] for n in nodes], np.int32)
        self.threshold = np.array([n[1] for n in nodes])
        self.child = np.array([n[2] for n in nodes], np.int32)
        self.value = np.array([n[3] for n in nodes])
        return self

    def _grow(self, nodes, edges, binned, g, h) -> np.ndarray:
        """Add one tree to the flat nodes; its output for each row."""
        out = np.zeros(len(g))
        self.roots.append(len(nodes))
        nodes.append(None)
        level = [(len(nodes) - 1, np.arange(len(g)))]
        for depth in range(DEPTH + 1):
            below = []
            for at, rows in level:
                split = self._split(binned[rows], g[rows], h[rows]) if depth < DEPTH else None
                if split is None:
                    value = -RATE * g[rows].sum() / (h[rows].sum() + SHRINK)
                    nodes[at] = [0, np.inf, at, value]  # a leaf leads to itself
                    out[rows] = value
                    continue
                f, b = split
                nodes[at] = [f, edges[f][b], len(nodes), 0.0]  # left child; the right one follows
                left = binned[rows, f] <= b
                for part in (rows[left], rows[~left]):
                    nodes.append(None)
                    below.append((len(nodes) - 1, part))
            level = below
        return out

    @staticmethod
    def _split(binned, g, h):
        best, found = 1e-6, None
        total_g, total_h = g.sum(), h.sum()
        for f in range(binned.shape[1]):
            n = np.cumsum(np.bincount(binned[:, f], minlength=BINS))[:-1]
            sum_g = np.cumsum(np.bincount(binned[:, f], weights=g, minlength=BINS))[:-1]
            sum_h = np.cumsum(np.bincount(binned[:, f], weights=h, minlength=BINS))[:-1]
            gain = sum_g**2 / (sum_h + SHRINK) + (total_g - sum_g) ** 2 / (total_h - sum_h + SHRINK) - total_g**2 / (total_h + SHRINK)
            gain[(n < LEAST_LEAF) | (len(g) - n < LEAST_LEAF)] = 0
            if len(gain) and gain.max() > best:
                best, found = gain.max(), (f, int(gain.argmax()))
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.roots:
            return np.full(len(x), self.base)
        margin, rows = np.full(len(x), np.log(self.base / (1 - self.base))), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                right = x[rows, self.feature[node]] > self.threshold[node]
                node = self.child[node] + right
            margin += self.value[node]
        return 1 / (1 + np.exp(-margin))


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _rows(batch) -> np.ndarray:
    found = [statistics(x.as_py()) for x in batch.column(1)]
    return np.stack(found) if found else np.empty((0, len(NAMES)))


def _measure(batches):
    for batch in batches:
        x = _rows(batch)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> BoostedTrees:
    """Trees fitted on at most ``rows`` labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    usable = usable.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    # ``rows`` bounds both what is broadcast and what comes to the driver
    sample = usable.orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = texts.join(F.broadcast(sample.select("id").distinct()), "id", "left_semi")
    measured = wanted.mapInArrow(_measure, f"id {kind}, x array<double>").join(F.broadcast(sample), "id")
    # a repeated id may match more rows: the bound holds for them too
    found = measured.orderBy(F.xxhash64("id"), "id", "y").limit(rows).select("x", "y").toArrow()
    x = np.array(found["x"].to_pylist(), np.float64).reshape(-1, len(NAMES))
    return BoostedTrees.fit(x, found["y"].to_numpy().astype(np.float64))


def _score(sent):
    def run(batches):
        for batch in batches:
            score = sent.value.score(_rows(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["row", "score"])

    return run


def score(docs: DataFrame, trees: BoostedTrees, keep: Column, text_col: str = "text") -> DataFrame:
    """(row, score) for each document; ``keep`` is the column that travels as ``row``."""
    small_batches(docs.sparkSession)
    rows = docs.select(keep.alias("row"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(sent), f"row {kind}, score double")


def accept(docs: DataFrame, trees: BoostedTrees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents of a score of ``threshold`` or more, with their own columns."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    moved = docs.toDF(*names.values())
    done = score(moved, trees, F.struct(*names.values()), names[text_col]).where(F.col("score") >= threshold)
    return done.select("row.*").toDF(*docs.columns)
