"""Scores as aggregates over (target, prediction) or (target, probability)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .order import quantiles, running

TINY = 1e-15


@dataclass(frozen=True)
class Scorer:
    """A named score: ``optimum`` is its best value, ``sign`` 1 if more is better."""

    name: str
    kind: str
    optimum: float
    sign: int
    value: Callable[..., Column]
    #: Whether ``value`` is a row's error of which the score is the median, else an aggregate.
    median: bool = False

    def loss(self, score: float) -> float:
        return self.optimum - self.sign * score


def _r2(y, p):
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


REGRESSION = {
    s.name: s
    for s in (
        Scorer("r2", "predict", 1, 1, _r2),
        Scorer("pearsonr", "predict", 1, 1, lambda y, p: F.corr(y, p)),
        Scorer("mean_squared_error", "predict", 0, -1, lambda y, p: F.avg((y - p) * (y - p))),
        Scorer("mean_absolute_error", "predict", 0, -1, lambda y, p: F.avg(F.abs(y - p))),
        Scorer("median_absolute_error", "predict", 0, -1, lambda y, p: F.abs(y - p), True),
    )
}


def _counts(y, p):
    one = lambda a, b: F.sum(((y == a) & (p == b)).cast("double"))
    return one(1, 1), one(0, 1), one(1, 0), one(0, 0)


def precision(y, p):
    tp, fp, _, _ = _counts(y, p)
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall(y, p):
    tp, _, fn, _ = _counts(y, p)
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))


def specificity(y, p):
    _, fp, _, tn = _counts(y, p)
    return F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0))


def f1(y, p):
    tp, fp, fn, _ = _counts(y, p)
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def mcc(y, p):
    tp, fp, fn, tn = _counts(y, p)
    return F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))


def log_loss(y, p):
    q = F.greatest(F.least(p, F.lit(1 - TINY)), F.lit(TINY))
    return -F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))


def pac_score(y, p):
    """exp(-log loss) between that of the prior, 0, and that of certainty, 1."""
    prior = F.avg(y.cast("double"))
    base = F.exp(prior * F.log(F.greatest(prior, F.lit(TINY))) + (1 - prior) * F.log(F.greatest(1 - prior, F.lit(TINY))))
    return F.try_divide(F.exp(-log_loss(y, p)) - base, 1 - base)


CLASSIFICATION = {
    s.name: s
    for s in (
        Scorer("accuracy", "predict", 1, 1, lambda y, p: F.avg((y == p).cast("double"))),
        Scorer("precision", "predict", 1, 1, precision),
        Scorer("recall", "predict", 1, 1, recall),
        Scorer("sensitivity", "predict", 1, 1, recall),
        Scorer("specificity", "predict", 1, 1, specificity),
        Scorer("f1", "predict", 1, 1, f1),
        Scorer("mcc", "predict", 1, 1, mcc),
        Scorer("balanced_accuracy", "predict", 1, 1, lambda y, p: (recall(y, p) + specificity(y, p)) / 2),
        Scorer("log_loss", "proba", 0, -1, log_loss),
        Scorer("pac_score", "proba", 1, 1, pac_score),
    )
}


def evaluate(df: DataFrame, y: str, p: str, scorers: dict[str, Scorer]) -> DataFrame:
    """One row with every score, from one aggregate; rows with a null are left out."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    medians = {n: s.value(F.col(y), F.col(p)) for n, s in scorers.items() if s.median}
    found = {n: q[0] for n, q in quantiles(rows, medians, [0.5]).items()}
    return rows.agg(*((F.lit(found[name]).cast("double") if s.median else s.value(F.col(y), F.col(p))).alias(name) for name, s in scorers.items())).select(*(F.round(name, 6).alias(name) for name in scorers))


def make_scorer(name: str, value: Callable[..., Column], optimum: float = 1, more_is_better: bool = True, kind: str = "predict") -> Scorer:
    """A scorer of one's own: ``value`` makes an aggregate of two columns."""
    return Scorer(name, kind, optimum, 1 if more_is_better else -1, value)


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, n)."""
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, y: str, p: str, exact: bool = False) -> DataFrame:
    """(class, n, precision, recall, f1) of each class, from the confusion table; or its counts (class, tp, n, m)."""
    cells = confusion(df, y, p)
    long = cells.select(F.inline(F.array(F.struct(F.col("y").alias("class"), F.lit("y").alias("side"), "n", (F.col("y") == F.col("p")).alias("hit")), F.struct(F.col("p").alias("class"), F.lit("p").alias("side"), "n", F.lit(False).alias("hit")))))
    sums = long.groupBy("class").agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("side") == "y", F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("side") == "p", F.col("n"))), F.lit(0)).alias("m"),
    )
    if exact:
        return sums
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0)).cast("double"), 6)
    return sums.select("class", "n", ratio(F.col("tp"), F.col("m")).alias("precision"), ratio(F.col("tp"), F.col("n")).alias("recall"), ratio(2 * F.col("tp"), F.col("n") + F.col("m")).alias("f1"))


def averaged_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """(average, precision, recall, f1): macro, micro and weighted over the classes."""
    each = class_scores(df, y, p)
    parts = []
    for name in ("macro", "weighted"):
        w = F.lit(1.0) if name == "macro" else F.col("n")
        parts.append(each.agg(*(F.round(F.try_divide(F.sum(F.col(c) * w), F.sum(w)), 6).alias(c) for c in ("precision", "recall", "f1"))).select(F.lit(name).alias("average"), "precision", "recall", "f1"))
    hit = F.round(F.avg((F.col(y) == F.col(p)).cast("double")), 6)
    parts.append(df.agg(hit.alias("h")).select(F.lit("micro").alias("average"), F.col("h").alias("precision"), F.col("h").alias("recall"), F.col("h").alias("f1")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def class_log_loss(df: DataFrame, y: str, probabilities: dict) -> DataFrame:
    """(log_loss, pac_score) over classes; ``probabilities`` maps a class to its column, and rows sum to 1 after scaling."""
    clipped = {k: F.greatest(F.least(F.col(c), F.lit(1 - TINY)), F.lit(TINY)) for k, c in probabilities.items()}
    own = F.coalesce(*(F.when(F.col(y) == F.lit(k), c) for k, c in clipped.items()))
    total = sum(clipped.values(), F.lit(0.0))
    priors = [F.avg((F.col(y) == F.lit(k)).cast("double")) for k in probabilities]
    base = F.exp(sum((F.when(q > 0, q * F.log(q)).otherwise(0.0) for q in priors), F.lit(0.0)))
    one = df.where(F.col(y).isNotNull()).agg((-F.avg(F.log(own / total))).alias("ll"), base.alias("base"))
    return one.select(F.round("ll", 6).alias("log_loss"), F.round(F.try_divide(F.exp(-F.col("ll")) - F.col("base"), 1 - F.col("base")), 6).alias("pac_score"))


def class_balanced_accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """(balanced_accuracy): the mean recall of the classes that occur as targets."""
    each = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("r"))
    return each.agg(F.round(F.avg("r"), 6).alias("balanced_accuracy"))


def class_mcc(df: DataFrame, y: str, p: str) -> DataFrame:
    """(mcc) over any number of classes, from the confusion table."""
    each = class_scores(df, y, p, exact=True)
    one = each.agg(F.sum("tp").alias("c"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    s = F.col("s").cast("double")
    root = F.sqrt((s * s - F.col("mm")) * (s * s - F.col("nn")))
    return one.select(F.round(F.coalesce(F.try_divide(F.col("c") * s - F.col("nm"), root), F.lit(0.0)), 6).alias("mcc"))


def sample_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """(precision, recall, f1) averaged over rows, for columns that hold each row's set of labels as an array."""
    hit, m, n = F.size(F.array_intersect(y, p)), F.size(F.array_distinct(p)), F.size(F.array_distinct(y))
    ratio = lambda a, b: F.round(F.avg(F.coalesce(F.try_divide(a, b), F.lit(0.0))), 6)
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(ratio(hit, m).alias("precision"), ratio(hit, n).alias("recall"), ratio(2 * hit, m + n).alias("f1"))


def _score_table(df: DataFrame, y: str, p: str) -> DataFrame:
    """(score, pos, neg) of each distinct score, with the counts below it.

    Scores are dealt to ranges and summed within each before the ranges are, so no window
    holds all scores.
    """
    by = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    low, high = by.agg(F.min("score"), F.max("score")).first()
    if low is None:
        return by.withColumns({"pos_below": F.lit(0).cast("long"), "neg_below": F.lit(0).cast("long")})
    parts = 256
    placed = by.withColumn("__part", F.least(F.floor((F.col("score") - low) / F.lit((high - low) or 1.0) * parts), F.lit(parts - 1)))
    sums = placed.groupBy("__part").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    sums = sums.select("__part", F.coalesce(F.sum("tp").over(ahead), F.lit(0)).alias("__p"), F.coalesce(F.sum("tn").over(ahead), F.lit(0)).alias("__n"))
    inside = Window.partitionBy("__part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({"__a": F.coalesce(F.sum("pos").over(inside), F.lit(0)), "__b": F.coalesce(F.sum("neg").over(inside), F.lit(0))})
    return out.join(F.broadcast(sums), "__part").select("score", "pos", "neg", (F.col("__a") + F.col("__p")).alias("pos_below"), (F.col("__b") + F.col("__n")).alias("neg_below"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """(roc_auc): the share of (positive, negative) pairs in order, ties counting half."""
    t = _score_table(df, y, p)
    pairs = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    return t.agg(F.round(F.try_divide(pairs, (F.sum("pos") * F.sum("neg")).cast("double")), 6).alias("roc_auc"))


def roc_auc_classes(df: DataFrame, y: str, probabilities: dict, weighted: bool = False) -> DataFrame:
    """(roc_auc) averaged over classes, each against the rest; ``probabilities`` maps a class to its column."""
    out = None
    for label, c in probabilities.items():
        part = roc_auc(df.withColumn("__y", (F.col(y) == F.lit(label)).cast("int")), "__y", c).withColumn("w", F.lit(1.0))
        if weighted:
            part = part.drop("w").join(F.broadcast(df.agg(F.sum((F.col(y) == F.lit(label)).cast("double")).alias("w"))))
        out = part if out is None else out.unionByName(part)
    return out.agg(F.round(F.try_divide(F.sum(F.col("roc_auc") * F.col("w")), F.sum("w")), 6).alias("roc_auc"))


def roc_auc_pairs(df: DataFrame, y: str, probabilities: dict) -> DataFrame:
    """(roc_auc) averaged over ordered pairs of classes, each pair on its own rows."""
    out = None
    for a in probabilities:
        for b in probabilities:
            if a != b:
                rows = df.where(F.col(y).isin(a, b)).withColumn("__y", (F.col(y) == F.lit(a)).cast("int"))
                part = roc_auc(rows, "__y", probabilities[a])
                out = part if out is None else out.unionByName(part)
    return out.agg(F.round(F.avg("roc_auc"), 6).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """(average_precision): precision at each score, weighted by the recall gained there."""
    t = _score_table(df, y, p)
    whole = t.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    t = t.join(F.broadcast(whole))
    tp, fp = F.col("all_pos") - F.col("pos_below"), F.col("all_neg") - F.col("neg_below")
    gain = F.try_divide(F.col("pos"), F.col("all_pos"))
    return t.agg(F.round(F.sum(gain * F.try_divide(tp, tp + fp)), 6).alias("average_precision"))


def mean_ranks(df: DataFrame, keys: list[str], c: str, made: str) -> DataFrame:
    """Average ranks of a column within ``keys``."""
    values = df.groupBy(*keys, F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running(values, keys, ["__v"], {"__below": ("sum", F.col("__n"))}, exclusive=True)
    ranks = ranks.select(*(F.col(k).alias(f"__g_{i}") for i, k in enumerate(keys)), "__v", (F.col("__below") + (F.col("__n") + 1) / F.lit(2.0)).alias(made))
    same = [F.col(k).eqNullSafe(F.col(f"__g_{i}")) for i, k in enumerate(keys)]
    return df.join(ranks, reduce(lambda a, b: a & b, same, F.col(c).eqNullSafe(F.col("__v")))).select(*df.columns, made)


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, spearman) within each group."""
    ranked = mean_ranks(mean_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), keys, a, "__a"), keys, b, "__b")
    return ranked.groupBy(*keys).agg(F.round(F.corr("__a", "__b"), 6).alias("spearman"))


def _agreement(x, y, n) -> int:
    """Pairs that agree less pairs that differ, of weighted points: a count by halves of the ranks of x."""
    import numpy as np

    rank, y, n = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1], n.astype(np.int64)
    total = 0
    for level in range(int(rank.max(initial=0)).bit_length()):
        order = np.lexsort((y, rank >> (level + 1)))
        group, own, w = (rank >> (level + 1))[order], y[order], n[order]
        right = (rank[order] >> level & 1).astype(bool)
        low = np.concatenate([[0], np.cumsum(np.where(right, 0, w))])
        new_group = np.r_[True, group[1:] != group[:-1]]
        new_value = new_group | np.r_[True, own[1:] != own[:-1]]
        begins, ties = np.flatnonzero(new_group), np.flatnonzero(new_value)
        at_group, at_tie = np.cumsum(new_group) - 1, np.cumsum(new_value) - 1
        below = low[ties][at_tie] - low[begins][at_group]
        above = low[np.append(begins[1:], len(w))][at_group] - low[np.append(ties[1:], len(w))][at_tie]
        # Python's numbers: a sum over many rows may pass 64 bits
        total += sum(int(v) for v in np.add.reduceat(np.where(right, w * (below - above), 0), begins)) if len(begins) else 0
    return total


#: Distinct pairs of values that a range holds on average, and ranges at most.
RANGE_PAIRS, RANGES = 50_000, 512


def kendall(df: DataFrame, a: str, b: str, bins: int = 512) -> DataFrame:
    """(kendall): tau-b from exact counts, whatever the number of distinct values (``bins`` is not used any more).

    Both columns are cut into ranges of values. Pairs apart in both are counted from the
    rows of each two ranges, a table of at most ``RANGES`` squared; those within a range of
    a, and those apart in a within a range of b, by a task for each range.
    """
    import numpy as np
    import pandas as pd

    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    cells = cut(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    ranges = min(RANGES, cells.count() // RANGE_PAIRS + 1)
    # the bounds balance the tasks; the counts are exact with any
    ends = cells.approxQuantile(["a", "b"], [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else [[], []]
    ends = [sorted(set(e)) for e in ends]

    def place(c, bounds):
        return F.size(F.filter(F.array(*(F.lit(v) for v in bounds)), lambda v: v < F.col(c))) if bounds else F.lit(0)

    cells = cells.withColumns({"ra": place("a", ends[0]), "rb": place("b", ends[1])})

    def within(x):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"s": [str(_agreement(part[x].to_numpy(), part["b"].to_numpy(), part["n"].to_numpy()))]})

        return run

    parts = cells.groupBy("ra").applyInPandas(within("a"), "s string").union(cells.groupBy("rb").applyInPandas(within("ra"), "s string"))
    less = sum(int(r.s) for r in parts.collect())
    table = np.zeros((len(ends[0]) + 1, len(ends[1]) + 1))
    for r in cells.groupBy("ra", "rb").agg(F.sum("n").alias("n")).collect():
        table[r.ra, r.rb] = r.n
    below = np.zeros((table.shape[0] + 1, table.shape[1] + 1))
    below[1:, 1:] = table.cumsum(0).cumsum(1)
    less += (table * below[:-1, :-1]).sum() - (table * (below[:-1, -1:] - below[:-1, 1:])).sum()
    pairs = lambda n: n * (n - 1) / 2
    n = F.sum("n").cast("double")
    ties = [cells.groupBy(c).agg(n.alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0))).first()[0] for c in ("a", "b")]
    total = pairs(table.sum())
    tau = float(less) / math.sqrt(max(TINY, (total - ties[0]) * (total - ties[1])))
    return df.sparkSession.createDataFrame([(round(float(tau), 6),)], "kendall double")
