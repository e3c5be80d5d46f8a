"""Columns that say little or the same as another one go."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import functions as F

from .base import Fitted, Operator

#: Pairs of columns per aggregate, so that generated code stays small.
PAIRS = 400


@dataclass
class VarianceFilter(Operator):
    """Columns of a population variance up to ``threshold`` go; so do columns without values."""

    threshold: float = 0.0

    def fit(self, df, names, y=None):
        row = df.agg(*(F.var_pop(F.col(f"`{c}`").cast("double")).alias(str(i)) for i, c in enumerate(names))).first() if names else []
        found = dict(zip(names, row, strict=True))
        return Fitted({}, [c for c in names if found[c] is None or found[c] <= self.threshold], {"variance": found})


def pairwise(df, names: list[str], measure) -> dict[tuple[str, str], float]:
    """A measure of every pair of columns, in wide aggregates."""
    pairs, found = list(combinations(names, 2)), {}
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        row = df.agg(*(measure(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(str(i)) for i, (a, b) in enumerate(part))).first()
        found |= dict(zip(part, row, strict=True))
    return found


def correlation(a, b):
    """Pearson's, null where a column is constant."""
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


def f1(a, b):
    """F1 of two 0/1 columns."""
    return F.try_divide(2 * F.sum(a * b), F.sum(a) + F.sum(b))


def similar(found: dict, threshold: float, most: int) -> list[str]:
    """Of the pairs above the threshold, most similar first, the earlier column; ``most`` of them."""
    above = sorted(((v, p) for p, v in found.items() if v is not None and v > threshold), key=lambda x: (-x[0], x[1]))
    gone: list[str] = []
    for _, (a, _b) in above:
        if a not in gone and len(gone) < most:
            gone.append(a)
    return gone


@dataclass
class PearsonFilter(Operator):
    """Of two columns correlated above ``threshold`` the earlier goes; signed unless ``absolute``."""

    threshold: float = 0.9
    most: float = 0.8
    absolute: bool = False

    def fit(self, df, names, y=None):
        found = pairwise(df, names, (lambda a, b: F.abs(correlation(a, b))) if self.absolute else correlation)
        return Fitted({}, similar(found, self.threshold, int(len(names) * self.most)), {"similarity": found})


@dataclass
class F1Filter(Operator):
    """As above by F1, over those columns that hold 0 and 1 only."""

    threshold: float = 0.9
    most: float = 0.8

    def fit(self, df, names, y=None):
        binary = df.agg(*(F.coalesce(F.bool_and(F.col(f"`{c}`").isin(0, 1)), F.lit(False)).alias(str(i)) for i, c in enumerate(names))).first() if names else []
        flags = [c for c, b in zip(names, binary, strict=True) if b]
        found = pairwise(df, flags, f1)
        return Fitted({}, similar(found, self.threshold, int(len(names) * self.most)), {"similarity": found})
