"""Columns made of others: polynomials, symbolic formulas, kernel maps and projections."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement, islice

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.scalar import BINARY, UNARY
from .base import Fitted, Operator


def _x(c: str):
    return F.col(f"`{c}`").cast("double")


@dataclass
class Polynomial(Operator):
    """All monomials up to ``degree``, named by their factors."""

    degree: int = 2
    bias: bool = False

    def fit(self, df, names, y=None):
        made = {"1": F.lit(1.0)} if self.bias else {}
        for d in range(1, self.degree + 1):
            for factors in combinations_with_replacement(names, d):
                product = _x(factors[0])
                for f in factors[1:]:
                    product = product * _x(f)
                made["*".join(factors)] = product
        return Fitted(made, names, {}, "num")


def unary_statistics(df, names: list[str]) -> dict[str, dict]:
    """min, max, least and most magnitude of each column: what the domains of unary transforms ask for."""
    asks = [f(_x(c)).alias(f"{k}{i}") for k, f in (("min", F.min), ("max", F.max), ("least", lambda x: F.min(F.abs(x))), ("most", lambda x: F.max(F.abs(x)))) for i, c in enumerate(names)]
    row = df.agg(*asks).first()
    return {c: {k: row[f"{k}{i}"] if row[f"{k}{i}"] is not None else float("nan") for k in ("min", "max", "least", "most")} for i, c in enumerate(names)}


@dataclass
class SymbolicFeatures(Operator):
    """Unary transforms where their domain allows, then products of all pairs.

    Formulas that are constant, not finite, or correlated above ``parent`` with what they
    are made of, or above ``original`` with an original column, are left out.
    """

    steps: int = 2
    parent: float = 0.95
    original: float = 0.9
    #: Pairs tried at most; None: all.
    most: int | None = None

    def fit(self, df, names, y=None):
        stats = unary_statistics(df, names)
        pool, made = {c: (_x(c), None) for c in names}, {}
        unary = {f"{u}({c})": (how(_x(c)), c) for c in names for u, (how, fits) in UNARY.items() if fits(stats[c])}
        made |= self._good(df, unary, pool, names)
        if self.steps > 1:
            both, terms = {}, {c: _x(c) for c in names} | {k: v[0] for k, v in made.items()}
            listed = list(terms)
            for a, b in islice(combinations(listed, 2), self.most):
                both[f"({a})*({b})"] = (BINARY["x*y"](terms[a], terms[b]), a)
            made |= self._good(df, both, pool | made, names)
        return Fitted({k: v[0] for k, v in made.items()}, [], {"formulas": list(made)}, "num")

    def _good(self, df, tried, known, names):
        found, listed = {}, list(tried)
        for at in range(0, len(listed), 100):
            part = listed[at : at + 100]
            asks = []
            for k, name in enumerate(part):
                x, parent = tried[name]
                asks += [F.var_pop(x).alias(f"v{k}"), F.corr(x, known[parent][0]).alias(f"p{k}")]
                asks.append(F.greatest(*(F.abs(F.corr(x, _x(c))) for c in names), F.lit(0.0)).alias(f"o{k}"))
            row = df.agg(*asks).first()
            for k, name in enumerate(part):
                v, p, o = row[f"v{k}"], row[f"p{k}"], row[f"o{k}"]
                if v is not None and math.isfinite(v) and v > 1e-10 and abs(p or 0) < self.parent and (o or 0) < self.original:
                    found[name] = tried[name]
        return found


def most_columns(n: int, steps: int, unary: int = len(UNARY), binary: int = len(BINARY)) -> int:
    """An upper bound on the columns that symbolic expansion can make of ``n``."""
    total = n
    for step in range(steps):
        if step % 2 == 0:
            total += total * unary
        else:
            total += math.comb(total, 2) * binary
    return total


def dimensionless(units: dict[str, dict[str, int]]) -> list[dict[str, int]]:
    """Integer exponents of products of columns that have no unit, from a null space."""
    names, bases = list(units), sorted({b for u in units.values() for b in u})
    matrix = np.array([[units[c].get(b, 0) for c in names] for b in bases], float)
    _, s, vt = np.linalg.svd(matrix) if len(bases) else (None, np.zeros(0), np.eye(len(names)))
    null = vt[int((s > 1e-9).sum()) :]
    # row-reduce to small integers
    rows, out = [r.copy() for r in null], []
    col = 0
    for k in range(len(rows)):
        while col < len(names) and max(abs(r[col]) for r in rows[k:]) < 1e-9:
            col += 1
        if col == len(names):
            break
        best = max(range(k, len(rows)), key=lambda i: abs(rows[i][col]))
        rows[k], rows[best] = rows[best], rows[k]
        rows[k] = rows[k] / rows[k][col]
        for i in range(len(rows)):
            if i != k:
                rows[i] = rows[i] - rows[i][col] * rows[k]
        col += 1
    for r in rows:
        for scale in range(1, 25):
            if np.allclose(r * scale, np.round(r * scale), atol=1e-6):
                out.append({c: int(v) for c, v in zip(names, np.round(r * scale), strict=True) if v})
                break
    return out


def _linear(names, weights, shift):
    return sum((_x(c) * float(w) for c, w in zip(names, weights, strict=True)), F.lit(float(shift)))


@dataclass
class KitchenSinks(Operator):
    """Random Fourier features of a Gaussian kernel."""

    width: int = 50
    gamma: float = 1.0
    seed: int = 1

    def fit(self, df, names, y=None):
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(0, math.sqrt(2 * self.gamma), (self.width, len(names))), rng.uniform(0, 2 * math.pi, self.width)
        made = {f"sink_{k}": F.cos(_linear(names, w[k], b[k])) * math.sqrt(2 / self.width) for k in range(self.width)}
        return Fitted(made, names, {}, "num")


@dataclass
class Nystroem(Operator):
    """Kernel values against ``width`` landmark rows, those of the smallest hash, whitened."""

    width: int = 30
    gamma: float = 0.1

    def fit(self, df, names, y=None):
        rows = df.select(*(_x(c).alias(c) for c in names)).dropna().orderBy(F.xxhash64(*names), *names).limit(self.width).collect()
        marks = np.array([list(r) for r in rows], float).reshape(-1, len(names))
        d = ((marks[:, None] - marks[None]) ** 2).sum(2)
        values, vectors = np.linalg.eigh(np.exp(-self.gamma * d))
        whiten = vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T if len(marks) else marks
        near = [F.exp(-self.gamma * sum(((_x(c) - float(m)) * (_x(c) - float(m)) for c, m in zip(names, mark, strict=True)), F.lit(0.0))) for mark in marks]
        made = {f"landmark_{k}": sum((n * float(w) for n, w in zip(near, whiten[:, k], strict=True)), F.lit(0.0)) for k in range(len(marks))}
        return Fitted(made, names, {"landmarks": marks}, "num")


#: Partial sums of products are added up in so many lanes before they come to the driver.
LANES = 16


def covariance(df, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, population covariance and number of the complete rows.

    Means come from one aggregate; each partition then adds up its centred products as a
    matrix, partitions are added up in lanes, and ``LANES`` matrices come to the driver.
    """
    from .balance import packed

    rows = packed(df, names)
    one = rows.agg(F.count(F.lit(1)), *(F.avg(F.col("__x")[i]) for i in range(len(names)))).first()
    n, mean, width = one[0], np.array([m or 0.0 for m in one[1:]]), len(names)
    if not n:
        return mean, np.zeros((width, width)), 0

    def partial(batches):
        total, lane = np.zeros((width, width)), 0
        for b in batches:
            if len(b):
                x = np.stack(b["__x"].to_numpy()) - mean
                total, lane = total + x.T @ x, int(b["__lane"].iloc[0])
        yield pd.DataFrame({"lane": [lane], "products": [total.ravel()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lane": group["lane"].iloc[:1], "products": [np.sum(np.stack(group["products"].to_numpy()), axis=0)]})

    kind = "lane long, products array<double>"
    parts = rows.withColumn("__lane", F.spark_partition_id() % LANES).mapInPandas(partial, kind)
    found = parts.groupBy("lane").applyInPandas(added, kind).select("products").collect()
    return mean, sum(np.array(r[0]) for r in found).reshape(width, width) / n, n


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry is positive."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])] < 0, -1, 1)


def width_of(rows: int, columns: int, ratio: float) -> int:
    return max(1, min(rows, round(columns * ratio)))


@dataclass
class Pca(Operator):
    """Centred principal components (``centre``), or the components of the plain second moments."""

    ratio: float = 0.5
    centre: bool = True
    prefix: str = "pca"

    def fit(self, df, names, y=None):
        mean, cov, n = covariance(df, names)
        if not self.centre:
            cov, mean = cov + np.outer(mean, mean), np.zeros(len(names))
        values, vectors = np.linalg.eigh(cov)
        k = width_of(n, len(names), self.ratio)
        order = np.argsort(-values)[:k]
        v = _signed(vectors[:, order])
        made = {f"{self.prefix}_{i}": _linear(names, v[:, i], -(mean @ v[:, i])) for i in range(k)}
        total = values.sum() or 1.0
        return Fitted(made, names, {"variance": values[order].tolist(), "share": (values[order] / total).tolist()}, "num")


@dataclass
class FastIca(Operator):
    """Independent components: whitening from the covariance, then fixed-point rounds, each one aggregate."""

    ratio: float = 0.5
    rounds: int = 20
    seed: int = 1

    def fit(self, df, names, y=None):
        mean, cov, n = covariance(df, names)
        values, vectors = np.linalg.eigh(cov)
        k = width_of(n, len(names), self.ratio)
        order = [i for i in np.argsort(-values) if values[i] > 1e-12][:k]
        white = vectors[:, order] / np.sqrt(values[order])
        k = len(order)
        z = [_linear(names, white[:, i], -(mean @ white[:, i])) for i in range(k)]
        rows = df.select(*(c.alias(f"z{i}") for i, c in enumerate(z)))
        w = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(k, k)))[0]
        for _ in range(self.rounds):
            asks = []
            for a in range(k):
                g = F.tanh(sum((F.col(f"z{i}") * float(w[a, i]) for i in range(k)), F.lit(0.0)))
                asks += [F.avg(F.col(f"z{i}") * g).alias(f"m{a}_{i}") for i in range(k)] + [F.avg(1 - g * g).alias(f"d{a}")]
            row = rows.agg(*asks).first()
            new = np.array([[row[f"m{a}_{i}"] - row[f"d{a}"] * w[a, i] for i in range(k)] for a in range(k)])
            u, _, vt = np.linalg.svd(new)
            new = u @ vt
            close = np.abs(np.abs((new * w).sum(1)) - 1).max()
            w = new
            if close < 1e-4:
                break
        mix = white @ w.T
        return Fitted({f"ica_{i}": _linear(names, mix[:, i], -(mean @ mix[:, i])) for i in range(k)}, names, {}, "num")


@dataclass
class RandomTrees(Operator):
    """Leaves of trees that split at random, as 0/1 columns."""

    trees: int = 10
    depth: int = 3
    seed: int = 1

    def fit(self, df, names, y=None):
        stats, rng, made = unary_statistics(df, names), np.random.default_rng(self.seed), {}
        for t in range(self.trees):
            leaf = F.lit(0)
            for _ in range(self.depth):
                c = names[rng.integers(len(names))]
                at = rng.uniform(stats[c]["min"], stats[c]["max"]) if stats[c]["min"] < stats[c]["max"] else stats[c]["min"]
                leaf = leaf * 2 + F.coalesce((_x(c) > float(at)).cast("int"), F.lit(0))
            made |= {f"tree_{t}_{k}": (leaf == k).cast("int") for k in range(1 << self.depth)}
        return Fitted(made, names, {}, "num")


@dataclass
class Agglomerate(Operator):
    """Columns merged by average-linkage correlation into clusters, each pooled by its mean."""

    ratio: float = 0.5
    pool: str = "mean"

    def fit(self, df, names, y=None):
        _, cov, n = covariance(df, names)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
        far = 1 - cov / np.outer(sd, sd)
        groups = [[i] for i in range(len(names))]
        while len(groups) > width_of(n, len(names), self.ratio):
            a, b = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: (far[np.ix_(groups[p[0]], groups[p[1]])].mean(), p))
            groups[a] += groups.pop(b)
        how = {"mean": lambda cs: sum(cs[1:], cs[0]) / len(cs), "max": lambda cs: F.greatest(*cs) if len(cs) > 1 else cs[0], "median": lambda cs: F.element_at(F.array_sort(F.array(*cs)), (len(cs) + 1) // 2)}[self.pool]
        return Fitted({f"cluster_{k}": how([_x(names[i]) for i in g]) for k, g in enumerate(groups)}, names, {"clusters": [[names[i] for i in g] for g in groups]}, "num")


@dataclass
class KernelPca(Operator):
    """Principal components of a Gaussian kernel's landmark features: a declared approximation of kernel PCA."""

    components: int = 5
    width: int = 50
    gamma: float = 1.0
    prefix: str = "kpca"

    def fit(self, df, names, y=None):
        landmarks = Nystroem(self.width, self.gamma).fit(df, names)
        temporary = {f"__land_{i}": x for i, x in enumerate(landmarks.made.values())}
        through = lambda d: d.withColumns(temporary)
        own = list(temporary)
        mean, cov, n = covariance(through(df).select(*own), own)
        values, vectors = np.linalg.eigh(cov)
        top = np.argsort(-values)[: min(self.components, len(own))]
        vectors = _signed(vectors[:, top])
        made = {f"{self.prefix}_{k}": _linear(own, vectors[:, k], -float(mean @ vectors[:, k])) for k in range(vectors.shape[1])}
        return Fitted(made, [*names, *own], {"variance": values[top]}, "num", through)


@dataclass
class AdaptiveReducer(Operator):
    """PCA, truncated SVD or ICA to as many components as score best on held-out rows, their number found by halving."""

    needs_target = True
    kind: str = "pca"
    classify: bool = True
    rounds: int = 4

    def fit(self, df, names, y=None):
        from ..session import cut
        from .estimators import assembled, make
        from .frame import FeatureFrame
        from .metrics import REGRESSION
        from .select import best_count

        rows = cut(df.select(*names, y).withColumn("__held", F.pmod(F.xxhash64(*names, y), F.lit(3)) == 0))

        def reducer(n: int):
            share = n / len(names)
            return FastIca(share) if self.kind == "ica" else Pca(share, self.kind == "pca", self.kind)

        def score(n: int) -> float:
            fitted = reducer(n).fit(rows.where(~F.col("__held")), names)
            part = assembled(fitted.apply(FeatureFrame(rows, dict.fromkeys(names, "num"))).df, list(fitted.made), y)
            told = make("decision_tree", self.classify).fit(part.where(~F.col("__held"))).transform(part.where("__held"))
            value = F.avg((F.col("prediction") == F.col("label")).cast("double")) if self.classify else REGRESSION["r2"].value(F.col("label"), F.col("prediction"))
            return told.agg(value).first()[0] or 0.0

        n = best_count(score, len(names), self.rounds)
        fitted = reducer(n).fit(df, names)
        fitted.state = {"components": n}
        return fitted
