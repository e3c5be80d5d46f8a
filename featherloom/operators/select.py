"""Feature selection by univariate statistics or by the importance that a model gives."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Fitted, Operator


def _x(c: str):
    return F.col(f"`{c}`").cast("double")


def anova_f(df: DataFrame, names: list[str], y: str) -> DataFrame:
    """(column_name, f): between-class over within-class mean squares, from one grouped aggregate."""
    rows = df.where(F.col(y).isNotNull())
    asks = [a for i, c in enumerate(names) for a in (F.count(_x(c)).alias(f"n{i}"), F.sum(_x(c)).alias(f"s{i}"), F.sum(_x(c) * _x(c)).alias(f"q{i}"))]
    classes = rows.groupBy(y).agg(*asks)
    total = []
    for i in range(len(names)):
        n, s, q, k = F.sum(f"n{i}"), F.sum(f"s{i}"), F.sum(f"q{i}"), F.count(F.lit(1))
        between = F.sum(F.try_divide(F.col(f"s{i}") * F.col(f"s{i}"), F.col(f"n{i}"))) - F.try_divide(s * s, n)
        within = q - F.sum(F.try_divide(F.col(f"s{i}") * F.col(f"s{i}"), F.col(f"n{i}")))
        total.append(F.try_divide(F.try_divide(between, k - 1), F.try_divide(within, n - k)).alias(f"f{i}"))
    one = classes.agg(*total)
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.round(F.col(f"f{i}"), 6).alias("f")) for i, c in enumerate(names)))))


def chi2(df: DataFrame, names: list[str], y: str) -> DataFrame:
    """(column_name, chi2) of class sums against expected sums; negative values count as 0."""
    rows = df.where(F.col(y).isNotNull())
    x = [F.greatest(_x(c), F.lit(0.0)) for c in names]
    classes = rows.groupBy(y).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(v), F.lit(0.0)).alias(f"s{i}") for i, v in enumerate(x)))
    whole = classes.agg(F.sum("n").alias("all_n"), *(F.sum(f"s{i}").alias(f"t{i}") for i in range(len(names))))
    joined = classes.join(F.broadcast(whole))
    asks = []
    for i in range(len(names)):
        expected = F.col(f"t{i}") * F.col("n") / F.col("all_n")
        asks.append(F.sum(F.try_divide((F.col(f"s{i}") - expected) * (F.col(f"s{i}") - expected), expected)).alias(f"c{i}"))
    one = joined.agg(*asks)
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.round(F.col(f"c{i}"), 6).alias("chi2")) for i, c in enumerate(names)))))


def f_regression(df: DataFrame, names: list[str], y: str) -> DataFrame:
    """(column_name, f): r^2 / (1 - r^2) * (n - 2)."""
    asks = [a for i, c in enumerate(names) for a in (F.corr(_x(c), _x(y)).alias(f"r{i}"), F.count(_x(c) + _x(y)).alias(f"n{i}"))]
    one = df.agg(*asks)
    f = lambda i: F.try_divide(F.pow(f"r{i}", F.lit(2.0)), 1 - F.pow(f"r{i}", F.lit(2.0))) * (F.col(f"n{i}") - 2)
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.round(f(i), 6).alias("f")) for i, c in enumerate(names)))))


def mutual_information(df: DataFrame, names: list[str], y: str, bins: int = 16, target_bins: int | None = None) -> DataFrame:
    """(column_name, mi): plug-in mutual information of each column, in equal-width bins, with the target.

    A continuous target is binned too, into ``target_bins``.
    """
    if target_bins:
        low, high = df.agg(F.min(_x(y)), F.max(_x(y))).first()
        df = df.withColumn(y, F.least(F.floor((_x(y) - (low or 0.0)) / (((high or 0.0) - (low or 0.0)) or 1.0) * target_bins), F.lit(target_bins - 1)))
    row = df.agg(*(f(_x(c)).alias(f"{k}{i}") for k, f in (("a", F.min), ("b", F.max)) for i, c in enumerate(names))).first()
    pairs = []
    for i, c in enumerate(names):
        low, high = row[f"a{i}"] or 0.0, row[f"b{i}"] or 0.0
        code = F.least(F.floor((_x(c) - low) / ((high - low) or 1.0) * bins), F.lit(bins - 1))
        pairs.append(F.struct(F.lit(c).alias("c"), code.alias("v")))
    cells = df.where(F.col(y).isNotNull()).select(F.col(y).cast("string").alias("y"), F.inline(F.array(*pairs))).where("v is not null").groupBy("c", "v", "y").count()
    n, nv, ny = (F.sum("count").over(Window.partitionBy(*k)) for k in (["c"], ["c", "v"], ["c", "y"]))
    cells = cells.withColumn("term", F.col("count") / n * F.log(F.col("count") * n / (nv * ny)))
    return cells.groupBy(F.col("c").alias("column_name")).agg(F.round(F.sum("term"), 6).alias("mi"))


@dataclass
class UnivariateSelector(Operator):
    """The best ``percent`` of the columns by a univariate score, one at least, in their order."""

    needs_target = True
    score: str = "f_classif"
    percent: float = 50.0

    def fit(self, df, names, y=None):
        how = {"f_classif": anova_f, "chi2": chi2, "f_regression": f_regression, "mutual_info": mutual_information, "mutual_info_regression": lambda d, n, t: mutual_information(d, n, t, target_bins=16)}[self.score]
        found = {r[0]: r[1] for r in how(df, names, y).collect()}  # a row per column
        top = sorted(names, key=lambda c: (-(found.get(c) or 0.0), names.index(c)))[: max(1, math.ceil(len(names) * self.percent / 100))]
        return Fitted({}, [c for c in names if c not in top], {"scores": found})


def importances(df: DataFrame, names: list[str], y: str, classify: bool = True, kind: str = "forest", seed: int = 1) -> dict[str, float]:
    """Importance of each column in a tree or linear model."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    rows = VectorAssembler(inputCols=names, outputCol="__x", handleInvalid="skip").transform(df.where(F.col(y).isNotNull()).withColumn("__y", F.col(y).cast("double")))
    about = {"featuresCol": "__x", "labelCol": "__y"}
    if kind == "forest":
        model = (RandomForestClassifier if classify else RandomForestRegressor)(numTrees=20, maxDepth=5, seed=seed, **about).fit(rows)
        return dict(zip(names, model.featureImportances.toArray().tolist(), strict=True))
    if kind == "boosted":
        model = GBTRegressor(maxIter=10, maxDepth=4, seed=seed, **about).fit(rows)
        return dict(zip(names, model.featureImportances.toArray().tolist(), strict=True))
    model = (LogisticRegression(regParam=0.01, **about) if classify else LinearRegression(regParam=0.01, **about)).fit(rows)
    weights = abs(model.coefficientMatrix.toArray()).sum(0) if classify else abs(model.coefficients.toArray())
    return dict(zip(names, weights.tolist(), strict=True))


@dataclass
class ModelSelector(Operator):
    """The best ``percent`` of the columns by a model's importance."""

    needs_target = True
    classify: bool = True
    kind: str = "forest"
    percent: float = 50.0

    def fit(self, df, names, y=None):
        found = importances(df, names, y, self.classify, self.kind)
        top = sorted(names, key=lambda c: (-found[c], names.index(c)))[: max(1, round(len(names) * self.percent / 100))]
        return Fitted({}, [c for c in names if c not in top], {"importances": found})


@dataclass
class RecursiveSelector(Operator):
    """Drops the least important ``step`` share of columns, refits, and goes on down to ``percent``."""

    needs_target = True
    classify: bool = True
    percent: float = 50.0
    step: float = 0.25

    def fit(self, df, names, y=None):
        left, goal = list(names), max(1, round(len(names) * self.percent / 100))
        while len(left) > goal:
            found = importances(df, left, y, self.classify)
            k = min(len(left) - goal, max(1, int(len(left) * self.step)))
            worst = set(sorted(left, key=lambda c: (found[c], -left.index(c)))[:k])
            left = [c for c in left if c not in worst]
        return Fitted({}, [c for c in names if c not in left], {"kept": left})


@dataclass
class AdaptiveSelector(Operator):
    """Half a forest's and half a boosted model's importance, each scaled to 0..1; the columns kept grow with ``percent``."""

    needs_target = True
    classify: bool = True
    percent: float = 50.0

    def fit(self, df, names, y=None):
        def scaled(found):
            low, high = min(found.values()), max(found.values())
            return {c: (v - low) / ((high - low) or 1.0) for c, v in found.items()}

        a, b = scaled(importances(df, names, y, self.classify)), scaled(importances(df, names, y, self.classify, "boosted"))
        blend = {c: (a[c] + b[c]) / 2 for c in names}
        k = 1 + round((min(df.count(), len(names)) - 1) * self.percent / 100)
        top = sorted(names, key=lambda c: (-blend[c], names.index(c)))[:k]
        return Fitted({}, [c for c in names if c not in top], {"importances": blend})


@dataclass
class BorutaSelector(Operator):
    """Columns that beat shuffled copies of the columns more often than chance.

    Each round adds shadow columns (five at least), a column's values dealt to other rows
    by hash order, and counts a hit where an importance exceeds the best shadow's. After
    the rounds a two-sided binomial test, corrected for the number of columns, accepts or
    rejects; undecided columns stay if their median importance is above the median of the
    best shadows. Two columns stay at least.
    """

    needs_target = True
    classify: bool = True
    rounds: int = 10
    alpha: float = 0.05

    def fit(self, df, names, y=None):
        hits, seen, best = dict.fromkeys(names, 0), {c: [] for c in names}, []
        shadows = [names[i % len(names)] for i in range(max(5, len(names)))]
        # positions by row are needed to deal values anew: taken within hash lanes, so that no task has all rows
        rows = df.select(*names, y).withColumn("__lane", F.pmod(F.xxhash64(*names, y), F.lit(64)))
        for r in range(self.rounds):
            left = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__lane").orderBy(F.xxhash64(*names, y, F.lit(2 * r)))))
            right = rows.select("__lane", *(F.col(c).alias(f"__s{i}") for i, c in enumerate(shadows)), F.row_number().over(Window.partitionBy("__lane").orderBy(F.xxhash64(*names, y, F.lit(2 * r + 1)))).alias("__n"))
            found = importances(left.join(right, ["__lane", "__n"]), [*names, *(f"__s{i}" for i in range(len(shadows)))], y, self.classify, seed=r + 1)
            top = max(found[f"__s{i}"] for i in range(len(shadows)))
            best.append(top)
            for c in names:
                seen[c].append(found[c])
                hits[c] += found[c] > top
        tail = lambda k: sum(math.comb(self.rounds, j) for j in range(k, self.rounds + 1)) / 2**self.rounds
        level = self.alpha / max(1, len(names))
        kept = []
        for c in names:
            accepted, rejected = tail(hits[c]) <= level, 1 - tail(hits[c] + 1) <= level
            if accepted or not rejected and np.median(seen[c]) > np.median(best):
                kept.append(c)
        if len(kept) < 2:
            kept = sorted(names, key=lambda c: -np.median(seen[c]))[:2]
        return Fitted({}, [c for c in names if c not in kept], {"hits": hits})


@dataclass
class NoiseFilter(Operator):
    """Columns whose weight in a linear model exceeds that of every noise column added to them.

    Noise columns are normal numbers, half as many as the columns and three at least, and
    the columns themselves with their rows' values dealt anew by a hash; all have mean 0 and
    deviation 1. Of ``rounds`` resamples of 85 % of the rows a column must win ``share``.
    """

    needs_target = True
    classify: bool = True
    rounds: int = 3
    share: float = 0.5
    seed: int = 1

    def fit(self, df, names, y=None):
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.regression import LinearRegression

        from .estimators import assembled
        from .scale import StandardScaler

        wins = dict.fromkeys(names, 0)
        own = StandardScaler().fit(df, names).made
        noise = [f"__noise_{i}" for i in range(max(3, len(names) // 2))]
        for r in range(self.rounds):
            part = df.select(y, *(F.coalesce(x, F.lit(0.0)).alias(f"__x_{i}") for i, x in enumerate(own.values())))
            part = part.withColumns({n: F.randn(self.seed * 1000 + 100 * r + i) for i, n in enumerate(noise)}).sample(0.85, self.seed + r)
            rows = assembled(part, [f"__x_{i}" for i in range(len(names))] + noise, y)
            kind = LogisticRegression(regParam=0.01) if self.classify else LinearRegression(regParam=0.01)
            model = kind.fit(rows)
            weights = abs(model.coefficientMatrix.toArray()).max(0) if self.classify else abs(model.coefficients.toArray())
            for c, w in zip(names, weights, strict=False):
                wins[c] += bool(w > weights[len(names) :].max())
        kept = [c for c in names if wins[c] >= self.share * self.rounds]
        return Fitted({}, [c for c in names if c not in kept], {"wins": wins})


def best_count(score, most: int, rounds: int = 10) -> int:
    """The number of columns, from 1 to ``most``, of the best score: thirds first, then halves about the best so far."""
    seen: dict[int, float] = {}

    def at(n: int) -> float:
        if n not in seen:
            seen[n] = score(n)
        return seen[n]

    for n in {most, max(1, most // 3), max(1, 2 * most // 3)}:
        at(n)
    for _ in range(rounds):
        best = max(seen, key=lambda n: (seen[n], -n))
        below, above = max((n for n in seen if n < best), default=0), min((n for n in seen if n > best), default=None)
        new = [m for m in ((below + best + 1) // 2, (best + above) // 2 if above else None) if m and m not in seen]
        if not new:
            break
        for n in new:
            at(n)
    return max(seen, key=lambda n: (seen[n], -n))


@dataclass
class DichotomySelector(Operator):
    """As many of the most important columns as score best on held-out rows, their number found by halving."""

    needs_target = True
    classify: bool = True
    rounds: int = 10

    def fit(self, df, names, y=None):
        from ..session import cut
        from .estimators import assembled, make
        from .metrics import REGRESSION

        found = importances(df, names, y, self.classify)
        order = sorted(names, key=lambda c: (-found[c], names.index(c)))
        rows = cut(df.select(*names, y).withColumn("__held", F.pmod(F.xxhash64(*names, y), F.lit(3)) == 0))

        def score(n: int) -> float:
            part = assembled(rows, order[:n], y)
            model = make("decision_tree", self.classify).fit(part.where(~F.col("__held")))
            told = model.transform(part.where("__held"))
            value = F.avg((F.col("prediction") == F.col("label")).cast("double")) if self.classify else REGRESSION["r2"].value(F.col("label"), F.col("prediction"))
            return told.agg(value).first()[0] or 0.0

        k = best_count(score, len(names), self.rounds)
        return Fitted({}, [c for c in names if c not in order[:k]], {"kept": order[:k]})
