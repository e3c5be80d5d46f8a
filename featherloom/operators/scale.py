"""Scalers: one aggregate over the table, then a projection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Fitted, Operator
from .order import quantiles


def _col(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _stats(df, names, **how):
    """{statistic: {column: value}} of one aggregate."""
    asks = [f(_col(c)).alias(f"{k}_{i}") for k, f in how.items() for i, c in enumerate(names)]
    row = df.agg(*asks).first() if asks else {}
    return {k: {c: row[f"{k}_{i}"] for i, c in enumerate(names)} for k in how}


@dataclass
class StandardScaler(Operator):
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""

    def fit(self, df, names, y=None):
        s = _stats(df, names, mean=F.avg, deviation=F.stddev_pop)
        return Fitted({c: (_col(c) - F.lit(s["mean"][c])) / F.lit(s["deviation"][c] or 1.0) for c in names}, [], s)


@dataclass
class MinMaxScaler(Operator):
    """(x - least) / (most - least); a range of 0 counts as 1."""

    def fit(self, df, names, y=None):
        s = _stats(df, names, least=F.min, most=F.max)
        return Fitted({c: (_col(c) - F.lit(s["least"][c])) / F.lit((s["most"][c] or 0) - (s["least"][c] or 0) or 1.0) for c in names}, [], s)


@dataclass
class RobustScaler(Operator):
    """(x - median) / (high quantile - low quantile), quantiles interpolated."""

    low: float = 0.25
    high: float = 0.75

    def fit(self, df, names, y=None):
        s = {"q": quantiles(df, {c: _col(c) for c in names}, [self.low, 0.5, self.high])}
        made = {}
        for c, q in s["q"].items():
            made[c] = (_col(c) - F.lit(q[1])) / F.lit((q[2] - q[0] if q[0] is not None else 0) or 1.0)
        return Fitted(made, [], s)


@dataclass
class RowNormaliser(Operator):
    """Each row over its Euclidean norm; a row of zeros stays."""

    def fit(self, df, names, y=None):
        norm = F.sqrt(sum((_col(c) * _col(c) for c in names), F.lit(0.0)))
        return Fitted({c: _col(c) / F.when(norm == 0, 1.0).otherwise(norm) for c in names}, [])


@dataclass
class QuantileScaler(Operator):
    """The piecewise-linear empirical distribution function, uniform or normal; quantiles capped by rows."""

    quantiles: int = 100
    normal: bool = False

    def fit(self, df, names, y=None):
        n = max(2, min(self.quantiles, df.count()))
        at = [k / (n - 1) for k in range(n)]
        s = {"q": quantiles(df, {c: _col(c) for c in names}, at)}
        return Fitted({c: self._normal(self._place(_col(c), q, at)) if self.normal else self._place(_col(c), q, at) for c, q in s["q"].items() if q[0] is not None}, [], s)

    @staticmethod
    def _place(x: Column, q: list[float], at: list[float]) -> Column:
        values, first = np.unique(np.array(q), return_index=True)
        # a repeated quantile takes the middle of its steps
        last = np.append(first[1:], len(q)) - 1
        level = [(at[a] + at[b]) / 2 for a, b in zip(first, last, strict=True)]
        v, u = F.array(*map(F.lit, map(float, values))), F.array(*map(F.lit, level))
        below = F.size(F.filter(v, lambda b: b <= x))
        lo, hi = F.get(v, below - 1), F.get(v, below)
        step = F.get(u, below - 1) + (x - lo) / (hi - lo) * (F.get(u, below) - F.get(u, below - 1))
        return F.when(x <= float(values[0]), level[0]).when(x >= float(values[-1]), level[-1]).otherwise(step)

    @staticmethod
    def _normal(u: Column) -> Column:
        """The normal quantile by a rational approximation (error below 4.5e-4), clipped at 1e-7."""
        p = F.greatest(F.least(u, F.lit(1 - 1e-7)), F.lit(1e-7))
        t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
        z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
        return F.when(p < 0.5, -z).otherwise(z)


def yeo_johnson(x: Column, power: float) -> Column:
    """The Yeo-Johnson transform at a fixed power."""
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


@dataclass
class PowerScaler(Operator):
    """Yeo-Johnson at the likeliest power, then standardised.

    Likelihoods of a whole grid of powers come from one aggregate; two finer grids
    around the best follow.
    """

    steps: int = 17

    def fit(self, df, names, y=None):
        best, width = dict.fromkeys(names, 0.0), 4.0
        for _ in range(3):
            grid = {c: [best[c] + width * (k / (self.steps - 1) - 0.5) for k in range(self.steps)] for c in names}
            asks = [F.var_pop(yeo_johnson(_col(c), p)).alias(f"v{i}_{k}") for i, c in enumerate(names) for k, p in enumerate(grid[c])]
            asks += [F.avg(F.signum(_col(c)) * F.log1p(F.abs(_col(c)))).alias(f"j{i}") for i, c in enumerate(names)]
            row = df.agg(*asks).first()
            for i, c in enumerate(names):
                score = [(-0.5 * np.log(row[f"v{i}_{k}"]) + (p - 1) * row[f"j{i}"], -k) for k, p in enumerate(grid[c]) if (row[f"v{i}_{k}"] or 0) > 1e-300]
                if score:
                    best[c] = grid[c][-max(score)[1]]
            width /= self.steps / 4
        powered = {c: yeo_johnson(_col(c), p) for c, p in best.items()}
        row = df.agg(*(f(powered[c]).alias(f"{k}{i}") for k, f in (("m", F.avg), ("d", F.stddev_pop)) for i, c in enumerate(names))).first()
        made = {c: (powered[c] - F.lit(row[f"m{i}"])) / F.lit(row[f"d{i}"] or 1.0) for i, c in enumerate(names)}
        return Fitted(made, [], {"power": best})


@dataclass
class AdaptiveScaler(Operator):
    """Standard or robust scaling, whichever gives a linear model the better validation score; ties go to standard.

    ``ranges`` are quantile ranges to try; a robust one must win by ``margin``.
    """

    needs_target = True
    ranges: tuple = ((0.1, 0.9), (0.2, 0.8), (0.25, 0.75), (0.3, 0.7))
    margin: float = 0.002

    def fit(self, df, names, y=None):
        from pyspark.ml.evaluation import RegressionEvaluator
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import LinearRegression

        valid = F.pmod(F.xxhash64(*names), F.lit(3)) == 0

        def score(fitted: Fitted) -> float:
            rows = df.select(*(x.alias(c) for c, x in fitted.made.items()), F.col(y).cast("double").alias("__y"), valid.alias("__v")).dropna()
            rows = VectorAssembler(inputCols=list(fitted.made), outputCol="__x").transform(rows)
            model = LinearRegression(featuresCol="__x", labelCol="__y", regParam=0.1, standardization=False).fit(rows.where("not __v"))
            return RegressionEvaluator(labelCol="__y", metricName="r2").evaluate(model.transform(rows.where("__v")))

        best = StandardScaler().fit(df, names)
        top = score(best) + self.margin
        for low, high in self.ranges:
            tried = RobustScaler(low, high).fit(df, names)
            if (s := score(tried)) > top:
                best, top = tried, s
        return best
