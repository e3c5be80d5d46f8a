"""Categorical encoders. Levels are texts; nulls and unknown levels have a defined code each."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import md5_bucket
from .base import Fitted, Operator, level_rows, lookup
from .profile import is_number


@dataclass
class OneHotEncoder(Operator):
    """A 0/1 column for each level in sorted order, ``col_1`` onwards; unknown levels are all zero."""

    def fit(self, df, names, y=None):
        levels = {c: [r["v"] for r in rows] for c, rows in level_rows(df, names).items()}
        made = {f"{c}_{k + 1}": F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("int"), F.lit(0)) for c in names for k, v in enumerate(levels[c])}
        return Fitted(made, names, {"levels": levels}, "num")


@dataclass
class OrdinalEncoder(Operator):
    """The rank of each level, from 0, in sorted or declared order; -1 for unknown ones and nulls."""

    declared: dict[str, list[str]] | None = None

    def fit(self, df, names, y=None):
        told = self.declared or {}
        seen = level_rows(df, [c for c in names if c not in told])
        levels = {c: told[c] if c in told else [r["v"] for r in seen[c]] for c in names}
        made = {c: lookup(c, {str(v): k for k, v in enumerate(levels[c])}, -1, "int") for c in names}
        return Fitted(made, [], {"levels": levels}, "ordinal")


@dataclass
class BinaryEncoder(Operator):
    """The ordinal code, from 1, in base-2 columns ``col_0`` (highest bit) onwards; unknown levels are 0."""

    def fit(self, df, names, y=None):
        made, state = {}, {}
        for c, rows in level_rows(df, names).items():
            codes = {r["v"]: k + 1 for k, r in enumerate(rows)}
            width = max(1, len(codes).bit_length())
            code = lookup(c, codes, 0, "int")
            made |= {f"{c}_{k}": F.shiftright(code, width - 1 - k).bitwiseAND(1) for k in range(width)}
            state[c] = codes
        return Fitted(made, names, {"codes": state}, "num")


@dataclass
class HashEncoder(Operator):
    """Counts of the hash buckets that a row's categories fall into; nothing is learnt."""

    buckets: int = 8

    def fit(self, df, names, y=None):
        at = [md5_bucket(F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))), self.buckets) for c in names]
        made = {f"hash_{k}": sum(((a == k).cast("int") for a in at), F.lit(0)) for k in range(self.buckets)}
        return Fitted(made, names, {}, "num")


def target_levels(df: DataFrame, names: list[str], y: str) -> tuple[dict[str, list], float, int]:
    """Per level: n, total of y; with the overall mean and count of rows that have a target."""
    rows = df.where(F.col(y).isNotNull())
    prior, n = rows.agg(F.avg(y), F.count(F.lit(1))).first()
    return level_rows(rows, names, F.sum(F.col(y).cast("double")).alias("total")), float(prior or 0.0), n


@dataclass
class TargetEncoder(Operator):
    """A level's mean of the target, drawn to the overall mean by 1 / (1 + exp(1 - n)); a single row gives the prior."""

    needs_target = True
    smoothing: float = 1.0

    def fit(self, df, names, y=None):
        levels, prior, _ = target_levels(df, names, y)
        code = lambda r: prior if r["n"] == 1 else prior + (r["total"] / r["n"] - prior) / (1 + math.exp(-(r["n"] - 1) / self.smoothing))
        codes = {c: {r["v"]: code(r) for r in rows} for c, rows in levels.items()}
        return Fitted({c: lookup(c, codes[c], prior, "double") for c in names}, [], {"codes": codes, "prior": prior}, "num")

    @staticmethod
    def nearest_level(value: Column, codes: dict[str, float]) -> Column:
        """The level whose code is nearest to a value; of equally near ones the first by name."""
        return F.array_min(F.array(*(F.struct(F.abs(value - m).alias("d"), F.lit(v).alias("v")) for v, m in codes.items())))["v"]


@dataclass
class LeaveOneOutEncoder(Operator):
    """The level's mean of the target; on training rows, without the row's own value, by ``leave_out``."""

    needs_target = True

    def fit(self, df, names, y=None):
        levels, prior, _ = target_levels(df, names, y)
        codes = {c: {r["v"]: r["total"] / r["n"] for r in rows} for c, rows in levels.items()}
        return Fitted({c: lookup(c, codes[c], prior, "double") for c in names}, [], {"codes": codes, "prior": prior}, "num")

    @staticmethod
    def leave_out(df: DataFrame, c: str, y: str, made: str) -> DataFrame:
        """Training form: (sum - own) / (n - 1) from a per-level aggregate; null where the level has one row."""
        sums = df.groupBy(c).agg(F.sum(y).alias("__s"), F.count(F.lit(1)).alias("__n"))
        joined = df.join(sums.withColumnRenamed(c, "__c"), F.col(c).eqNullSafe(F.col("__c")))
        return joined.withColumn(made, F.try_divide(F.col("__s") - F.col(y), F.col("__n") - 1)).drop("__s", "__n", "__c")


@dataclass
class CatBoostEncoder(Operator):
    """(sum + prior) / (n + 1) of each level."""

    needs_target = True

    def fit(self, df, names, y=None):
        levels, prior, _ = target_levels(df, names, y)
        codes = {c: {r["v"]: (r["total"] + prior) / (r["n"] + 1) for r in rows} for c, rows in levels.items()}
        return Fitted({c: lookup(c, codes[c], prior, "double") for c in names}, [], {"codes": codes, "prior": prior}, "num")


@dataclass
class WoeEncoder(Operator):
    """ln of a level's share of positives over its share of negatives, each regularised; binary targets only."""

    needs_target = True
    regular: float = 1.0

    def fit(self, df, names, y=None):
        levels, prior, n = target_levels(df, names, y)
        good, r = prior * n, self.regular
        bad = n - good
        woe = lambda x: math.log(((x["total"] + r) / (good + 2 * r)) / ((x["n"] - x["total"] + r) / (bad + 2 * r)))
        codes = {c: {x["v"]: woe(x) for x in rows} for c, rows in levels.items()}
        return Fitted({c: lookup(c, codes[c], 0.0, "double") for c in names}, [], {"codes": codes}, "num")


@dataclass
class CombineRare(Operator):
    """Levels below a share of the rows become one; a column that keeps no level goes."""

    minimum: float = 0.1
    rare: str = "Others Infrequent"
    rare_number: float = 999

    def fit(self, df, names, y=None):
        kinds, n = dict(df.dtypes), df.count()
        kept = {c: [r["v"] for r in rows if r["n"] >= self.minimum * n] for c, rows in level_rows(df, names).items()}
        made = {}
        for c in names:
            if kept[c]:
                x = F.col(f"`{c}`")
                other = F.lit(self.rare_number).cast(kinds[c]) if is_number(kinds[c]) else F.lit(self.rare)
                made[c] = F.when(x.cast("string").isin(kept[c]), x).otherwise(other)
        return Fitted(made, [c for c in names if not kept[c]], {"kept": kept})


#: Pairs of levels of two columns that an embedding holds on the driver, at most.
MOST_CELLS = 20_000_000


@dataclass
class EmbeddingEncoder(Operator):
    """Low-rank supervised coordinates of each level, in place of a trained network.

    The columns of a level's table are its target mean and its co-occurrence shares with
    the levels of the other columns; its leading singular vectors are the coordinates.
    Unknown levels are zero. Names are ``col_0`` onwards.
    """

    needs_target = True

    @staticmethod
    def width(levels: int) -> int:
        return round(5 * (1 - math.exp(-0.05 * levels)) + 1)

    def fit(self, df, names, y=None):
        import numpy as np

        levels, prior, _ = target_levels(df, names, y)
        made, state = {}, {}
        for c in names:
            own = [r["v"] for r in levels[c]]
            if not own:
                continue
            place = {v: k for k, v in enumerate(own)}
            parts = [np.array([[r["total"] / r["n"] - prior] for r in levels[c]])]
            for other in names:
                if other != c:
                    far = {r["v"]: k for k, r in enumerate(levels[other])}
                    if len(own) * len(far) > MOST_CELLS:
                        raise ValueError(f"{c} and {other} have more than {MOST_CELLS} pairs of levels: combine rare ones first")
                    share = np.zeros((len(own), len(far)))
                    pairs = df.groupBy(F.col(f"`{c}`").cast("string").alias("a"), F.col(f"`{other}`").cast("string").alias("b")).count().where("a is not null and b is not null")
                    for a, b, k in pairs.collect():
                        if a in place and b in far:
                            share[place[a], far[b]] = k
                    share /= np.maximum(1, share.sum(1, keepdims=True))
                    parts.append(share - share.mean(0))
            u, s, _ = np.linalg.svd(np.hstack(parts), full_matrices=False)
            k = min(self.width(len(own)), len(s))
            coords = u[:, :k] * s[:k] * np.where(u[np.abs(u[:, :k]).argmax(0), range(k)] < 0, -1, 1)
            made |= {f"{c}_{i}": lookup(c, {v: float(coords[p, i]) for v, p in place.items()}, 0.0, "double") for i in range(k)}
            state[c] = coords
        return Fitted(made, names, {"coordinates": state}, "num")
