"""Missing values: columns dropped by their share of nulls, the rest filled."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .base import Fitted, Operator, level_rows, lookup
from .order import quantiles
from .profile import is_number

NULL_LEVEL = "<NULL>"


def null_ratios(df: DataFrame, names: list[str]) -> dict[str, float]:
    """The share of nulls of each column; 0 for a table without rows."""
    if not names:
        return {}
    row = df.agg(*(F.coalesce(F.try_divide(F.count_if(F.col(f"`{c}`").isNull()), F.count(F.lit(1))), F.lit(0.0)).alias(str(i)) for i, c in enumerate(names))).first()
    return dict(zip(names, row, strict=True))


def modes(df: DataFrame, names: list[str]) -> dict[str, str | None]:
    """The most frequent level of each column; of equally frequent ones the smallest."""
    found = level_rows(df, names)
    return {c: min(rows, key=lambda r: (-r["n"], r["v"]))["v"] if rows else None for c, rows in found.items()}


@dataclass
class SimpleImputer(Operator):
    """Columns of ``missing_rate`` nulls or more go; numbers are filled by median or mean, others by mode or a constant."""

    missing_rate: float = 0.4
    num_strategy: str = "median"
    cat_strategy: str = "most_frequent"

    def fit(self, df, names, y=None):
        kinds, ratios = dict(df.dtypes), null_ratios(df, names)
        gone = [c for c in names if ratios[c] >= self.missing_rate]
        stay = [c for c in names if c not in gone and ratios[c] > 0]
        numbers = [c for c in stay if is_number(kinds[c])]
        fill = {}
        if numbers:
            if self.num_strategy == "median":
                fill |= {c: q[0] for c, q in quantiles(df, {c: F.col(f"`{c}`") for c in numbers}, [0.5]).items()}
            else:
                fill |= dict(zip(numbers, df.agg(*(F.avg(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(numbers))).first(), strict=True))
        cats = [c for c in stay if c not in numbers]
        top = modes(df, cats) if self.cat_strategy == "most_frequent" else {}
        fill |= {c: NULL_LEVEL if (v := top.get(c)) is None else v for c in cats}
        made = {c: F.coalesce(F.col(f"`{c}`").cast("double") if c in numbers else F.col(f"`{c}`").cast("string"), F.lit(v)) for c, v in fill.items()}
        return Fitted(made, gone, {"fill": fill, "dropped": gone, "ratios": ratios})


@dataclass
class CategoryCoder:
    """Categories as whole numbers (by the order of their names) and back; nulls stay null both ways."""

    levels: dict[str, list[str]] = field(default_factory=dict)

    def fit(self, df: DataFrame, names: list[str]) -> CategoryCoder:
        self.levels = {c: [r["v"] for r in rows] for c, rows in level_rows(df, names).items()}
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: lookup(c, {v: float(i) for i, v in enumerate(found)}, None, "double") for c, found in self.levels.items()})

    def decode(self, df: DataFrame) -> DataFrame:
        """The category of the nearest code; beyond the ends the first or the last."""
        made = {}
        for c, found in self.levels.items():
            at = F.greatest(F.least(F.round(F.col(f"`{c}`")).cast("int"), F.lit(len(found) - 1)), F.lit(0))
            made[c] = F.when(F.col(f"`{c}`").isNotNull(), F.get(F.array(*map(F.lit, found)), at)) if found else F.lit(None).cast("string")
        return df.withColumns(made)


@dataclass
class IterativeImputer(Operator):
    """Each incomplete column is predicted from the others, in rounds, by a tree model.

    Columns go from the fewest nulls to the most. Rounds end when the change of numbers,
    sum of squared steps over sum of squares, no longer falls, or after ``rounds``. The
    model is a boosted (``gbt``) or a random (``forest``) one; categories use forests.
    """

    rounds: int = 10
    method: str = "gbt"
    trees: int = 20
    depth: int = 4
    models: dict = field(default_factory=dict)

    def fit_transform(self, df: DataFrame, names: list[str]) -> DataFrame:
        """``df`` with the nulls of the named columns filled; categories by forests, on codes that are read back at the end."""
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

        kinds, ratios = dict(df.dtypes), null_ratios(df, names)
        cats = [c for c in names if not is_number(kinds[c])]
        coder = CategoryCoder().fit(df, cats)
        df = coder.encode(df)
        open_ = sorted((c for c in names if 0 < ratios[c] < 1), key=lambda c: (ratios[c], c))
        if not open_:
            return coder.decode(df)
        start = dict(zip(names, df.agg(*((F.mode(c, True) if c in cats else F.avg(c)).alias(str(i)) for i, c in enumerate(names))).first(), strict=True))
        now = df.withColumns({f"__gap_{c}": F.col(c).isNull() for c in open_}).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(start[c] or 0.0)) for c in names})
        before = float("inf")
        for _ in range(self.rounds):
            old = now
            change, size = 0.0, 0.0
            for c in open_:
                rest = [x for x in names if x != c]
                featured = VectorAssembler(inputCols=rest, outputCol="__x").transform(now)
                if c in cats:
                    kind = RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, seed=1).setProbabilityCol("__q").setRawPredictionCol("__r")
                else:
                    kind = GBTRegressor(maxIter=self.trees, maxDepth=self.depth, seed=1) if self.method == "gbt" else RandomForestRegressor(numTrees=self.trees, maxDepth=self.depth, seed=1)
                model = kind.setFeaturesCol("__x").setLabelCol(c).setPredictionCol("__p").fit(featured.where(~F.col(f"__gap_{c}")))
                done = model.transform(featured)
                step = done.where(F.col(f"__gap_{c}")).agg(F.sum((F.col("__p") - F.col(c)) ** 2), F.sum(F.col("__p") ** 2)).first()
                change, size = change + (step[0] or 0.0), size + (step[1] or 0.0)
                now = done.withColumn(c, F.when(F.col(f"__gap_{c}"), F.col("__p")).otherwise(F.col(c))).drop("__x", "__p", "__q", "__r")
            gamma = change / size if size else 0.0
            if gamma >= before:
                now = old
                break
            now, before = cut(now), gamma
        return coder.decode(now.drop(*(f"__gap_{c}" for c in open_)))


def _masked_nearest(x: np.ndarray, table: np.ndarray, k: int, skip: np.ndarray | None = None):
    """For each gap of ``x`` (row, column): the k nearest donors that have the column, as (row, column, distance, value).

    Distances are squared, over the coordinates that both rows have, scaled up by all over
    common coordinates; ``skip`` marks (row, donor) pairs that do not count.
    """
    p = x.shape[1]
    mx, mt = (~np.isnan(x)).astype(float), (~np.isnan(table)).astype(float)
    x0, t0 = np.nan_to_num(x), np.nan_to_num(table)
    out = []
    for at in range(0, len(x), 256):
        part = slice(at, at + 256)
        both = mx[part] @ mt.T
        d = np.maximum(0, (x0[part] ** 2) @ mt.T - 2 * x0[part] @ t0.T + mx[part] @ (t0**2).T) * p / np.maximum(1, both)
        d[both == 0] = np.inf
        if skip is not None:
            d[skip[part]] = np.inf
        for c in range(p):
            rows, donors = np.flatnonzero(mx[part, c] == 0), np.flatnonzero(mt[:, c])
            if not len(rows) or not len(donors):
                continue
            own = d[np.ix_(rows, donors)]
            best = np.argsort(own, axis=1, kind="stable")[:, :k]
            far = np.take_along_axis(own, best, 1)
            r = np.repeat(rows + at, best.shape[1])
            keep = np.isfinite(far.ravel())
            out.append((r[keep], np.full(keep.sum(), c), far.ravel()[keep], table[donors[best], c].ravel()[keep]))
    if not out:
        return tuple(np.empty(0, t) for t in (int, int, float, float))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def knn_impute(df: DataFrame, key: str, names: list[str], k: int = 5, row_most: float = 0.5, block: int = 20_000) -> DataFrame:
    """``df`` with the nulls of number columns filled by the mean of the k nearest rows that have the value, among all rows.

    Rows are dealt by hash to blocks of about ``block``; each row with a gap passes each
    block, and the nearest over all blocks stay. Rows with more than ``row_most`` nulls, and
    gaps without any donor, get the column's mean. ``key`` tells rows apart.
    """
    rows = cut(df.select(F.col(key).alias("__key"), F.array(*(F.col(f"`{c}`").cast("double") for c in names)).alias("__x")))
    means = df.agg(*(F.avg(F.col(f"`{c}`").cast("double")).alias(str(i)) for i, c in enumerate(names))).first()
    gaps = F.size(F.filter("__x", lambda v: v.isNull()))
    asking = rows.where((gaps > 0) & (gaps <= row_most * len(names)))
    blocks, kind, out = max(1, -(-rows.count() // block)), dict(rows.dtypes)["__key"], None
    floats = lambda column: np.array([[np.nan if v is None else v for v in r] for r in column], float).reshape(-1, len(names))
    for at in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("__key", F.lit(11)), F.lit(blocks)) == at).orderBy("__key").toArrow()
        sent = df.sparkSession.sparkContext.broadcast((held["__key"].to_numpy(), floats(held["__x"].to_pylist())))

        def run(batches, sent=sent):
            keys, table = sent.value
            for b in batches:
                if len(b) and len(keys):
                    own = b["__key"].to_numpy()
                    r, c, far, v = _masked_nearest(floats(b["__x"]), table, k, own[:, None] == keys[None])
                    yield pd.DataFrame({"__key": own[r], "c": c, "d": far, "v": v})

        part = asking.mapInPandas(run, f"__key {kind}, c int, d double, v double")
        out = part if out is None else out.unionByName(part)
    near = Window.partitionBy("__key", "c").orderBy("d", "v")
    filled = out.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k).groupBy("__key", "c").agg(F.avg("v").alias("v"))
    wide = filled.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("__found"))
    joined = df.join(wide, F.col(key) == F.col("__key"), "left")
    made = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.try_element_at("__found", F.lit(i)), F.lit(means[i])) for i, c in enumerate(names)}
    return joined.withColumns(made).select(*df.columns)


@dataclass
class KnnImputer(Operator):
    """Nulls become the mean of the k nearest donors that have the value, by masked distances.

    Fitted for rows yet to come: the donors are ``donors`` rows of the smallest hash, a
    documented bound, so that they travel with the projection; ``knn_impute`` fills a table
    from all of its rows. Rows with more than ``row_most`` nulls get column means.
    """

    k: int = 5
    row_most: float = 0.5
    donors: int = 10_000

    def fit(self, df, names, y=None):
        some = df.select(F.array(*(F.col(f"`{c}`").cast("double") for c in names)).alias("x"))
        means = np.array([m or 0.0 for m in df.agg(*(F.avg(f"`{c}`") for c in names)).first()])
        held = some.orderBy(F.xxhash64("x"), "x").limit(self.donors).toArrow()["x"].to_pylist()
        table = np.array([[np.nan if v is None else v for v in r] for r in held], float).reshape(-1, len(names))
        k, most = self.k, self.row_most

        @F.pandas_udf("array<double>")
        def fill(rows: pd.Series) -> pd.Series:
            x = np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(-1, len(means))
            r, c, _, v = _masked_nearest(x, table, k)
            some = np.isnan(x).mean(1)[r] <= most
            total, n = np.zeros_like(x), np.zeros_like(x)
            np.add.at(total, (r[some], c[some]), v[some])
            np.add.at(n, (r[some], c[some]), 1)
            full = np.where(n > 0, total / np.maximum(1, n), means[None])
            return pd.Series(list(np.where(np.isnan(x), full, x)))

        packed = fill(F.array(*(F.col(f"`{c}`").cast("double") for c in names)))
        return Fitted({c: packed[i] for i, c in enumerate(names)}, [], {"means": means.tolist(), "donors": len(table)})
