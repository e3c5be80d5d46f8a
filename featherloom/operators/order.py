"""Ranks, running sums and exact quantiles that no single task has to sort.

A window keyed by a class, a budget or nothing puts all of a key's rows into one task.
Here rows are dealt to ranges of (keys, order) first; a window runs within each range, a
second one over the ranges' totals, which are as many as there are ranges and keys, and
their sum is the rank. A hot key thus spreads over as many tasks as its rows fill.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

RANGE = "__range"
#: Letters of a hash text that name its range: 256 ranges to each key.
HASH_LETTERS = 2
#: Cells of counts that a round of ``quantiles`` brings to the driver, at most.
CELLS = 100_000

#: How a running aggregate joins what is inside a range with what lies before it.
JOINED = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}
INSIDE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
OVER = INSIDE | {"count": F.sum}


def _over_ranges(df: DataFrame, keys: list[str], order: list, made: dict[str, tuple[str, Column]], exclusive: bool) -> DataFrame:
    """``df``, which has its ranges in column RANGE, with running aggregates over all ranges of a key."""
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    ahead = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, RANGE).agg(*(INSIDE[how](c).alias(f"__t_{n}") for n, (how, c) in made.items()))
    before = totals.select(*(F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)), F.col(RANGE).alias("__r"), *(OVER[how](f"__t_{n}").over(ahead).alias(f"__b_{n}") for n, (how, _) in made.items()))
    within = df.select("*", *(INSIDE[how](c).over(inside).alias(f"__i_{n}") for n, (how, c) in made.items()))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)]
    joined = within.join(before, reduce(lambda a, b: a & b, same, F.col(RANGE) == F.col("__r")))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c not in made and c != RANGE), *(JOINED[how](F.col(f"__i_{n}"), F.col(f"__b_{n}")).alias(n) for n, (how, _) in made.items()))


def running(df: DataFrame, keys: list[str], order: list, made: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """``df`` with running aggregates ``made`` (name: (sum, count, min or max; column)) within ``keys``, by ``order``.

    ``exclusive`` leaves the row itself out. ``order`` (columns, or ``F.desc`` of them) must
    tell rows apart for a result that is the same at every run. Ranges are cut from a sample,
    and written with their rows, so that a lost task deals them alike.
    """
    lane = [] if keys else ["__lane"]
    rows = df if keys else df.withColumn("__lane", F.lit(0))
    rows = cut(rows.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()))
    return _over_ranges(rows, keys or lane, order, made, exclusive).drop(*lane)


def hash_rank(df: DataFrame, keys: list[str], text: Column, key: str, made: str) -> DataFrame:
    """``df`` with each row's rank from 1 within ``keys``, by a hash text (hexadecimal), then ``key``.

    The text's first letters name the range: they are in the same order, and even by nature.
    """
    rows = df.withColumns({"__text": text}).withColumn(RANGE, F.substring("__text", 1, HASH_LETTERS))
    return _over_ranges(rows, keys, ["__text", key], {made: ("count", F.lit(1))}, False).drop("__text")


def quantiles(df: DataFrame, columns: dict[str, Column], at: list[float]) -> dict[str, list[float | None]]:
    """The exact quantiles of each column, interpolated; None for a column without numbers.

    Counts of equal bins between the least and the most value show in which bin a quantile's
    rank lies, and the next round looks at that bin alone, until a bin has one value. A round
    is one aggregate for all columns; its cells are bounded and no values come to the driver.
    """
    columns = {c: x.cast("double") for c, x in columns.items()}
    if not columns:
        return {}
    real = {c: x.isNotNull() & ~F.isnan(x) for c, x in columns.items()}
    ends = {c: (F.count_if(real[c] & (x == -math.inf)), F.count_if(real[c] & (x.isNotNull())), *(f(F.when(real[c] & (F.abs(x) != math.inf), x)) for f in (F.min, F.max, F.count))) for c, x in columns.items()}
    first = df.agg(*(v.alias(f"{i}_{k}") for i, c in enumerate(columns) for k, v in enumerate(ends[c]))).first()
    known: dict[tuple[str, int], float] = {}
    todo, sizes = [], {}
    for i, c in enumerate(columns):
        minus, n, low, high, finite = (first[f"{i}_{k}"] for k in range(5))
        sizes[c] = n
        ranks = {r for q in at for r in (math.floor((n - 1) * q), math.ceil((n - 1) * q))} if n else set()
        known |= {(c, r): -math.inf for r in ranks if r < minus} | {(c, r): math.inf for r in ranks if r >= minus + finite}
        todo.append((c, low, high, minus, sorted(r for r in ranks if minus <= r < minus + finite)))
    while todo := [t for t in todo if t[4]]:
        bins = max(4, CELLS // len(todo))
        cells = []
        for i, (c, low, high, _, _) in enumerate(todo):
            x, step = columns[c], (high / 2 - low / 2) or 1.0
            place = F.least(F.floor((x / 2 - low / 2) / step * bins), F.lit(bins - 1))
            cells.append(F.when(real[c] & (x >= low) & (x <= high), F.struct(F.lit(i).alias("i"), place.alias("b"), x.alias("x"))))
        long = df.select(F.inline(F.array_compact(F.array(*cells))))
        counted: dict[int, list] = {}
        for r in long.groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
            counted.setdefault(r["i"], []).append(r)
        after = []
        for i, (c, _, _, below, ranks) in enumerate(todo):
            for r in sorted(counted[i], key=lambda r: r["b"]):
                inside = [k for k in ranks if below <= k < below + r["n"]]
                # the least and the most of a bin are known by now
                known |= {(c, k): r["low"] for k in inside if k == below or r["low"] == r["high"]} | {(c, k): r["high"] for k in inside if k == below + r["n"] - 1}
                after.append((c, r["low"], r["high"], below, [k for k in inside if (c, k) not in known]))
                below += r["n"]
        todo = after

    def value(c: str, q: float) -> float:
        h = (sizes[c] - 1) * q
        a, b = known[c, math.floor(h)], known[c, math.ceil(h)]
        return a if a == b else a + (b - a) * (h - math.floor(h))

    return {c: [value(c, q) if sizes[c] else None for q in at] for c in columns}


def group_quantile(df: DataFrame, keys: list[str], c: str, q: float, made: str) -> DataFrame:
    """(keys, made): the exact interpolated quantile of a column within each group."""
    values = df.where(F.col(c).isNotNull()).groupBy(*keys, F.col(c).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = cut(running(values, keys, ["__x"], {"__upto": ("sum", F.col("__n"))}))
    sizes = ranked.groupBy(*(F.col(k).alias(f"__g_{i}") for i, k in enumerate(keys))).agg(((F.sum("__n") - 1) * q).alias("__h"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__g_{i}")) for i, k in enumerate(keys)))
    # the values of the two ranks about the quantile's place
    holds = lambda rank: (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
    near = ranked.join(sizes, same).where(holds(F.floor("__h")) | holds(F.ceil("__h")))
    share = F.first("__h") - F.floor(F.first("__h"))
    return near.groupBy(*keys).agg((F.min("__x") + (F.max("__x") - F.min("__x")) * share).alias(made))
