"""What all feature operators have in common.

An operator is fitted on the rows that its scope allows, by a bounded number of
aggregates, and then applied as one lazy projection. Statistics of the target are only
taken from training rows; others see all roles if ``stacked`` is set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import FeatureFrame

#: Levels of a category that a fitted operator holds on the driver, at most.
MOST_LEVELS = 1_000_000


@dataclass
class Fitted:
    """Columns that go and columns that come; ``state`` is what was learnt."""

    made: dict[str, Column]
    old: list[str]
    state: dict[str, Any] = field(default_factory=dict)
    group: str | None = None
    #: What a table passes first, if columns that are made need more than a projection; it adds columns that ``old`` names.
    through: Callable[[DataFrame], DataFrame] | None = None

    def apply(self, frame: FeatureFrame) -> FeatureFrame:
        if self.through:
            frame = FeatureFrame(self.through(frame.df), frame.groups)
        return frame.replace(self.old, self.made, self.group)


class Operator:
    """Base of operators that end as a projection."""

    needs_target = False

    def fit(self, df: DataFrame, names: list[str], y: str | None = None) -> Fitted:
        raise NotImplementedError

    def fit_frame(self, frame: FeatureFrame, group, y: str | None = None, stacked: bool = False) -> Fitted:
        rows = frame.rows() if stacked and not self.needs_target else frame.rows("train")
        return self.fit(rows, frame.columns(group), y)


def level_rows(df: DataFrame, names: list[str], *aggregates: Column) -> dict[str, list]:
    """For each column its levels (nulls apart) with aggregates, in one pass over the table.

    Columns are unfolded to (column, level) pairs and pre-aggregated where they are read;
    the number of levels that come to the driver is checked.
    """
    if not names:
        return {}
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in names))
    long = df.withColumn("__p", F.explode(pairs)).groupBy(F.col("__p.c").alias("c"), F.col("__p.v").alias("v"))
    rows = long.agg(F.count(F.lit(1)).alias("n"), *aggregates).where("v is not null").limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels: use the hashing encoder")
    found = {c: [] for c in names}
    for r in sorted(rows, key=lambda r: (r["c"], r["v"])):
        found[r["c"]].append(r)
    return found


def lookup(c: str, table: dict[str, Any], default, kind: str) -> Column:
    """A column's value in a fitted table of levels; ``default`` for nulls and unknown levels."""
    if not table:
        return F.lit(default).cast(kind)
    known = F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values())))
    return F.coalesce(F.try_element_at(known, F.col(f"`{c}`").cast("string")), F.lit(default)).cast(kind)
