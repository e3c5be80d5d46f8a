"""A DataFrame whose columns belong to feature groups.

Groups are tags on columns; operators select columns by group and name a group for what
they make. Roles of rows (train, valid, test) are a column, so the rows that a
statistic sees are a filter and splits need no union.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE = "_role"
NATIVE_GROUPS = ("text", "date", "cat", "highC_cat", "num")
AUXILIARY_GROUPS = ("id", "target", "ignore")


def unique_names(names: list[str], dirty: bool = False, tidy: bool = False) -> list[str]:
    """Names without repeats: later ones get _1, _2 and so on.

    ``dirty`` first renames those without any letter or digit to ``col``; ``tidy`` lowers
    case and joins words by underscores.
    """
    found, seen = [], {}
    if dirty:
        names = [n if re.search(r"\w", n) else "col" for n in names]
    if tidy:
        names = [re.sub(r"\W+", "_", re.sub(r"([a-z\d])([A-Z])", r"\1_\2", n)).strip("_").lower() for n in names]
    taken = set(names)
    for n in names:
        if n not in seen:
            seen[n] = 0
            found.append(n)
            continue
        while True:
            seen[n] += 1
            if (made := f"{n}_{seen[n]}") not in taken:
                break
        taken.add(made)
        found.append(made)
    return found


@dataclass
class FeatureFrame:
    """``df`` and the group of each feature column; other columns travel along."""

    df: DataFrame
    groups: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        # unknown columns are dropped from the description
        self.groups = {c: g for c, g in self.groups.items() if c in self.df.columns}

    @classmethod
    def described(cls, df: DataFrame, described: dict[str, str | list[str]]) -> FeatureFrame:
        """From a description of groups, each a column or a list of columns."""
        pairs = {c: g for g, cs in described.items() for c in ([cs] if isinstance(cs, str) else cs)}
        return cls(df, pairs)

    def columns(self, group: str | list[str] | None = None, inside: bool = True) -> list[str]:
        """Feature columns of a group or groups, in the table's order; all for None or "all"."""
        wanted = None if group in (None, "all") else {group} if isinstance(group, str) else set(group)
        return [c for c in self.df.columns if c in self.groups and (wanted is None or (self.groups[c] in wanted) == inside)]

    def select(self, group=None, inside: bool = True) -> FeatureFrame:
        """The features of a group (or all others) with the columns that are no features."""
        keep = set(self.columns(group, inside))
        names = [c for c in self.df.columns if c in keep or c not in self.groups]
        return FeatureFrame(self.df.select(*names), {c: self.groups[c] for c in keep})

    def replace(self, old: list[str], made: dict[str, Column], group: str | None) -> FeatureFrame:
        """Columns ``old`` go, ``made`` come at the end under ``group``, all in one projection.

        A made column of an old name keeps that column's group if ``group`` is None.
        """
        rest = [c for c in self.df.columns if c not in set(old) | set(made)]
        df = self.df.select(*(F.col(f"`{c}`") for c in rest), *(x.alias(c) for c, x in made.items()))
        groups = {c: g for c, g in self.groups.items() if c in rest}
        return FeatureFrame(df, groups | {c: group or self.groups.get(c, "num") for c in made})

    def retag(self, mapping: dict[str, str]) -> FeatureFrame:
        """Other groups for groups or for single columns; no plan changes."""
        return FeatureFrame(self.df, {c: mapping.get(c, mapping.get(g, g)) for c, g in self.groups.items()})

    def concat(self, other: FeatureFrame, key: str) -> FeatureFrame:
        """The columns of ``other`` beside these, row by row of an equal key; names that are taken get a number."""
        theirs = [c for c in other.df.columns if c != key]
        names = unique_names([*self.df.columns, *theirs])[len(self.df.columns) :]
        right = other.df.select(F.col(key).alias("__key"), *(F.col(f"`{c}`").alias(n) for c, n in zip(theirs, names, strict=True)))
        df = self.df.join(right, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
        return FeatureFrame(df, self.groups | {n: other.groups[c] for c, n in zip(theirs, names, strict=True) if c in other.groups})

    def drop(self, group) -> FeatureFrame:
        return self.select(group, inside=False)

    def pop_auxiliary(self) -> tuple[FeatureFrame, dict[str, list[str]]]:
        """The frame without id, target and ignored features, and those columns by group."""
        found = {g: self.columns(g) for g in AUXILIARY_GROUPS if self.columns(g)}
        return FeatureFrame(self.df, {c: g for c, g in self.groups.items() if g not in AUXILIARY_GROUPS}), found

    def like(self, other: FeatureFrame) -> FeatureFrame:
        """The same columns in the order of ``other``; a different set of columns is an error."""
        if set(self.df.columns) != set(other.df.columns):
            raise ValueError(f"columns differ: {sorted(set(self.df.columns) ^ set(other.df.columns))}")
        return FeatureFrame(self.df.select(*other.df.columns), self.groups)

    def at(self, positions: list[int]) -> FeatureFrame:
        """Columns by position."""
        names = [self.df.columns[i] for i in positions]
        return FeatureFrame(self.df.select(*names), self.groups)

    def rows(self, *roles: str) -> DataFrame:
        """Rows of some roles; all rows for none, or where the frame has no roles."""
        return self.df.where(F.col(ROLE).isin(*roles)) if roles and ROLE in self.df.columns else self.df


def stack_roles(**frames: DataFrame) -> DataFrame:
    """Tables of the roles named, under one another, with their role as a column."""
    parts = [df.withColumn(ROLE, F.lit(role)) for role, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rectify(df: DataFrame, names: list[str]) -> DataFrame:
    """String columns of which every value is a number become doubles; one aggregate for all."""
    if not names:
        return df
    tests = [F.coalesce(F.bool_and(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()), F.lit(False)).alias(c) for c in names]
    numeric = df.agg(*tests).first()
    return df.withColumns({c: F.col(c).try_cast("double") for c in names if numeric[c]})
