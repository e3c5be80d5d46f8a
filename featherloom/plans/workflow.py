"""Workflows: steps from one feature group to another, compiled to one plan per fitted table."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compress, encode, expand, impute, scale, select, text
from ..operators.base import Fitted, Operator
from ..operators.frame import FeatureFrame

#: Operators by name; ``register`` adds one's own.
REGISTRY: dict[str, Callable[..., Operator]] = {
    "impute.simple": impute.SimpleImputer,
    "impute.knn": impute.KnnImputer,
    "encode.one_hot": encode.OneHotEncoder,
    "encode.ordinal": encode.OrdinalEncoder,
    "encode.binary": encode.BinaryEncoder,
    "encode.hash": encode.HashEncoder,
    "encode.target": encode.TargetEncoder,
    "encode.leave_one_out": encode.LeaveOneOutEncoder,
    "encode.cat_boost": encode.CatBoostEncoder,
    "encode.woe": encode.WoeEncoder,
    "encode.combine_rare": encode.CombineRare,
    "encode.entity": encode.EmbeddingEncoder,
    "scale.standard": scale.StandardScaler,
    "scale.minmax": scale.MinMaxScaler,
    "scale.robust": scale.RobustScaler,
    "scale.normalize": scale.RowNormaliser,
    "scale.quantile": scale.QuantileScaler,
    "scale.power": scale.PowerScaler,
    "scale.adaptive": scale.AdaptiveScaler,
    "compress.variance": compress.VarianceFilter,
    "compress.pearson": compress.PearsonFilter,
    "compress.f1score": compress.F1Filter,
    "select.univar": select.UnivariateSelector,
    "select.from_model": select.ModelSelector,
    "select.rfe": select.RecursiveSelector,
    "select.adaptive": select.AdaptiveSelector,
    "select.boruta": select.BorutaSelector,
    "select.noise": select.NoiseFilter,
    "select.dichotomy": select.DichotomySelector,
    "generate.autofeat": expand.SymbolicFeatures,
    "expand.polynomial": expand.Polynomial,
    "expand.kitchen_sinks": expand.KitchenSinks,
    "expand.nystroem": expand.Nystroem,
    "reduce.pca": expand.Pca,
    "reduce.truncated_svd": lambda **k: expand.Pca(centre=False, prefix="svd", **k),
    "reduce.fast_ica": expand.FastIca,
    "reduce.random_trees": expand.RandomTrees,
    "reduce.kernel_pca": expand.KernelPca,
    "reduce.adaptive": expand.AdaptiveReducer,
    "text.lsi": lambda **k: text.Topics("lsi", **k),
    "text.tsvd": lambda **k: text.Topics("tsvd", **k),
    "text.lda": lambda **k: text.Topics("lda", **k),
    "text.hdp": lambda **k: text.Topics("hdp", **k),
    "text.nmf": lambda **k: text.Topics("nmf", **k),
    "text.random_projection": lambda **k: text.Topics("random_projection", **k),
    "reduce.agglomeration": expand.Agglomerate,
}


def register(name: str, make: Callable[..., Operator]) -> None:
    REGISTRY[name] = make


#: Endings by which a parameter names what it is relative to.
RELATIVE = ("lr_ratio", "sp1_ratio", "sp1_percent", "sp1_dev", "card_ratio")


def relative(kind: str, value: float, rows: int, columns: int, parameters: dict[str, Any], levels: int | None = None) -> int:
    """A whole number relative to the learning rate, the number of columns or that of a category's levels.

    ``lr_ratio`` is a number of rounds at a learning rate of 1; ``sp1_ratio``, ``sp1_percent``
    and ``sp1_dev`` are a share, a percentage and a fraction's divisor of the columns;
    ``card_ratio`` is a share of the levels, two at least.
    """
    if kind == "lr_ratio":
        return max(int(value / parameters["learning_rate"]), 10)
    if kind == "sp1_ratio":
        return max(1, min(rows, round(columns * value)))
    if kind == "sp1_percent":
        return max(1, int(columns * value / 100))
    if kind == "sp1_dev":
        return max(1, math.ceil(columns / (value or 1)))
    if kind == "card_ratio":
        return max(2, math.ceil((levels or 0) * value))
    raise ValueError(f"unknown kind of relative parameter: {kind}")


def _resolve(parameters: dict[str, Any], frame: FeatureFrame, group) -> dict[str, Any]:
    """Parameters that depend on the table.

    A callable gets the number of the group's columns; ``_name__kind`` is a parameter
    ``name`` relative to what its ending says.
    """
    columns, out = frame.columns(group), {}
    for name, value in parameters.items():
        plain, found, kind = name[1:].rpartition("__")
        if name.startswith("_") and found and kind in RELATIVE:
            rows = frame.df.count() if kind == "sp1_ratio" else 0
            levels = None
            if kind == "card_ratio" and columns:
                levels = max(frame.df.agg(*(F.count_distinct(F.col(f"`{c}`")) for c in columns)).first())
            out[plain] = relative(kind, value, rows, len(columns), parameters, levels)
        else:
            out[name] = value(len(columns)) if callable(value) else value
    return out


@dataclass
class Step:
    """``operator`` (a name, or names joined by ``|``) over a group; ``out`` renames what it made."""

    group: str | list[str] | None
    operator: str
    out: str | None = None
    parameters: dict[str, Any] = field(default_factory=dict)


@dataclass
class Workflow:
    """Steps in order. Statistics come from training rows, or from all roles with ``stacked``."""

    steps: list[Step]
    stacked: bool = False

    def fit_transform(self, frame: FeatureFrame, y: str | None = None) -> FeatureFrame:
        self.fitted: list[tuple[Step, list[Fitted | None]]] = []
        for step in self.steps:
            done: list[Fitted | None] = []
            group = step.group
            for name in step.operator.split("|"):
                columns = frame.columns(group)
                if name == "keep":
                    made = None
                elif name == "drop":
                    made = Fitted({}, columns)
                else:
                    given = _resolve(step.parameters, frame, group)
                    known = {f.name for f in dataclasses.fields(REGISTRY[name])} if dataclasses.is_dataclass(REGISTRY[name]) else None
                    if known is not None and (odd := set(given) - known) and "|" not in step.operator:
                        raise TypeError(f"{name} has no parameter {sorted(odd)}")
                    chosen = {k: v for k, v in given.items() if known is None or k in known}
                    made = REGISTRY[name](**chosen).fit_frame(frame, group, y, self.stacked) if columns else None
                done.append(made)
                frame = self._apply(frame, columns, made, step)
            self.fitted.append((step, done))
        return frame

    def transform(self, frame: FeatureFrame) -> FeatureFrame:
        for step, done in self.fitted:
            for made in done:
                frame = self._apply(frame, frame.columns(step.group), made, step)
        return frame

    @staticmethod
    def _apply(frame: FeatureFrame, columns: list[str], made: Fitted | None, step: Step) -> FeatureFrame:
        if made is not None:
            if made.through:
                frame = FeatureFrame(made.through(frame.df), frame.groups)
            group = step.out or made.group
            gone = made.old if made.made or made.old else []
            frame = frame.replace([c for c in gone if c not in made.made], made.made, group)
        if step.out:
            frame = frame.retag({c: step.out for c in columns if c in frame.groups})
        return frame


def default_workflow(groups: dict[str, str]) -> Workflow:
    """Impute, encode and scale what the groups call for."""
    have, steps = set(groups.values()), [Step(None, "impute.simple")]
    if "cat" in have:
        steps.append(Step("cat", "encode.one_hot", "num"))
    if "highC_cat" in have:
        steps.append(Step("highC_cat", "encode.ordinal", "num"))
    steps.append(Step("num", "scale.standard", "final"))
    return Workflow(steps)


def prepare(df: DataFrame, described: dict[str, str] | None = None, y: str | None = None) -> FeatureFrame:
    """A frame with inferred groups; the target and ids are no features."""
    from ..operators.profile import infer_groups

    groups = infer_groups(df, described)
    return FeatureFrame(df, {c: g for c, g in groups.items() if c != y and g not in ("id", "target", "ignore", "date", "text")})
