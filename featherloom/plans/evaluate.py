"""Trials: a workflow and an estimator, judged by folds, logged, and put together.

A trial's predictions are one table (trial, fold, key, y, p). Scores are one grouped
aggregate over it, and a trial's loss and scores are their means over its folds.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ensemble, estimators, split
from ..operators.frame import ROLE, FeatureFrame
from ..operators.metrics import CLASSIFICATION, REGRESSION, Scorer
from ..session import cut
from . import trials

#: Iterations of an estimator at a whole budget.
MOST_ITERATIONS = {"gradient_boosting": 40, "lightgbm": 60, "catboost": 60, "random_forest": 40, "extra_trees": 40, "logistic_regression": 100, "sgd": 100, "elastic_net": 100, "tabular_nn": 100}
#: The parameter that says how many.
ITERATIONS = {"random_forest": "numTrees", "extra_trees": "numTrees"}


def iterations(most: int, budget: float) -> int:
    """A budget below 1 takes its share of the iterations, one at least."""
    return max(round(most * min(1.0, budget)), 1)


def folds_of(budget: float, k: int, by_budget: dict[float, int] | None = None) -> list[int]:
    """Folds that a budget pays for: the first up to a budget of 1; beyond, all, or as many as ``by_budget`` says."""
    return [0] if budget <= 1 else list(range(min(k, (by_budget or {}).get(budget, k))))


def fold_scores(predictions: DataFrame, scorers: dict[str, Scorer], trial: str = "trial", fold: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    """(trial, fold, scores...) from one aggregate; rows with a null are left out."""
    rows = predictions.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return rows.groupBy(trial, fold).agg(*(s.value(F.col(y), F.col(p)).alias(n) for n, s in scorers.items() if not s.median))


def trial_scores(predictions: DataFrame, scorers: dict[str, Scorer], main: str, trial: str = "trial", fold: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    """(trial, n_folds, loss, scores...): means over each trial's folds; the loss is that of the score ``main``."""
    each = fold_scores(predictions, scorers, trial, fold, y, p)
    s = scorers[main]
    names = [n for n, x in scorers.items() if not x.median]
    return each.groupBy(trial).agg(F.count(F.lit(1)).alias("n_folds"), F.avg(F.lit(float(s.optimum)) - s.sign * F.col(main)).alias("loss"), *(F.avg(n).alias(n) for n in names))


@dataclass
class EarlyStopping:
    """Stops once a score beats none of the last ``window`` bests by ``tolerance``."""

    window: int = 5
    tolerance: float = 0.001
    best: list[tuple[float, int]] = field(default_factory=list)
    stopped: bool = False
    asked: int = 0

    def tell(self, iteration: int, score: float) -> bool:
        """Whether to go on."""
        at = self.asked % self.window
        self.asked += 1
        if len(self.best) < self.window or any(score - self.tolerance > b for b, _ in self.best):
            self.best[at : at + 1] = [(score, iteration)]
        else:
            self.stopped = True
        return not self.stopped

    def iteration(self) -> int:
        """The iteration of the best score; of equal ones the first."""
        return min((-s, i) for s, i in self.best)[1]


@dataclass
class Trial:
    """A configuration: a workflow to make features, an estimator's name and its parameters."""

    workflow: Callable[[dict[str, str]], Any]
    estimator: str
    parameters: dict[str, Any] = field(default_factory=dict)

    def model(self, classify: bool, classes: int, budget: float):
        chosen = dict(self.parameters)
        if self.estimator in MOST_ITERATIONS:
            name = ITERATIONS.get(self.estimator, "maxIter")
            chosen[name] = iterations(chosen.get(name, MOST_ITERATIONS[self.estimator]), budget)
        return estimators.make(self.estimator, classify, classes, **chosen)


def evaluate(frame: FeatureFrame, trial: Trial, key: str, y: str, name: int = 0, classify: bool = True, budget: float = 1.0, k: int = 5, by_budget: dict[float, int] | None = None, main: str | None = None) -> tuple[DataFrame, dict]:
    """(out-of-fold predictions, record for the log) of one trial.

    Features and the estimator are fitted anew on the training rows of each fold, so no
    statistic sees the rows it is judged on. Labels of classes are 0, 1 and so on.
    """
    began = time.time()
    classes = frame.df.select(y).distinct().count() if classify else 0
    folded = split.stratified_folds(frame.df, key, y, k) if classify else split.hash_folds(frame.df, key, k)
    folded, parts = cut(folded), []
    for fold in folds_of(budget, k, by_budget):
        roles = folded.withColumn(ROLE, F.when(F.col(split.FOLD) == fold, "valid").otherwise("train"))
        done = trial.workflow(frame.groups).fit_transform(FeatureFrame(roles, dict(frame.groups)), y)
        rows = estimators.assembled(done.df, done.columns(), y)
        model = trial.model(classify, classes, budget).fit(rows.where(F.col(ROLE) == "train"))
        told = model.transform(rows.where(F.col(ROLE) == "valid"))
        if classify and "probability" in told.columns:
            told = estimators.probability(told)
        else:
            told = told.withColumn("p", F.col("prediction"))
        parts.append(told.select(F.lit(name).alias("trial"), F.lit(fold).alias("fold"), F.col(key).alias("rid"), F.col("label").alias("y"), "prediction", "p"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = cut(out)
    scorers = {n: s for n, s in (CLASSIFICATION if classify else REGRESSION).items() if s.kind == "predict" and (classes == 2 or n in ("accuracy", *REGRESSION))}
    main = main or ("accuracy" if classify else "r2")
    found = trial_scores(out, scorers, main, p="prediction").first().asDict()
    scores = {n: float(found[n]) for n in scorers if n in found and found[n] is not None}
    record = {"trial_id": name, "experiment": 0, "config": repr((trial.estimator, sorted(trial.parameters.items()))), "budget": float(budget), "estimator": trial.estimator, "loss": float(found["loss"]), "cost_time": time.time() - began, "status": "success", "started": began, "finished": time.time(), "scores": scores, "info": None}
    return out, record


def assemble(log: DataFrame, predictions: DataFrame, k: int = 10, classify: bool = True):
    """The ensemble of the log's k best trials: a vote of one alone, else a stack over their predictions.

    Gives (predictions (rid, p) of the ensemble, the stacking model or None). Trials whose
    predictions are not as many as most trials' are left out.
    """
    best = trials.best_k(log, k).select(F.col("trial_id").alias("trial"))
    own = ensemble.aligned(predictions.join(F.broadcast(best), "trial", "left_semi"), "trial")
    names = sorted(r[0] for r in own.select("trial").distinct().collect())
    if len(names) <= 1:
        return ensemble.soft_vote(own.select("rid", "p")), None
    model, rows = ensemble.stack(own.withColumnRenamed("trial", "model"), names, classify=classify)
    told = model.transform(rows)
    return (estimators.probability(told) if classify else told.withColumn("p", F.col("prediction"))).select("rid", "p"), model
