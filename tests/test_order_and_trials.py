"""Ranks and quantiles by ranges, and trials judged by folds."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from featherloom.functions import literals
from featherloom.operators import balance, estimators, metrics, order, select, split
from featherloom.operators.frame import FeatureFrame
from featherloom.plans import evaluate, trials
from featherloom.plans.workflow import default_workflow


@pytest.mark.parametrize("cells", [40, 100_000])
def test_quantiles(spark, monkeypatch, cells):
    monkeypatch.setattr(order, "CELLS", cells)
    pick = random.Random(3)
    columns = {
        "plain": [pick.uniform(-5, 5) for _ in range(501)],
        "ties": [float(pick.randint(0, 3)) for _ in range(501)],
        "one": [7.0] * 501,
        "skewed": [10.0 ** pick.randint(-30, 30) for _ in range(500)] + [None],
        "ends": [math.inf, -math.inf, *[pick.gauss(0, 1) for _ in range(498)], None],
        "huge": [pick.choice([-1.7e308, 1.7e308, 0.0, 1.0]) for _ in range(501)],
        "none": [None] * 501,
    }
    rows = [tuple(columns[c][i] if i < len(columns[c]) else None for c in columns) for i in range(501)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    at = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = order.quantiles(df, {c: F.col(c) for c in columns}, at)
    for c, values in columns.items():
        real = sorted(v for v in values if v is not None)
        if not real:
            assert got[c] == [None] * len(at)
            continue
        for q, v in zip(at, got[c], strict=True):
            h = (len(real) - 1) * q
            a, b = real[math.floor(h)], real[math.ceil(h)]
            assert v == (a if a == b else a + (b - a) * (h - math.floor(h)))
    assert order.quantiles(df.limit(0), {"plain": F.col("plain")}, at) == {"plain": [None] * len(at)}


def test_group_quantile(spark):
    df = spark.createDataFrame([(g, float((i * 7) % 13)) for g in (1, 2, None) for i in range(10 + (g or 0))], "g int, x double")
    got = {r.g: r.q for r in order.group_quantile(df, ["g"], "x", 0.3, "q").collect()}
    for g in (1, 2, None):
        assert got[g] == pytest.approx(np.quantile([float((i * 7) % 13) for i in range(10 + (g or 0))], 0.3))


def test_running_and_ranks(spark):
    pick = random.Random(5)
    rows = [(pick.choice([None, "a", "b"]), pick.randint(0, 9), i, pick.choice([None, float(i % 5)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x int, i int, v double")
    made = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}
    for exclusive in (False, True):
        got = {r.i: r for r in order.running(df, ["g"], ["x", "i"], made, exclusive).collect()}
        for g, x, i, _ in rows:
            before = [r for r in rows if r[0] == g and ((r[1], r[2]) < (x, i) or r[2] == i and not exclusive)]
            values = [r[3] for r in before if r[3] is not None]
            assert (got[i].n, got[i].s or 0.0, got[i].low, got[i].high) == (len(before), sum(values), min(values, default=None), max(values, default=None))
    assert order.running(df.limit(0), ["g"], ["x"], made).count() == 0
    whole = order.running(df, [], [F.desc("x"), "i"], {"n": ("count", F.lit(1))}).collect()
    assert [r.i for r in sorted(whole, key=lambda r: r.n)] == [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    ranked = order.hash_rank(df, ["g"], split.dealt("i"), "i", "k").collect()
    for g in (None, "a", "b"):
        assert sorted(r.k for r in ranked if r.g == g) == list(range(1, 1 + sum(r[0] == g for r in rows)))


def _rows(spark, n=120):
    pick = np.random.default_rng(1)
    x = pick.normal(size=(n, 4))
    return spark.createDataFrame([(i, *map(float, x[i]), "uv"[i % 2], int(x[i, 0] + x[i, 1] > 0)) for i in range(n)], "id long, a double, b double, c double, d double, w string, y int")


def test_trials_and_their_ensemble(spark, tmp_path):
    df = _rows(spark)
    frame = FeatureFrame(df, {"a": "num", "b": "num", "c": "num", "w": "cat"})
    told, log = [], []
    for k, (name, parameters) in enumerate((("logistic_regression", {}), ("decision_tree", {"maxDepth": 3}), ("random_forest", {"seed": 1}))):
        out, record = evaluate.evaluate(frame, evaluate.Trial(default_workflow, name, parameters), "id", "y", k, budget=4.0, k=3)
        rows = out.collect()
        assert len(rows) == 120 and {r.fold for r in rows} == {0, 1, 2}
        mean = np.mean([np.mean([r.prediction == r.y for r in rows if r.fold == f]) for f in range(3)])
        assert record["loss"] == pytest.approx(1 - mean) and record["scores"]["accuracy"] == pytest.approx(mean) and mean > 0.75
        told.append(out)
        log.append(record)
    small, record = evaluate.evaluate(frame, evaluate.Trial(default_workflow, "random_forest"), "id", "y", 9, budget=0.1, k=3)
    assert {r.fold for r in small.select("fold").distinct().collect()} == {0} and record["budget"] == 0.1
    logged = spark.createDataFrame([(r["trial_id"], r["trial_id"], r["budget"], r["loss"]) for r in log], "trial_id long, seq long, budget double, loss double")
    both, model = evaluate.assemble(logged, told[0].unionByName(told[1]).unionByName(told[2]).select("trial", "fold", "rid", "y", "p"), 2)
    assert model is not None and both.count() == 120
    alone, model = evaluate.assemble(logged, told[0].unionByName(told[1]), 1)
    assert model is None and alone.count() == 120
    fitted = estimators.make("logistic_regression").fit(estimators.assembled(df, ["a", "b"], "y"))
    estimators.save_model(fitted, f"{tmp_path}/model")
    assert estimators.load_model(LogisticRegressionModel, f"{tmp_path}/model").coefficients == fitted.coefficients
    assert trials.next_id(logged.limit(0)).first()[0] == 1


def test_early_stopping():
    stop = evaluate.EarlyStopping(window=3, tolerance=0.01)
    assert [stop.tell(k, s) for k, s in enumerate((0.5, 0.7, 0.7, 0.6, 0.6))] == [True, True, True, True, False]
    assert stop.iteration() == 1


def test_noise_filter_dichotomy_and_boosted_regression(spark):
    df = _rows(spark, 300)
    found = select.NoiseFilter().fit(df, ["a", "b", "c", "d"], "y")
    assert {"a", "b"}.isdisjoint(found.old)
    kept = select.DichotomySelector(rounds=3).fit(df, ["a", "b", "c", "d"], "y").state["kept"]
    assert {"a", "b"} <= set(kept)
    asked = []
    assert select.best_count(lambda n: asked.append(n) or -abs(n - 7), 20) == 7 and len(asked) <= 14
    rows = estimators.assembled(df.withColumn("t", F.col("a") * 2 + F.col("b")), ["a", "b"], "t")
    done = estimators.adaboost_regression(rows, rounds=4)(rows)
    assert metrics.evaluate(done, "label", "prediction", metrics.REGRESSION).first().r2 > 0.7


def test_literals():
    for v in (3, 2.5, True, None, [1, "x"], {"a": 1}):
        assert literals.decode(literals.encode(v)) == v
    assert literals.decode("http://x") == "http://x" and literals.decode("3:float") == "3:float" and literals.decode("None") is None
    assert literals.by_prefix({"svc:c": 1, "svc:kernel:x": 2, "k": 3}) == {"svc": {"c": 1, "kernel:x": 2}, "": {"k": 3}}


def test_resampling_sizes(spark):
    df = spark.createDataFrame([(i, i % 7 == 0) for i in range(100)], "id long, y boolean")
    assert balance.random_under(df, "id", "y").groupBy("y").count().collect()[0]["count"] == 15
    over = balance.random_over(df, "id", "y")
    assert {r["count"] for r in over.groupBy("y").count().collect()} == {85}
