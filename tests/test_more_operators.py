"""Neighbours without bounds, categories among nulls, topics and reducers in workflows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherloom.operators import balance, ensemble, estimators, expand, impute, metrics, text
from featherloom.operators.frame import FeatureFrame
from featherloom.plans import search, space
from featherloom.plans.workflow import Step, Workflow, relative
from featherloom.sources import tables


def _classes(spark, n=90):
    pick = np.random.default_rng(2)
    x = pick.normal(size=(n, 2))
    return spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), "abc"[int(x[i, 0] > 0)], int(i % 3 == 0)) for i in range(n)], "key long, x double, z double, w string, c int")


@pytest.mark.parametrize("block", [20_000, 25])
def test_smote_looks_among_all_rows(spark, monkeypatch, block):
    monkeypatch.setattr(balance, "REFERENCE_ROWS", block)
    df = _classes(spark)
    rows = {r.key: r for r in df.collect()}
    few = [k for k, r in rows.items() if r.c == 1]
    grown = balance.smote(df, "key", ["x", "z"], "c", k=3, cats=["w"]).where("key is null").collect()
    assert len(grown) == 30 and {r.c for r in grown} == {1}
    near = {k: sorted(few, key=lambda o: (rows[o].x - rows[k].x) ** 2 + (rows[o].z - rows[k].z) ** 2)[1:4] for k in few}

    def between(r, a, b):
        d = np.array([b.x - a.x, b.z - a.z])
        t = np.dot([r.x - a.x, r.z - a.z], d) / np.dot(d, d)
        return -1e-9 <= t <= 1 + 1e-9 and np.allclose([a.x, a.z] + t * d, [r.x, r.z])

    for r in grown:
        found = [k for k in few for o in near[k] if between(r, rows[k], rows[o])]
        assert found
        words = [[rows[o].w for o in near[k]] for k in found]
        assert any(r.w == min(set(w), key=lambda v: (-w.count(v), v)) for w in words)


def test_adaptive_copies_follow_the_share(spark):
    rows = [(i, float(i), 0.0, 0) for i in range(40)] + [(100 + i, 10.0 + i / 100, 0.0, 1) for i in range(5)] + [(200 + i, 500.0 + i, 0.0, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "key long, x double, z double, c int")
    grown = balance.smote(df, "key", ["x", "z"], "c", k=5, only="adaptive").where("key is null").collect()
    # the far group has no foreign neighbours but one, the near group many
    assert len(grown) == 30 and sum(r.x < 100 for r in grown) > sum(r.x > 100 for r in grown)


@pytest.mark.parametrize("block", [20_000, 30])
def test_knn_impute_by_brute_force(spark, block):
    pick = np.random.default_rng(4)
    x = pick.normal(size=(80, 4))
    x[pick.random(x.shape) < 0.2] = np.nan
    x[7] = np.nan
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "key long, a double, b double, c double, d double")
    got = {r.key: r for r in impute.knn_impute(df, "key", names, k=3, block=block).collect()}
    means = np.nanmean(x, axis=0)
    for i, r in enumerate(x):
        for j in np.flatnonzero(np.isnan(r)):
            near = []
            for o, s in enumerate(x):
                both = ~np.isnan(r) & ~np.isnan(s)
                if o != i and not np.isnan(s[j]) and both.any():
                    near.append((((r - s)[both] ** 2).sum() * 4 / both.sum(), s[j]))
            want = means[j] if np.isnan(r).mean() > 0.5 or not near else np.mean([v for _, v in sorted(near)[:3]])
            assert got[i][names[j]] == pytest.approx(want)
        assert all(got[i][n] == pytest.approx(v) for n, v in zip(names, r, strict=True) if not np.isnan(v))
    some = impute.KnnImputer(k=3).fit(df, names).apply(FeatureFrame(df, dict.fromkeys(names, "num"))).df
    assert some.where(" or ".join(f"{n} is null" for n in names)).count() == 0


def test_iterative_imputer_fills_categories(spark):
    rows = [(float(i % 2), float(i), "odd" if i % 2 else "even") for i in range(60)] + [(1.0, 3.0, None), (0.0, 4.0, None), (None, 5.0, "odd")]
    df = spark.createDataFrame(rows, "p double, x double, w string")
    done = impute.IterativeImputer(rounds=2, trees=5, depth=3, method="forest").fit_transform(df, ["p", "x", "w"]).collect()
    assert {r.w for r in done} == {"odd", "even"} and all(r.w == ("odd" if r.p > 0.5 else "even") for r in done)
    coder = impute.CategoryCoder().fit(df, ["w"])
    assert {(r.w, r.k) for r in coder.decode(coder.encode(df).withColumn("k", F.col("w"))).collect()} == {("even", 0.0), ("odd", 1.0), (None, None)}


TEXTS = ["red apple green apple", "green leaf red leaf", "blue sea deep sea", "deep blue water", "red green fruit", "sea water wave", None, ""]


@pytest.mark.parametrize("kind", ["lsi", "tsvd", "lda", "hdp", "nmf", "random_projection"])
def test_topics_in_a_workflow(spark, kind):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string")
    flow = Workflow([Step("text", f"text.{kind}", "num", {"topics": 2})])
    done = flow.fit_transform(FeatureFrame(df, {"t": "text"}))
    assert done.columns("num") == ["t_0", "t_1"] and set(done.df.columns) == {"id", "t_0", "t_1"}
    again = flow.transform(FeatureFrame(df.limit(3), {"t": "text"}))
    assert again.df.columns == done.df.columns and again.df.count() == 3 and done.df.where("t_0 is null").count() == 0


def test_nmf_takes_any_key(spark):
    df = text.tokenise(spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(TEXTS)], "id string, t string"), "t")
    done = text.nmf_topics(df, "id", "t", topics=2, rounds=3).collect()
    assert len(done) == len(TEXTS) and all(r.t_0 >= 0 and r.t_1 >= 0 for r in done)


def test_kernel_pca_and_adaptive_reducer(spark):
    df = _classes(spark)
    frame = FeatureFrame(df, {"x": "num", "z": "num"})
    done = Workflow([Step("num", "reduce.kernel_pca", "num", {"components": 3, "width": 10})]).fit_transform(frame)
    assert done.columns("num") == ["kpca_0", "kpca_1", "kpca_2"]
    values = np.array([[r.kpca_0, r.kpca_1, r.kpca_2] for r in done.df.collect()])
    assert np.allclose(values.mean(0), 0, atol=1e-6) and abs(np.corrcoef(values.T)[0, 1]) < 1e-3
    for kind in ("pca", "svd", "ica"):
        found = expand.AdaptiveReducer(kind=kind, rounds=1).fit(df, ["x", "z"], "c")
        assert 1 <= found.state["components"] <= 2 and len(found.made) == found.state["components"]


SPACE = space.Space({"kind": space.Choice(("a", "b")), "x": space.Uniform(0.0, 1.0), "y": space.Uniform(0.01, 1.0, log=True)}, {"y": ("kind", ("b",))})


@pytest.mark.parametrize("kind", [search.BudgetDensitySampler, search.SurrogateSampler, lambda s, **k: search.SurrogateSampler(s, log=True, **k), search.BudgetSurrogateSampler])
def test_samplers_find_low_losses(kind):
    loss = lambda c, b: (c["x"] - 0.7) ** 2 + (0.3 if c["kind"] == "a" else 0.0) + 0.01 / b
    late = []
    for seed in range(3):
        sampler = kind(SPACE, seed=seed, least=4)
        runs = search.hyperband(sampler, loss, 1, 9, brackets=12)
        late.append(np.median([r.loss for r in runs if r.bracket >= 6 and r.stage == 0]))
        assert min(r.loss for r in runs) < 0.02
        found = search.importance(SPACE, runs)
        assert set(found) == {"kind", "x", "y"} and all(0 <= v <= 1 + 1e-9 for v in found.values())
    drawn = [loss(SPACE.sample(np.random.default_rng(i)), 1) for i in range(300)]
    assert np.median(late) < 0.6 * np.median(drawn), (late, np.median(drawn))


def test_runs_as_a_table(spark):
    runs = [search.Run({"x": 0.5, "kind": "a"}, 1.0, 0.2, 0, 0), search.Run({"x": 0.1, "kind": "b", "error": "?"}, 1.0, 9.0, 0, 0)]
    rows = search.as_table(spark, runs).orderBy("run").collect()
    assert json.loads(rows[0].config) == {"x": 0.5, "kind": "a"} and rows[1].loss == 9.0
    assert search.misordered([1, 2, 3], [1, 2, 3]) == 0 and search.misordered([1, 2], [2, 1]) == 2


def test_relative_parameters(spark):
    assert [relative("sp1_ratio", 0.5, 3, 10, {}), relative("sp1_percent", 25, 99, 10, {}), relative("sp1_dev", 3, 99, 10, {}), relative("lr_ratio", 20, 0, 0, {"learning_rate": 0.1}), relative("card_ratio", 0.5, 0, 0, {}, 9)] == [3, 2, 4, 200, 5]
    frame = FeatureFrame(_classes(spark), {"x": "num", "z": "num"})
    done = Workflow([Step("num", "reduce.kernel_pca", "num", {"_components__sp1_percent": 100, "width": 10})]).fit_transform(frame)
    assert done.columns("num") == ["kpca_0", "kpca_1"]


def test_regressors_and_stacks(spark):
    pick = np.random.default_rng(3)
    x = pick.normal(size=(200, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(1000 + 50 * np.tanh(a) - 20 * b), int(a > 0) + int(b > 0)) for i, (a, b) in enumerate(x)], "rid long, a double, b double, t double, y int")
    rows = estimators.assembled(df, ["a", "b"], "t")
    for name in ("linear_svr", "sgd"):
        done = estimators.fit_standardised(estimators.make(name, classify=False), rows)(rows)
        assert metrics.evaluate(done, "label", "prediction", metrics.REGRESSION).first().r2 > 0.85
    done = estimators.neural_regression(df, ["a", "b"], "t", hidden=8, rounds=40, rate=0.1)(df)
    assert metrics.evaluate(done, "t", "prediction", metrics.REGRESSION).first().r2 > 0.95
    told = df.select("rid", "y", F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("model"))
    told = told.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.when(c == F.col("y"), 0.6).otherwise(0.2)))
    model, stacked = ensemble.stack_classes(told, ["m1", "m2"], 3)
    assert model.transform(stacked).where("prediction = y").count() > 150 and len(stacked.first().features) == 4


def test_relational_tables(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.createDataFrame([(i, float("nan") if i % 3 == 0 else i / 2, f"w{i}") for i in range(40)], "id int, x double, w string")
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no relational database among Spark's jars")
    tables.write_jdbc(rows, url, "t", driver)
    back = tables.read_jdbc(spark, url, "t", "id", 0, 40, 3)
    found = {r[0]: r[1] for r in back.collect()}
    assert back.rdd.getNumPartitions() == 3 and len(found) == 40 and found[3] is None and found[4] == 2.0
