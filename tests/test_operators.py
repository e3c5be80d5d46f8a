"""Feature operators, metrics, search and workflow on small inline tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherloom.functions import hashing, scalar
from featherloom.operators import balance, compress, encode, expand, impute, metrics, scale, select, split, text
from featherloom.operators.frame import FeatureFrame, stack_roles, unique_names
from featherloom.operators.profile import infer_groups, profile
from featherloom.plans import search, space, workflow
from featherloom.sources import tables
from featherloom.streaming import monitor


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, ["a", "b", "c"][i % 3], float(i), float(i * i), i % 2, None if i % 4 == 0 else float(i)) for i in range(40)]
    return spark.createDataFrame(rows, "key long, cat string, x double, z double, y int, gap double").cache()


def test_names():
    assert unique_names(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    assert unique_names(["@", "@", "ok"], dirty=True) == ["col", "col_1", "ok"]
    assert unique_names(["FooBar x"], tidy=True) == ["foo_bar_x"]


def test_hashes(spark, small):
    assert hashing.value_hash({"a": [1, 2], "b": {"c": 3}}) == hashing.value_hash({"b": {"c": 3}, "a": [2, 1]}) != hashing.value_hash({"a": [1, 3], "b": {"c": 3}})
    assert hashing.table_hash(small) == hashing.table_hash(small.repartition(7)) != hashing.table_hash(small.limit(39))


def test_groups(spark):
    rows = [("one two", "a", "2020-01-01", "1", 1.0), ("three four", "b", None, "2", 2.0), ("x y", "c", "2021-02-03", "3", 3.0), ("z w", "d", "2020-05-05", "4.5", 4.0)]
    df = spark.createDataFrame(rows, "t string, c string, d string, n string, x double")
    assert infer_groups(df) == {"t": "text", "c": "highC_cat", "d": "date", "n": "num", "x": "num"}
    assert infer_groups(df, {"c": "id"})["c"] == "id" and profile(df).where("column_name = 'd'").first().n_null == 1


def test_frame_rules(spark, small):
    f = FeatureFrame.described(small, {"num": ["x", "z"], "cat": "cat", "id": "key", "nan": "missing"})
    assert f.columns("num") == ["x", "z"] and f.columns(["num"], inside=False) == ["key", "cat"]
    made = f.replace(["x"], {"w": F.col("x") * 2}, "new")
    assert made.df.columns[-1] == "w" and made.groups["w"] == "new" and "x" not in made.df.columns
    rest, popped = f.pop_auxiliary()
    assert popped == {"id": ["key"]} and "key" not in rest.groups
    assert stack_roles(train=small, test=small).count() == 80


def test_combine_rare_fixture(spark):
    rows = [(0 if i < 10 else i, "A" if i < 10 else str(i), ["D"] * 25 + ["C"] * 25 + ["B"] * 25 + ["A"] * 24 + ["Z"]) for i in range(100)]
    df = spark.createDataFrame([(a, b, c[i], i) for i, (a, b, c) in enumerate(rows)], "col1 int, col3 string, col4 string, col5 int")
    out = encode.CombineRare().fit(df, df.columns).apply(FeatureFrame(df, dict.fromkeys(df.columns, "cat"))).df
    assert "col5" not in out.columns
    assert {r[0] for r in out.select("col1").distinct().collect()} == {0, 999}
    assert {r[0] for r in out.select("col3").distinct().collect()} == {"A", "Others Infrequent"}
    assert {r[0] for r in out.select("col4").distinct().collect()} == {"D", "C", "B", "A", "Others Infrequent"}


def test_declared_order_and_unknown_levels(spark):
    train = spark.createDataFrame([("C", "3", 0), ("D", "4", 1), ("D", "4", 1)], "alpha string, digits string, y int")
    other = spark.createDataFrame([("E", None, 0)], train.schema)
    frame = lambda d: FeatureFrame(d, {"alpha": "cat", "digits": "cat"})
    fitted = encode.OrdinalEncoder({"alpha": ["D", "C"], "digits": ["4", "3"]}).fit(train, ["alpha", "digits"])
    assert [tuple(r) for r in fitted.apply(frame(train)).df.select("alpha", "digits").collect()] == [(1, 1), (0, 0), (0, 0)]
    for op in (encode.OneHotEncoder(), encode.BinaryEncoder(), encode.HashEncoder(), encode.TargetEncoder(), encode.LeaveOneOutEncoder(), encode.CatBoostEncoder(), encode.WoeEncoder(), encode.EmbeddingEncoder()):
        done = op.fit(train, ["alpha", "digits"], "y").apply(frame(other)).df.first()
        assert all(v is not None for k, v in done.asDict().items() if k != "y"), op
    codes = {"a": 0.1, "b": 0.9}
    assert train.select(encode.TargetEncoder.nearest_level(F.lit(0.7), codes)).first()[0] == "b"


def test_imputers(spark, small):
    done = impute.SimpleImputer().fit(small, ["gap", "cat"]).apply(FeatureFrame(small, {"gap": "num", "cat": "cat"})).df
    values = sorted(r.gap for r in small.where("gap is not null").collect())
    assert done.where("key = 0").first().gap == np.median(values)
    assert impute.SimpleImputer(missing_rate=0.2).fit(small, ["gap"]).old == ["gap"]
    near = impute.KnnImputer(k=2).fit(small.select("x", "z", "gap"), ["x", "z", "gap"]).apply(FeatureFrame(small, dict.fromkeys(["x", "z", "gap"], "num"))).df
    assert abs(near.where("key = 20").first().gap - 20) <= 1.5
    filled = impute.IterativeImputer(rounds=2, trees=3, depth=2).fit_transform(small, ["x", "z", "gap"])
    assert filled.where("gap is null").count() == 0 and filled.count() == 40


def test_scalers(spark, small):
    frame = FeatureFrame(small, {"x": "num"})
    x = np.arange(40.0)
    for op, want in ((scale.StandardScaler(), (x - x.mean()) / x.std()), (scale.MinMaxScaler(), x / 39), (scale.RobustScaler(), (x - np.median(x)) / (np.quantile(x, 0.75) - np.quantile(x, 0.25)))):
        got = [r.x for r in op.fit(small, ["x"]).apply(frame).df.orderBy("key").collect()]
        assert np.allclose(got, want), op
    q = [r.x for r in scale.QuantileScaler(11).fit(small, ["x"]).apply(frame).df.orderBy("key").collect()]
    assert np.allclose(q, x / 39, atol=1e-9)
    p = [r.x for r in scale.PowerScaler().fit(small, ["x"]).apply(frame).df.collect()]
    assert abs(np.mean(p)) < 1e-9 and abs(np.std(p) - 1) < 1e-9
    assert scale.StandardScaler().fit(small.withColumn("k", F.lit(3.0)), ["k"]).apply(FeatureFrame(small.withColumn("k", F.lit(3.0)), {"k": "num"})).df.first().k == 0


def test_compression_and_selection(spark, small):
    df = small.withColumns({"same": F.col("x") * 2, "flat": F.lit(1.0)})
    assert compress.VarianceFilter().fit(df, ["x", "flat"]).old == ["flat"]
    assert compress.PearsonFilter(0.99).fit(df, ["x", "y", "same"]).old == ["x"]
    wanted = df.withColumn("label", (F.col("x") > 20).cast("int"))
    for score in ("f_classif", "chi2", "mutual_info"):
        assert "x" not in select.UnivariateSelector(score=score, percent=50).fit(wanted, ["x", "y"], "label").old
    assert "x" not in select.ModelSelector(percent=50).fit(wanted, ["x", "y"], "label").old
    assert select.RecursiveSelector(percent=50).fit(wanted, ["x", "y"], "label").state["kept"] == ["x"]


def test_expansions(spark, small):
    frame = FeatureFrame(small, {"x": "num", "z": "num"})
    assert expand.Polynomial(2).fit(small, ["x", "z"]).apply(frame).df.where("key = 3").first()["x*z"] == 27
    done = expand.Pca(ratio=1.0).fit(small, ["x", "z"])
    x = np.array([(i, i * i) for i in range(40)], float)
    assert np.allclose(done.state["variance"], sorted(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1])
    assert expand.width_of(500, 1024, 0) == 1 and expand.width_of(500, 1024, 0.25) == 256 and expand.width_of(500, 1024, 1) == 500
    for op in (expand.KitchenSinks(4), expand.Nystroem(5), expand.RandomTrees(2, 2), expand.Agglomerate(), expand.FastIca(1.0), expand.SymbolicFeatures(1)):
        fitted = op.fit(small, ["x", "z"])
        assert fitted.apply(frame).df.count() == 40, op
    assert expand.dimensionless({"v": {"m": 1, "s": -1}, "d": {"m": 1}, "t": {"s": 1}}) in ([{"v": 1, "d": -1, "t": 1}], [{"v": -1, "d": 1, "t": -1}])


def test_text(spark):
    df = spark.createDataFrame([(1, "A b, b! 7"), (2, None), (3, "b c")], "key long, t string")
    listed = text.tokenise(df, "t")
    assert {r.key: r.t for r in listed.collect()} == {1: ["A", "b", "b"], 2: [], 3: ["b", "c"]}
    assert {r.key: r.t for r in text.keep_frequent(listed, "key", "t").collect()} == {1: ["b", "b"], 2: [], 3: ["b"]}
    assert {r.token: r.df for r in text.document_frequency(listed, "t").collect()} == {"A": 1, "b": 2, "c": 1}
    assert set(text.random_projection(listed, "t", 3).columns) == {"key", "t", "t_0", "t_1", "t_2"}
    assert text.lda_topics(listed, "t", topics=2, rounds=2).count() == 3


def test_resampling(spark, small):
    rows = small.withColumn("c", (F.col("key") < 10).cast("int")).select("key", "x", "z", "c")
    assert balance.class_sizes(balance.random_under(rows, "key", "c"), "c") == {0: 10, 1: 10}
    assert balance.class_sizes(balance.random_over(rows, "key", "c"), "c") == {0: 30, 1: 30}
    grown = balance.smote(rows, "key", ["x", "z"], "c", k=3)
    assert balance.class_sizes(grown, "c") == {0: 30, 1: 30} and grown.where("key is null and x > 9").count() == 0
    assert balance.class_sizes(balance.near_miss(rows, "key", ["x", "z"], "c"), "c") == {0: 10, 1: 10}
    for f in (balance.without_tomek, balance.edited, balance.all_knn, balance.neighbourhood_cleaning, balance.condensed, balance.one_sided, balance.instance_hardness):
        out = balance.class_sizes(f(rows, "key", ["x", "z"], "c"), "c")
        assert out[1] == 10 and 0 < out[0] <= 30, f
    kept = balance.isolation_keep(rows, ["x", "z"], trees=10, rows=20).count()
    assert 20 <= kept <= 28


def test_splits(spark, small):
    folds = split.stratified_folds(small, "key", "y", 4)
    assert {r.n for r in split.fold_classes(folds, "y").collect()} == {5}
    assert split.stratified_sample(small, "key", "y", 0.01).count() == 2
    assert {r["class"]: r.weight for r in split.class_weights(small.where("key < 30 or y = 0"), "y").collect()} == {0: 0.875, 1: pytest.approx(1.166667)}
    assert split.holdout(small, "key").where("_fold = 0").count() < 25


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1)], "y int, h int, p double")
    got = metrics.evaluate(df, "y", "h", {k: metrics.CLASSIFICATION[k] for k in ("accuracy", "f1", "mcc")}).first()
    assert (got.accuracy, got.f1) == (0.6, 0.5) and got.mcc == pytest.approx(1 / 6, abs=1e-6)
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx(4.5 / 6, abs=1e-6)
    assert metrics.CLASSIFICATION["log_loss"].loss(0.3) == 0.3 and metrics.CLASSIFICATION["accuracy"].loss(0.75) == 0.25
    own = metrics.make_scorer("bias", lambda y, p: F.avg(p - y), optimum=0)
    assert metrics.evaluate(df, "y", "h", {"bias": own}).first()[0] == 0
    assert metrics.roc_auc(df.limit(0), "y", "p").first()[0] is None
    pairs = [(1, 1), (2, 3), (3, 2), (4, 4), (4, 5)]
    agree = sum((a[0] - b[0]) * (a[1] - b[1]) > 0 for i, a in enumerate(pairs) for b in pairs[:i])
    differ = sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for i, a in enumerate(pairs) for b in pairs[:i])
    tau = (agree - differ) / math.sqrt(9 * 10)
    assert metrics.kendall(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()[0] == pytest.approx(tau, abs=1e-6)


def test_softmax_and_argmax(spark):
    row = spark.range(1).select(scalar.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s"), scalar.argmax(F.array(F.lit(1.0), F.lit(3.0))).alias("a"), scalar.sigmoid(F.lit(30.0)).alias("g")).first()
    assert row.s == [0.5, 0.5] and row.a == 1 and row.g == 1.0


def test_space_and_search():
    s = space.Space({"model": space.Choice(("gbdt", "dart", "goss"), {"gbdt": 0.6}), "lr": space.Uniform(1e-3, 1, log=True), "depth": space.Uniform(2, 8, whole=True)}, {"depth": ("model", ("gbdt",))}, [{"model": "goss"}])
    assert s.parameters["model"].probabilities() == pytest.approx([0.6, 0.2, 0.2])
    assert all(("depth" in c) == (c["model"] == "gbdt") and c["model"] != "goss" for c in s.grid(3)) and len(s.grid(3)) == 3 * 3 + 3
    assert space.nested({"a.b": 1, "a.c": 2}) == {"a": {"b": 1, "c": 2}} and space.merged({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}
    for kind in (search.RandomSampler, search.DensitySampler, search.SurrogateSampler):
        runs = search.hyperband(kind(s, seed=3), lambda c, b: (math.log(c["lr"]) + 3) ** 2 + 1 / b, 1, 9, brackets=3)
        assert min(r.loss for r in runs) < 2 and {r.budget for r in runs} == {1, 3, 9}
    failed = search.hyperband(search.RandomSampler(s), lambda c, b: 1 / 0, 1, 1)
    assert failed[0].loss == 65535.0
    assert search.promote([3, 1, 1, 2], 2) == [1, 2]


def test_workflow(spark, small):
    frame = workflow.prepare(small.drop("z"), {"key": "id"}, y="y")
    flow = workflow.default_workflow(frame.groups)
    out = flow.fit_transform(frame, "y")
    assert set(out.groups.values()) == {"final"} and out.df.where("x is null or gap is null").count() == 0
    again = flow.transform(workflow.FeatureFrame(small.drop("z"), frame.groups))
    assert sorted(again.df.columns) == sorted(out.df.columns)
    with pytest.raises(TypeError):
        workflow.Workflow([workflow.Step("num", "scale.robust", None, {"lo": 1})]).fit_transform(frame)


def test_store_and_stream(spark, small, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/store")
    name = store.put(small)
    assert store.put(small) == name and store.get(name, ["key"]).count() == 40
    made = []
    for _ in range(2):
        store.cached({"a": [1]}, lambda: made.append(1) or small)
    assert made == [1]
    path = f"file://{tmp_path}/log"
    tables.log_trials(spark, [{"trial_id": i, "budget": float(i % 2), "loss": float(10 - i), "config": str(i), "finished": 100.0 * i} for i in range(6)], path)
    meta = tables.log_metadata(tables.read_trials(spark, path)).first()
    assert (meta.n_runs, meta.budgets) == (6, [0.0, 1.0])
    q = monitor.incumbents(monitor.watch_trials(spark, path)).writeStream.outputMode("complete").format("memory").queryName("best").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.budget, r.config) for r in spark.sql("select * from best").collect()} == {(0.0, "4"), (1.0, "5")}


def test_estimators(spark, small):
    from featherloom.operators import ensemble, estimators

    rows = estimators.assembled(small.withColumn("label_", (F.col("x") > 20).cast("int")), ["x", "z"], "label_")
    for name in ("decision_tree", "random_forest", "logistic_regression", "linear_svc", "gaussian_nb"):
        done = estimators.make(name).fit(rows).transform(rows)
        assert done.where("prediction = label").count() >= 34, name
        assert estimators.probability(done).where("p between 0 and 1").count() == 40
    assert estimators.adaboost(rows, 3)(rows).where("prediction = label").count() == 40
    assert estimators.boosted_leaves(rows, 2, 2)(rows).where("prediction = label").count() >= 38
    for quadratic in (False, True):
        done = estimators.Discriminant(quadratic).fit(rows, ["x"], "label_").transform(rows)
        assert done.where("prediction = label_").count() >= 36
    exact = small.withColumn("t", 3 * F.col("x") - 2 * F.col("y") + 1)
    for kind in ("ridge", "bayes", "ard"):
        done = estimators.RidgeFamily(kind, 1e-6).fit(exact, ["x", "y"], "t").transform(exact)
        assert done.agg(F.max(F.abs(F.col("prediction") - F.col("t")))).first()[0] < 0.1, kind
    votes = spark.createDataFrame([(m, i, float(i % 2) * 0.8 + 0.1, i % 2) for m in ("a", "b") for i in range(10)] + [("c", 0, 0.5, 0)], "model string, rid int, p double, y int")
    assert {r.model for r in ensemble.aligned(votes).select("model").distinct().collect()} == {"a", "b"}
    model, stacked = ensemble.stack(ensemble.aligned(votes), ["a", "b"])
    assert model.transform(stacked).count() == 10 and ensemble.soft_vote(votes).count() == 10


def test_neighbours_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i * 7919 % 211), float(i * 104729 % 97), i % 3) for i in range(150)], "k long, x double, z double, y int")
    made = lambda: [
        sorted(map(tuple, balance.neighbours(rows, "k", ["x", "z"], "y", 4).collect())),
        sorted(map(tuple, balance.tomek_links(rows, "k", ["x", "z"], "y").collect())),
        sorted(map(tuple, balance.near_miss(rows.where("y < 2 or k < 60"), "k", ["x", "z"], "y").collect())),
    ]
    whole = made()
    points = {r.k: (r.x, r.z) for r in rows.collect()}
    monkeypatch.setattr(balance, "REFERENCE_ROWS", 40)
    assert made() == whole and len(whole[0]) == 600
    for k in range(0, 150, 10):
        far = sorted((points[k][0] - x) ** 2 + (points[k][1] - z) ** 2 for j, (x, z) in points.items() if j != k)[:4]
        assert [r[5] for r in sorted(whole[0], key=lambda r: r[4]) if r[0] == k] == far


def test_kendall_is_exact_with_many_values(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=900)
    y = x + rng.normal(size=900)
    x, y = np.append(x, 1e9), np.append(y, -1e9)
    x[:60] = np.round(x[:60])
    y[30:90] = np.round(y[30:90])
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (dx * dy).sum() / math.sqrt((dx**2).sum() * (dy**2).sum())
    rows = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y, strict=True)], "a double, b double")
    assert metrics.kendall(rows, "a", "b").first()[0] == pytest.approx(want, abs=1e-6)
    monkeypatch.setattr(metrics, "RANGE_PAIRS", 100)
    assert metrics.kendall(rows, "a", "b").first()[0] == pytest.approx(want, abs=1e-6)


def test_symbolic_tries_all_pairs(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(expand.SymbolicFeatures, "_good", lambda self, df, new, known, names: tried.append(list(new)) or {})
    names = [f"c{i}" for i in range(25)]
    rows = spark.createDataFrame([tuple(float(i * j) for i in range(25)) for j in (-1, 1)], ",".join(f"{c} double" for c in names))
    expand.SymbolicFeatures(steps=2).fit(rows, names)
    assert len(tried[1]) == 300 and "(c23)*(c24)" in tried[1]
