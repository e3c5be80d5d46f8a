"""More queries beside their SQL: sources, frames, scalars, classes, trials and closed-form models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import literals, scalar
from ..functions.hashing import table_hash
from ..operators import balance, compress, encode, estimators, expand, impute, metrics, profile, scale, select, split
from ..operators.frame import FeatureFrame, rectify, unique_names
from ..session import shared_folder, table
from ..sources import tables
from . import evaluate, search, space, trials
from .catalogue import CLASSED, HOLES, JUDGED, LOG, PAIRED, TOKENS, _classed, _holes, _judged, _log, _rounded, query


def _work(spark) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"


# ---- sources --------------------------------------------------------------------


@query("s01_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01_csv(spark, d):
    path = f"{_work(spark)}.csv"
    table(spark, d, "nation").write.option("header", True).csv(path)
    return tables.read(spark, path)


@query("s03_label_scan", "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL")
def s03_label_scan(spark, d):
    return tables.read(spark, f"{d}/labels.parquet", ["doc_id", "quality"]).where("quality is not null")


@query("s05_stored_by_content", "SELECT c_custkey, c_mktsegment FROM customer")
def s05_stored_by_content(spark, d):
    store = tables.Store(spark, _work(spark))
    name = store.put(table(spark, d, "customer"))
    # the same rows in another order have the same name, and are not written again
    assert store.put(table(spark, d, "customer").repartition(3)) == name
    return store.get(name, ["c_custkey", "c_mktsegment"])


@query("s16_cached_table", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def s16_cached_table(spark, d):
    store, made = tables.Store(spark, _work(spark)), []

    def make() -> DataFrame:
        made.append(1)
        return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))

    store.cached({"what": ["by", "nation"]}, make)
    return store.cached({"what": ["nation", "by"]}, make)


@query("s19_trial_log", "SELECT (k + 1)::BIGINT AS trial_id, 'svm-' || k AS config, round(1.0 / (k + 1), 6)::DOUBLE AS loss, 1 - round(1.0 / (k + 1), 6)::DOUBLE AS accuracy FROM (SELECT unnest(range(12)) AS k) WHERE k % 3 <> 0 AND k >= 4")
def s19_trial_log(spark, d):
    path, rows = _work(spark), []
    for k in range(12):
        loss = round(1.0 / (k + 1), 6)
        rows.append({"trial_id": k + 1, "config": f"svm-{k}", "loss": loss, "status": "failed" if k % 3 == 0 else "success", "started": float(k), "scores": {"accuracy": 1 - loss}})
    tables.log_trials(spark, rows[:6], path)
    tables.log_trials(spark, rows[6:], path)
    found = trials.scan(tables.read_trials(spark, path), {"status": "success"}, since=4.0, order="trial_id")
    return found.select("trial_id", "config", "loss", F.col("scores")["accuracy"].alias("accuracy"))


@query("s27_table_hash", "SELECT true AS same, false AS other")
def s27_table_hash(spark, d):
    n = table(spark, d, "nation")
    same = table_hash(n) == table_hash(n.orderBy(F.desc("n_name")).repartition(4))
    return spark.createDataFrame([(same, table_hash(n) == table_hash(n.where("n_nationkey > 0")))], "same boolean, other boolean")


# ---- frames ----------------------------------------------------------------------

DESCRIBED = {"id": "p_partkey", "cat": ["p_brand", "p_type"], "num": ["p_size", "p_retailprice"], "text": "p_name", "date": "no_such_column"}


def _parts(spark, d) -> FeatureFrame:
    return FeatureFrame.described(table(spark, d, "part"), DESCRIBED)


@query("f01_select_group", "SELECT p_size, p_retailprice FROM part")
def f01_select_group(spark, d):
    return _parts(spark, d).select("num").df


@query("f02_other_groups", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def f02_other_groups(spark, d):
    return _parts(spark, d).select("cat", inside=False).df


@query("f03_replaced_values", "SELECT p_partkey, p_name, p_brand, p_type, 2 * p_size AS double_size, p_retailprice + 1 AS p_retailprice FROM part")
def f03_replaced_values(spark, d):
    made = {"double_size": 2 * F.col("p_size"), "p_retailprice": F.col("p_retailprice") + 1}
    return _parts(spark, d).replace(["p_size"], made, "final").df


@query("f05_retagged", "SELECT * FROM (VALUES ('p_partkey', 'id'), ('p_name', 'text'), ('p_brand', 'highC_cat'), ('p_type', 'encode'), ('p_size', 'ready'), ('p_retailprice', 'ready')) t(column_name, feature_group)")
def f05_retagged(spark, d):
    frame = _parts(spark, d).retag({"num": "ready", "cat": "encode", "p_brand": "highC_cat"})
    return spark.createDataFrame([(c, frame.groups[c]) for c in frame.columns()], "column_name string, feature_group string")


@query("f06_dropped_group", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def f06_dropped_group(spark, d):
    return _parts(spark, d).drop("cat").df


@query("f08_columns_by_position", "SELECT p_brand, p_partkey FROM part")
def f08_columns_by_position(spark, d):
    return _parts(spark, d).at([2, 0]).df


@query("f10_auxiliary_groups", "SELECT * FROM (VALUES ('id', 'p_partkey')) t(feature_group, column_name)")
def f10_auxiliary_groups(spark, d):
    _, gone = _parts(spark, d).pop_auxiliary()
    return spark.createDataFrame([(g, c) for g, cs in gone.items() for c in cs], "feature_group string, column_name string")


@query("f11_like_training", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def f11_like_training(spark, d):
    n = table(spark, d, "nation")
    return FeatureFrame(n.select("n_regionkey", "n_name", "n_nationkey")).like(FeatureFrame(n)).df


@query("f12_unique_names", "SELECT * FROM (VALUES (0, 'size'), (1, 'size_1'), (2, 'size_3'), (3, 'col'), (4, 'size_2'), (5, 'col_1')) t(place, name)")
def f12_unique_names(spark, d):
    return spark.createDataFrame(list(enumerate(unique_names(["size", "size_1", "size", "#!", "size_2", "??"], dirty=True))), "place int, name string")


@query("f13_rectified", "SELECT c_custkey, c_acctbal, c_name FROM customer")
def f13_rectified(spark, d):
    words = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_name")
    return rectify(words, ["c_acctbal", "c_name"])


@query(
    "f14_repaired_numbers",
    "WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN c_custkey % 7 = 1 THEN 'Infinity'::DOUBLE WHEN c_custkey % 7 = 2 THEN '-Infinity'::DOUBLE ELSE c_acctbal END AS x FROM customer), "
    "s AS (SELECT min(x) AS lo, max(x) AS hi FROM x WHERE NOT isnan(x) AND NOT isinf(x)) "
    "SELECT c_custkey, CASE WHEN isnan(x) THEN (lo + hi) / 2 WHEN x = 'Infinity'::DOUBLE THEN hi WHEN x = '-Infinity'::DOUBLE THEN lo ELSE x END AS x, isnan(x) AS was_nan FROM x, s",
)
def f14_repaired_numbers(spark, d):
    k, inf = F.col("c_custkey") % 7, float("inf")
    x = table(spark, d, "customer").select("c_custkey", F.when(k == 0, float("nan")).when(k == 1, inf).when(k == 2, -inf).otherwise(F.col("c_acctbal")).alias("x"))
    low, high = x.agg(F.min(scalar.finite(F.col("x"))), F.max(scalar.finite(F.col("x")))).first()
    return x.select("c_custkey", scalar.clip_infinite(F.col("x"), F.lit(low), F.lit(high)).alias("x"), scalar.nan_to_null(F.col("x")).isNull().alias("was_nan"))


@query("j01_beside", 'SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal, s_nationkey * 2 AS s_nationkey_1 FROM supplier')
def j01_beside(spark, d):
    s = table(spark, d, "supplier")
    left = FeatureFrame(s.select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal")), {"s_nationkey": "cat", "s_acctbal": "num"})
    right = FeatureFrame(s.select("s_suppkey", (F.col("s_nationkey") * 2).alias("s_nationkey")), {"s_nationkey": "cat"})
    return left.concat(right, "s_suppkey").df


@query("u03_without_ids", "SELECT l.doc_id FROM documents l WHERE NOT EXISTS (SELECT 1 FROM labels r WHERE r.doc_id = l.doc_id)")
def u03_without_ids(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


# ---- scalars ---------------------------------------------------------------------


@query("a01_null_tests", f"WITH {HOLES} SELECT bool_or(p_size IS NULL) AS size_null, bool_or(p_partkey IS NULL) AS key_null, 1 - count(p_brand) / count(*)::DOUBLE > 0.4 AS brand_above, 1 - count(p_size) / count(*)::DOUBLE > 0.4 AS size_above FROM holes")
def a01_null_tests(spark, d):
    return _holes(spark, d).agg(
        profile.has_null(F.col("p_size")).alias("size_null"), profile.has_null(F.col("p_partkey")).alias("key_null"),
        profile.null_ratio_above(F.col("p_brand"), 0.4).alias("brand_above"), profile.null_ratio_above(F.col("p_size"), 0.4).alias("size_above"),
    )


@query("f07_date_columns", "SELECT true AS dates, false AS names, true AS slashed")
def f07_date_columns(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), "o_orderpriority", F.date_format("o_orderdate", "dd.MM.yyyy").alias("b"))
    return o.agg(profile.all_dates(F.col("a")).alias("dates"), profile.all_dates(F.col("o_orderpriority")).alias("names"), profile.all_dates(F.col("b")).alias("slashed"))


@query("f04_joined_tokens", f"WITH {TOKENS.replace('unnest(', '(', 1)} SELECT doc_id, array_to_string(token, ' ') AS words FROM k")
def f04_joined_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", scalar.join_tokens(scalar.tokens(scalar.clean_text(F.col("text")))).alias("words"))


UNARY_SQL = {"exp": "exp(x)", "exp-": "exp(-x)", "log": "ln(x)", "abs": "abs(x)", "sqrt": "sqrt(x)", "sin": "sin(x)", "cos": "cos(x)", "2^": "pow(2, x)", "^2": "x * x", "^3": "x * x * x", "1+": "1 + x", "1-": "1 - x", "1/": "1 / x"}


@query("f08_unary", "SELECT k, " + ", ".join(f'round({s}, 6) + 0.0 AS "{u}"' for u, s in UNARY_SQL.items()) + " FROM (SELECT p_partkey AS k, p_size / 10.0::DOUBLE AS x FROM part)")
def f08_unary(spark, d):
    x = F.col("p_size") / F.lit(10.0)
    return _rounded(table(spark, d, "part").select(F.col("p_partkey").alias("k"), *(f(x).cast("double").alias(u) for u, (f, _) in scalar.UNARY.items())), ["k"])


@query("f10_binary", 'SELECT k, x + y AS "x+y", round(x * y, 6) AS "x*y", x - y AS "x-y", y - x AS "y-x" FROM (SELECT p_partkey AS k, p_size::DOUBLE AS x, p_retailprice AS y FROM part)')
def f10_binary(spark, d):
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return _rounded(table(spark, d, "part").select(F.col("p_partkey").alias("k"), *(f(x, y).alias(n) for n, f in scalar.BINARY.items())), ["k"]).withColumns({n: F.col(f"`{n}`") for n in ("x+y", "x-y", "y-x")})


@query("f11_softmax", "WITH x AS (SELECT p_partkey, exp(p_size / 10.0 - greatest(p_size / 10.0, 2, 3)) AS a, exp(2 - greatest(p_size / 10.0, 2, 3)) AS b, exp(3 - greatest(p_size / 10.0, 2, 3)) AS c FROM part) SELECT p_partkey, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS best, (a / (a + b + c) > 0.5)::INTEGER AS likely FROM x")
def f11_softmax(spark, d):
    p = scalar.softmax(F.array(F.col("p_size") / F.lit(10.0), F.lit(2.0), F.lit(3.0)))
    rows = table(spark, d, "part").select("p_partkey", p.alias("p"))
    return rows.select("p_partkey", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"), scalar.argmax(F.col("p")).alias("best"), scalar.binarise(F.col("p")[0]).alias("likely"))


@query("f14_typed_literals", "SELECT * FROM (VALUES (0, '3:int', 'int'), (1, 'word', 'str'), (2, '2.5:float', 'float'), (3, 'True:bool', 'bool'), (4, '[1, 2]:list', 'list'), (5, 'a:b', 'str'), (6, '__import__(\"os\"):int', 'str')) t(place, literal, kind)")
def f14_typed_literals(spark, d):
    written = [literals.encode(v) for v in (3, "word", 2.5, True, [1, 2], "a:b", '__import__("os"):int')]
    return spark.createDataFrame([(i, w, type(literals.decode(w)).__name__) for i, w in enumerate(written)], "place int, literal string, kind string")


@query("f16_json_predicate", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events WHERE props ->> '$.k' = '9'")
def f16_json_predicate(spark, d):
    e = table(spark, d, "events").where(trials.field_equals("props", "$.k", "9"))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---- coding, filters, selection ---------------------------------------------------


@query("i06_category_codes", f"WITH {HOLES}, l AS (SELECT p_type AS v, row_number() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM holes WHERE p_type IS NOT NULL)) SELECT p_partkey, k::DOUBLE AS code, p_type FROM holes LEFT JOIN l ON p_type = v")
def i06_category_codes(spark, d):
    rows = _holes(spark, d).select("p_partkey", "p_type")
    coder = impute.CategoryCoder().fit(rows, ["p_type"])
    coded = coder.encode(rows)
    return coder.decode(coded.withColumn("code", F.col("p_type"))).select("p_partkey", "code", "p_type")


@query("i01_impute_mean", f"WITH {HOLES}, m AS (SELECT avg(p_size) AS mean FROM holes) SELECT p_partkey, round(coalesce(p_size, mean)::DOUBLE, 6) AS p_size FROM holes, m")
def i01_impute_mean(spark, d):
    rows = _holes(spark, d).select("p_partkey", "p_size")
    fitted = impute.SimpleImputer(num_strategy="mean").fit(rows, ["p_size"])
    return _rounded(fitted.apply(FeatureFrame(rows, {"p_size": "num"})).df, ["p_partkey"])


@query("i07_nearest_level", f"WITH {JUDGED}, c AS (SELECT source, prior + (s / k::DOUBLE - prior) / (1 + exp(-(k - 1))) AS code FROM g, p), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY abs(code - toxic), source) AS n FROM (SELECT doc_id, toxic FROM j), c) SELECT doc_id, source FROM r WHERE n = 1")
def i07_nearest_level(spark, d):
    rows = _judged(spark, d)
    codes = encode.TargetEncoder().fit(rows, ["source"], "quality").state["codes"]["source"]
    return rows.select("doc_id", encode.TargetEncoder.nearest_level(F.col("toxic").cast("double"), codes).alias("source"))


@query("k01_kept_columns", " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM lineitem HAVING var_pop({c}) > 0.01" for c in PAIRED))
def k01_kept_columns(spark, d):
    gone = compress.VarianceFilter(0.01).fit(table(spark, d, "lineitem"), PAIRED).old
    return spark.createDataFrame([(c,) for c in PAIRED if c not in gone], "column_name string")


@query("k02_dropped_columns", "SELECT 'a' AS column_name FROM lineitem HAVING corr(l_quantity, l_quantity + l_tax) > 0.9")
def k02_dropped_columns(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_tax")).alias("b"), F.col("l_discount").alias("c"))
    return spark.createDataFrame([(c,) for c in compress.PearsonFilter().fit(rows, ["a", "b", "c"]).old], "column_name string")


@query("k03_dropped_columns", "SELECT 'a' AS column_name FROM (SELECT (l_quantity > 25)::INTEGER AS a, (l_quantity > 26)::INTEGER AS b FROM lineitem) HAVING 2 * sum(a * b) / (sum(a) + sum(b))::DOUBLE > 0.9")
def k03_dropped_columns(spark, d):
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").select((q > 25).cast("int").alias("a"), (q > 26).cast("int").alias("b"), (F.col("l_tax") > 0.04).cast("int").alias("c"), q.alias("d"))
    return spark.createDataFrame([(c,) for c in compress.F1Filter().fit(rows, ["a", "b", "c", "d"]).old], "column_name string")


@query(
    "l02_mutual_information",
    "WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem), "
    "v AS (SELECT least(floor((l_quantity - a) / (b - a) * 16), 15) AS v, least(floor((l_extendedprice - c) / (d - c) * 16), 15) AS y FROM lineitem, r), "
    "c AS (SELECT v, y, count(*)::DOUBLE AS n FROM v GROUP BY v, y), w AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY v) AS a, sum(n) OVER (PARTITION BY y) AS b FROM c) "
    "SELECT 'l_quantity' AS column_name, round(sum(n / t * ln(n * t / (a * b))), 6) AS mi FROM w",
)
def l02_mutual_information(spark, d):
    return select.mutual_information(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", target_bins=16)


@query("l01_selected", "SELECT column_name FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, corr({c}, l_extendedprice) ** 2 AS r FROM lineitem" for c in ("l_quantity", "l_discount")) + ") ORDER BY r DESC LIMIT 1")
def l01_selected(spark, d):
    names = ["l_quantity", "l_discount"]
    gone = select.UnivariateSelector("f_regression", 50.0).fit(table(spark, d, "lineitem"), names, "l_extendedprice").old
    return spark.createDataFrame([(c,) for c in names if c not in gone], "column_name string")


@query("g03_most_columns", "SELECT 2 AS steps, (n + n * (n - 1) // 2 * 4)::INTEGER AS most FROM (SELECT 5 + 5 * 13 AS n)")
def g03_most_columns(spark, d):
    return spark.createDataFrame([(2, expand.most_columns(5, 2))], "steps int, most int")


@query("g04_dimensionless", "SELECT * FROM (VALUES ('d', 1), ('t', -1), ('v', -1)) t(column_name, exponent)")
def g04_dimensionless(spark, d):
    (found,) = expand.dimensionless({"v": {"m": 1, "s": -1}, "d": {"m": 1}, "t": {"s": 1}})
    sign = 1 if found["d"] > 0 else -1
    return spark.createDataFrame([(c, sign * k) for c, k in found.items()], "column_name string, exponent int")


# ---- folds and budgets ---------------------------------------------------------------

HASH_FOLD = "(('0x' || substr(md5({key}::VARCHAR || ':0'), 1, 8))::BIGINT % {k})::INTEGER"


@query("y02_hash_folds", f"SELECT o_orderkey, {HASH_FOLD.format(key='o_orderkey', k=5)} AS fold FROM orders")
def y02_hash_folds(spark, d):
    return split.hash_folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").withColumnRenamed(split.FOLD, "fold")


@query("y02_group_folds", f"SELECT o_custkey, {HASH_FOLD.format(key='o_custkey', k=5)} AS fold, count(*) AS n FROM orders GROUP BY 1, 2")
def y02_group_folds(spark, d):
    folds = split.hash_folds(table(spark, d, "orders").select("o_custkey"), "o_custkey")
    return folds.groupBy("o_custkey", F.col(split.FOLD).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("y01_holdout", f"SELECT o_orderkey, CASE WHEN {HASH_FOLD.format(key='o_orderkey', k=3)} = 0 THEN 0 ELSE 1 END AS fold FROM orders")
def y01_holdout(spark, d):
    return split.default_splitter(10_000, True)(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "o_orderkey").withColumnRenamed(split.FOLD, "fold")


@query("y05_iteration_budget", "SELECT b AS budget, greatest(round(40 * least(1, b)), 1)::INTEGER AS iterations FROM (VALUES (0.01::DOUBLE), (0.25::DOUBLE), (1::DOUBLE), (4::DOUBLE)) t(b)")
def y05_iteration_budget(spark, d):
    return spark.createDataFrame([(b, evaluate.iterations(40, b)) for b in (0.01, 0.25, 1.0, 4.0)], "budget double, iterations int")


@query("y06_fold_budget", "SELECT * FROM (VALUES (0.5::DOUBLE, 1), (1::DOUBLE, 1), (4::DOUBLE, 3), (9::DOUBLE, 5)) t(budget, folds)")
def y06_fold_budget(spark, d):
    return spark.createDataFrame([(b, len(evaluate.folds_of(b, 5, {4.0: 3}))) for b in (0.5, 1.0, 4.0, 9.0)], "budget double, folds int")


@query("h05_grid", "SELECT a AS kernel, b AS c FROM (VALUES ('rbf'), ('linear')) t(a), (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) u(b) WHERE NOT (a = 'linear' AND b = 0)")
def h05_grid(spark, d):
    s = space.Space({"kernel": space.Choice(("rbf", "linear")), "c": space.Uniform(0.0, 1.0)}, forbidden=[{"kernel": "linear", "c": 0.0}])
    return spark.createDataFrame([(c["kernel"], c["c"]) for c in s.grid(3)], "kernel string, c double")


@query("h11_budgets", "SELECT * FROM (VALUES (0, 1::DOUBLE), (1, 3::DOUBLE), (2, 9::DOUBLE), (3, 27::DOUBLE)) t(step, budget)")
def h11_budgets(spark, d):
    return spark.createDataFrame([(i, round(float(b), 6)) for i, b in enumerate(search.budgets(1, 27, 3))], "step int, budget double")


# ---- trials ---------------------------------------------------------------------------

FOLDED = f"f AS (SELECT config AS trial, (seq % 3)::INTEGER AS fold, (loss > 20)::INTEGER AS y, (config % 3 = 0)::INTEGER AS p FROM log)"


@query(
    "a18_fold_means",
    f"WITH {LOG}, {FOLDED}, c AS (SELECT trial, fold, avg((y = p)::INTEGER) AS accuracy, sum(y * p)::DOUBLE AS tp, sum((1 - y) * p)::DOUBLE AS fp, sum(y * (1 - p))::DOUBLE AS fn FROM f GROUP BY 1, 2), "
    "s AS (SELECT trial, accuracy, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c) "
    "SELECT trial, count(*) AS n_folds, round(avg(1 - accuracy), 6) AS loss, round(avg(accuracy), 6) AS accuracy, round(avg(f1), 6) AS f1 FROM s GROUP BY trial",
)
def a18_fold_means(spark, d):
    log = _log(spark, d)
    told = log.select(F.col("config").alias("trial"), (F.col("seq") % 3).cast("int").alias("fold"), (F.col("loss") > 20).cast("int").alias("y"), (F.col("config") % 3 == 0).cast("int").alias("p"))
    return _rounded(evaluate.trial_scores(told, {n: metrics.CLASSIFICATION[n] for n in ("accuracy", "f1")}, "accuracy"), ["trial"])


@query("t05_next_id", f"WITH {LOG} SELECT max(seq) + 1 AS next_id FROM log")
def t05_next_id(spark, d):
    return trials.next_id(_log(spark, d))


@query("t08_ordered_scan", f"WITH {LOG} SELECT seq, config, loss FROM log WHERE experiment IN (1, 3) AND kind = 1 AND started >= (SELECT min(started) + 3600 FROM log)")
def t08_ordered_scan(spark, d):
    log = _log(spark, d)
    since = log.agg(F.min("started")).first()[0] + 3600
    return trials.scan(log, {"experiment": [1, 3], "kind": 1}, since).select("seq", "config", "loss")


@query("w08_resampling", f"WITH {LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY loss, seq) AS place FROM log) SELECT budget, seq, place::INTEGER AS place FROM k WHERE place <= 20")
def w08_resampling(spark, d):
    return trials.resampled(_log(spark, d), 40, ["budget"]).select("budget", "seq", "place")


@query("w11_early_stopping", "SELECT * FROM (VALUES (0, 0.50::DOUBLE, true), (1, 0.60::DOUBLE, true), (2, 0.61::DOUBLE, true), (3, 0.58::DOUBLE, false)) t(iteration, score, goes_on)")
def w11_early_stopping(spark, d):
    stop, rows = evaluate.EarlyStopping(window=2, tolerance=0.02), []
    for k, score in enumerate((0.50, 0.60, 0.61, 0.58)):
        rows.append((k, score, stop.tell(k, score)))
    return spark.createDataFrame(rows, "iteration int, score double, goes_on boolean")


@query("z05_best_trials_vote", f"WITH {LOG}, b AS (SELECT seq FROM log WHERE budget = (SELECT max(budget) FROM log) ORDER BY loss, seq LIMIT 3) SELECT user_id AS rid, round(avg(value), 6) AS p FROM events WHERE event_id IN (SELECT seq FROM b) GROUP BY user_id")
def z05_best_trials_vote(spark, d):
    from ..operators import ensemble

    best = trials.best_k(_log(spark, d), 3).select("seq")
    votes = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("rid"), F.col("value").alias("p"))
    return _rounded(ensemble.soft_vote(votes.join(F.broadcast(best), "seq", "left_semi")), ["rid"])


# ---- scores of several classes -----------------------------------------------------------

PROBA = "x AS (SELECT o_orderstatus AS y, 1 + o_orderkey % 3 AS a, 1 + o_orderkey % 5 AS b, 1 + o_orderkey % 7 AS c FROM orders), q AS (SELECT y, a / (a + b + c)::DOUBLE AS f, b / (a + b + c)::DOUBLE AS o, c / (a + b + c)::DOUBLE AS p FROM x)"


def _proba(spark, d) -> tuple[DataFrame, dict]:
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(F.col("o_orderstatus").alias("y"), (1 + k % 3).alias("a"), (1 + k % 5).alias("b"), (1 + k % 7).alias("c"))
    total = (F.col("a") + F.col("b") + F.col("c")).cast("double")
    return x.select("y", (F.col("a") / total).alias("f"), (F.col("b") / total).alias("o"), (F.col("c") / total).alias("p")), {"F": "f", "O": "o", "P": "p"}


@query(
    "v13_class_log_loss",
    f"WITH {PROBA}, l AS (SELECT -avg(ln(CASE y WHEN 'F' THEN f WHEN 'O' THEN o ELSE p END)) AS ll FROM q), n AS (SELECT y, count(*) / (SELECT count(*) FROM q)::DOUBLE AS r FROM q GROUP BY y), b AS (SELECT exp(sum(r * ln(r))) AS base FROM n) "
    "SELECT round(ll, 6) AS log_loss, round((exp(-ll) - base) / (1 - base), 6) AS pac_score FROM l, b",
)
def v13_class_log_loss(spark, d):
    rows, columns = _proba(spark, d)
    return metrics.class_log_loss(rows, "y", columns)


def _auc(where: str, y: str, c: str) -> str:
    return (
        f"(SELECT (sum(CASE WHEN g THEN r END)::DOUBLE - sum(g::INTEGER) * (sum(g::INTEGER) + 1) / 2.0) / (sum(g::INTEGER) * sum((NOT g)::INTEGER))::DOUBLE FROM (SELECT y = '{y}' AS g, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r FROM q WHERE {where}))"
    )


@query("v16_roc_auc_rest", f"WITH {PROBA} SELECT round((" + " + ".join(f"round({_auc('true', y, c)}, 6)" for y, c in (("F", "f"), ("O", "o"), ("P", "p"))) + ") / 3, 6) AS roc_auc")
def v16_roc_auc_rest(spark, d):
    rows, columns = _proba(spark, d)
    return metrics.roc_auc_classes(rows, "y", columns)


@query("v16_roc_auc_pairs", f"WITH {PROBA} SELECT round((" + " + ".join("round(" + _auc(f"y IN ('{a}', '{b}')", a, a.lower()) + ", 6)" for a in "FOP" for b in "FOP" if a != b) + ") / 6, 6) AS roc_auc")
def v16_roc_auc_pairs(spark, d):
    rows, columns = _proba(spark, d)
    return metrics.roc_auc_pairs(rows, "y", columns)


@query("v09_class_balanced_accuracy", f"WITH {CLASSED}, r AS (SELECT y, avg((y = p)::INTEGER) AS r FROM x GROUP BY y) SELECT round(avg(r), 6) AS balanced_accuracy FROM r")
def v09_class_balanced_accuracy(spark, d):
    return metrics.class_balanced_accuracy(_classed(spark, d), "y", "p")


@query("v07_class_mcc", f"WITH {CLASSED}, t AS (SELECT sum(tp)::DOUBLE AS c, sum(n)::DOUBLE AS s, sum(n * m)::DOUBLE AS nm, sum(n * n)::DOUBLE AS nn, sum(m * m)::DOUBLE AS mm FROM c) SELECT round((c * s - nm) / sqrt((s * s - mm) * (s * s - nn)), 6) AS mcc FROM t")
def v07_class_mcc(spark, d):
    return metrics.class_mcc(_classed(spark, d), "y", "p")


@query(
    "v11_sample_scores",
    "WITH t AS (SELECT list_distinct(list(l_returnflag)) AS y, list_distinct(list(CASE WHEN l_quantity > 25 THEN 'R' ELSE l_returnflag END)) AS p FROM lineitem GROUP BY l_orderkey), c AS (SELECT len(list_intersect(y, p))::DOUBLE AS h, len(y) AS n, len(p) AS m FROM t) "
    "SELECT round(avg(h / m), 6) AS precision, round(avg(h / n), 6) AS recall, round(avg(2 * h / (n + m)), 6) AS f1 FROM c",
)
def v11_sample_scores(spark, d):
    told = F.when(F.col("l_quantity") > 25, "R").otherwise(F.col("l_returnflag"))
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("y"), F.collect_set(told).alias("p"))
    return metrics.sample_scores(sets, "y", "p")


# ---- closed-form models --------------------------------------------------------------------


BEST = "r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, c) AS place FROM k) "
FLAGGED = "x AS (SELECT o_orderkey, o_totalprice, (o_orderstatus = 'O')::INTEGER AS y, 1 + o_orderkey % 7 AS a, 1 + o_custkey % 3 AS b, (o_totalprice > 150000)::INTEGER AS f, (o_custkey % 2)::INTEGER AS g FROM orders)"
SURE = "SELECT o_orderkey, round(1 / (1 + exp(min(score) FILTER (c = 0) - min(score) FILTER (c = 1))), 6) AS p FROM k GROUP BY 1"


def _flagged(spark, d) -> DataFrame:
    price, key, who = F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "O").cast("int").alias("y"), (1 + key % 7).alias("a"), (1 + who % 3).alias("b"),
        (price > 150000).cast("int").alias("f"), (who % 2).cast("int").alias("g"),
    )


@query(
    "m06_gaussian_nb",
    f"WITH {FLAGGED}, s AS (SELECT y AS c, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM x GROUP BY 1), e AS (SELECT 1e-9 * var_pop(o_totalprice) AS e FROM x), "
    f"k AS (SELECT o_orderkey, c, ln(n) - 0.5 * ln(2 * pi() * (v + e)) - (o_totalprice - m) ** 2 / (2 * (v + e)) AS score FROM x, s, e) {SURE}",
)
def m06_gaussian_nb(spark, d):
    rows = estimators.assembled(_flagged(spark, d), ["o_totalprice"], "y")
    done = estimators.probability(estimators.make("gaussian_nb").fit(rows).transform(rows))
    return done.select("o_orderkey", F.round("p", 6).alias("p"))


@query(
    "m14_multinomial_nb",
    f"WITH {FLAGGED}, s AS (SELECT y, count(*) AS n, sum(a) + 1 AS a, sum(b) + 1 AS b FROM x GROUP BY y), t AS (SELECT y AS c, ln((n + 1) / (SELECT sum(n) + 2 FROM s)::DOUBLE) AS prior, ln(a / (a + b)::DOUBLE) AS la, ln(b / (a + b)::DOUBLE) AS lb FROM s), "
    f"k AS (SELECT o_orderkey, c, prior + x.a * la + x.b * lb AS score FROM x, t) {SURE}",
)
def m14_multinomial_nb(spark, d):
    rows = estimators.assembled(_flagged(spark, d), ["a", "b"], "y")
    done = estimators.probability(estimators.make("multinomial_nb").fit(rows).transform(rows))
    return done.select("o_orderkey", F.round("p", 6).alias("p"))


@query(
    "m02_bernoulli_nb",
    f"WITH {FLAGGED}, s AS (SELECT y, count(*) AS n, (sum(f) + 1) / (count(*) + 2)::DOUBLE AS f, (sum(g) + 1) / (count(*) + 2)::DOUBLE AS g FROM x GROUP BY y), "
    f"k AS (SELECT o_orderkey, s.y AS c, ln((n + 1) / (SELECT sum(n) + 2 FROM s)::DOUBLE) + ln(CASE x.f WHEN 1 THEN s.f ELSE 1 - s.f END) + ln(CASE x.g WHEN 1 THEN s.g ELSE 1 - s.g END) AS score FROM x, s) {SURE}",
)
def m02_bernoulli_nb(spark, d):
    rows = estimators.assembled(_flagged(spark, d), ["f", "g"], "y")
    done = estimators.probability(estimators.make("bernoulli_nb").fit(rows).transform(rows))
    return done.select("o_orderkey", F.round("p", 6).alias("p"))


LINE = "WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, count(*) AS n, covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx FROM lineitem) "


@query("q03_ridge_line", LINE + "SELECT l_orderkey, l_linenumber, round(my + (l_quantity - mx) * sxy / (sxx + 1000), 4) AS prediction FROM lineitem, m")
def q03_ridge_line(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    done = estimators.RidgeFamily("ridge", 1000.0).fit(rows, ["l_quantity"], "l_extendedprice").transform(rows)
    return done.select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))


@query(
    "m10_lda_line",
    "WITH s AS (SELECT o_orderstatus AS c, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS q FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n, sum(q) / (sum(n) - count(*)) + 1e-6 AS v FROM s), "
    f"k AS (SELECT o_orderkey, c, ln(s.n / t.n) - (o_totalprice - m) ** 2 / (2 * v) AS score FROM orders, s, t), {BEST}SELECT o_orderkey, c AS prediction FROM r WHERE place = 1",
)
def m10_lda_line(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return estimators.Discriminant().fit(rows, ["o_totalprice"], "o_orderstatus").transform(rows).select("o_orderkey", "prediction")


@query(
    "m15_qda_line",
    "WITH s AS (SELECT o_orderstatus AS c, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) + 1e-6 AS v FROM orders GROUP BY 1), "
    f"k AS (SELECT o_orderkey, c, ln(s.n / (SELECT sum(n) FROM s)) - 0.5 * ln(v) - (o_totalprice - m) ** 2 / (2 * v) AS score FROM orders, s), {BEST}SELECT o_orderkey, c AS prediction FROM r WHERE place = 1",
)
def m15_qda_line(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return estimators.Discriminant(quadratic=True).fit(rows, ["o_totalprice"], "o_orderstatus").transform(rows).select("o_orderkey", "prediction")


@query(
    "c05_quantile_scaled",
    "WITH g AS (" + " UNION ALL ".join(f"SELECT {k / 4}::DOUBLE AS u, quantile_cont(c_acctbal, {k / 4}) AS v FROM customer" for k in range(5)) + "), w AS (SELECT u, v, lead(u) OVER (ORDER BY u) AS u2, lead(v) OVER (ORDER BY u) AS v2 FROM g) "
    "SELECT c_custkey, round(min(u + (c_acctbal - v) / (v2 - v) * (u2 - u)), 6) AS c_acctbal FROM customer JOIN w ON c_acctbal >= v AND c_acctbal <= v2 GROUP BY c_custkey",
)
def c05_quantile_scaled(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    fitted = scale.QuantileScaler(5).fit(rows, ["c_acctbal"])
    return _rounded(fitted.apply(FeatureFrame(rows, {"c_acctbal": "num"})).df, ["c_custkey"])


@query("b08_under_sizes", "SELECT quality, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS n FROM (SELECT DISTINCT quality FROM labels)")
def b08_under_sizes(spark, d):
    return balance.random_under(table(spark, d, "labels"), "doc_id", "quality").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
