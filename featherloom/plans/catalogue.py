"""Every query of the engine, each beside the SQL that gives the same rows.

Queries run over whole tables. Floats are rounded to six digits on both sides; missing
values are derived alike on both sides, as the tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import UNARY, clean_text, sigmoid, tokens
from ..operators import balance, compress, encode, ensemble, estimators, expand, impute, metrics, scale, select, split, text
from ..operators.frame import FeatureFrame, stack_roles
from ..operators.profile import infer_groups, one_hot_megabytes, profile, target_task
from ..session import table
from ..sources.tables import log_metadata
from . import trials

FLAGSHIP = "p01_profile"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL if it has one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    from . import catalogue_more  # noqa: F401  it registers its queries here

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in queries() if name in SQL}


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    """Doubles to six digits, without negative zeros; keys as they are."""
    kinds = dict(df.dtypes)
    return df.select(*(F.col(f"`{c}`") if c in keys or kinds[c] not in ("double", "float") else (F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) for c in df.columns))


def _apply(df: DataFrame, keys: list[str], names: list[str], op, y: str | None = None) -> DataFrame:
    """Keys and what a fitted operator makes of the named columns."""
    fitted = op.fit(df, names, y)
    frame = fitted.apply(FeatureFrame(df.select(*keys, *names), dict.fromkeys(names, "num")))
    return _rounded(frame.df, keys)


# ---- profiles -----------------------------------------------------------------

PROFILED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    "p01_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_ratio, "
        f"count(DISTINCT coalesce({c}::VARCHAR, 'nan')) AS n_distinct, min({c})::VARCHAR AS min_text, max({c})::VARCHAR AS max_text FROM lineitem"
        for c in PROFILED
    ),
)
def p01_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile(table(spark, d, "lineitem"))


@query(
    "p02_infer_groups",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CASE WHEN bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) THEN 'num' WHEN min(len(string_split({c}, ' '))) >= 2 THEN 'text' "
        f"WHEN count(DISTINCT {c}) >= 4 THEN 'highC_cat' ELSE 'cat' END AS feature_group FROM documents"
        for c in ("text", "lang", "source")
    )
    + " UNION ALL SELECT 'doc_id', 'num' UNION ALL SELECT 'n_chars', 'num'",
)
def p02_infer_groups(spark, d):
    found = infer_groups(table(spark, d, "documents"))
    return spark.createDataFrame(list(found.items()), "column_name string, feature_group string")


def _task_sql(name, t, c):
    return (
        f"SELECT '{name}' AS target, count(DISTINCT {c}) AS n_distinct, bool_or({c} <> floor({c})) AS any_fraction, CASE WHEN count(DISTINCT {c}) <= 2 THEN 'binary' "
        f"WHEN bool_or({c} <> floor({c})) THEN 'continuous' ELSE 'multiclass' END AS task, NOT (NOT bool_or({c} <> floor({c})) AND min({c}) = 0 AND max({c}) = count(DISTINCT {c}) - 1) AS needs_encoding FROM {t}"
    )


@query("p03_target_task", " UNION ALL ".join(_task_sql(*x) for x in (("quality", "labels", "quality"), ("size", "part", "p_size"), ("price", "part", "p_retailprice"))))
def p03_target_task(spark, d):
    parts = [target_task(table(spark, d, t), c).select(F.lit(n).alias("target"), "*") for n, t, c in (("quality", "labels", "quality"), ("size", "part", "p_size"), ("price", "part", "p_retailprice"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _holes(spark, d) -> DataFrame:
    """Parts with derived nulls: sizes up to 10, brands of odd sizes, prices of sizes beyond 25."""
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", F.when(size > 10, size).alias("p_size"), F.when(size % 2 == 0, F.col("p_brand")).alias("p_brand"), F.when(size % 5 != 0, F.col("p_type")).alias("p_type"), F.when(size <= 25, F.col("p_retailprice")).alias("p_retailprice")
    )


HOLES = (
    "holes AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS p_size, CASE WHEN p_size % 2 = 0 THEN p_brand END AS p_brand, "
    "CASE WHEN p_size % 5 <> 0 THEN p_type END AS p_type, CASE WHEN p_size <= 25 THEN p_retailprice END AS p_retailprice FROM part)"
)


@query(
    "p15_missing_rate",
    f"WITH {HOLES} "
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(1 - count({c}) / count(*)::DOUBLE, 6) AS null_ratio, 1 - count({c}) / count(*)::DOUBLE >= 0.4 AS dropped FROM holes" for c in ("p_size", "p_brand", "p_type", "p_retailprice")),
)
def p15_missing_rate(spark, d):
    found = impute.SimpleImputer().fit(_holes(spark, d), ["p_size", "p_brand", "p_type", "p_retailprice"]).state
    return spark.createDataFrame([(c, round(r, 6), c in found["dropped"]) for c, r in found["ratios"].items()], "column_name string, null_ratio double, dropped boolean")


@query(
    "i01_impute_median_mode",
    f"WITH {HOLES}, m AS (SELECT median(p_size) AS med FROM holes), t AS (SELECT p_type AS top FROM holes WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1) "
    "SELECT p_partkey, coalesce(p_size, med)::DOUBLE AS p_size, coalesce(p_type, top) AS p_type FROM holes, m, t",
)
def i01_impute_median_mode(spark, d):
    return _apply(_holes(spark, d).select("p_partkey", "p_size", "p_type"), ["p_partkey"], ["p_size", "p_type"], impute.SimpleImputer())


@query("u01_stack_roles", "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS role, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def u01_stack_roles(spark, d):
    c = table(spark, d, "customer")
    both = stack_roles(train=c.where("c_custkey % 2 = 0"), test=c.where("c_custkey % 2 <> 0"))
    return both.groupBy(F.col("_role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


# ---- encoders -----------------------------------------------------------------


@query(
    "e01_one_hot",
    "WITH l AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) AS k FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderkey, "
    + ", ".join(f"CASE WHEN k = {k} THEN 1 ELSE 0 END AS o_orderpriority_{k}" for k in range(1, 6))
    + " FROM orders JOIN l ON o_orderpriority = v",
)
def e01_one_hot(spark, d):
    return _apply(table(spark, d, "orders"), ["o_orderkey"], ["o_orderpriority"], encode.OneHotEncoder())


@query("e02_ordinal", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS c_mktsegment FROM customer")
def e02_ordinal(spark, d):
    return _apply(table(spark, d, "customer"), ["c_custkey"], ["c_mktsegment"], encode.OrdinalEncoder())


@query("e03_binary", "WITH c AS (SELECT n_nationkey, dense_rank() OVER (ORDER BY n_name)::INTEGER AS k FROM nation) SELECT n_nationkey, " + ", ".join(f"(k >> {4 - i}) & 1 AS n_name_{i}" for i in range(5)) + " FROM c")
def e03_binary(spark, d):
    return _apply(table(spark, d, "nation"), ["n_nationkey"], ["n_name"], encode.BinaryEncoder())


@query("e04_hash", "WITH h AS (SELECT p_partkey, ('0x' || substr(md5('p_type=' || p_type), 1, 5))::BIGINT % 8 AS a, ('0x' || substr(md5('p_brand=' || p_brand), 1, 5))::BIGINT % 8 AS b FROM part) SELECT p_partkey, " + ", ".join(f"(a = {k})::INTEGER + (b = {k})::INTEGER AS hash_{k}" for k in range(8)) + " FROM h")
def e04_hash(spark, d):
    return _apply(table(spark, d, "part"), ["p_partkey"], ["p_type", "p_brand"], encode.HashEncoder(8))


def _judged(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")


JUDGED = "j AS (SELECT doc_id, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)), p AS (SELECT avg(quality) AS prior, count(*) AS n, sum(quality) AS good FROM j), g AS (SELECT source, count(*) AS k, sum(quality) AS s FROM j GROUP BY source)"


@query("e05_target_mean", f"WITH {JUDGED} SELECT doc_id, round(CASE WHEN k = 1 THEN prior ELSE prior + (s / k::DOUBLE - prior) / (1 + exp(-(k - 1))) END, 6) AS source FROM j JOIN g USING (source), p")
def e05_target_mean(spark, d):
    return _apply(_judged(spark, d), ["doc_id"], ["source"], encode.TargetEncoder(), "quality")


@query("e06_leave_one_out", f"WITH {JUDGED} SELECT doc_id, CASE WHEN k > 1 THEN round((s - quality) / (k - 1)::DOUBLE, 6) END AS code FROM j JOIN g USING (source)")
def e06_leave_one_out(spark, d):
    return _rounded(encode.LeaveOneOutEncoder.leave_out(_judged(spark, d), "source", "quality", "code").select("doc_id", "code"), ["doc_id"])


@query("e07_cat_boost", f"WITH {JUDGED} SELECT doc_id, round((s + prior) / (k + 1)::DOUBLE, 6) AS source FROM j JOIN g USING (source), p")
def e07_cat_boost(spark, d):
    return _apply(_judged(spark, d), ["doc_id"], ["source"], encode.CatBoostEncoder(), "quality")


@query("e08_woe", f"WITH {JUDGED} SELECT doc_id, round(ln(((s + 1) / (good + 2)::DOUBLE) / ((k - s + 1) / (n - good + 2)::DOUBLE)), 6) AS source FROM j JOIN g USING (source), p")
def e08_woe(spark, d):
    return _apply(_judged(spark, d), ["doc_id"], ["source"], encode.WoeEncoder(), "quality")


@query("e09_combine_rare", "WITH f AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part)::DOUBLE AS share FROM part GROUP BY p_brand) SELECT p_partkey, CASE WHEN share >= 0.04 THEN p_brand ELSE 'Others Infrequent' END AS p_brand FROM part JOIN f USING (p_brand)")
def e09_combine_rare(spark, d):
    return _apply(table(spark, d, "part"), ["p_partkey"], ["p_brand"], encode.CombineRare(0.04))


# ---- scalers ------------------------------------------------------------------

LINE_KEYS, LINE_NUMBERS = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_tax"]


def _scale_sql(each, stats):
    s = ", ".join(f"{v} AS {k}_{c}" for c in LINE_NUMBERS for k, v in stats(c).items())
    return f"WITH s AS (SELECT {s} FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({each(c)}, 6) + 0.0 AS {c}" for c in LINE_NUMBERS) + " FROM lineitem, s"


@query("c01_standard", _scale_sql(lambda c: f"({c} - m_{c}) / d_{c}", lambda c: {"m": f"avg({c})", "d": f"stddev_pop({c})"}))
def c01_standard(spark, d):
    return _apply(table(spark, d, "lineitem"), LINE_KEYS, LINE_NUMBERS, scale.StandardScaler())


@query("c02_minmax", _scale_sql(lambda c: f"({c} - m_{c}) / (d_{c} - m_{c})", lambda c: {"m": f"min({c})", "d": f"max({c})"}))
def c02_minmax(spark, d):
    return _apply(table(spark, d, "lineitem"), LINE_KEYS, LINE_NUMBERS, scale.MinMaxScaler())


@query("c03_robust", _scale_sql(lambda c: f"({c} - m_{c}) / (b_{c} - a_{c})", lambda c: {"m": f"quantile_cont({c}, 0.5)", "a": f"quantile_cont({c}, 0.25)", "b": f"quantile_cont({c}, 0.75)"}))
def c03_robust(spark, d):
    return _apply(table(spark, d, "lineitem"), LINE_KEYS, LINE_NUMBERS, scale.RobustScaler())


@query("c04_row_normal", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c} / sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_tax * l_tax), 6) AS {c}" for c in LINE_NUMBERS) + " FROM lineitem")
def c04_row_normal(spark, d):
    return _apply(table(spark, d, "lineitem"), LINE_KEYS, LINE_NUMBERS, scale.RowNormaliser())


@query("c05_quantile_grid", " UNION ALL ".join(f"SELECT {k / 10}::DOUBLE AS q, round(quantile_cont(o_totalprice, {k / 10}), 6) AS value FROM orders" for k in range(11)))
def c05_quantile_grid(spark, d):
    at = [k / 10 for k in range(11)]
    fitted = scale.QuantileScaler(11).fit(table(spark, d, "orders"), ["o_totalprice"])
    return spark.createDataFrame([(q, round(v, 6)) for q, v in zip(at, fitted.state["q"]["o_totalprice"], strict=True)], "q double, value double")


@query("c06_yeo_johnson", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 6) AS c_acctbal FROM customer")
def c06_yeo_johnson(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(scale.yeo_johnson(F.col("c_acctbal"), 0.5), 6).alias("c_acctbal"))


# ---- compression and selection ------------------------------------------------

PAIRED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("k01_variance", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(var_pop({c}), 6) AS variance FROM lineitem" for c in PAIRED))
def k01_variance(spark, d):
    found = compress.VarianceFilter().fit(table(spark, d, "lineitem"), PAIRED).state["variance"]
    return spark.createDataFrame([(c, round(v, 6)) for c, v in found.items()], "column_name string, variance double")


@query("k02_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(PAIRED) for b in PAIRED[i + 1 :]))
def k02_pearson(spark, d):
    found = compress.PearsonFilter().fit(table(spark, d, "lineitem"), PAIRED).state["similarity"]
    return spark.createDataFrame([(a, b, round(r, 6)) for (a, b), r in found.items()], "a string, b string, r double")


@query(
    "k03_f1_pairs",
    "WITH x AS (SELECT (l_returnflag = 'R')::INTEGER AS r, (l_linestatus = 'F')::INTEGER AS f, (l_discount > 0.05)::INTEGER AS s FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(2 * sum({a} * {b}) / (sum({a}) + sum({b}))::DOUBLE, 6) AS f1 FROM x" for a, b in (("r", "f"), ("r", "s"), ("f", "s"))),
)
def k03_f1_pairs(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("r"), (F.col("l_linestatus") == "F").cast("int").alias("f"), (F.col("l_discount") > 0.05).cast("int").alias("s"))
    found = compress.F1Filter().fit(x, ["r", "f", "s"]).state["similarity"]
    return spark.createDataFrame([(a, b, round(v, 6)) for (a, b), v in found.items()], "a string, b string, f1 double")


@query(
    "l01_anova_f",
    f"WITH {JUDGED}, c AS (SELECT quality, count(*) AS k, sum(n_chars) AS s, sum(n_chars::DOUBLE * n_chars) AS q FROM j GROUP BY quality), "
    "t AS (SELECT sum(k) AS n, sum(s) AS s, sum(q) AS q, count(*) AS c, sum(s::DOUBLE * s / k) AS b FROM c) "
    "SELECT 'n_chars' AS column_name, round(((b - s::DOUBLE * s / n) / (c - 1)) / ((q - b) / (n - c)), 6) AS f FROM t",
)
def l01_anova_f(spark, d):
    return select.anova_f(_judged(spark, d), ["n_chars"], "quality")


@query(
    "l01_chi2",
    f"WITH {JUDGED}, c AS (SELECT quality, count(*) AS k, sum(n_chars)::DOUBLE AS s FROM j GROUP BY quality), t AS (SELECT sum(k)::DOUBLE AS n, sum(s) AS s FROM c) "
    "SELECT 'n_chars' AS column_name, round(sum((c.s - t.s * k / n) ** 2 / (t.s * k / n)), 6) AS chi2 FROM c, t",
)
def l01_chi2(spark, d):
    return select.chi2(_judged(spark, d), ["n_chars"], "quality")


@query("l02_f_regression", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2), 6) AS f FROM lineitem" for c in ("l_discount", "l_tax")))
def l02_f_regression(spark, d):
    return select.f_regression(table(spark, d, "lineitem"), ["l_discount", "l_tax"], "l_extendedprice")


@query(
    "l01_mutual_information",
    "WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), v AS (SELECT least(floor((l_quantity - a) / (b - a) * 16), 15) AS v, l_returnflag AS y FROM lineitem, r), "
    "c AS (SELECT v, y, count(*)::DOUBLE AS n FROM v GROUP BY v, y), w AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY v) AS a, sum(n) OVER (PARTITION BY y) AS b FROM c) "
    "SELECT 'l_quantity' AS column_name, round(sum(n / t * ln(n * t / (a * b))), 6) AS mi FROM w",
)
def l01_mutual_information(spark, d):
    return select.mutual_information(table(spark, d, "lineitem"), ["l_quantity"], "l_returnflag")


@query("x01_polynomial", 'SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice, (p_size * p_size)::DOUBLE AS "p_size*p_size", round(p_size * p_retailprice, 6) AS "p_size*p_retailprice", round(p_retailprice * p_retailprice, 6) AS "p_retailprice*p_retailprice" FROM part')
def x01_polynomial(spark, d):
    return _apply(table(spark, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"], expand.Polynomial())


@query(
    "f09_unary_guards",
    "WITH s AS (SELECT min(p_size) AS lo, max(p_size) AS hi, min(abs(p_size)) AS least, max(abs(p_size)) AS most FROM part) "
    "SELECT unnest(['exp', 'exp-', 'log', 'abs', 'sqrt', 'sin', 'cos', '2^', '^2', '^3', '1+', '1-', '1/']) AS transform, "
    "unnest([hi < 10, -lo < 10, lo > 0, lo < 0, lo >= 0, true, true, hi < 50, most < 1e6, most < 1e4, true, true, least > 0]) AS defined FROM s",
)
def f09_unary_guards(spark, d):
    stats = expand.unary_statistics(table(spark, d, "part"), ["p_size"])["p_size"]
    return spark.createDataFrame([(u, bool(fits(stats))) for u, (_, fits) in UNARY.items()], "transform string, defined boolean")


# ---- text ---------------------------------------------------------------------

CLEANED_SQL = "translate(text, chr(13) || chr(10) || '!\"#$&()*+,-./:;<=>?@[\\]^_{|}~`0123456789' || chr(39), repeat(' ', 43))"
TOKENS = f"k AS (SELECT doc_id, unnest(list_filter(string_split_regex({CLEANED_SQL}, '\\s+'), lambda t: t <> '')) AS token FROM documents)"


@query("n01_token_counts", f"WITH {TOKENS} SELECT token, count(*) AS n FROM k GROUP BY token")
def n01_token_counts(spark, d):
    return text.token_counts(text.tokenise(table(spark, d, "documents").select("doc_id", "text"), "text"), "text")


@query("n02_document_frequency", f"WITH {TOKENS} SELECT token, count(DISTINCT doc_id) AS df FROM k GROUP BY token")
def n02_document_frequency(spark, d):
    return text.document_frequency(text.tokenise(table(spark, d, "documents").select("doc_id", "text"), "text"), "text")


@query(
    "n01_frequent_tokens",
    f"WITH {TOKENS}, c AS (SELECT token FROM k GROUP BY token HAVING count(*) > 1), m AS (SELECT doc_id, count(*) AS n FROM k JOIN c USING (token) GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n_tokens FROM documents LEFT JOIN m USING (doc_id)",
)
def n01_frequent_tokens(spark, d):
    listed = text.tokenise(table(spark, d, "documents").select("doc_id", "text"), "text")
    return text.keep_frequent(listed, "doc_id", "text").select("doc_id", F.size("text").cast("long").alias("n_tokens"))


@query(
    "n03_tf_idf",
    f"WITH {TOKENS}, f AS (SELECT doc_id, lower(token) AS token, count(*) AS tf FROM k WHERE len(token) >= 2 GROUP BY 1, 2), d AS (SELECT token, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM f GROUP BY token), "
    "r AS (SELECT doc_id, token, tf * idf AS raw FROM f JOIN d USING (token)) SELECT doc_id, token, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r",
)
def n03_tf_idf(spark, d):
    listed = table(spark, d, "documents").select("doc_id", tokens(clean_text(F.col("text"))).alias("text"))
    return _rounded(text.tf_idf(listed, "doc_id", "text"), ["doc_id", "token"])


# ---- classes, folds, resampling ------------------------------------------------


@query("a09_imbalance", "WITH c AS (SELECT count(*) AS n FROM labels GROUP BY quality) SELECT round(max(n) / min(n)::DOUBLE, 6) AS ratio, max(n) / min(n)::DOUBLE > 2 AS imbalanced FROM c")
def a09_imbalance(spark, d):
    return split.imbalance(table(spark, d, "labels"), "quality")


@query("a10_class_weights", 'WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT quality AS "class", n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 6) AS weight FROM c')
def a10_class_weights(spark, d):
    return split.class_weights(table(spark, d, "labels"), "quality")


DEALT = "row_number() OVER (PARTITION BY {y} ORDER BY md5({key}::VARCHAR || ':0'), {key})"


@query("b08_random_under", f"WITH k AS (SELECT doc_id, quality, {DEALT.format(y='quality', key='doc_id')} AS k FROM labels) SELECT doc_id, quality FROM k WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))")
def b08_random_under(spark, d):
    return balance.random_under(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query(
    "b01_random_over",
    f"WITH k AS (SELECT doc_id, quality, {DEALT.format(y='quality', key='doc_id')} AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels), m AS (SELECT max(n) AS most FROM k) "
    "SELECT doc_id, quality, unnest(range(0, most // n + CASE WHEN k <= most % n THEN 1 ELSE 0 END))::INTEGER AS copy FROM k, m",
)
def b01_random_over(spark, d):
    return balance.random_over(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality").withColumnRenamed("_copy", "copy")


@query("y01_stratified_folds", f"SELECT o_orderkey, o_orderstatus, (({DEALT.format(y='o_orderstatus', key='o_orderkey')} - 1) % 5)::INTEGER AS fold FROM orders")
def y01_stratified_folds(spark, d):
    return split.stratified_folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus").withColumnRenamed("_fold", "fold")


@query("y03_stratified_sample", f"WITH k AS (SELECT o_orderkey, o_orderstatus, {DEALT.format(y='o_orderstatus', key='o_orderkey')} AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus FROM k WHERE k <= greatest(1, round(n * 0.1))")
def y03_stratified_sample(spark, d):
    return split.stratified_sample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.1)


# ---- metrics ------------------------------------------------------------------

SCORED = "s AS (SELECT (l_returnflag = 'R')::INTEGER AS y, l_returnflag AS word, l_linestatus AS told, l_quantity / 51 AS p, (l_quantity > 25)::INTEGER AS h, l_extendedprice AS t, l_quantity * 1500 AS e FROM lineitem)"


def _scored(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_returnflag").alias("word"),
        F.col("l_linestatus").alias("told"),
        (F.col("l_quantity") / 51).alias("p"),
        (F.col("l_quantity") > 25).cast("int").alias("h"),
        F.col("l_extendedprice").alias("t"),
        (F.col("l_quantity") * 1500).alias("e"),
    )


@query(
    "v01_metrics_regression",
    f"WITH {SCORED} SELECT round(1 - sum((t - e) * (t - e)) / (var_pop(t) * count(*)), 6) AS r2, round(corr(t, e), 6) AS pearsonr, round(avg((t - e) * (t - e)), 6) AS mean_squared_error, "
    "round(avg(abs(t - e)), 6) AS mean_absolute_error, round(median(abs(t - e)), 6) AS median_absolute_error FROM s",
)
def v01_metrics_regression(spark, d):
    return metrics.evaluate(_scored(spark, d), "t", "e", metrics.REGRESSION)


@query(
    "v06_metrics_binary",
    f"WITH {SCORED}, c AS (SELECT sum(y * h)::DOUBLE AS tp, sum((1 - y) * h)::DOUBLE AS fp, sum(y * (1 - h))::DOUBLE AS fn, sum((1 - y) * (1 - h))::DOUBLE AS tn FROM s) SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, "
    "round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, "
    "round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c",
)
def v06_metrics_binary(spark, d):
    return metrics.evaluate(_scored(spark, d), "y", "h", {n: s for n, s in metrics.CLASSIFICATION.items() if s.kind == "predict"})


@query(
    "v13_log_loss_pac",
    f"WITH {SCORED}, l AS (SELECT -avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll, avg(y) AS q FROM s), b AS (SELECT ll, exp(q * ln(q) + (1 - q) * ln(1 - q)) AS base FROM l) SELECT round(ll, 6) AS log_loss, round((exp(-ll) - base) / (1 - base), 6) AS pac_score FROM b",
)
def v13_log_loss_pac(spark, d):
    return metrics.evaluate(_scored(spark, d), "y", "p", {n: s for n, s in metrics.CLASSIFICATION.items() if s.kind == "proba"})


@query(
    "v15_roc_auc",
    f"WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s), c AS (SELECT sum(CASE WHEN y = 1 THEN r END)::DOUBLE AS s, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM r) SELECT round((s - a * (a + 1) / 2) / (a * b), 6) AS roc_auc FROM c",
)
def v15_roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d), "y", "p")


@query(
    "v12_average_precision",
    f"WITH {SCORED}, g AS (SELECT p, sum(y)::DOUBLE AS a, count(*)::DOUBLE AS n FROM s GROUP BY p), c AS (SELECT a, sum(a) OVER w AS tp, sum(n) OVER w AS k, sum(a) OVER () AS pos FROM g WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(a / pos * tp / k), 6) AS average_precision FROM c",
)
def v12_average_precision(spark, d):
    return metrics.average_precision(_scored(spark, d), "y", "p")


@query("v17_confusion", "SELECT l_returnflag AS y, l_linestatus AS p, count(*) AS n FROM lineitem GROUP BY 1, 2")
def v17_confusion(spark, d):
    return metrics.confusion(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


CLASSED = (
    "x AS (SELECT o_orderpriority AS y, CASE WHEN o_totalprice > 250000 THEN '1-URGENT' WHEN o_totalprice > 100000 THEN o_orderpriority ELSE '5-LOW' END AS p FROM orders), "
    'k AS (SELECT DISTINCT y AS "class" FROM x UNION SELECT DISTINCT p FROM x), '
    'c AS (SELECT "class", (SELECT count(*) FROM x WHERE y = "class" AND p = "class") AS tp, (SELECT count(*) FROM x WHERE y = "class") AS n, (SELECT count(*) FROM x WHERE p = "class") AS m FROM k), '
    'e AS (SELECT "class", n, round(CASE WHEN m = 0 THEN 0 ELSE tp / m::DOUBLE END, 6) AS precision, round(CASE WHEN n = 0 THEN 0 ELSE tp / n::DOUBLE END, 6) AS recall, round(2 * tp / (n + m)::DOUBLE, 6) AS f1 FROM c)'
)


def _classed(spark, d) -> DataFrame:
    price = F.col("o_totalprice")
    told = F.when(price > 250000, "1-URGENT").when(price > 100000, F.col("o_orderpriority")).otherwise("5-LOW")
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("y"), told.alias("p"))


@query("v11_class_scores", f"WITH {CLASSED} SELECT * FROM e")
def v11_class_scores(spark, d):
    return metrics.class_scores(_classed(spark, d), "y", "p")


@query(
    "v11_averaged_scores",
    f"WITH {CLASSED} SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM e UNION ALL "
    "SELECT 'weighted', round(sum(precision * n) / sum(n), 6), round(sum(recall * n) / sum(n), 6), round(sum(f1 * n) / sum(n), 6) FROM e UNION ALL "
    "SELECT 'micro', h, h, h FROM (SELECT round(avg((y = p)::INTEGER), 6) AS h FROM x)",
)
def v11_averaged_scores(spark, d):
    return metrics.averaged_scores(_classed(spark, d), "y", "p")


@query("v03_spearman", "WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events) SELECT event_type, round(corr(a, b), 6) AS spearman FROM r GROUP BY event_type")
def v03_spearman(spark, d):
    return metrics.spearman(table(spark, d, "events"), ["event_type"], "value", "user_id")


@query(
    "v04_kendall",
    "WITH c AS (SELECT l_quantity AS a, l_tax AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(x.n * y.n * sign(y.b - x.b)) AS s FROM c x JOIN c y ON x.a < y.a), t AS (SELECT sum(n) AS n FROM c), "
    "p AS (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT sum(n) AS n FROM c GROUP BY a)), q AS (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT sum(n) AS n FROM c GROUP BY b)) "
    "SELECT round(s / sqrt((n * (n - 1) / 2 - p.k) * (n * (n - 1) / 2 - q.k)), 6) AS kendall FROM s, t, p, q",
)
def v04_kendall(spark, d):
    return metrics.kendall(table(spark, d, "lineitem"), "l_quantity", "l_tax")


# ---- the trial log: events as runs -----------------------------------------------

LOG = (
    "log AS (SELECT event_id AS seq, user_id AS config, len(event_type)::DOUBLE AS budget, value AS loss, epoch(ts)::DOUBLE AS started, epoch(ts)::DOUBLE + 60 * (1 + user_id % 7) AS finished, user_id % 5 AS experiment, user_id % 2 AS kind FROM events)"
)


def _log(spark, d) -> DataFrame:
    started = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("config"), F.length("event_type").cast("double").alias("budget"), F.col("value").alias("loss"), started.alias("started"),
        (started + 60 * (1 + F.col("user_id") % 7)).alias("finished"), (F.col("user_id") % 5).alias("experiment"), (F.col("user_id") % 2).alias("kind"),
    )


@query("t01_best_k", f"WITH {LOG} SELECT seq, config, loss FROM log WHERE budget = (SELECT max(budget) FROM log) ORDER BY loss, seq LIMIT 10")
def t01_best_k(spark, d):
    return trials.best_k(_log(spark, d), 10).select("seq", "config", "loss")


@query("t03_retention", f"WITH {LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY loss, seq) AS k FROM log) SELECT seq, budget, loss FROM k WHERE k <= 100")
def t03_retention(spark, d):
    return trials.retained(_log(spark, d), 100).select("seq", "budget", "loss")


@query("w01_running_best", f"WITH {LOG} SELECT seq, budget, min(loss) OVER w AS best, count(*) OVER w AS n_finished FROM log WINDOW w AS (PARTITION BY budget ORDER BY finished, seq ROWS UNBOUNDED PRECEDING)")
def w01_running_best(spark, d):
    return trials.running_best(_log(spark, d)).select("seq", "budget", "best", "n_finished")


@query("w04_incumbents", f"WITH {LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY loss, seq) AS k FROM log) SELECT budget, config, loss FROM k WHERE k = 1")
def w04_incumbents(spark, d):
    return trials.incumbent_per_budget(_log(spark, d))


@query(
    "w03_incumbent_trajectory",
    f"WITH {LOG}, b AS (SELECT *, max(budget) OVER (PARTITION BY experiment ORDER BY finished, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM log), t AS (SELECT *, greatest(coalesce(pb, budget), budget) AS top FROM b), "
    "l AS (SELECT *, min(CASE WHEN budget = top THEN loss END) OVER (PARTITION BY experiment, top ORDER BY finished, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl FROM t) "
    "SELECT experiment, seq, budget, loss FROM l WHERE pb IS NULL OR budget > pb OR (budget = pb AND (pl IS NULL OR loss < pl))",
)
def w03_incumbent_trajectory(spark, d):
    return trials.incumbent_trajectory(_log(spark, d)).select("experiment", "seq", "budget", "loss")


@query("w05_learning_curves", f"WITH {LOG} SELECT config, count(*) AS n_points, round(list_sum(list_transform(list(struct_pack(b := budget, l := loss) ORDER BY budget, loss), lambda x, i: x.l * i)), 4) AS weighted FROM log GROUP BY config")
def w05_learning_curves(spark, d):
    curve = trials.learning_curves(_log(spark, d))
    terms = F.transform("curve", lambda x, i: x["loss"] * (i + 1))
    return curve.select("config", F.size("curve").cast("long").alias("n_points"), F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 4).alias("weighted"))


@query("w06_largest_budget", f"WITH {LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY budget DESC, seq DESC) AS k FROM log) SELECT config, seq, budget, loss FROM k WHERE k = 1")
def w06_largest_budget(spark, d):
    return trials.largest_budget_runs(_log(spark, d)).select("config", "seq", "budget", "loss")


@query("w07_promotion", f"WITH {LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY experiment, budget ORDER BY loss, seq) AS place FROM log) SELECT experiment, budget, seq, place::INTEGER AS place FROM k WHERE place <= 20")
def w07_promotion(spark, d):
    return trials.promoted(_log(spark, d), 20, ["experiment", "budget"]).select("experiment", "budget", "seq", "place")


@query(
    "w09_without_gaps",
    f"WITH {LOG}, e AS (SELECT *, max(finished) OVER (PARTITION BY experiment ORDER BY started, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM log), g AS (SELECT *, coalesce(greatest(started - pe, 0), 0) AS g FROM e) "
    "SELECT seq, round(started - sum(g) OVER (PARTITION BY experiment ORDER BY started, seq ROWS UNBOUNDED PRECEDING), 3) AS started FROM g",
)
def w09_without_gaps(spark, d):
    return trials.without_gaps(_log(spark, d)).select("seq", F.round("started", 3).alias("started"))


@query("a21_concurrency", f"WITH {LOG}, c AS (SELECT moment, sum(d) AS d FROM (SELECT started AS moment, 1 AS d FROM log UNION ALL SELECT finished, -1 FROM log) GROUP BY moment) SELECT moment, (sum(d) OVER (ORDER BY moment))::BIGINT AS n_running FROM c")
def a21_concurrency(spark, d):
    return trials.concurrency(_log(spark, d))


@query("a20_time_range", f"WITH {LOG}, m AS (SELECT experiment, min(started) AS first_start, max(finished) AS last_finish, max(budget) AS max_budget FROM log GROUP BY experiment) SELECT m.*, (SELECT min(loss) FROM log l WHERE l.experiment = m.experiment AND l.budget = m.max_budget) AS best_loss FROM m")
def a20_time_range(spark, d):
    return trials.time_range(_log(spark, d))


@query("a22_loss_histogram", f"WITH {LOG} SELECT budget, kind, CASE WHEN loss < 0 THEN 0 WHEN loss >= 200 THEN 21 ELSE floor(loss / 10)::BIGINT + 1 END AS bin, count(*) AS n FROM log GROUP BY 1, 2, 3")
def a22_loss_histogram(spark, d):
    return trials.loss_histogram(_log(spark, d), 0.0, 200.0, 20)


@query("a24_loss_summary", f"WITH {LOG} SELECT budget, round(quantile_cont(loss, 0.05), 6) AS p05, round(min(loss), 6) AS least, round(max(loss), 6) AS most, round(avg(loss), 6) AS mean, round(stddev_pop(loss), 6) AS deviation FROM log GROUP BY budget")
def a24_loss_summary(spark, d):
    return trials.loss_summary(_log(spark, d))


@query(
    "a23_budget_correlation",
    f"WITH {LOG}, o AS (SELECT config, budget, avg(loss) AS loss FROM log GROUP BY 1, 2), p AS (SELECT x.budget AS low, y.budget AS high, x.loss AS a, y.loss AS b FROM o x JOIN o y ON x.config = y.config AND x.budget < y.budget), "
    "r AS (SELECT low, high, rank() OVER (PARTITION BY low, high ORDER BY a) AS a, rank() OVER (PARTITION BY low, high ORDER BY b) AS b FROM p) SELECT low, high, round(corr(a, b), 6) AS spearman FROM r GROUP BY low, high",
)
def a23_budget_correlation(spark, d):
    return metrics.spearman(trials.budget_pairs(_log(spark, d)), ["low", "high"], "a", "b")


# ---- neighbours -----------------------------------------------------------------


def _points(spark, d) -> tuple[DataFrame, list[str]]:
    e, names = table(spark, d, "embeddings"), [f"x{i}" for i in range(64)]
    return e.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names))), names


NEAR = (
    "q AS (SELECT a.vec_id AS k, a.label AS l, b.vec_id AS nk, b.label AS nl, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS place "
    "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
)


@query("m09_knn_vote", f"WITH {NEAR}, v AS (SELECT k, l, nl, count(*) AS n FROM q WHERE place <= 5 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, nl) AS c FROM v) SELECT k AS \"key\", l AS label, nl AS prediction FROM r WHERE c = 1")
def m09_knn_vote(spark, d):
    rows, names = _points(spark, d)
    return estimators.knn_vote(rows, "vec_id", names, "label")


@query(
    "b10_tomek_links",
    "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), o AS (SELECT a.vec_id AS k, min([list_distance(a.e, b.e), b.vec_id])[2]::BIGINT AS nk FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY a.vec_id) "
    "SELECT o.k AS \"key\", o.nk AS near_key FROM o JOIN o b ON o.nk = b.k AND b.nk = o.k JOIN v x ON x.vec_id = o.k JOIN v y ON y.vec_id = o.nk WHERE x.label <> y.label",
)
def b10_tomek_links(spark, d):
    rows, names = _points(spark, d)
    return balance.tomek_links(rows, "vec_id", names, "label")


@query(
    "b11_edited_neighbours",
    f"WITH {NEAR}, m AS (SELECT label FROM embeddings GROUP BY label ORDER BY count(*), label::VARCHAR LIMIT 1), a AS (SELECT k, l, avg((l = nl)::INTEGER) AS same FROM q WHERE place <= 3 GROUP BY k, l) SELECT k AS vec_id, l AS label FROM a, m WHERE l = m.label OR same = 1",
)
def b11_edited_neighbours(spark, d):
    rows, names = _points(spark, d)
    return balance.edited(rows, "vec_id", names, "label").select("vec_id", "label")


# ---- models: checked by rows and by tests ----------------------------------------


@query("r01_pca")
def r01_pca(spark, d):
    rows, names = _points(spark, d)
    return _apply(rows, ["vec_id"], names, expand.Pca(ratio=0.05))


@query("m13_logistic")
def m13_logistic(spark, d):
    rows = estimators.assembled(_judged(spark, d), ["n_chars", "toxic"], "quality")
    model = estimators.make("logistic_regression", maxIter=20).fit(rows)
    return estimators.probability(model.transform(rows)).select("doc_id", "label", F.round("p", 6).alias("p"))


@query("m10_discriminant")
def m10_discriminant(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", *PAIRED)
    return estimators.Discriminant().fit(rows, PAIRED, "l_linestatus").transform(rows).select("l_orderkey", "l_linenumber", "l_linestatus", "prediction")


@query(
    "q03_ridge",
    "WITH s AS (SELECT count(*) * var_pop(l_quantity) + 1 AS a, count(*) * covar_pop(l_quantity, l_discount) AS b, count(*) * var_pop(l_discount) + 1 AS c, count(*) * covar_pop(l_quantity, l_extendedprice) AS x, count(*) * covar_pop(l_discount, l_extendedprice) AS y, "
    "avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS mp FROM lineitem), w AS (SELECT (c * x - b * y) / (a * c - b * b) AS u, (a * y - b * x) / (a * c - b * b) AS v, mq, md, mp FROM s) "
    "SELECT l_orderkey, l_linenumber, round(mp + (l_quantity - mq) * u + (l_discount - md) * v, 4) AS prediction FROM lineitem, w",
)
def q03_ridge(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *PAIRED)
    done = estimators.RidgeFamily("ridge", 1.0).fit(rows, ["l_quantity", "l_discount"], "l_extendedprice").transform(rows)
    return done.select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))


# ---- smaller questions --------------------------------------------------------------


@query("a08_fold_classes", f"WITH k AS (SELECT o_orderstatus, (({DEALT.format(y='o_orderstatus', key='o_orderkey')} - 1) % 5)::INTEGER AS fold FROM orders) SELECT fold, o_orderstatus AS \"class\", count(*) AS n FROM k GROUP BY 1, 2")
def a08_fold_classes(spark, d):
    folds = split.stratified_folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
    return split.fold_classes(folds, "o_orderstatus")


@query("a25_one_hot_megabytes", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(count(*) * count(DISTINCT {c}) * 8 / 1048576.0::DOUBLE, 6) AS megabytes FROM part" for c in ("p_brand", "p_type")))
def a25_one_hot_megabytes(spark, d):
    return one_hot_megabytes(table(spark, d, "part"), ["p_brand", "p_type"])


@query("s20_log_metadata", f"WITH {LOG} SELECT count(*) AS n_runs, count(DISTINCT config) AS n_configs, min(budget) AS min_budget, max(budget) AS max_budget, count(DISTINCT budget) AS n_budgets FROM log")
def s20_log_metadata(spark, d):
    return log_metadata(_log(spark, d)).select("n_runs", "n_configs", "min_budget", "max_budget", F.size("budgets").cast("long").alias("n_budgets"))


@query("z01_soft_vote", "SELECT user_id AS rid, round(avg(value), 6) AS p FROM events GROUP BY user_id")
def z01_soft_vote(spark, d):
    votes = table(spark, d, "events").select(F.col("user_id").alias("rid"), F.col("event_type").alias("model"), F.col("value").alias("p"))
    return _rounded(ensemble.soft_vote(votes), ["rid"])


@query("z04_aligned_predictions", "WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), m AS (SELECT n FROM s GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1) SELECT event_type AS model, n FROM s WHERE n = (SELECT n FROM m)")
def z04_aligned_predictions(spark, d):
    votes = table(spark, d, "events").select(F.col("event_type").alias("model"), "value")
    return ensemble.aligned(votes).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("t02_specific_trials", f"WITH {LOG} SELECT seq, config, loss FROM log WHERE seq IN (1, 5, 8)")
def t02_specific_trials(spark, d):
    return trials.specific(_log(spark, d), [1, 5, 8]).select("seq", "config", "loss")


@query("f11_sigmoid", "SELECT c_custkey, round(CASE WHEN c_acctbal / 100 > 20 THEN 1.0 WHEN c_acctbal / 100 < -20 THEN 0.0 ELSE 1 / (1 + exp(-c_acctbal / 100)) END::DOUBLE, 6) AS p FROM customer")
def f11_sigmoid(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(sigmoid(F.col("c_acctbal") / 100), 6).alias("p"))
