"""Tokens, document frequencies, weights and topics of text columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clean_text, tokens
from ..session import cut
from .base import Fitted, Operator


def tokenise(df: DataFrame, c: str, made: str | None = None) -> DataFrame:
    """``df`` with the cleaned tokens of a text column."""
    return df.withColumn(made or c, tokens(clean_text(F.col(f"`{c}`"))))


def token_counts(df: DataFrame, c: str) -> DataFrame:
    """(token, n): occurrences of each token over all rows of a token column."""
    return df.select(F.explode(c).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(df: DataFrame, c: str) -> DataFrame:
    """(token, df): the number of rows that have each token."""
    return df.select(F.explode(F.array_distinct(c)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def keep_frequent(df: DataFrame, key: str, c: str, least: int = 1) -> DataFrame:
    """Token lists with only the tokens that occur more than ``least`` times, in their order.

    The counts stay distributed: tokens are joined with their counts and put together again
    by row; ``key`` names each row. Rows left without tokens have an empty list.
    """
    long = df.select(key, F.posexplode(c).alias("place", "token"))
    kept = long.join(token_counts(df, c).where(F.col("n") > least).select("token"), "token", "left_semi")
    again = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda t: t["token"]).alias("__kept"))
    return df.join(again, key, "left").withColumn(c, F.coalesce("__kept", F.array().cast("array<string>"))).drop("__kept")


def tf_idf(df: DataFrame, key: str, c: str, letters: int = 2) -> DataFrame:
    """(key, token, weight): counts times ln((1 + n) / (1 + df)) + 1, rows of norm 1.

    Tokens are lower-cased; shorter ones than ``letters`` are left out.
    """
    rows = df.count()
    long = df.select(key, F.explode(c).alias("token")).where(F.length("token") >= letters).select(key, F.lower("token").alias("token"))
    # dealt by row once: the counts, and later the norms, need no other shuffle
    tf = cut(long.repartition(key).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf")))
    idf = tf.groupBy("token").agg((F.log(F.lit(1 + rows) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    raw = tf.join(idf, "token").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "token", (F.col("raw") / norm).alias("weight"))


def _vectors(df: DataFrame, c: str, size: int):
    from pyspark.ml.feature import CountVectorizer

    model = CountVectorizer(inputCol=c, outputCol="__v", vocabSize=size).fit(df)
    return model.transform(df), model


def _expand(df: DataFrame, source: str, c: str, k: int) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    a = vector_to_array(source)
    return df.withColumns({f"{c}_{i}": a[i] for i in range(k)}).drop(source, "__v")


def lda_model(df: DataFrame, c: str, topics: int = 10, rounds: int = 20, vocabulary: int = 1 << 18, least: float = 0.0, seed: int = 1):
    """A function that adds the topic mixture of each row as ``c_0`` onwards; see ``lda_topics``."""
    from pyspark.ml.clustering import LDA

    rows, counter = _vectors(df, c, vocabulary)
    model = LDA(k=topics, maxIter=rounds, featuresCol="__v", topicDistributionCol="__t", seed=seed).fit(rows)

    def add(d: DataFrame) -> DataFrame:
        done = _expand(model.transform(counter.transform(d)), "__t", c, topics)
        if least > 0:
            total = sum((F.when(F.col(f"{c}_{i}") >= least, F.col(f"{c}_{i}")).otherwise(0.0) for i in range(topics)), F.lit(0.0))
            done = done.withColumn("__all", total)
            done = done.withColumns({f"{c}_{i}": F.when(F.col(f"{c}_{i}") >= least, F.col(f"{c}_{i}") / F.col("__all")).otherwise(0.0) for i in range(topics)}).drop("__all")
        return done

    return add


def lda_topics(df: DataFrame, c: str, topics: int = 10, rounds: int = 20, vocabulary: int = 1 << 18, least: float = 0.0, seed: int = 1) -> DataFrame:
    """The topic mixture of each row as ``c_0`` onwards.

    With ``least`` above 0, shares below it are set to zero and the rest scaled: many
    topics pruned in this way stand in for a model that finds their number itself.
    """
    return lda_model(df, c, topics, rounds, vocabulary, least, seed)(df)


def svd_model(df: DataFrame, c: str, topics: int = 10, vocabulary: int = 1 << 12, weighted: bool = True):
    """A function that adds the coordinates of each row along the leading right singular vectors of its token weights (or counts)."""
    import numpy as np
    from pyspark.ml.feature import IDF
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows, counter = _vectors(df, c, vocabulary)
    idf = IDF(inputCol="__v", outputCol="__w").fit(rows) if weighted else None
    weigh = lambda d: idf.transform(d) if weighted else d.withColumn("__w", F.col("__v"))
    # the vectors stay sparse on their way into the matrix
    matrix = RowMatrix(weigh(rows).select("__w").rdd.map(lambda r: Vectors.fromML(r["__w"])))
    v = matrix.computeSVD(topics).V.toArray()
    v = v * np.where(v[np.abs(v).argmax(0), range(v.shape[1])] < 0, -1, 1)

    def add(d: DataFrame) -> DataFrame:
        w = vector_to_array("__w")
        made = {f"{c}_{i}": F.aggregate(F.zip_with(w, F.array(*map(F.lit, v[:, i].tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for i in range(v.shape[1])}
        return weigh(counter.transform(d)).withColumns(made).drop("__v", "__w")

    add.width = v.shape[1]
    return add


def svd_topics(df: DataFrame, c: str, topics: int = 10, vocabulary: int = 1 << 12) -> DataFrame:
    """Coordinates of each row along the leading right singular vectors of its token weights; the most frequent tokens count."""
    return svd_model(df, c, topics, vocabulary)(df)


@dataclass
class Topics(Operator):
    """Topics of text columns as number columns, in place of the text.

    ``kind`` is lsi (weighted) or tsvd (counts), lda, hdp (LDA of many topics, small shares
    pruned: a declared substitute), nmf (the topics' token weights are fitted, and a row's
    own are its tokens' mean: a declared substitute) or random_projection.
    """

    kind: str = "lsi"
    topics: int = 10

    def fit(self, df, names, y=None):
        adds, made = [], {}
        for c in names:
            words = f"__words_{c}"
            rows = tokenise(df, c, words)
            width = self.topics
            if self.kind in ("lsi", "tsvd"):
                add = svd_model(rows, words, self.topics, weighted=self.kind == "lsi")
                width = add.width
            elif self.kind in ("lda", "hdp"):
                add = lda_model(rows, words, self.topics, least=0.05 if self.kind == "hdp" else 0.0)
            elif self.kind == "nmf":
                add = nmf_model(rows, words, self.topics)
            else:
                add = lambda d, words=words: random_projection(d, words, self.topics)
            adds.append(lambda d, c=c, words=words, add=add: add(tokenise(d, c, words)))
            made |= {f"{c}_{i}": F.col(f"`{words}_{i}`") for i in range(width)}

        def through(d: DataFrame) -> DataFrame:
            for add in adds:
                d = add(d)
            return d

        temporary = [f"__words_{c}" for c in names] + [f"__words_{m}" for m in made]
        return Fitted(made, [*names, *temporary], {"kind": self.kind}, "num", through)


def _numbered(df: DataFrame, c: str, made: str) -> DataFrame:
    """(c, made): the distinct values of a column with numbers from 0, as whole numbers of 32 bits."""
    from .order import running

    values = df.select(c).where(F.col(c).isNotNull()).distinct()
    return running(values, [], [c], {made: ("count", F.lit(1))}, exclusive=True).withColumn(made, F.col(made).cast("int"))


def nmf_topics(df: DataFrame, key: str, c: str, topics: int = 10, rounds: int = 10, seed: int = 1) -> DataFrame:
    """Non-negative factors of each row's token counts, by alternating least squares: ``c_0`` onwards. ``key`` names each row, of any type."""
    from pyspark.ml.recommendation import ALS

    long = df.select(F.col(key).alias("__key"), F.explode(c).alias("__token"))
    users, items = cut(_numbered(long, "__key", "u")), cut(_numbered(long, "__token", "i"))
    counts = long.groupBy("__key", "__token").agg(F.count(F.lit(1)).cast("float").alias("r")).join(users, "__key").join(items, "__token").select("u", "i", "r")
    model = ALS(rank=topics, maxIter=rounds, nonnegative=True, userCol="u", itemCol="i", ratingCol="r", seed=seed).fit(counts)
    factors = model.userFactors.select(F.col("id").alias("u"), *(F.col("features")[i].cast("double").alias(f"{c}_{i}") for i in range(topics))).join(users, "u").drop("u")
    return df.join(factors, F.col(key) == F.col("__key"), "left").drop("__key").fillna(0.0, [f"{c}_{i}" for i in range(topics)])


def nmf_model(df: DataFrame, c: str, topics: int = 10, rounds: int = 10, seed: int = 1):
    """A function that adds the mean of a row's tokens' non-negative factors as ``c_0`` onwards; tokens unknown then count as zero."""
    from pyspark.ml.recommendation import ALS

    rows = cut(df.select(F.xxhash64(c).alias("__key"), F.col(c).alias("__words")))
    long = rows.select("__key", F.explode("__words").alias("__token"))
    users, items = cut(_numbered(long, "__key", "u")), cut(_numbered(long, "__token", "i"))
    counts = long.groupBy("__key", "__token").agg(F.count(F.lit(1)).cast("float").alias("r")).join(users, "__key").join(items, "__token").select("u", "i", "r")
    model = ALS(rank=topics, maxIter=rounds, nonnegative=True, userCol="u", itemCol="i", ratingCol="r", seed=seed).fit(counts)
    factors = cut(model.itemFactors.withColumnRenamed("id", "i").join(items, "i").select("__token", F.col("features").cast("array<double>").alias("__f")))

    def add(d: DataFrame) -> DataFrame:
        # written with the rows, so that both sides of the join see the same numbers
        numbered = cut(d.withColumn("__n", F.monotonically_increasing_id()))
        found = numbered.select("__n", F.explode(c).alias("__token")).join(factors, "__token", "left")
        means = found.groupBy("__n").agg(*(F.avg(F.coalesce(F.col("__f")[i], F.lit(0.0))).alias(f"{c}_{i}") for i in range(topics)))
        return numbered.join(means, "__n", "left").drop("__n").fillna(0.0, [f"{c}_{i}" for i in range(topics)])

    return add


def random_projection(df: DataFrame, c: str, width: int = 16, seed: int = 1) -> DataFrame:
    """Sums of signs that a hash deals to each token: ``c_0`` onwards."""
    sign = lambda t, i: F.when(F.pmod(F.xxhash64(t, F.lit(seed * 1000 + i)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    scale = width**-0.5
    made = {f"{c}_{i}": F.aggregate(F.transform(c, lambda t, i=i: sign(t, i)), F.lit(0.0), lambda s, x: s + x) * scale for i in range(width)}
    return df.withColumns(made)
