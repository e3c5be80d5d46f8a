"""Folds, subsamples and weights by hashes of keys: the same rows at every run and partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import hash_rank, quantiles

FOLD = "_fold"


def dealt(key: str, seed: int = 0) -> Column:
    """A text that orders rows at random, but alike at each run."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_folds(df: DataFrame, key: str, y: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with a fold for each row; every fold has its share of each class, to a row."""
    ranked = hash_rank(df, [y], dealt(key, seed), key, "__k")
    return ranked.withColumn(FOLD, ((F.col("__k") - 1) % k).cast("int")).drop("__k")


def hash_folds(df: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Folds by the key's hash alone: no shuffle, nearly equal sizes; for continuous targets and groups."""
    return df.withColumn(FOLD, F.pmod(F.conv(F.substring(dealt(key, seed), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def holdout(df: DataFrame, key: str, parts: int = 3, seed: int = 0) -> DataFrame:
    """One split: fold 0 is the validation part, 1 / ``parts`` of the rows."""
    return df.withColumn(FOLD, F.when(F.col(FOLD) == 0, 0).otherwise(1)) if FOLD in df.columns else holdout(hash_folds(df, key, parts, seed), key, parts, seed)


def default_splitter(rows: int, classify: bool, most: int = 5000) -> Callable[[DataFrame, str, str], DataFrame]:
    """One split for more than ``most`` rows, else five folds, stratified for classes."""
    if rows > most:
        return lambda df, key, y: holdout(df, key)
    return (lambda df, key, y: stratified_folds(df, key, y)) if classify else (lambda df, key, y: hash_folds(df, key))


def stratified_sample(df: DataFrame, key: str, y: str, share: float, seed: int = 0) -> DataFrame:
    """A share of each class, a row of each at least."""
    sizes = df.groupBy(F.col(y).alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = hash_rank(df, [y], dealt(key, seed), key, "__k").join(sizes, F.col(y).eqNullSafe(F.col("__y")))
    return ranked.where(F.col("__k") <= F.greatest(F.lit(1), F.round(F.col("__n") * share))).drop("__n", "__k", "__y")


def binned(df: DataFrame, y: str, made: str, bins: int = 5) -> DataFrame:
    """A continuous target as quantile bins, so that it can be stratified."""
    cuts = quantiles(df, {y: F.col(y)}, [i / bins for i in range(1, bins)])[y]
    return df.withColumn(made, sum(((F.col(y) > c).cast("int") for c in cuts if c is not None), F.lit(0)))


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """(class, n, weight): n / (k * n_c), of mean 1."""
    counts = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"))
    return counts.join(F.broadcast(whole)).select("class", "n", F.round(F.col("rows") / (F.col("k") * F.col("n")), 6).alias("weight"))


def with_weights(df: DataFrame, y: str, made: str = "_weight") -> DataFrame:
    """Rows with the balanced weight of their class; the class table is as small as the classes are few."""
    return df.join(F.broadcast(class_weights(df, y).select(F.col("class").alias("__c"), F.col("weight").alias(made))), F.col(y) == F.col("__c"), "left").drop("__c")


def imbalance(df: DataFrame, y: str, above: float = 2.0) -> DataFrame:
    """(ratio, imbalanced): largest over smallest class."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.try_divide(F.max("n"), F.min("n")).cast("double")
    return counts.agg(F.round(ratio, 6).alias("ratio"), (ratio > above).alias("imbalanced"))


def fold_classes(df: DataFrame, y: str) -> DataFrame:
    """(fold, class, n)."""
    return df.groupBy(F.col(FOLD).alias("fold"), F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))
