"""Column profiles and inferred feature groups, each from one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values, as text and with nulls as one of them, from which a category counts as of high cardinality.
HIGH_CARDINALITY = 4
#: Timestamp formats that make a string column a date.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")


def is_number(kind: str) -> bool:
    return kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def as_text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))


def profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_null, null_ratio, n_distinct, min_text, max_text), a row per column.

    Nulls and ends come from one aggregate; distinct texts from (column, text) pairs, put
    together where they are read, so that a row is not copied whole for each column. Nested
    columns are left out.
    """
    kinds = dict(df.dtypes)
    names = [c for c in names or df.columns if not kinds[c].startswith(("array", "map", "struct"))]
    stats = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        stats += [F.count_if(x.isNull()).alias(f"null_{i}"), F.min(x).cast("string").alias(f"min_{i}"), F.max(x).cast("string").alias(f"max_{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *stats)
    pairs = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), as_text(c).alias("v")) for i, c in enumerate(names)))))
    distinct = pairs.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    rows = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(c).alias("column_name"),
            F.col("n").alias("n_rows"),
            F.col(f"null_{i}").alias("n_null"),
            F.round(F.try_divide(F.col(f"null_{i}"), F.col("n")).cast("double"), 6).alias("null_ratio"),
            F.col(f"min_{i}").alias("min_text"),
            F.col(f"max_{i}").alias("max_text"),
        )
        for i, c in enumerate(names)
    ]
    joined = one.select(F.inline(F.array(*rows))).join(distinct, "i", "left")
    return joined.select("column_name", "n_rows", "n_null", "null_ratio", F.coalesce("d", F.lit(0).cast("long")).alias("n_distinct"), "min_text", "max_text")


def has_null(c: Column) -> Column:
    """Aggregate: whether any value is null."""
    return F.coalesce(F.bool_or(c.isNull()), F.lit(False))


def null_ratio_above(c: Column, ratio: float) -> Column:
    """Aggregate: whether the share of nulls is above ``ratio``."""
    return F.coalesce(F.try_divide(F.count_if(c.isNull()), F.count(F.lit(1))) > ratio, F.lit(False))


def all_dates(c: Column) -> Column:
    """Aggregate: whether every value that is not null reads as a date."""
    read = F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS))
    return F.coalesce(F.bool_and(c.isNull() | read.isNotNull()), F.lit(True))


def all_text(c: Column) -> Column:
    """Aggregate: whether every value has two words or more; a null has none."""
    return F.coalesce(F.bool_and(F.size(F.split(F.coalesce(c, F.lit("nan")), " ")) >= 2), F.lit(True))


def infer_groups(df: DataFrame, described: dict[str, str] | None = None, threshold: int = HIGH_CARDINALITY) -> dict[str, str]:
    """A feature group for each column.

    Numbers are ``num``, timestamps and dates ``date``; strings (and booleans) are ``date``
    or ``text`` if all values are, numbers if all values read as such, else ``cat``, or
    ``highC_cat`` from ``threshold`` distinct values on. A described ``cat`` is promoted by
    the same rule. One aggregate answers all questions for all columns.
    """
    described, kinds, asks, found = described or {}, dict(df.dtypes), [], {}
    for c, kind in kinds.items():
        x = F.col(f"`{c}`")
        told = described.get(c)
        if told and told != "cat":
            found[c] = told
        elif told or kind in ("string", "boolean"):
            text = x.cast("string")
            asks.append(
                F.struct(
                    all_dates(text).alias("date"),
                    all_text(text).alias("text"),
                    F.coalesce(F.bool_and(text.isNull() | text.try_cast("double").isNotNull()), F.lit(True)).alias("number"),
                    F.count_distinct(as_text(c)).alias("distinct"),
                ).alias(c)
            )
            found[c] = "cat"
        elif kind.startswith(("timestamp", "date")):
            found[c] = "date"
        else:
            found[c] = "num" if is_number(kind) else "ignore"
    if asks:
        answers = df.agg(*asks).first().asDict()
        for c, a in answers.items():
            high = "highC_cat" if a["distinct"] >= threshold else "cat"
            if c in described:
                found[c] = high
            else:
                found[c] = "num" if a["number"] and kinds[c] == "string" else "date" if a["date"] and kinds[c] == "string" else "text" if a["text"] else high
    return {c: found[c] for c in df.columns}


def target_task(df: DataFrame, y: str) -> DataFrame:
    """(n_distinct, any_fraction, task, needs_encoding) of a target column.

    Two values make a binary task, more whole numbers or strings a multiclass one,
    fractions a continuous one. Encoding is needed unless the distinct values are 0..k-1.
    """
    c = F.col(y)
    number = c.try_cast("double") if dict(df.dtypes)[y] == "string" else c.cast("double")
    one = df.where(c.isNotNull()).agg(
        F.count_distinct(c).alias("n_distinct"),
        F.coalesce(F.bool_or(number != F.floor(number)), F.lit(False)).alias("any_fraction"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.coalesce(F.bool_or(number.isNull()), F.lit(False)).alias("any_word"),
    )
    task = F.when(F.col("n_distinct") <= 2, "binary").when(F.col("any_fraction"), "continuous").otherwise("multiclass")
    plain = ~F.col("any_word") & ~F.col("any_fraction") & (F.col("low") == 0) & (F.col("high") == F.col("n_distinct") - 1)
    return one.select("n_distinct", "any_fraction", task.alias("task"), (~plain).alias("needs_encoding"))


def one_hot_megabytes(df: DataFrame, names: list[str], bytes_each: int = 8) -> DataFrame:
    """Rows times one-hot width of each category column, in MB."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(names)))
    rows = [F.struct(F.lit(c).alias("column_name"), F.round(F.col("n") * F.col(f"d{i}") * bytes_each / F.lit(1048576.0), 6).alias("megabytes")) for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))
