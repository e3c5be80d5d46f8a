"""Scalar functions as column expressions; everything stays inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that text cleaning turns into spaces.
CLEANED = "\r\n!\"'#$&()*+,-./:;<=>?@[\\]^_{|}~`0123456789"


def clean_text(text: Column) -> Column:
    """Line ends, most ASCII punctuation and digits become spaces; letters keep their case."""
    return F.translate(text, CLEANED, " " * len(CLEANED))


def tokens(text: Column) -> Column:
    """Runs of non-space characters; null text gives an empty list."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def join_tokens(words: Column) -> Column:
    return F.array_join(words, " ")


def md5_bucket(text: Column, buckets: int | None = None) -> Column:
    """The first five hex digits of the md5 as an integer, modulo ``buckets`` if given."""
    n = F.conv(F.substring(F.md5(text), 1, 5), 16, 10).cast("long")
    return n if buckets is None else F.pmod(n, F.lit(buckets))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip_infinite(x: Column, low: Column, high: Column) -> Column:
    """Infinities to the finite bounds, NaN to their middle."""
    x = x.cast("double")
    return F.when(F.isnan(x), (low + high) / 2).when(x == float("inf"), high).when(x == float("-inf"), low).otherwise(x)


def nan_to_null(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def null_to_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("nan")))


def sigmoid(x: Column, most: float = 20.0) -> Column:
    """The logistic function; beyond ``most`` it is exactly 0 or 1."""
    return F.when(x > most, 1.0).when(x < -most, 0.0).otherwise(1 / (1 + F.exp(-x)))


def softmax(x: Column) -> Column:
    """Of an array, shifted by its largest entry."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))


def argmax(p: Column) -> Column:
    """The position, from 0, of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def binarise(p: Column, at: float = 0.5) -> Column:
    return F.when(p > at, 1).otherwise(0)


#: Unary transforms: what they compute, and for which column statistics they are defined.
UNARY: dict[str, tuple[Callable[[Column], Column], Callable[[dict], bool]]] = {
    "exp": (F.exp, lambda s: s["max"] < 10),
    "exp-": (lambda x: F.exp(-x), lambda s: -s["min"] < 10),
    "log": (F.log, lambda s: s["min"] > 0),
    "abs": (F.abs, lambda s: s["min"] < 0),
    "sqrt": (F.sqrt, lambda s: s["min"] >= 0),
    "sin": (F.sin, lambda s: True),
    "cos": (F.cos, lambda s: True),
    "2^": (lambda x: F.pow(F.lit(2.0), x), lambda s: s["max"] < 50),
    "^2": (lambda x: x * x, lambda s: s["most"] < 1e6),
    "^3": (lambda x: x * x * x, lambda s: s["most"] < 1e4),
    "1+": (lambda x: 1 + x, lambda s: True),
    "1-": (lambda x: 1 - x, lambda s: True),
    "1/": (lambda x: 1 / x, lambda s: s["least"] > 0),
}

#: Binary combinations of two columns.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "x+y": lambda x, y: x + y,
    "x*y": lambda x, y: x * y,
    "x-y": lambda x, y: x - y,
    "y-x": lambda x, y: y - x,
}
