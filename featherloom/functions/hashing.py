"""Content fingerprints of tables, values and nested structures."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_hash(value) -> str:
    """md5 of a nested value; the order of keys and of list entries does not matter."""

    def canonical(v):
        if isinstance(v, dict):
            return {str(k): canonical(v[k]) for k in sorted(v, key=str)}
        if isinstance(v, (list, tuple, set, frozenset)):
            return sorted((canonical(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True, default=str))
        return v

    return hashlib.md5(json.dumps(canonical(value), sort_keys=True, default=str).encode()).hexdigest()


def row_text(df: DataFrame, digits: int = 3):
    """A row as text: floats with ``digits`` decimals, nulls told apart from empty strings."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        text = F.format_string(f"%.{digits}f", c.cast("double")) if kind in ("double", "float") else c.cast("string")
        parts.append(F.coalesce(F.concat(F.lit("v"), text), F.lit("n")))
    return F.concat_ws("\x1f", *parts)


def table_hash(df: DataFrame, digits: int = 3) -> str:
    """A fingerprint of a table's columns and rows; order and partitioning do not matter.

    One aggregate over 64-bit row hashes, exact sums in decimals; repeated rows count.
    """
    text = row_text(df, digits)
    low, high = F.xxhash64(text), F.xxhash64(text, F.lit(1))
    sums = df.select(low.cast("decimal(38,0)").alias("a"), high.cast("decimal(38,0)").alias("b")).agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    return value_hash([[list(x) for x in df.dtypes], [str(x) for x in sums]])
