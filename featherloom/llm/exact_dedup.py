"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each input partition hashes its texts, sorts the distinct hashes and sends every
owner (a range of hash values) its share, Golomb-Rice coded. An owner sees which
hashes came from more than one sender and answers each sender with a bitmap over
the list that it had sent. Only texts under a marked hash, the suspects, are
shuffled, and groups form on the text itself, byte for byte: equal fingerprints
alone never join two documents.

Cases. Null text counts as empty text. Null ids: a null id is below every other id;
a group of null ids keeps one row. Repeated rows (same id, same text) count each in
``group_size`` and one of them stays. Empty tables give empty results. Extra columns
pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import golomb
from .common import cut, own, shuffle_partitions

#: Senders flush after this many hashes, so that a partition of any size fits in memory.
SENDER_ROWS = 4_000_000
#: A list of suspects up to this length (16 bytes each and table overhead) is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 500_000

SKETCH = "owner int, sender long, n int, rice int, unary binary, rest binary, again binary"
REPLY = "sender long, owner int, both binary"


def owner_bits(partitions: int) -> int:
    """log2 of the number of owners: as many as shuffle partitions, 8 to 4096."""
    return max(3, min(12, (max(1, partitions) - 1).bit_length()))


def _send(bits: int):
    def flush(sender: int, parts: list[np.ndarray]):
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        owners = (values >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.searchsorted(owners, np.arange((1 << bits) + 1))
        for owner in np.unique(owners):
            lo, hi = edges[owner], edges[owner + 1]
            base = np.uint64(owner) << np.uint64(64 - bits)
            rice, unary, rest = golomb.encode(values[lo:hi] - base)
            again = np.packbits(counts[lo:hi] > 1).tobytes()
            yield int(owner), sender, int(hi - lo), rice, unary, rest, again

    def send(batches):
        held, rows, chunk, part = [], 0, 0, None
        columns = [c.split()[0] for c in SKETCH.split(", ")]
        for batch in batches:
            if not len(batch):
                continue
            part = int(batch["part"].iloc[0])
            held.append(batch["hash"].to_numpy(np.int64).view(np.uint64))
            rows += len(batch)
            if rows >= SENDER_ROWS:
                yield pd.DataFrame(list(flush(part << 20 | chunk, held)), columns=columns)
                held, rows, chunk = [], 0, chunk + 1
        if held:
            yield pd.DataFrame(list(flush(part << 20 | chunk, held)), columns=columns)

    return send


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """An owner's replies: for each sender, a bitmap of the hashes that another sender has too."""
    lists = [golomb.decode(*x) for x in zip(group["n"], group["rice"], group["unary"], group["rest"], strict=True)]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    both = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"sender": group["sender"], "owner": group["owner"], "both": both})


def _suspects(bits: int):
    def suspects(batches):
        for batch in batches:
            found = []
            for owner, n, rice, unary, rest, again, both in zip(*(batch[c] for c in ("owner", "n", "rice", "unary", "rest", "again", "both")), strict=True):
                mark = np.frombuffer(again, np.uint8) | np.frombuffer(both, np.uint8)
                if mark.any():
                    values = golomb.decode(n, rice, unary, rest) + (np.uint64(owner) << np.uint64(64 - bits))
                    found.append(values[np.unpackbits(mark)[:n].astype(bool)])
            if found:
                yield pd.DataFrame({"hash": np.concatenate(found).view(np.int64)})

    return suspects


def suspect_hashes(hashes: DataFrame) -> DataFrame:
    """The distinct values of column ``hash`` that occur on more than one row, by the exchange."""
    spark = hashes.sparkSession
    bits = owner_bits(shuffle_partitions(spark))
    sketches = cut(hashes.select("hash", F.spark_partition_id().alias("part")).mapInPandas(_send(bits), SKETCH))
    replies = sketches.drop("again").groupBy("owner").applyInPandas(_answer, REPLY)
    told = sketches.join(replies, ["sender", "owner"])
    return told.mapInPandas(_suspects(bits), "hash long").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None) -> DataFrame:
    """``docs`` with keep_id, group_size and kept: of equal texts the row with the largest id stays.

    ``normalise`` is an expression over ``docs``; texts are equal when it gives the same
    string. By default it is the text itself. Columns of those three names are replaced.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    text, mark, h, rank = own(docs, "text", "suspect", "hash", "rank")
    rows = docs.withColumn(text, F.coalesce(F.col(text_col) if normalise is None else normalise, F.lit("")).cast("string"))
    rows = rows.withColumn(h, F.xxhash64(text))
    found = cut(suspect_hashes(rows.select(F.col(h).alias("hash")))).select(F.col("hash").alias(h), F.lit(True).alias(mark))
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = rows.join(found, h, "left")
    alone = rows.where(F.col(mark).isNull()).withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    suspects = rows.where(F.col(mark).isNotNull())
    # partial sums per partition come first, so a text with a third of all rows arrives as a few
    groups = cut(suspects.groupBy(h, text).agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    # ranks come before the join and groups are read anew: nothing around the join then needs a text's rows
    # together, and Spark can split a hot text
    same = Window.partitionBy(id_col, h, text).orderBy(F.lit(1))
    joined = suspects.withColumn(rank, F.row_number().over(same)).join(groups, [h, text])
    joined = joined.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col(rank) == 1))
    out = [*docs.columns, "keep_id", "group_size", "kept"]
    return alone.select(out).unionByName(joined.select(out))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its own columns, also those named as the decisions are."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    moved = docs.toDF(*names.values())
    return exact_dedup(moved, names[id_col], names[text_col]).where("kept").select(*names.values()).toDF(*docs.columns)
