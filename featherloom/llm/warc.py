"""Merkle fixity audit of WARC replicas.

Records lie in volumes at offsets. The leaves of a volume's tree are ordered offset
ranges of ``RANGE_BYTES``: a leaf hashes, in order of offset, the digests of the records
that start in its range. Every ``FANOUT`` neighbours share a parent, up to the volume's
root; volumes have parents in the same way, up to one root for the replica. An audit
compares the roots of two replicas and descends only into branches that differ; the
records of the differing leaves are compared by their ids.

Trees hold no record bytes; digests are taken where the records are read. Levels are
DataFrames keyed by volume and range, built by grouped aggregates of at most ``FANOUT``
children each; only the number of levels comes to the driver.

Cases. Null payloads, urls and ids are written as empty; records of equal id in a volume
are told apart by their order. Empty replicas have no root: against a full one all
records are missing or extra. Extra columns are not read. A record of any length is
hashed whole and belongs to the range in which it starts.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .sharding import BUCKET_ROWS, ranked

RANGE_BYTES, FANOUT = 1 << 16, 16
#: Records that a volume has, by ranges of ids.
VOLUME_IDS = 512


def page_record(id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Column:
    """A page as the text of a WARC resource record."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    payload = said(payload_col)
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), said(id_col),
        F.lit(">\r\nWARC-Target-URI: "), said(url_col),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def lay_out(records: DataFrame, rows: int, id_col: str = "id", record_col: str = "record", volume_col: str = "volume") -> DataFrame:
    """(volume, offset, length, id, digest): the manifest of records put one after another in their volumes.

    The order in a volume is that of ids and digests. Offsets are prefix sums within ranges
    of about ``BUCKET_ROWS`` of the ``rows`` records, and over them, so no task holds a large volume.
    """
    length = F.octet_length(record_col).cast("long")
    each = records.select(F.col(volume_col).alias("volume"), F.col(id_col).alias("id"), length.alias("length"), F.sha2(record_col, 256).alias("digest"))
    # the number of its range is written with each row, so that no later run deals them otherwise
    dealt = cut(each.repartitionByRange(max(1, rows // BUCKET_ROWS), "volume", "id", "digest").withColumn("range", F.spark_partition_id()))
    ahead = Window.partitionBy("volume").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("volume", "range").agg(F.sum("length").alias("total"))
    totals = totals.select(F.col("volume").alias("v"), F.col("range").alias("r"), F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("volume", "range").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("length").over(within), F.lit(0)))
    placed = inside.join(totals, F.col("volume").eqNullSafe(F.col("v")) & (F.col("range") == F.col("r")))
    return placed.select("volume", (F.col("inside") + F.col("before")).alias("offset"), "length", "id", "digest")


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of uncompressed WARC files: a volume per file, ids by WARC-Record-ID."""

    def records(batches):
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                found, at = [], 0
                while (head := raw.find(b"\r\n\r\n", at)) >= 0:
                    fields = dict(x.split(b": ", 1) for x in raw[at:head].split(b"\r\n")[1:] if b": " in x)
                    end = min(len(raw), head + 8 + int(fields.get(b"Content-Length", b"0")))
                    digest = hashlib.sha256(raw[at:end]).hexdigest()
                    found.append((name.rsplit("/", 1)[-1], at, end - at, fields.get(b"WARC-Record-ID", b"").decode("utf-8", "replace"), digest))
                    at = end
                yield pd.DataFrame(found, columns=["volume", "offset", "length", "id", "digest"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(records, "volume string, offset long, length long, id string, digest string")


def leaves(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(volume, part, hash): the leaf of each offset range that records start in."""
    inside = F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("offset", "length", "digest"))), lambda r: F.concat_ws(",", r["offset"].cast("string"), r["length"].cast("string"), r["digest"])))
    part = F.floor(F.col("offset") / range_bytes).alias("part")
    return manifest.groupBy("volume", part).agg(F.sha2(inside, 256).alias("hash"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above: every ``fanout`` parts under one hash."""
    joined = F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("part", "hash"))), lambda r: F.concat_ws(",", r["part"].cast("string"), r["hash"])))
    return nodes.groupBy("volume", F.floor(F.col("part") / fanout).alias("part")).agg(F.sha2(joined, 256).alias("hash"))


def _levels(most: int, fanout: int) -> int:
    n = 0
    while most > 0:
        most, n = most // fanout, n + 1
    return n


class Tree:
    """A replica's levels, leaves first; the last level has the root alone."""

    def __init__(self, manifest: DataFrame, within: int, across: int, numbers: DataFrame):
        self.manifest, self.levels = manifest, [cut(leaves(manifest))]
        for _ in range(within):
            self.levels.append(cut(parents(self.levels[-1])))
        # volumes become the parts of one tree
        top = self.levels[-1].join(numbers, "volume").select(F.lit("").alias("volume"), F.col("number").alias("part"), "hash")
        self.top = [cut(top)]
        for _ in range(across):
            self.top.append(cut(parents(self.top[-1])))

    def root(self) -> str | None:
        found = self.top[-1].select("hash").first()
        return found[0] if found else None


def trees(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[Tree, Tree, DataFrame]:
    """The trees of two manifests, of equal height, and the numbers of their volumes."""
    a, b = cut(a.withColumn("volume", F.coalesce(F.col("volume").cast("string"), F.lit("")))), cut(b.withColumn("volume", F.coalesce(F.col("volume").cast("string"), F.lit(""))))
    volumes = a.select("volume").union(b.select("volume")).distinct()
    count = volumes.count()
    lane = volumes.withColumn("lane", F.lit(0))
    numbers = cut(ranked(lane, ["lane"], [F.col("volume")], count, "number").drop("lane"))
    most = a.select("offset").union(b.select("offset")).agg(F.max("offset")).first()[0] or 0
    within, across = _levels(most // range_bytes, FANOUT), _levels(max(0, count - 1), FANOUT)
    return Tree(a, within, across, numbers), Tree(b, within, across, numbers), numbers


def _differing(x: DataFrame, y: DataFrame, above: DataFrame | None) -> DataFrame:
    """(volume, part) at which two levels differ, below differing parents only."""
    if above is not None:
        parent = above.select("volume", F.col("part").alias("up"))
        x, y = (n.withColumn("up", F.floor(F.col("part") / FANOUT)).join(parent, ["volume", "up"], "left_semi") for n in (x, y))
    both = x.select("volume", "part", F.col("hash").alias("h")).join(y.select("volume", "part", F.col("hash").alias("k")), ["volume", "part"], "full_outer")
    return both.where(~F.col("h").eqNullSafe(F.col("k"))).select("volume", "part")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume, id, status, offset, length, digest, other_digest) for records that the replicas do not share.

    ``a`` and ``b`` are manifests. Status is corrupt (another digest), missing (not in b),
    extra (not in a) or moved (intact at another offset); offset, length and digest are
    a's, or b's for extra records.
    """
    left, right, numbers = trees(a, b)
    differ = None
    for x, y in zip(reversed(left.top), reversed(right.top), strict=True):
        differ = cut(_differing(x, y, differ))
    named = differ.join(numbers, differ["part"] == numbers["number"]).select(numbers["volume"])
    top_x, top_y = (t.levels[-1].join(named, "volume", "left_semi") for t in (left, right))
    differ = cut(_differing(top_x, top_y, None))
    for x, y in zip(reversed(left.levels[:-1]), reversed(right.levels[:-1]), strict=True):
        differ = cut(_differing(x, y, differ))
    again = Window.partitionBy("volume", "id").orderBy("offset")

    def suspects(t: Tree) -> DataFrame:
        part = t.manifest.withColumn("part", F.floor(F.col("offset") / RANGE_BYTES)).join(differ, ["volume", "part"], "left_semi")
        return part.withColumn("nth", F.row_number().over(again))

    x, y = suspects(left), suspects(right)
    y = y.select(*(F.col(c).alias(f"other_{c}") for c in ("volume", "id", "nth", "offset", "length", "digest")))
    same = [F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in ("volume", "id", "nth")]
    both = x.join(y, same, "full_outer")
    status = (
        F.when(F.col("digest").isNull(), "extra").when(F.col("other_digest").isNull(), "missing")
        .when(F.col("digest") != F.col("other_digest"), "corrupt").when(F.col("offset") != F.col("other_offset"), "moved")
    )
    either = [F.coalesce(c, f"other_{c}").alias(c) for c in ("volume", "id", "offset", "length")]
    found = both.select(*either[:2], status.alias("status"), *either[2:], "digest", "other_digest")
    return found.where("status is not null")
