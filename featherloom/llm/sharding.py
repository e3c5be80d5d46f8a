"""Shards of equal row counts by balanced label propagation.

Documents with equal texts are linked. A document's link is its text's hash, so a group
of any size is a hub, never all its pairs. The law is ``rows``: shard sizes, counted in
documents, are at most one apart, always.

1. Linked documents (groups of two or more) start evenly over the shards, group after
   group by prefix sums: a shard's end cuts one group at most, whether there is room or not.
2. Rounds of label propagation: each group names its target, the shard with room that
   holds most of its members; members elsewhere ask to move there; a shard accepts asks
   in an order by prefix sums, as far as its room goes. Groups that do not fit move in
   part. Rooms never go below zero, so shard sizes stay within their capacities. Rounds
   end when no document moves: each move raises the sum of squared cells of its group.
3. Documents without links have no edge to cut and fill what room is left, exactly.

Ranks and prefix sums are taken in two levels, over hash buckets and within each, so no
task sorts a shard or group whole. State is one narrow row per document; texts are read
once. DataFrame operations only.

Cases. Null text: no bytes, so a size of 8, and linked like empty text; a null id is
placed like any other; repeated rows each get a place; fewer documents than shards leave
some shards empty; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, own

SHARDS = 24
#: Rounds at most; None: until no document moves.
ROUNDS = None
#: Rows that a bucket of a two-level rank has on average.
BUCKET_ROWS = 20_000
ROW_BYTES = 8


def ranked(df: DataFrame, keys: list[str], order: list[Column], rows: int, rank: str, weight: Column | None = None) -> DataFrame:
    """``df`` with the sum of weights before each row among those of equal ``keys`` (ranks from 0 by default).

    Rows go by hash bucket, then by ``order``: an arbitrary order that is the same at each
    run. No window holds more than a bucket's rows or a key's buckets.
    """
    bucket, before, value = own(df, "bucket", "before", "value")
    n = max(1, rows // BUCKET_ROWS)
    dealt = df.withColumns({bucket: F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(n)), value: F.lit(1).cast("long") if weight is None else weight})
    totals = dealt.groupBy(*keys, bucket).agg(F.sum(value).alias("total"))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(before, F.coalesce(F.sum("total").over(ahead), F.lit(0))).drop("total")
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.withColumn(rank, F.coalesce(F.sum(value).over(within), F.lit(0))).join(totals, [*keys, bucket])
    return joined.withColumn(rank, F.col(rank) + F.col(before)).drop(bucket, before, value)


def _pick(index: Column, values: list[int]) -> Column:
    """The entry of a short list at a column's index."""
    return F.array(*(F.lit(int(v)).cast("long") for v in values))[index]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _filled(room: list[int]) -> Column:
    """The shard of the rows of rank nth, when shards are filled one after another."""
    ends = list(accumulate(room))
    return reduce(lambda rest, s: F.when(F.col("nth") < ends[s], F.lit(s)).otherwise(rest), reversed(range(len(room) - 1)), F.lit(len(room) - 1)).cast("int")


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Rows in each shard; as many numbers as there are shards come to the driver."""
    found = dict(state.groupBy("shard").count().collect())
    return [found.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, rows: int, shards: int, rounds: int | None = ROUNDS) -> DataFrame:
    """Moves the rows of ``linked`` (columns link and shard) towards their link's other rows.

    ``rows`` counts all documents, linked or not: it sets the capacities, which the first
    placement must respect.
    """
    room_for, state = capacities(rows, shards), linked
    for _ in count() if rounds is None else range(rounds):
        room = [c - n for c, n in zip(room_for, _loads(state, shards), strict=True)]
        cells = state.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("members"))
        has_room = _pick(F.col("shard"), room) > 0
        # the fullest shard with room; ties go by a hash, alike for all members
        score = F.when(has_room, F.struct("members", F.xxhash64("link", "shard").alias("tie"), "shard"))
        targets = cells.groupBy("link").agg(F.max(score).alias("best")).where("best is not null")
        # a cell moves if its target holds at least as many; one that is as full stays for the other's move
        stronger = F.col("best.members") >= F.col("members")
        asks = cells.join(targets, "link").where((F.col("shard") != F.col("best.shard")) & stronger)
        asks = asks.select("link", "shard", "members", F.col("best.shard").alias("target"))
        asking = asks.count()
        if not asking:
            break
        asks = ranked(asks, ["target"], [F.xxhash64("link"), F.col("link"), F.col("shard")], asking, "ahead", F.col("members"))
        quota = F.greatest(F.least(_pick(F.col("target"), room) - F.col("ahead"), F.col("members")), F.lit(0))
        granted = asks.withColumn("quota", quota).where("quota > 0").select("link", "shard", "target", "quota", "members")
        granted = cut(granted)
        if granted.isEmpty():
            break
        # cells granted whole move by a join; those granted in part send their first rows
        joined = state.join(granted, ["link", "shard"], "left")
        part = F.col("quota") < F.col("members")
        whole = joined.where(F.col("quota").isNull() | ~part)
        whole = whole.withColumn("shard", F.coalesce("target", "shard")).select(*linked.columns)
        some = joined.where(part)
        some = ranked(some, ["link", "shard"], [F.xxhash64("id"), F.col("id"), F.col("size")], rows, "nth")
        some = some.withColumn("shard", F.when(F.col("nth") < F.col("quota"), F.col("target")).otherwise(F.col("shard"))).select(*linked.columns)
        state = cut(whole.unionByName(some))
    return state


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int | None = ROUNDS) -> DataFrame:
    """(id, size, text_crc32, link, shard, slot) for each document; slots count each shard's documents from 0."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    all_rows = cut(docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("link")))
    rows = all_rows.count()
    groups = cut(all_rows.groupBy("link").agg(F.count(F.lit(1)).alias("members")))
    linked_rows = groups.where("members > 1").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    lane, = own(groups, "lane")
    # written first, so that Spark can split the join of a text that many documents have
    grouped = cut(ranked(groups.where("members > 1").withColumn(lane, F.lit(0)), [lane], [F.xxhash64("link"), F.col("link")], rows, "before", F.col("members")).select("link", "before"))
    order = [F.xxhash64("id", "link"), F.col("id"), F.col("link")]
    linked, single = all_rows.join(grouped, "link"), all_rows.join(cut(groups.where("members = 1").select("link")), "link")
    start = ranked(linked, ["link"], [*order, F.col("size")], rows, "nth").withColumn("nth", F.col("nth") + F.col("before"))
    start = cut(start.withColumn("shard", _filled(capacities(linked_rows, shards))).drop("nth", "before"))
    placed = propagate(start, rows, shards, rounds)
    room = [c - n for c, n in zip(capacities(rows, shards), _loads(placed, shards), strict=True)]
    filled = _over_all(single, order, rows).withColumn("shard", _filled(room)).drop("nth")
    whole = placed.unionByName(filled)
    return ranked(whole, ["shard"], order, rows // shards, "slot").select("id", "size", "text_crc32", "link", "shard", "slot")


def _over_all(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """``df`` with column nth, the rank of each row among all, from 0."""
    lane, = own(df, "lane")
    return ranked(df.withColumn(lane, F.lit(0)), [lane], order, rows, "nth").drop(lane)
