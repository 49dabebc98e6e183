"""8. Sharding: minimax contiguous partition.

Equal texts form one atomic group.  Groups are ordered by a hash of the text; the shards are contiguous runs of that
order whose largest size in bytes is the smallest possible.  That capacity is found by binary search, each candidate
checked greedily: fill a shard until the next group does not fit, then cut.

The driver never holds the groups.  It holds the sums of at most 2^`bits` ranges of hashes, which bracket the capacity and
every cut; only the few ranges in which a cut can lie are then divided further.  A cut is a hash, so rows learn their
shard by comparing theirs.  Slots count on from the sums of (shard, bucket) counts; buckets deal the rows of a shard by id,
so neither a large shard nor a hot text is one task.

Defined cases: a null text is an empty one, of size 8; repeated rows and null ids are rows of their own, with their own
slots; a group larger than the mean is a shard of its own at least; with fewer groups than shards, late shards are
empty; ties of hashes keep a group whole, and rows of one bucket are placed by (hash, id); the size of a very long text is only
counted; an empty table gives an empty result.  `assign` keeps all columns of the input; its own replace those of their
names.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, with_columns_of, written

BITS, FINER = 12, 6
#: Starts of slots (shards times buckets) up to which they are broadcast.
MOST_STARTS = 1_000_000


def filled(ends: list[int], counts: list[int], capacity: int, shards: int, hopeful: bool) -> list[int] | None:
    """Sums at which the shards end if each is filled up to the capacity; None if that takes more shards.

    ends are known group ends, counts[i] the groups after the end before, up to ends[i].  Between them more ends may
    lie: hopeful takes one to lie just where it is wanted, else none is taken to lie there.
    """
    cuts, at, total = [], 0, ends[-1]
    for _ in range(shards):
        want = at + capacity
        if want >= total:
            return [*cuts, total]
        i = bisect_right(ends, want)
        nxt = ends[i - 1] if i else 0
        if hopeful and counts[i] > 1:
            nxt = want
        if nxt <= at:
            return None
        cuts.append(nxt)
        at = nxt
    return None


def smallest(fits, low: int, high: int) -> int:
    """The smallest number from low to high that fits; high does."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def reached(ends: list[int], capacity: int, shards: int) -> list[int]:
    """The pessimist's cuts as far as they come."""
    cuts, at = [], 0
    for _ in range(shards):
        i = bisect_right(ends, at + capacity)
        at = max(at, ends[i - 1] if i else 0)
        cuts.append(at)
    return cuts


def partition(groups: DataFrame, shards: int, bits: int = BITS) -> tuple[int, list[int]]:
    """The smallest capacity and the last hash of each shard but the last; groups has a row (h, bytes) for each text."""

    def ranges(rows: DataFrame, b: int) -> list[tuple[int, int, int, int, int]]:
        """(last hash, b, first hashes' bits, bytes, groups) of the ranges that share b leading bits."""
        by = rows.groupBy(F.shiftright("h", 64 - b).alias("p")).agg(F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("n"))
        return [(((r["p"] + 1) << (64 - b)) - 1, b, r["p"], r["s"], r["n"]) for r in by.collect()]

    known = sorted(ranges(groups, bits))
    if not known:
        return 0, []
    total, largest = sum(k[3] for k in known), groups.agg(F.max("bytes")).first()[0]
    while True:
        ends, at = [], 0
        for k in known:
            at += k[3]
            ends.append(at)
        counts = [k[4] for k in known]
        low = smallest(lambda c: filled(ends, counts, c, shards, True) is not None, max(largest, -(-total // shards)), total)
        high = smallest(lambda c: filled(ends, counts, c, shards, False) is not None, low, total)
        if low == high:
            last = {e: k[0] for e, k in zip(ends, known)}
            return high, [last[c] for c in filled(ends, counts, high, shards, False)[:-1]]
        early, late, gaps = reached(ends, low, shards), filled(ends, counts, high, shards, True), set()
        for j in range(shards):
            a, b = early[j], late[min(j, len(late) - 1)]
            gaps |= {i for i in range(bisect_right(ends, a), min(bisect_right(ends, b), len(ends) - 1) + 1) if counts[i] > 1}
        divided = []
        for b in {known[i][1] for i in gaps}:  # a few levels; a few ranges for each shard
            some = groups.where(F.shiftright("h", 64 - b).isin([known[i][2] for i in gaps if known[i][1] == b]))
            divided += ranges(some, min(64, b + FINER))
        known = sorted([k for i, k in enumerate(known) if i not in gaps] + divided)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def assign(docs: DataFrame, shards: int, keyed: DataFrame | None = None) -> DataFrame:
    """The rows of docs with shard (int), slot (long, from 0 in each shard, gapless), size and text_crc32 (long).

    keyed may give the rows as (row struct, id, h, size, text_crc32) instead, where the text itself is not wanted.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot", "size", "text_crc32")]
    if keyed is None:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        row = F.struct(*[F.col(f"`{c}`") for c in names])
        keyed = docs.select(row.alias("__row"), F.col("doc_id").alias("__id"), text_hash().alias("h"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    small = written(keyed.select("__id", "h", "size"))
    groups = written(small.groupBy("h").agg(F.sum("size").alias("bytes")))
    _, cuts = partition(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("h") > c).cast("int")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("h", "__id"), F.lit(n))
    counts = small.groupBy(shard.alias("shard"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()  # shards x buckets
    starts, at = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["bucket"])):
        starts.append((r["shard"], r["bucket"], at.get(r["shard"], 0)))
        at[r["shard"]] = starts[-1][2] + r["n"]
    start = docs.sparkSession.createDataFrame(starts or [(0, 0, 0)], "s0 int, b0 long, start long")
    rows = keyed.withColumns({"shard": shard, "bucket": bucket})
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "__id"))
    start = F.broadcast(start) if len(starts) <= MOST_STARTS else start
    rows = rows.withColumn("place", place).join(start, (F.col("shard") == F.col("s0")) & (F.col("bucket") == F.col("b0")))
    return rows.select(*[F.col("__row")[c].alias(c) for c in names], "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    docs = with_columns_of(table(spark, sf_dir, "documents"), ("doc_id", "long"), ("text", "string"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct("doc_id").alias("__row"), F.col("doc_id").alias("__id"), text_hash().alias("h"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign(docs.select("doc_id"), shards, written(keyed))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
