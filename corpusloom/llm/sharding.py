"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal texts) are never divided. A group that is large against a shard is
packed as it is; small ones first fill pallets, by best fit in each bucket of a hash of the
group, so that tasks work side by side and what reaches the last packing is bounded by the
number of shards and buckets. That packing puts pallets and large groups, by falling size,
into the fullest bin that still takes them, found in a balanced tree of remaining
capacities, and looks for the smallest capacity with which the wanted number of bins is
enough.

Defined results: a null text has no bytes and shares a group with empty texts. With fewer
groups than shards some shards stay empty. A group larger than a shard's share has a shard
to itself, and the others share the rest. Slots order the rows of a shard by part, id
(nulls first) and hash; repeated rows get one slot each. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

PALLETS = 256  # of a shard's capacity
BUCKET_GROUPS, PART_ROWS = 20_000, 2_000  # in one bucket of small groups, in one part of a shard's slots
MAX_BUCKETS = 65_536  # buckets then grow instead, which tasks stream through; each may leave a pallet that is not full
_NONE = None


class CapacityTree:
    """A weight-balanced search tree of (remaining capacity, bin), as nested tuples.

    ``tightest(size)`` is the bin with the least remaining capacity that still takes size.
    """

    def __init__(self) -> None:
        self.root = _NONE

    @staticmethod
    def _node(left, key, right):
        n = 1 + (left[3] if left else 0) + (right[3] if right else 0)
        return (left, key, right, n)

    @classmethod
    def _balanced(cls, left, key, right):
        nl, nr = (left[3] if left else 0), (right[3] if right else 0)
        if nl + nr > 1 and nr > 3 * nl:
            rl, rk, rr, _ = right
            if (rl[3] if rl else 0) < 2 * (rr[3] if rr else 0):
                return cls._node(cls._node(left, key, rl), rk, rr)
            return cls._node(cls._node(left, key, rl[0]), rl[1], cls._node(rl[2], rk, rr))
        if nl + nr > 1 and nl > 3 * nr:
            ll, lk, lr, _ = left
            if (lr[3] if lr else 0) < 2 * (ll[3] if ll else 0):
                return cls._node(ll, lk, cls._node(lr, key, right))
            return cls._node(cls._node(ll, lk, lr[0]), lr[1], cls._node(lr[2], key, right))
        return cls._node(left, key, right)

    @classmethod
    def _insert(cls, at, key):
        if at is _NONE:
            return (_NONE, key, _NONE, 1)
        left, k, right, _ = at
        return cls._balanced(cls._insert(left, key), k, right) if key < k else cls._balanced(left, k, cls._insert(right, key))

    @classmethod
    def _delete(cls, at, key):
        left, k, right, _ = at
        if key < k:
            return cls._balanced(cls._delete(left, key), k, right)
        if key > k:
            return cls._balanced(left, k, cls._delete(right, key))
        if left is _NONE or right is _NONE:
            return left or right
        heir = right
        while heir[0]:
            heir = heir[0]
        return cls._balanced(left, heir[1], cls._delete(right, heir[1]))

    def add(self, remaining: int, name: int) -> None:
        self.root = self._insert(self.root, (remaining, name))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes the bin out of the tree."""
        at, best = self.root, None
        while at:
            if at[1][0] >= size:
                best, at = at[1], at[0]
            else:
                at = at[2]
        if best:
            self.root = self._delete(self.root, best)
        return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; ``sizes`` fall. An item above the capacity has a bin to itself."""
    tree, bins, out = CapacityTree(), 0, []
    for size in sizes:
        found = tree.tightest(size)
        if found is None:
            found, bins = (capacity, bins), bins + 1
        remaining, name = found
        if remaining > size:
            tree.add(remaining - size, name)
        out.append(name)
    return out


def smallest_capacity(sizes: list[int], n_bins: int) -> list[int]:
    """Bins of items in falling order, under about the least capacity for which ``n_bins`` do.

    Items above the mean of what is left have a bin to themselves first.
    """
    alone, total = 0, sum(sizes)
    while alone < min(n_bins - 1, len(sizes)) and sizes[alone] * (n_bins - alone) > total:
        total -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], n_bins - alone
    if not rest:
        return list(range(alone))
    low = max(rest[0], -(-total // bins))
    high = 2 * low
    best = best_fit_decreasing(rest, high)
    while high - low > low >> 14:
        mid = (low + high) // 2
        got = best_fit_decreasing(rest, mid)
        if max(got) < bins:
            best, high = got, mid
        else:
            low = mid + 1
    return [*range(alone), *(alone + b for b in best)]


def _fill_pallets(capacity: int):
    """Best fit of small groups, bucket by bucket; rows come sorted by bucket and falling size."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, tree, made = None, CapacityTree(), 0
        for batch in batches:
            pallets = []
            for b, size in zip(batch["bucket"].tolist(), batch["size"].tolist(), strict=True):
                if b != bucket:
                    bucket, tree, made = b, CapacityTree(), 0
                found = tree.tightest(size)
                if found is None:
                    found, made = (capacity, made), made + 1
                if found[0] > size:
                    tree.add(found[0] - size, found[1])
                pallets.append(found[1])
            yield pd.DataFrame({"bucket": batch["bucket"], "grp": batch["grp"], "size": batch["size"], "pallet": pd.Series(pallets, dtype="int64")})

    return fill


def assign_shards(groups: DataFrame, n_shards: int) -> DataFrame:
    """(grp, shard) of groups given as (grp: string, size: long), each once."""
    spark = groups.sparkSession
    total, n = groups.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return groups.select("grp", F.lit(0).alias("shard")).limit(0)
    capacity = max(int(total) // n_shards // PALLETS, 1)
    buckets = min(MAX_BUCKETS, max(1, int(n) // BUCKET_GROUPS))
    small = groups.where(F.col("size") < capacity).withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    dealt = small.select("bucket", "grp", "size").repartition("bucket").sortWithinPartitions("bucket", F.desc("size"), "grp")
    pallets = cut_lineage(dealt.mapInPandas(_fill_pallets(capacity), "bucket long, grp string, size long, pallet long"))
    # At most n_shards * PALLETS large groups and about twice as many pallets, plus MAX_BUCKETS: the driver's part never grows beyond.
    items = groups.where(F.col("size") >= capacity).select(F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("pallet"), "grp", "size")
    items = items.unionByName(pallets.groupBy("bucket", "pallet").agg(F.lit(None).cast("string").alias("grp"), F.sum("size").alias("size")))
    rows = sorted(items.collect(), key=lambda r: (-r["size"], r["grp"] or "", r["bucket"] or 0, r["pallet"] or 0))
    bins = smallest_capacity([r["size"] for r in rows], n_shards)
    placed = spark.createDataFrame([(r["bucket"], r["pallet"], r["grp"], b) for r, b in zip(rows, bins, strict=True)], "bucket long, pallet long, grp string, shard int")
    large = placed.where("grp IS NOT NULL").select("grp", "shard")
    on_pallets = pallets.join(F.broadcast(placed.where("grp IS NULL").drop("grp")), ["bucket", "pallet"]).select("grp", "shard")
    return on_pallets.unionByName(large)


def shard_documents(docs: DataFrame, n_shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Rows of groups that fill at least a pallet meet their shard by broadcast (there are at
    most ``n_shards * PALLETS`` such groups), the others by a shuffle in which no key holds
    more than a pallet. Slots are numbered in many parts of a shard at once, each beginning
    where the counts of those before it end.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("grp")))
    groups = cut_lineage(rows.groupBy("grp").agg(F.sum("size").cast("long").alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    hot = max(int(total) // n_shards // PALLETS, 1)
    shards = assign_shards(groups, n_shards)
    large = groups.where(F.col("size") >= hot).select("grp")
    is_hot = F.broadcast(large.select("grp", F.lit(True).alias("_hot")))
    told = rows.join(is_hot, "grp", "left")
    of_hot = told.where("_hot").join(F.broadcast(shards.join(F.broadcast(large), "grp", "left_semi")), "grp")
    others = told.where("_hot IS NULL").join(shards, "grp")
    # A row repeated very often lies in many tasks, and their numbers deal it to as many parts.
    placed = cut_lineage(of_hot.unionByName(others).select("_id", "size", "text_crc32", "grp", "shard", F.spark_partition_id().alias("task")))
    part = F.pmod(F.xxhash64("_id", "grp", "task"), F.lit(max(1, placed.count() // n_shards // PART_ROWS)))
    counts = placed.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"))
    first = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("_id", "grp", "size")) - 1
    numbered = placed.withColumn("part", part).withColumn("nth", nth).join(first, ["shard", "part"])  # dealt by these already
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))
