"""Sharding by Karmarkar-Karp differencing.

Equal texts form a group that must stay together. Differencing starts with one partial partition per
item (its size in one shard, nothing in the others), and again and again combines the two with the
largest spread, the fullest shard of one with the emptiest of the other, until one is left.

Items are bounded in number however many groups there are: a group above a fixed small part of all
bytes is an item of its own (there can be only so many), and all other groups share items by hash.
So only items meet on the driver, and every document finds its shard without a shuffle.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.session import materialize

GRAIN = 1024  # a group above 1 / (shards * GRAIN) of all bytes is an item of its own
BUCKETS = 1 << 14  # items that the other groups share


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, by repeatedly combining the partial partitions of largest spread."""
    heap = []
    for i, size in enumerate(sizes):
        parts = [(size, [i])] + [(0, [])] * (shards - 1)
        heap.append((-size if shards > 1 else 0, i, parts))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = []
        for (m, xs), (n, ys) in zip(a, reversed(b)):
            if len(xs) < len(ys):
                xs, ys = ys, xs
            if xs:
                xs.extend(ys)
            joined.append((m + n, xs))
        joined.sort(key=lambda p: -p[0])
        least = joined[-1][0]
        joined = [(n - least, xs) for n, xs in joined]
        heapq.heappush(heap, (-joined[0][0], turn, joined))
        turn += 1
    shard = [0] * len(sizes)
    for place, (_, items) in enumerate(heap[0][2] if heap else []):
        for i in items:
            shard[i] = place
    return shard


def text_size(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int = 16, grain: int = GRAIN, buckets: int = BUCKETS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) for every row of ``docs`` (doc_id, text).

    The law is ``bytes``: shards come out as near equal in bytes as groups of equal texts allow; a
    group larger than a fair share fills a shard alone. A null text counts as empty. Slots number a
    shard's rows without gaps, in no promised order. Repeated rows take a slot each.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            text_size("text").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
        ),
        "sizes",
    )
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    unit = total // (shards * grain)
    bucket = F.pmod("group", F.lit(buckets)).cast("int")
    heavy = groups.where(F.col("bytes") > unit).select("group", "bytes").collect()
    light = groups.where(F.col("bytes") <= unit).groupBy(bucket.alias("bucket")).agg(F.sum("bytes").alias("bytes")).collect()
    items = sorted([(-r["bytes"], 0, r["group"]) for r in heavy] + [(-r["bytes"], 1, r["bucket"]) for r in light])
    shard = differencing([-i[0] for i in items], shards)
    own = [(key, s) for (_, kind, key), s in zip(items, shard) if kind == 0]
    shared = [(key, s) for (_, kind, key), s in zip(items, shard) if kind == 1]
    # Both sides are bounded by the parameters: at most shards * grain groups, and ``buckets`` buckets.
    own = F.broadcast(spark.createDataFrame(own, "group long, own_shard int"))
    shared = F.broadcast(spark.createDataFrame(shared, "bucket int, shared_shard int"))
    placed = rows.withColumn("bucket", bucket).join(own, "group", "left").join(shared, "bucket", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "shared_shard").alias("shard"))
    return number_within(placed, "shard", "slot", F.xxhash64("doc_id", "text_crc32"))


def number_within(rows: DataFrame, group: str, name: str, spread: Column) -> DataFrame:
    """``rows`` with a number from 0 without gaps within each value of ``group``.

    Groups are cut into parts by a hash, numbered there, and moved on by the sizes of the parts before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_part", F.pmod(spread, F.lit(parts)).cast("int"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_part").orderBy("doc_id")
    numbered = rows.withColumn("_row", F.row_number().over(within))
    joined = numbered.join(offsets, [group, "_part"])
    return joined.withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")
