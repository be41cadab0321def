"""Sharding by fixed virtual slots and a versioned slot map.

Every record hashes into one of thousands of slots. Slots, not records, are placed on shards, so
the placement is a table of `slots` rows: heavy slots first, each on the lightest shard. A later
version of the map is an edit of the earlier one that moves as few slots as it needs.

Defined cases: a null text has no bytes, so size 1 and checksum 0; a null id hashes like any other
value; records with equal id and text share a slot; an empty table gives an empty result; only
`doc_id` and `text` are read, other columns of any name are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from riskspark.llm.common import register, table, write_shared

SLOTS = 4096
MAP = T.StructType(
    [T.StructField("version", T.IntegerType()), T.StructField("vslot", T.IntegerType())]
    + [T.StructField("shard", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("bytes", "rows", "first")]
)


def to_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every record; texts are read once."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_sizes(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each used slot: at most as many entries as there are slots."""
    found = slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return {r["vslot"]: (r["bytes"], r["rows"]) for r in found.collect()}


def first_map(sizes: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """Version 0: slots by falling bytes, each to the shard with the fewest bytes so far."""
    load = [(0, s) for s in range(shards)]
    placed = {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s][0], s)):
        total, shard = heapq.heappop(load)
        placed[slot] = shard
        heapq.heappush(load, (total + sizes[slot][0], shard))
    return placed


def rebalance(
    placed: dict[int, int], sizes: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.02
) -> dict[int, int]:
    """The next version: an edited copy of `placed` for new slot sizes or more shards.

    Slots without a place go to the lightest shard. Then single slots move from the heaviest to
    the lightest shard while that narrows the spread, until it is within `tolerance` of the mean.
    """
    edited = {s: placed[s] for s in sizes if placed.get(s, shards) < shards}
    load, held = [0] * shards, [[] for _ in range(shards)]
    for slot in sorted(sizes, key=lambda s: (s not in edited, -sizes[s][0], s)):
        shard = edited.setdefault(slot, min(range(shards), key=lambda i: (load[i], i)))
        load[shard] += sizes[slot][0]
        held[shard].append(slot)
    mean = sum(load) / shards
    while True:
        high = max(range(shards), key=lambda i: (load[i], -i))
        low = min(range(shards), key=lambda i: (load[i], i))
        gap = load[high] - load[low]
        able = [s for s in held[high] if 0 < sizes[s][0] < gap]
        if gap <= tolerance * mean or not able:
            return edited
        slot = min(able, key=lambda s: (abs(2 * sizes[s][0] - gap), s))
        held[high].remove(slot)
        held[low].append(slot)
        load[high] -= sizes[slot][0]
        load[low] += sizes[slot][0]
        edited[slot] = low


def map_table(spark: SparkSession, placed: dict[int, int], sizes: dict, version: int) -> DataFrame:
    """The written map of one version; `first` is the place in its shard of a slot's first record."""
    rows, used = [], {}
    for slot in sorted(placed):
        size, count = sizes[slot]
        shard = placed[slot]
        rows.append((version, slot, shard, size, count, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + count
    return write_shared(spark.createDataFrame(rows, MAP).coalesce(1), "slot-map")


def place(slotted: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless place within it for every record, from per-slot numbering plus the slot's start."""
    order = W.Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = slotted.withColumn("n", F.row_number().over(order))
    # One row per slot: `slots` bounds the broadcast.
    known = F.broadcast(slot_map.select("vslot", "shard", "first"))
    return numbered.join(known, "vslot").withColumn("slot", F.col("first") + F.col("n") - 1)


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    slotted = write_shared(to_slots(docs, slots), "slotted")
    sizes = slot_sizes(slotted)
    return place(slotted, map_table(docs.sparkSession, first_map(sizes, shards), sizes, 0))


@register("op8_sharding")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_documents(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
