"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands, far more than shards).  Bytes are summed per slot,
and a versioned slot-to-shard map is stored.  Rebalancing edits that map and never rehashes a record: it moves whole
slots from heavy shards to light ones until the byte sizes are as near as slots allow.

Everything on the rows is built from DataFrame functions.  The map has one row per virtual slot, a fixed number, so the
driver may hold and broadcast it whatever the size of the corpus.

Defined results: a null text has no bytes (its record still counts its fixed overhead) and the checksum of no bytes; a
null id is hashed as null together with the text; repeated rows are separate records with places of their own; an empty
table gives no rows; further columns of the input do not matter.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import get_bytes, put_bytes, scratch, table

VIRTUAL_SLOTS = 8192
OVERHEAD = 8


@dataclass
class SlotMap:
    """shard_of[slot] for each virtual slot; version counts the edits, moved lists the slots of the last one."""

    shards: int
    shard_of: list[int]
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @classmethod
    def first(cls, shards: int, slots: int = VIRTUAL_SLOTS) -> SlotMap:
        return cls(shards, [slot % shards for slot in range(slots)])

    def loads(self, sizes: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += sizes.get(slot, 0)
        return out

    def rebalanced(self, sizes: dict[int, int]) -> SlotMap:
        """The next version of the map, edited until no single move or swap with the lightest shard evens out more.

        Slots leave shards that hold more than their mean, the largest that fits first, for the lightest shard; then
        swaps between the heaviest and the lightest shard shave what is left.
        """
        shard_of, load = list(self.shard_of), self.loads(sizes)
        own: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(shard_of):
            if sizes.get(slot, 0):
                own[shard].append(slot)
        mean, pool = sum(load) / self.shards, []
        for shard in range(self.shards):
            own[shard].sort(key=lambda s: (-sizes[s], s))
            keep = []
            total = 0
            for slot in own[shard]:  # what fits under the mean stays where it is
                if total + sizes[slot] <= mean:
                    keep.append(slot)
                    total += sizes[slot]
                else:
                    pool.append(slot)
            own[shard], load[shard] = keep, total
        light = [(x, shard) for shard, x in enumerate(load)]
        heapq.heapify(light)
        for slot in sorted(pool, key=lambda s: (-sizes[s], s)):
            x, shard = heapq.heappop(light)
            own[shard].append(slot)
            heapq.heappush(light, (x + sizes[slot], shard))
        load = [0] * self.shards
        for x, shard in light:
            load[shard] = x
        for _ in range(8 * self.shards):
            high, low = max(range(self.shards), key=lambda s: (load[s], -s)), min(range(self.shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            best = (0, None, None)
            mine = sorted((sizes[s], s) for s in own[low])
            for a in own[high]:
                want = sizes[a] - gap / 2
                at = _nearest(mine, want)
                for size_b, b in [(0, None), *mine[max(0, at - 1) : at + 2]]:
                    gain = gap - abs(gap - 2 * (sizes[a] - size_b))
                    if gain > best[0]:
                        best = (gain, a, b)
            gain, a, b = best
            if a is None:
                break
            own[high].remove(a)
            own[low].append(a)
            if b is not None:
                own[low].remove(b)
                own[high].append(b)
            change = sizes[a] - (sizes[b] if b is not None else 0)
            load[high] -= change
            load[low] += change
        for shard, slots in enumerate(own):
            for slot in slots:
                shard_of[slot] = shard
        moved = [s for s, (x, y) in enumerate(zip(self.shard_of, shard_of, strict=True)) if x != y]
        return SlotMap(self.shards, shard_of, self.version + 1, moved)

    def grown(self, sizes: dict[int, int]) -> SlotMap:
        """The next version with one more shard: slots move into the new shard alone, from the heaviest shards."""
        load = self.loads(sizes)
        shard_of, target, new, moved = list(self.shard_of), sum(load) / (self.shards + 1), 0, []
        for slot in sorted(range(len(shard_of)), key=lambda s: (-sizes.get(s, 0), s)):
            size = sizes.get(slot, 0)
            if size and new + size <= target and load[shard_of[slot]] - size >= target - size / 2:
                load[shard_of[slot]] -= size
                new += size
                shard_of[slot] = self.shards
                moved.append(slot)
        return SlotMap(self.shards + 1, shard_of, self.version + 1, sorted(moved))

    def save(self, folder: str) -> str:
        uri = f"{folder}/slot-map-v{self.version:06d}.json"
        put_bytes(uri, json.dumps(vars(self)).encode())
        return uri

    @classmethod
    def load(cls, uri: str) -> SlotMap:
        return cls(**json.loads(get_bytes(uri)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(virtual_slot, shard, map_version): a row per virtual slot."""
        return spark.createDataFrame([(slot, shard, self.version) for slot, shard in enumerate(self.shard_of)], "virtual_slot int, shard int, map_version int")


def _nearest(mine: list[tuple[int, int]], want: float) -> int:
    low, high = 0, len(mine)
    while low < high:
        middle = (low + high) // 2
        if mine[middle][0] < want:
            low = middle + 1
        else:
            high = middle
    return low


def slotted(docs: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, tie) of each record."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("doc_id", "text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(
        "doc_id",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + OVERHEAD).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per virtual slot: as many rows as there are slots, however large the table."""
    return {r["virtual_slot"]: (r["size"], r["rows"]) for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()}


def shard(docs: DataFrame, shards: int = 24, slots: int = VIRTUAL_SLOTS, maps: str | None = None) -> DataFrame:
    """Deals docs to shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, virtual_slot, map_version.

    slot is a record's place in its shard, gapless from 0.  Places come from a rank inside each virtual slot plus the
    rows of the shard's earlier virtual slots, so no task ever sorts a whole shard.  maps: the folder that keeps the
    versions of the slot-to-shard map.
    """
    spark = docs.sparkSession
    records = slotted(docs, slots)
    found = slot_sizes(records)
    sizes = {slot: size for slot, (size, _) in found.items()}
    folder = maps or scratch(spark, "slot-maps")
    first = SlotMap.first(shards, slots)
    first.save(folder)
    placed = first.rebalanced(sizes)
    placed.save(folder)
    before, rows = [0] * shards, []
    for slot, to in enumerate(placed.shard_of):
        rows.append((slot, to, before[to], placed.version))
        before[to] += found.get(slot, (0, 0))[1]
    places = spark.createDataFrame(rows, "virtual_slot int, shard int, rows_before long, map_version int")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        records.withColumn("rank", rank)
        .join(F.broadcast(places), "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rows_before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
    )


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``bytes``."""
    return shard(table(spark, sf_dir, "documents"), 24)
