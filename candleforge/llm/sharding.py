"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots, bytes are added up per slot, and a versioned map, a few thousand
entries however large the table, assigns slots to shards. Rebalancing edits the map; only records of the slots
that it moves change place.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candleforge.llm.common import exists

SLOTS = 8192
SHARDS = 40
#: Bytes that a record takes beside its text.
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot]; every edit is a new version."""

    version: int
    shards: int
    shard_of: tuple[int, ...] = field(repr=False)

    @staticmethod
    def balanced(slot_bytes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """Largest slot first, each to the lightest shard so far; slots without bytes are dealt round."""
        heap = [(0, s) for s in range(shards)]
        shard_of = [slot % shards for slot in range(slots)]
        for slot, size in sorted(slot_bytes.items(), key=lambda x: (-x[1], x[0])):
            load, shard = heap[0]
            shard_of[slot] = shard
            heapq.heapreplace(heap, (load + size, shard))
        return SlotMap(1, shards, tuple(shard_of))

    def loads(self, slot_bytes: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, size in slot_bytes.items():
            out[self.shard_of[slot]] += size
        return out

    def rebalanced(self, slot_bytes: dict[int, int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version: slots leave shards above the mean for the lightest ones until all are within tolerance of
        the mean or no move helps. More shards receive slots only; with fewer, those of the last shards move."""
        shards = shards or self.shards
        shard_of = list(self.shard_of)
        own: list[list[tuple[int, int]]] = [[] for _ in range(max(shards, self.shards))]
        for slot, shard in enumerate(shard_of):
            own[shard].append((slot_bytes.get(slot, 0), slot))
        loads = [sum(b for b, _ in x) for x in own]
        heap = [(loads[s], s) for s in range(shards)]
        heapq.heapify(heap)

        def give(size: int, slot: int) -> None:
            load, to = heapq.heappop(heap)
            shard_of[slot] = to
            loads[to] += size
            heapq.heappush(heap, (load + size, to))

        for gone in range(shards, self.shards):
            for size, slot in sorted(own[gone], reverse=True):
                give(size, slot)
        mean = sum(slot_bytes.values()) / shards
        for shard in sorted(range(min(shards, self.shards)), key=lambda s: -loads[s]):
            for size, slot in sorted(own[shard], reverse=True):
                heap = [(loads[s], s) for s in range(shards) if s != shard]
                if not heap or loads[shard] <= mean * (1 + tolerance):
                    break
                heapq.heapify(heap)
                if size and heap[0][0] + size < loads[shard]:
                    loads[shard] -= size
                    give(size, slot)
        return SlotMap(self.version + 1, shards, tuple(shard_of))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, i, s) for i, s in enumerate(self.shard_of)], "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to a map table; versions are never rewritten."""
        self.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version, by default the newest."""
        rows = spark.read.schema("shards int, virtual_slot int, shard int, version int").parquet(path)
        wanted = rows.agg(F.max("version")).first()[0] if version is None else version
        found = sorted((r.virtual_slot, r.shard, r.shards) for r in rows.where(F.col("version") == wanted).collect())
        return SlotMap(wanted, found[0][2], tuple(s for _, s, _ in found))


    @staticmethod
    def stored(spark: SparkSession, path: str, slot_bytes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS, tolerance: float = 0.01) -> SlotMap:
        """The map at path that fits these slots: the newest version if it still does, else that one rebalanced, or the
        first one, stored as a new version. A map of another number of slots is replaced."""
        newest = SlotMap.load(spark, path) if exists(spark, path) else None
        if newest is None or len(newest.shard_of) != slots:
            chosen = replace(SlotMap.balanced(slot_bytes, shards, slots), version=newest.version + 1 if newest else 1)
        else:
            chosen = newest.rebalanced(slot_bytes, shards, tolerance)
            if chosen.shards == newest.shards and chosen.shard_of == newest.shard_of:
                return newest
        chosen.save(spark, path)
        return chosen


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot); the text goes no further than the scan."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    return docs.select(key.alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.when(key.isNotNull(), slot_of(key, slots)).otherwise(slot_of(text, slots)).alias("virtual_slot"))


def slot_facts(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows): at most `slots` entries."""
    return {r.virtual_slot: (r.b, r.n) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, slot_map: SlotMap | None = None, store: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SlotMap]:
    """(rows, map). rows: doc_id, size, text_crc32, virtual_slot, shard, slot, map_version of every row of docs.

    The law is `bytes`: shards are near equal in size, whatever their row counts. `slot` is a row's place in its
    shard, gapless from 0: rows are ranked within their virtual slot, and each virtual slot begins where the ones
    before it in its shard end, so no task sees more than a virtual slot. store: a folder of map versions, which is
    read and, where the slots no longer fit, given a new version.

    Null text has no bytes; rows with a null id are dealt over the slots by their text, in which copies stay together;
    long texts count whole; rows are placed by id, size and text, so repeated rows one after another; an empty table
    gives an empty result and a map; other columns are not read, whatever their names.
    """
    rows = sized(docs, id_col, text_col, slots)
    facts = slot_facts(rows)
    sizes = {k: b for k, (b, _) in facts.items()}
    chosen = slot_map or (SlotMap.stored(docs.sparkSession, store, sizes, shards, slots) if store else SlotMap.balanced(sizes, shards, slots))
    begin, at = [], [0] * chosen.shards
    for slot, s in enumerate(chosen.shard_of):
        begin.append((slot, s, at[s], chosen.version))
        at[s] += facts.get(slot, (0, 0))[1]
    table = docs.sparkSession.createDataFrame(begin, "virtual_slot int, shard int, first long, map_version int")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    ranked = rows.withColumn("rank", rank).join(F.broadcast(table), "virtual_slot")  # as many rows as slots
    return ranked.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), "map_version"), chosen
