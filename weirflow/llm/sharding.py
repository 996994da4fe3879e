"""Sharding by fixed virtual slots.

Records are hashed by their text into thousands of virtual slots, so equal texts share a slot
and, with it, a shard. Bytes are summed per slot, and a versioned map, a table, sends slots to
shards so that shards weigh nearly the same. A slot heavier than a ``HEAVY``-th of a shard (a large
group of copies) is dealt into parts, each with a place in the map of its own, by a number that every
record gets when the table is read; this alone may part equal texts, since a group that weighs
more than shards may differ by cannot stay whole under the law of equal bytes. Rebalancing
edits the map: it moves as few slots as it needs and writes a new version. A record's
place is its shard and a gapless position there: the number of records in the shard's
earlier parts plus its rank among its own part's records.

Only narrow rows (id, size, checksum, slot) are shuffled. The map has a row for each slot and
each part of a heavy slot, of which there are at most ``SLOTS + 2 * HEAVY * shards``
whatever the input's size, so it may be collected and broadcast.

Defined cases: a null text has size 8 and checksum 0; null ids are like any others;
repeated rows each get a position of their own and are parted like copies; shards may stay empty
when there are fewer rows than shards; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import whole
from weirflow.plans.runtime import cut

#: Virtual slots; fixed for the life of a data set.
SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: Slots heavier than this fraction of a shard's mean bytes are dealt into parts.
HEAVY = 8


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard table.

    ``parts`` holds the heavy slots and into how many parts they are dealt; part ``p`` of slot
    ``s`` stands in ``shard_of`` under ``s + p * SLOTS``.
    """

    version: int
    shards: int
    shard_of: Mapping[int, int] = field(repr=False)
    parts: Mapping[int, int] = field(default_factory=dict, repr=False)

    @classmethod
    def balanced(cls, weight: Mapping[int, int], shards: int, slots: int = SLOTS, parts: Mapping[int, int] | None = None) -> SlotMap:
        """Heaviest slot first, each to the lightest shard; slots without weight go round in turn."""
        parts = dict(parts or {})
        heap = [(0, s) for s in range(shards)]
        owner = {}
        for slot in sorted((s for s in weight if weight[s]), key=lambda s: (-weight[s], s)):
            w, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (w + weight[slot], shard))
        owner |= {s: s % shards for s in range(slots) if s not in owner}
        return cls(1, shards, owner, parts)

    def rebalanced(self, weight: Mapping[int, int], shards: int | None = None, tolerance: float = 0.02, parts: Mapping[int, int] | None = None) -> SlotMap:
        """A next version for new weights or another number of shards.

        ``parts`` are slots dealt into (more) parts since; new parts begin where the slot was. Slots of removed shards move; then slots move from the heaviest to the lightest
        shard while the gap is more than ``tolerance`` of the mean and a move narrows it.
        """
        shards = shards or self.shards
        owner = dict(self.shard_of)
        parts = {**self.parts, **(parts or {})}
        owner |= {v: owner[v % SLOTS] for v in weight if v not in owner}
        load = [0] * shards
        loose = []
        for slot, shard in owner.items():
            if shard < shards:
                load[shard] += weight.get(slot, 0)
            else:
                loose.append(slot)
        for slot in sorted(loose, key=lambda s: (-weight.get(s, 0), s)):
            owner[slot] = min(range(shards), key=lambda s: (load[s], s))
            load[owner[slot]] += weight.get(slot, 0)
        mean = sum(load) / shards
        mine: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, shard in owner.items():
            mine[shard].append((weight.get(slot, 0), slot))
        while mean:
            high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            best = max((x for x in mine[high] if 0 < x[0] < gap), key=lambda x: (-abs(x[0] - gap / 2), -x[1]), default=None)
            if gap <= tolerance * mean or best is None:
                break
            mine[high].remove(best)
            mine[low].append(best)
            owner[best[1]] = low
            load[high] -= best[0]
            load[low] += best[0]
        return SlotMap(self.version + 1, shards, owner, parts)

    def moved(self, other: SlotMap) -> int:
        return sum(other.shard_of[s] != shard for s, shard in self.shard_of.items())

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.shards, s, self.parts.get(s, 1), d) for s, d in sorted(self.shard_of.items())]
        return spark.createDataFrame(rows, "shards int, slot int, parts int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at ``path``; a version that is there already is an error."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The wanted version of the table at ``path``, else the last."""
        rows = spark.read.parquet(path)
        wanted = version or rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == wanted).collect()
        return cls(wanted, found[0]["shards"], {r["slot"]: r["shard"] for r in found}, {r["slot"]: r["parts"] for r in found if r["parts"] > 1})


def slot_of(checksum: Column, size: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(checksum, size), F.lit(slots)).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, slot, number) of every record, computed once; numbers differ from record to record."""
    checksum = F.crc32(whole(F.col("text")))
    size = F.octet_length(whole(F.col("text"))).cast("long") + OVERHEAD
    rows = docs.select("doc_id", size.alias("size"), checksum.alias("text_crc32"))
    return cut(rows.withColumn("slot", slot_of(F.col("text_crc32"), F.col("size"))).withColumn("number", F.monotonically_increasing_id()))


def placed_in(rows: DataFrame, parts: Mapping[int, int]) -> DataFrame:
    """Adds ``virtual_slot``: the slot, or for heavy slots one of its parts."""
    if not parts:
        return rows.withColumn("virtual_slot", F.col("slot"))
    table = rows.sparkSession.createDataFrame(sorted(parts.items()), "slot int, parts int")
    part = F.pmod(F.xxhash64("number"), F.coalesce(F.col("parts"), F.lit(1))).cast("int")
    return rows.join(F.broadcast(table), "slot", "left").withColumn("virtual_slot", F.col("slot") + part * SLOTS).drop("parts")


def weights(rows: DataFrame, by: str) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows by slot."""
    found = rows.groupBy(by).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r[by]: r["b"] for r in found}, {r[by]: r["n"] for r in found}


def shard(docs: DataFrame, shards: int = 24, store: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, map_version, shard, slot): ``slot`` counts from 0 in each shard.

    ``store`` is the table of map versions: its last version is edited and the next one added, or version 1
    is written where there is none; records are placed by what the table then holds.
    """
    spark = docs.sparkSession
    rows = sized(docs)
    by_slot, _ = weights(rows, "slot")
    earlier = SlotMap.load(spark, store) if store and _exists(spark, store) else None
    limit = max(1, sum(by_slot.values()) // (shards * HEAVY))
    parts = {s: -(-b // limit) for s, b in by_slot.items() if b > limit}
    if earlier:
        parts = {**parts, **{s: max(n, parts.get(s, 1)) for s, n in earlier.parts.items()}}
    rows = placed_in(rows, parts)
    weight, count = weights(rows, "virtual_slot") if parts else (by_slot, weights(rows, "slot")[1])
    table = earlier.rebalanced(weight, shards, parts=parts) if earlier else SlotMap.balanced(weight, shards, parts=parts)
    if store:
        table.save(spark, store)
        table = SlotMap.load(spark, store, table.version)
    filled = [0] * shards
    places = []
    for s in sorted(count):
        to = table.shard_of[s]
        places.append((s, to, filled[to]))
        filled[to] += count[s]
    placed = spark.createDataFrame(places, "virtual_slot int, shard int, ahead long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "number"))
    out = rows.withColumn("__rank", rank).join(F.broadcast(placed), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", F.lit(table.version).alias("map_version"), "shard", (F.col("ahead") + F.col("__rank") - 1).alias("slot"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
