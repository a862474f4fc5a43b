"""Sharding by fixed virtual slots.

Every record hashes into one of ``SLOTS`` slots, by its id and text (and, where rows repeat one another, the number of the
copy), so that neither a hot id nor a hot text fills a slot; bytes and rows are added up by slot; a table of versions
maps slots to shards. Version 0 deals out runs of slots; rebalancing edits the last version there is and writes the next,
in which slots have moved from full shards to empty ones until the bytes of the shards are near equal. Records never move
by themselves, only slots do. The map has SLOTS rows, whatever the size of the corpus, and is all that the driver and
every task hold.

Null text has no bytes; a null id hashes like any other value; repeated rows are each placed; an empty table gives no
rows; other columns are ignored. No slot needs more than its own rows in one task.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
SLOTS = 4096


class SlotMap:
    """Versions of a map from slots to shards, in a Parquet table at path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, shard_of: list[int]) -> None:
        rows = [(slot, shard) for slot, shard in enumerate(shard_of)]
        self.spark.createDataFrame(rows, "slot int, shard int").coalesce(1).write.parquet(f"{self.path}/version={version}")

    def versions(self) -> list[int]:
        """The numbers of the versions written, none if the map is new."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return []
        return sorted(r[0] for r in self.table().select("version").distinct().collect())

    def edit(self, size: list[int], shards: int) -> int:
        """Rebalance the last version (the first map, if there is none) by the bytes of each slot; the number of the next."""
        known = self.versions()
        if not known:
            self.write(0, first_map(shards, len(size)))
            known = [0]
        last = self.read(known[-1])
        if len(last) != len(size) or max(last) >= shards:
            raise ValueError(f"the map in {self.path} has {len(last)} slots and {max(last) + 1} shards")
        self.write(known[-1] + 1, rebalanced(last, size, shards))
        return known[-1] + 1

    def table(self) -> DataFrame:
        return self.spark.read.schema("slot int, shard int, version int").parquet(self.path)

    def read(self, version: int) -> list[int]:
        """The shard of each slot."""
        return [r.shard for r in self.table().filter(F.col("version") == version).orderBy("slot").collect()]


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    return [slot * shards // slots for slot in range(slots)]


def rebalanced(shard_of: list[int], size: list[int], shards: int = SHARDS) -> list[int]:
    """shard_of with slots moved from the fullest shard to the emptiest, each move lessening the gap, until none can."""
    shard_of, total, own = list(shard_of), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        total[shard] += size[slot]
        if size[slot]:
            bisect.insort(own[shard], (size[slot], slot))
    while True:
        full, empty = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[full] - total[empty]
        at = bisect.bisect_right(own[full], (gap // 2, len(shard_of)))
        choice = [x for x in own[full][max(0, at - 1) : at + 1] if x[0] < gap]
        if not choice:
            return shard_of
        n, slot = min(choice, key=lambda x: abs(2 * x[0] - gap))
        own[full].remove((n, slot))
        bisect.insort(own[empty], (n, slot))
        total[full] -= n
        total[empty] += n
        shard_of[slot] = empty


def place(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place within the shard, from 0), grown_shard and virtual_slot of each record.

    path: where the versions of the map are, if any, and the next one goes; a scratch folder if not given."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = common.copies(rows).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(slots)).cast("int"))
    rows = common.written(rows, "slots")
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r["size"], r.n
    maps = SlotMap(spark, path or common.scratch_dir(spark, "slot-map"))
    filled, begins = [0] * shards, []
    for slot, shard in enumerate(maps.read(maps.edit(size, shards))):
        begins.append((slot, shard, filled[shard]))
        filled[shard] += count[slot]
    known = spark.createDataFrame(begins, "virtual_slot int, shard int, begin long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "text_hash", "copy")
    rows = rows.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(known), "virtual_slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
