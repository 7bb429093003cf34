"""Sharding by fixed virtual slots: records hash into thousands of slots, and a versioned table says which shard holds a slot.

Rebalancing edits the table, never the hash: a slot moves as a whole, and a new version keeps every slot that need not move.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tapelab.llm.common import number_within, stage, table
from tapelab.session import ensure_checkpoint_dir

#: Slots are fixed for the life of a data set; the map has one row per slot, so its size is bounded by this number.
SLOTS = 4096
MAX_SLOTS = 65_536
SHARDS = 16

MAP_SCHEMA = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                           T.StructField("slot_bytes", T.LongType()), T.StructField("version", T.IntegerType())])


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def first_map(slots: int, shards: int) -> np.ndarray:
    return np.arange(slots, dtype=np.int64) % shards


def edit_map(old: np.ndarray, slot_bytes: np.ndarray, shards: int) -> np.ndarray:
    """The next version of a map: slots move from the fullest to the emptiest shard as long as that evens them out.

    Slots of shards that are no longer there (or new shards that hold none) are handled by the same moves. Each move takes the slot
    closest to half the difference, so the spread falls to about the size of a small slot.
    """
    new = np.where(old < shards, old, np.arange(len(old)) % shards)
    load = np.bincount(new, weights=slot_bytes, minlength=shards)
    for _ in range(8 * len(old)):
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        own = np.flatnonzero((new == full) & (slot_bytes > 0) & (slot_bytes < gap))
        if not len(own):
            break
        slot = own[np.abs(slot_bytes[own] - gap / 2).argmin()]
        new[slot] = empty
        load[full] -= slot_bytes[slot]
        load[empty] += slot_bytes[slot]
    return new


class SlotMap:
    """Slot-to-shard map kept as one Parquet folder per version under ``path``."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        if not 0 < slots <= MAX_SLOTS:
            raise ValueError(f"slots must be in 1..{MAX_SLOTS}")
        self.spark, self.path, self.slots = spark, path.rstrip("/"), slots

    def write(self, shard: np.ndarray, slot_bytes: np.ndarray, version: int) -> None:
        rows = [(i, int(s), int(b), version) for i, (s, b) in enumerate(zip(shard, slot_bytes))]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{self.path}/v{version:06d}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v{version:06d}")

    def rebalance(self, version: int, slot_bytes: np.ndarray, shards: int) -> int:
        """Writes the version after ``version`` and returns its number."""
        old = np.zeros(self.slots, np.int64)
        for row in self.read(version).collect():  # one row per slot
            old[row["virtual_slot"]] = row["shard"]
        self.write(edit_map(old, slot_bytes, shards), slot_bytes, version + 1)
        return version + 1


def slot_sizes(rows: DataFrame, slots: int) -> np.ndarray:
    """Bytes per slot: summed before the shuffle, one row per slot comes to the driver."""
    out = np.zeros(slots, np.float64)
    for row in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect():
        out[row["virtual_slot"]] = row["b"]
    return out


def shard_rows(df: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, law, shard, slot (place in the shard from 0), grown_shard, virtual_slot.

    The law is ``bytes``: the map is edited to the bytes measured per slot. A record's slot is the hash of its id; a repeated id is
    told apart by its number within a read task, so that copies of one row spread over slots too. Null ids hash like any value. Null texts have
    size 1. An empty table gives an empty result.
    """
    spark = df.sparkSession
    read = df.select(F.col(id_col).alias("id"), n_bytes(F.col(text_col)).alias("size"),
                     F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"))
    copy = F.row_number().over(W.partitionBy("part", "id").orderBy("size", "text_crc32")) - 1
    rows = stage(read.withColumn("copy", copy).withColumn("virtual_slot", F.pmod(F.xxhash64("id", "copy"), F.lit(slots)).cast("int")), "slots")
    slot_bytes = slot_sizes(rows, slots)
    kept = SlotMap(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}", slots)
    kept.write(first_map(slots, shards), np.zeros(slots), 0)
    current = kept.read(kept.rebalance(0, slot_bytes, shards))
    placed = rows.join(F.broadcast(current.select("virtual_slot", "shard")), "virtual_slot")
    out = number_within(placed, "shard", "part", ["id", "copy", "size", "text_crc32"], "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
