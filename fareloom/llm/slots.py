"""Sharding by fixed virtual slots, in DataFrame operations only.

A record's key is hashed into one of ``slots`` virtual slots, for good.  A small versioned table
maps slots to shards; growing or rebalancing edits that table and moves whole slots, so a record
moves only if its slot does.  Bytes are added up per slot, never per shard in one task.

Records are numbered inside their shard without a gap: by slot, inside the slot by part (a hash of
the key and text splits a slot), inside the part by key.  Offsets come from counts per part, so no
task sorts more than one part.

Defined results: a null key has a slot of its own hash (one slot for all null keys); null texts have
size 1 (0 bytes plus 1) and the checksum of the empty text; equal rows get different numbers of
one part in no stated order; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 4096
PARTS = 16


def slot_of(key, slots: int = SLOTS):
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """version 1: slots dealt round to the shards; depends on both counts only."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"),
                                     F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def grown_map(slot_map: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The next version for ``shards`` + 1: each shard hands the new one what it has over."""
    rank = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot"))
    spare = F.floor(F.lit(slots) / (shards + 1)) + (F.col("shard") < slots % (shards + 1)).cast("int")
    return slot_map.select((F.col("version") + 1).alias("version"), "vslot",
                           F.when(rank <= spare, F.col("shard")).otherwise(shards).alias("shard"))


def slot_bytes(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Records and bytes per slot that has any."""
    return (docs.select(slot_of(F.col(key), slots).alias("vslot"), _size(text).alias("size"))
            .groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))


def rebalanced_map(slot_map: DataFrame, loads: DataFrame, shards: int,
                   tolerance: float = 0.01) -> DataFrame:
    """The next version: shards above the mean hand over whole slots, smallest first.

    Handed slots line up by bytes and fall to the shards whose room covers their place in line.
    All tables here have one row per slot or shard.
    """
    held = (slot_map.join(loads.select("vslot", "bytes"), "vslot", "left")
            .withColumn("bytes", F.coalesce("bytes", F.lit(0))))
    mean = held.agg((F.sum("bytes") / shards).alias("mean"))
    held = held.join(F.broadcast(mean))
    upto = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot"))
    held = held.withColumn("over", upto > F.col("mean") * (1 + tolerance))
    room = (slot_map.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
            .join(held.where("not over").groupBy("shard").agg(F.sum("bytes").alias("kept")), "shard", "left")
            .join(F.broadcast(mean))
            .withColumn("room", F.greatest(F.lit(0.0), F.col("mean") - F.coalesce("kept", F.lit(0)))))
    ends = F.sum("room").over(W.orderBy("shard"))
    rooms = room.select((ends - F.col("room")).alias("at"), F.lit(0).alias("kind"),
                        F.when(F.col("room") > 0, F.col("shard")).alias("to"), F.lit(None).cast("int").alias("vslot"))
    line = F.sum("bytes").over(W.orderBy(F.desc("bytes"), "vslot")) - F.col("bytes")
    moved = held.where("over").select(line.cast("double").alias("at"), F.lit(1).alias("kind"),
                                      F.lit(None).cast("int").alias("to"), "vslot")
    placed = (rooms.unionByName(moved)
              .withColumn("to", F.last("to", True).over(W.orderBy("at", "kind", "vslot")))
              .where("kind = 1").select("vslot", "to"))
    return (slot_map.join(placed, "vslot", "left")
            .select((F.col("version") + 1).alias("version"), "vslot",
                    F.coalesce("to", "shard").alias("shard")))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Versions stand side by side; an existing version is never overwritten."""
    slot_map.write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    kept = spark.read.schema("vslot int, shard int, version int").parquet(path)
    return kept.where(F.col("version") == version).select("version", "vslot", "shard")


def _size(text: str):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, key: str = "doc_id",
          text: str = "text", slot_map: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the slot with its bytes."""
    spark = docs.sparkSession
    now = slot_map if slot_map is not None else first_map(spark, shards, slots)
    then = grown_map(now, shards, slots).select("vslot", F.col("shard").alias("grown_shard"))
    both = F.broadcast(now.drop("version").join(then, "vslot"))  # one row per slot
    rows = docs.select(
        F.col(key).alias("doc_id"), _size(text).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        slot_of(F.col(key), slots).alias("vslot"),
        F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(7)), F.lit(PARTS))
        .cast("int").alias("part"))
    parts = (rows.groupBy("vslot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
             .join(both, "vslot"))  # slots x PARTS rows
    before = F.sum("n").over(W.partitionBy("shard").orderBy("vslot", "part")) - F.col("n")
    offsets = parts.select("vslot", "part", "shard", "grown_shard", before.alias("before"),
                           F.sum("bytes").over(W.partitionBy("vslot")).alias("vslot_bytes"))
    inside = F.row_number().over(W.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("inside", inside).join(offsets, ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard",
        "vslot", "vslot_bytes")
