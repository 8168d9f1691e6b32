"""Sharding by fixed virtual slots.

Records are hashed by id into a few thousand slots that never change. Only the map from slot to shard does: it is a
small versioned table, edited from the bytes counted per slot, so rebalancing rewrites slots' owners and never a record's slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

#: Virtual slots; every table of slots has so many rows, whatever the input.
SLOTS = 4096


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)``: UTF-8 bytes plus 1, CRC of the bytes, slot by id.

    A null text has size 1 and the CRC of no bytes; a null id is placed by its text's CRC.
    """
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.concat(F.lit("#"), crc.cast("string")))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(found: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(virtual_slot, bytes, rows)`` of every slot, empty ones included."""
    sums = found.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = found.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt in turn."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(0).alias("version"), slot.alias("virtual_slot"), (slot % shards).alias("shard"))


def rebalanced(slot_map: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for ``shards`` shards of nearly equal bytes.

    Each shard keeps its largest slots up to the mean load; what lies above it, and all slots of shards that are gone, goes,
    largest first, to whichever shard is emptiest. Other slots stay where they are.
    """
    target = totals.agg(F.sum("bytes") / shards).scalar()
    largest = W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    owned = slot_map.join(totals, "virtual_slot").withColumn("sum", F.sum("bytes").over(largest))
    stays = (F.col("shard") < shards) & ((F.col("sum") <= target) | (F.col("bytes") == 0))
    owned = owned.withColumn("stays", stays)
    every = owned.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    held = every.join(owned.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").na.fill(0, ["load"])
    loads = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "load"))), lambda x: x["load"]).alias("loads"))
    moving = owned.filter("not stays").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("moving"))

    def give(state: Column, slot: Column) -> Column:
        to = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(state["loads"], lambda x, k: F.when(k == to, x - slot["less"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.array_append(state["given"], F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard"))).alias("given"))

    start = F.struct(F.col("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("given"))
    both = owned.sparkSession.range(1).select(loads.scalar().alias("loads"), moving.scalar().alias("moving"))
    given = both.select(F.explode(F.aggregate("moving", start, give)["given"]).alias("g"))
    edits = given.select(F.col("g.virtual_slot").alias("virtual_slot"), F.col("g.shard").alias("new"))
    version = slot_map.agg(F.max("version") + 1).scalar()
    return owned.join(edits, "virtual_slot", "left").select(version.alias("version"), "virtual_slot", F.coalesce("new", "shard").alias("shard"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the table at ``path``; a version that is there is never changed."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the table, the last by default."""
    table = spark.read.parquet(path)
    which = F.lit(version) if version is not None else table.agg(F.max("version")).scalar()
    return table.filter(F.col("version") == which).select(F.col("version").cast("int").alias("version"), "virtual_slot", "shard")


def placed(found: DataFrame, totals: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``found`` with shard, map_version and slot, the record's place in its shard: 0, 1, 2 and so on, without gaps.

    Slots of a shard follow each other, records in a slot by id, CRC and size; equal records in any order. Offsets of
    slots come from the counts, so that no shard is numbered as a whole.
    """
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = slot_map.join(totals, "virtual_slot").withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    offsets = offsets.select("virtual_slot", "shard", F.col("version").alias("map_version"), "offset")
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = found.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), "virtual_slot").withColumn("slot", (F.col("offset") + F.col("place")).cast("long")).drop("offset", "place")


def sharded(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot, shard, map_version, slot)`` of every row.

    Starts from the last map at ``map_path`` (a new table in the shared folder by default, whose version 0 deals slots in
    turn), stores the version rebalanced for these documents, and places the records by it. Law: sizes of
    shards are nearly equal. Repeated rows are all placed; an empty table gives no rows.
    """
    spark = docs.sparkSession
    found = cut_lineage(records(docs, doc_id, text, slots), "records")
    totals = cut_lineage(slot_totals(found, slots), "slot-totals")
    if map_path is None:
        map_path = scratch_path(spark, "slot-map")
        store_map(first_map(spark, shards, slots), map_path)
    store_map(rebalanced(load_map(spark, map_path), totals, shards), map_path)
    return placed(found, totals, load_map(spark, map_path))
