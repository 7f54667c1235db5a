"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's slot depends on its id alone and never changes; a small versioned map says which shard holds each slot. More
shards, or a better balance, are edits of the map: whole slots move, nothing is hashed anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir

SLOTS = 8192
#: Bytes that a record costs beside its text.
RECORD_BYTES = 16


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 32 bits of the md5 of its text, modulo the number of slots (null: as the empty text)."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def grown(shard_of: list[int], shards: int) -> list[int]:
    """The map for one more shard: it takes its share of slots from the fullest shards, and no other slot moves."""
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in enumerate(shard_of):
        held[shard].append(slot)
    out = list(shard_of)
    for _ in range(len(shard_of) // (shards + 1)):
        fullest = max(held, key=lambda s: (len(held[s]), -s))
        out[held[fullest].pop()] = shards
    return out


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The map that the number of shards alone decides: one shard, grown again and again."""
    if not 1 <= shards <= slots:
        raise ValueError("there must be at least one shard, and a slot for each")
    shard_of = [0] * slots
    for n in range(1, shards):
        shard_of = grown(shard_of, n)
    return shard_of


def rebalanced(shard_of: list[int], slot_bytes: dict[int, int], shards: int, tolerance: float = 0.02) -> list[int]:
    """The map with slots moved from the heaviest to the lightest shard while that narrows a gap over the tolerance."""
    out, load = list(shard_of), [0] * shards
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in enumerate(shard_of):
        load[shard] += slot_bytes.get(slot, 0)
        held[shard].append(slot)
    mean = sum(load) / shards
    for _ in range(len(shard_of)):
        most, least = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[most] - load[least]
        if gap <= tolerance * mean:
            break
        fits = [s for s in held[most] if 0 < slot_bytes.get(s, 0) < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: abs(slot_bytes[s] - gap / 2))
        held[most].remove(slot)
        held[least].append(slot)
        load[most] -= slot_bytes[slot]
        load[least] += slot_bytes[slot]
        out[slot] = least
    return out


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """(version, slot, shard) of all versions; its rows are as many as slots, whatever the data."""
    tables = [spark.range(1).select(F.lit(v).alias("version"), F.posexplode(F.split(F.lit(",".join(map(str, m))), ",")).alias("slot", "shard")).withColumn("shard", F.col("shard").cast("int")) for v, m in versions.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def store_map(spark: SparkSession, versions: dict[int, list[int]], path: str | None = None) -> str:
    """Write the versions as a table, one folder a version; gives its path."""
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    map_table(spark, versions).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return path


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("slot int, shard int, version int").parquet(path).where(F.col("version") == version).select("slot", "shard")


def slot_bytes(records: DataFrame) -> DataFrame:
    """(slot, rows, bytes) of records with columns vslot and size."""
    return records.groupBy(F.col("vslot").alias("slot")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law 'key', shard, slot (its place in the shard, gapless from 0),
    grown_shard (with one more shard), vslot (virtual slot), vslot_bytes (bytes of all records in it).

    A null text has no bytes and the crc of the empty text. A null doc_id is sharded like the empty text. Rows of one
    doc_id share a shard; their places follow size and crc. Empty tables give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    records = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot(F.col("doc_id"), slots).alias("vslot")), "records")
    now = slot_map(shards, slots)
    path = store_map(spark, {1: now, 2: grown(now, shards)})
    # both tables below have a row a slot, so their size does not depend on the data
    maps = load_map(spark, path, 1).join(load_map(spark, path, 2).withColumnRenamed("shard", "grown_shard"), "slot")
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_bytes(records).join(maps, "slot").select(F.col("slot").alias("vslot"), "shard", "grown_shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.col("bytes").alias("vslot_bytes"))
    within = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    numbered = records.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(placed, "vslot").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"), "grown_shard", "vslot", "vslot_bytes")
