"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, shared_folder

VIRTUAL_SLOTS = 4096
SHARDS = 8
#: A virtual slot with over so many times the mean rows (and over ``HOT_ROWS``) holds a repeated id, or one text without ids.
HOT_TIMES, HOT_ROWS = 8, 1000
#: A map in memory: one entry per virtual slot, so its size is fixed.
SlotMap = list[int]


def measured(docs: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` per row; the text itself goes no further.

    ``size`` is the UTF-8 length plus 1 (null text: 1). The slot is taken from the first 32 bits of the id's MD5;
    rows without an id hash their checksum instead, so they do not gather in one slot.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc32:"), crc.cast("string")))
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("text_crc32"),
        (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % slots).cast("int").alias("virtual_slot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """``virtual_slot, n, bytes``: at most one row per virtual slot, combined map-side."""
    return rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def spread_hot_slots(rows: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """``rows`` (stored, with a number ``uid`` each) with the rows of hot virtual slots dealt anew, row by row, over all slots.

    An id stands for one row as a rule, so a slot far above the mean holds rows that share their id, or have none and share
    their text; no law needs these to stay together.
    """
    counts = rows.groupBy("virtual_slot").count().collect()  # at most `slots` rows
    most = max(HOT_ROWS, HOT_TIMES * sum(r["count"] for r in counts) / slots)
    hot = [r.virtual_slot for r in counts if r["count"] > most]
    anew = F.pmod(F.xxhash64("doc_id", "text_crc32", "uid"), F.lit(slots)).cast("int")
    return rows.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(hot), anew).otherwise(F.col("virtual_slot"))) if hot else rows


def balanced_map(weights: dict[int, int], shards: int = SHARDS, slots: int = VIRTUAL_SLOTS) -> SlotMap:
    """First version of a map: heaviest slot first, each to the lightest shard (ties: lowest shard)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda v: (-weights.get(v, 0), v)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return out


def rebalanced_map(current: SlotMap, weights: dict[int, int], shards: int, tolerance: float = 0.01) -> SlotMap:
    """Next version of a map: moves only as many slots as bring each shard within ``tolerance`` of the mean.

    Shards may have been added since ``current``. The largest slot that fits moves from the heaviest to the
    lightest shard until both are in bounds or no move helps.
    """
    out, load = list(current), [0] * shards
    for slot, shard in enumerate(out):
        load[shard] += weights.get(slot, 0)
    mean = sum(load) / shards
    for _ in range(len(out)):
        high, low = max(range(shards), key=lambda s: load[s]), min(range(shards), key=lambda s: load[s])
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        room = (load[high] - load[low]) / 2
        movable = [v for v, s in enumerate(out) if s == high and 0 < weights.get(v, 0) <= room]
        if not movable:
            break
        slot = max(movable, key=lambda v: (weights[v], -v))
        out[slot] = low
        load[high] -= weights[slot]
        load[low] += weights[slot]
    return out


def save_map(spark: SparkSession, current: SlotMap, path: str, version: int) -> None:
    """Store one version as ``virtual_slot, shard`` below ``path``. A version is written once and never changed."""
    rows = spark.createDataFrame(list(enumerate(current)), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, DataFrame]:
    """The number and the rows ``virtual_slot, shard`` of the given version, or of the newest."""
    stored = spark.read.parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    return version, stored.filter(F.col("version") == version).select("virtual_slot", "shard")


def update_map(spark: SparkSession, rows: DataFrame, path: str, shards: int = SHARDS, slots: int = VIRTUAL_SLOTS, held: int | None = None) -> int:
    """Store the map for the bytes of ``rows`` and return its version.

    Without a held version this is version 1, balanced from nothing. Of a held one only as many slots are moved as
    the shards need, and the edited map becomes the next version; a map that needs no move stays as it is.
    """
    weights = {r.virtual_slot: r.bytes for r in slot_bytes(rows).collect()}  # at most `slots` rows
    if held is None:
        save_map(spark, balanced_map(weights, shards, slots), path, 1)
        return 1
    before = [r.shard for r in load_map(spark, path, held)[1].orderBy("virtual_slot").collect()]
    after = rebalanced_map(before, weights, shards)
    if after == before:
        return held
    save_map(spark, after, path, held + 1)
    return held + 1


def shard_documents(docs: DataFrame, path: str | None = None, shards: int = SHARDS, slots: int = VIRTUAL_SLOTS, held: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version`` per row, under the law ``bytes``.

    The slot map is stored below ``path`` (a new folder beside the checkpoints, if not given), read back and dealt
    from; ``held`` names a version there to be edited instead of starting anew. ``slot`` numbers the rows of a shard
    from 0 without gaps: the offset of the row's virtual slot within its shard plus its rank (by id, then checksum)
    within the virtual slot, so ranking runs on thousands of small groups rather than on a few shards; slots that one id or
    text fills are dealt anew first. Repeated rows get slots of their own, equally ranked ones in any order. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, f"slot-maps-{uuid.uuid4().hex}")
    rows = spread_hot_slots(checkpointed(measured(docs, slots).withColumn("uid", F.monotonically_increasing_id())), slots)
    version, current = load_map(spark, path, update_map(spark, rows, path, shards, slots, held))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    filled = current.join(slot_bytes(rows), "virtual_slot", "left").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    places = filled.select("virtual_slot", "shard", "first")  # one row per virtual slot
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (rows.withColumn("rank", rank).join(F.broadcast(places), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


#: The same in SQL. The checksum runs over the bytes with a table built from the polynomial, and the greedy deal is a
#: recursion over the slots, heaviest first.
ORACLE = """
WITH RECURSIVE crc_step(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
raw AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: ord(c) - CASE WHEN c > '9' THEN 55 ELSE 48 END) AS h
  FROM documents),
summed AS MATERIALIZED (
  SELECT doc_id, strlen(text) + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(text)),
               lambda i: h[2 * i + 1] * 16 + h[2 * i + 2])),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM raw, crc_table),
rows_ AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'crc32:' || text_crc32)), 1, 8))::BIGINT % 4096 AS virtual_slot FROM summed),
slots AS MATERIALIZED (
  SELECT v AS virtual_slot, count(doc_id) AS n, coalesce(sum(size), 0)::BIGINT AS bytes
  FROM range(4096) s(v) LEFT JOIN rows_ ON virtual_slot = v GROUP BY v),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS place FROM slots),
deal(place, load, virtual_slot, shard) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT o.place, list_transform(load, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN bytes ELSE 0 END),
         o.virtual_slot, list_position(load, list_min(load)) - 1
  FROM deal d JOIN ordered o ON o.place = d.place + 1),
placed AS (
  SELECT virtual_slot, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM deal JOIN slots USING (virtual_slot))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       (first + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard, virtual_slot::INTEGER AS virtual_slot, 1 AS map_version
FROM rows_ JOIN placed USING (virtual_slot)
"""
