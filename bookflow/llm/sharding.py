"""Fixed virtual slots: records hash to slots for good, slots map to shards by a versioned table.

A record's slot depends on its id alone, so it never changes. What a shard holds
is decided by the slot map, a table of (version, virtual_slot, slot_rows,
slot_bytes, shard). Version 0 deals the slots out in turn; each later version is
an edit of the one before that moves whole slots until the bytes of the shards
are near equal. Old versions stay readable.

Rows meet only in aggregates of one row per slot and, for positions, in windows
of one slot; a slot holds a fixed share of the ids, whatever their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from bookflow.llm.common import stored, utf8_length

N_SLOTS = 8192
N_SHARDS = 40
ROW_OVERHEAD = 16

MAP_COLUMNS = ["version", "virtual_slot", "slot_rows", "slot_bytes", "shard"]


def slot_of(doc_id: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a record; a null id falls back to its text, null text to the empty one."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def sized(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and ROW_OVERHEAD), text_crc32 and virtual_slot of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (utf8_length(F.col("text")) + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text"), n_slots).alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Rows and bytes of each slot: at most n_slots rows, summed on the map side first."""
    return rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def first_map(sizes: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 0: slots dealt to shards in turn."""
    return sizes.select(
        F.lit(0).alias("version"), "virtual_slot", "slot_rows", "slot_bytes",
        (F.col("virtual_slot") % n_shards).cast("int").alias("shard"),
    )


def rebalanced(slot_map: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The next version of a slot map: slots move from heavy to light shards.

    Each shard keeps its largest slots while they fit under the mean of all
    shards; the others are moved, largest first, each to the shard that is
    lightest by then. The fold runs over one array of at most n_slots fixed-size
    entries, whose number does not depend on the number of records.
    """
    by_size = W.Window.partitionBy("shard").orderBy(F.desc("slot_bytes"), "virtual_slot")
    total = slot_map.agg((F.sum("slot_bytes") / n_shards).alias("mean_bytes"), F.max("version").alias("old"))
    marked = slot_map.join(F.broadcast(total)).withColumn("held", F.sum("slot_bytes").over(by_size.rowsBetween(W.Window.unboundedPreceding, 0)))
    stays = F.col("held") <= F.col("mean_bytes")
    kept = marked.filter(stays)
    loads = kept.groupBy("shard").agg(F.sum("slot_bytes").alias("load"))
    every = slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    start = (
        every.join(loads, "shard", "left")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).cast("long").alias("load")))), lambda x: x["load"]).alias("loads"))
    )
    moving = marked.filter(~stays).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("neg"), "virtual_slot", "slot_rows"))).alias("moving"), F.max("old").alias("old")
    )
    kind = T.StructType([T.StructField("loads", T.ArrayType(T.LongType())), T.StructField("moves", T.ArrayType(T.IntegerType()))])

    def place(state: Column, slot: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        loads = F.transform(state["loads"], lambda x, i: F.when(i + 1 == lightest, x - slot["neg"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["moves"], F.array(lightest - 1)).alias("moves")).cast(kind)

    nothing = F.struct(F.col("loads"), F.array().cast("array<int>").alias("moves")).cast(kind)
    moved = (
        moving.join(F.broadcast(start))
        .select("old", "moving", F.aggregate("moving", nothing, place)["moves"].alias("moves"))
        .select("old", F.inline(F.arrays_zip("moving", "moves")))
        .select(
            (F.col("old") + 1).alias("version"), F.col("moving.virtual_slot"), F.col("moving.slot_rows"),
            (-F.col("moving.neg")).alias("slot_bytes"), F.col("moves").alias("shard"),
        )
    )
    same = kept.select((F.col("old") + 1).alias("version"), "virtual_slot", "slot_rows", "slot_bytes", "shard")
    return same.unionByName(moved)


def with_places(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of each row and its place there, counted from 0 without gaps.

    The place is the slot's offset in its shard plus the row's place in its slot,
    so no window spans a whole shard's rows.
    """
    before = W.Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("slot_offset"))
    inside = W.Window.partitionBy("virtual_slot").orderBy(F.asc_nulls_last("doc_id"), "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(inside) - 1)
    return placed.join(F.broadcast(offsets), "virtual_slot").withColumn("slot", F.col("slot_offset") + F.col("place"))


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> tuple[DataFrame, DataFrame]:
    """Put every row into one of n_shards shards by the law `bytes`.

    Returns the rows (doc_id, size, text_crc32, law, shard, slot, grown_shard,
    virtual_slot, map_version) and the slot map with its versions, which is
    stored in the shared folder.

    * null text counts as empty: its size is ROW_OVERHEAD, its checksum 0
    * rows with a null id are placed by their text, after the other rows of their slot
    * repeated rows stay: each takes a place of its own, in the same slot
    * an empty table gives no rows and an empty map
    * other columns of the input are ignored, whatever their names

    `slot` is the place in the shard, from 0 without gaps; `virtual_slot` is the
    hash slot. `grown_shard` is null: under this law more shards mean another
    edit of the map, decided by bytes.
    """
    rows = sized(docs, n_slots)
    sizes = stored(slot_sizes(rows), "slot-sizes")
    zero = first_map(sizes, n_shards)
    slot_map = stored(zero.unionByName(rebalanced(zero, n_shards)).select(*MAP_COLUMNS).coalesce(1), "slot-map")
    current = slot_map.filter(F.col("version") == 1)
    out = with_places(rows, current).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"),
    )
    return out, slot_map
