"""Sharding: balanced label propagation.

Documents of one group (here: equal texts) are linked. They start in the shard that a hash of doc_id gives.
Each round, every group counts its documents by shard, its minority cells ask to move to the shards where most
of the group already is (as many shards as the group needs), and each shard admits requests, whole groups by
hash, up to what its quota leaves. Unlinked documents are ballast: at the end every shard keeps its linked
documents first, and hands what exceeds its quota to the shards that have room.

The law is `rows`: shards differ by one row at most. State is by cell (group, chunk of the hash) with a count,
at most CHUNKS cells for a group however large, so no group is ever gathered; only sums by shard reach the driver.

Defined cases: null text counts as empty (size 8); null doc_ids and repeated rows are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import drop_stage, row_numbers, shuffle_partitions, stage, table

SHARDS = 24
#: Cells of a group for each shard it starts in.
CHUNKS_PER_SHARD = 64
ROUNDS = 8


def _unit(*c) -> Column:
    """A hash as a number from 0 up to 1."""
    return F.shiftrightunsigned(F.xxhash64(*c), 12) / F.lit(float(1 << 52))


def _by_shard(values: dict[int, float], shard: Column, shards: int) -> Column:
    """values[shard] as an expression."""
    return F.element_at(F.array(*(F.lit(float(values.get(s, 0))) for s in range(shards))), (shard + 1).cast("int"))


def _sums(df: DataFrame, key: str, value: Column) -> dict[int, int]:
    """At most one row for each shard reaches the driver."""
    return {r[0]: r[1] for r in df.groupBy(key).agg(value).collect()}


def propagate(cells: DataFrame, quota: dict[int, int], shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Moves cells (group, chunk, n, shard) of linked documents; returns the same columns."""
    total = F.sum("n").alias("total")
    capacity = max(1, min(quota.values(), default=1))
    state = stage(cells, "cells")
    held = _sums(state, "shard", F.sum("n"))
    for round_ in range(rounds):
        room = {s: quota[s] - held.get(s, 0) for s in range(shards)}
        size = state.groupBy("group").agg(total).withColumn("want", F.ceil(F.col("total") / capacity))
        # by group at most one row for each shard
        seats = state.groupBy("group", "shard").agg(F.sum("n").alias("here")).join(size, "group")
        seats = seats.withColumn("fits", (_by_shard(room, F.col("shard"), shards) + F.col("here") >= F.col("total")) | (F.col("want") > 1))
        best = Window.partitionBy("group").orderBy(F.desc("fits"), F.desc("here"), F.xxhash64("group", "shard"))
        top = seats.withColumn("rank", F.row_number().over(best)).where("rank <= want").groupBy("group").agg(F.first("want").alias("want"), F.array_sort(F.collect_list(F.struct("rank", "shard"))).alias("seats"))
        at = F.element_at(F.col("seats"), (F.pmod(F.xxhash64("group", "chunk", F.lit(round_)), F.size("seats")) + 1).cast("int"))["shard"]
        seated = F.exists("seats", lambda s: s["shard"] == F.col("shard"))
        asked = state.join(top, "group").withColumn("target", F.when(seated, F.col("shard")).otherwise(at))
        asked = stage(asked.select("group", "chunk", "n", "shard", "target", (F.col("want") > 1).alias("large")), "asked")
        drop_stage(state)
        wanted = _sums(asked.where("target <> shard"), "target", F.sum("n"))
        share = {t: min(1.0, max(0, room[t]) / n) for t, n in wanted.items()}
        draw = F.when(F.col("large"), _unit("group", "chunk", F.lit(round_ + 1000))).otherwise(_unit("group", F.lit(round_ + 1000)))
        moved = asked.withColumn("to", F.when((F.col("target") != F.col("shard")) & (draw < _by_shard(share, F.col("target"), shards)), F.col("target")).otherwise(F.col("shard")))
        state = stage(moved.select("group", "chunk", "n", F.col("to").alias("shard")), "cells")
        drop_stage(asked)
        held = _sums(state, "shard", F.sum("n"))
        if not any(share.values()):
            break
    return state


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    chunks = shards * CHUNKS_PER_SHARD
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("group"))
    rows = stage(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)).cast("int")), "rows")
    n = rows.count()
    quota = {s: n // shards + (s < n % shards) for s in range(shards)}

    cells = rows.groupBy("group", "chunk").agg(F.count("*").alias("n"))
    linked = cells.groupBy("group").agg(F.sum("n").alias("total")).where("total > 1").select("group")
    start = cells.join(linked, "group", "left_semi").withColumn("shard", F.pmod("chunk", F.lit(shards)).cast("int"))
    state = propagate(start, quota, shards, rounds).select(F.col("group").alias("_g"), F.col("chunk").alias("_c"), F.col("shard").alias("moved"))

    found = rows.join(state, (rows["group"] == state["_g"]) & (rows["chunk"] == state["_c"]), "left")
    found = found.select("doc_id", "size", "text_crc32", "group", F.coalesce("moved", F.pmod("chunk", F.lit(shards))).cast("int").alias("at"), F.col("moved").isNull().cast("int").alias("free"))
    found = stage(found, "found")
    return levelled(found, quota, shards, max(64, min(4096, 4 * shuffle_partitions(spark))))


def levelled(found: DataFrame, quota: dict[int, int], shards: int, slices: int) -> DataFrame:
    """Gives each row a slot; rows beyond their shard's quota, unlinked ones first, fill the others' gaps in order."""
    counts = {(r["at"], r["free"]): r["n"] for r in found.groupBy("at", "free").agg(F.count("*").alias("n")).collect()}
    held = {s: counts.get((s, 0), 0) + counts.get((s, 1), 0) for s in range(shards)}
    tied = {s: counts.get((s, 0), 0) for s in range(shards)}
    ranked = row_numbers(found, ["at", "free"], [F.xxhash64("group"), F.col("doc_id"), F.col("size")], slices, "rank")
    rank = F.col("rank") + F.when(F.col("free") == 1, _by_shard(tied, F.col("at"), shards)).otherwise(0)
    ranked = ranked.withColumn("rank", rank.cast("long"))
    before, surplus = {}, 0
    gaps = []  # (first number of the surplus that goes there, shard, first free slot)
    for s in range(shards):
        before[s] = surplus
        surplus += max(0, held[s] - quota[s])
    filled = 0
    for s in range(shards):
        if held[s] < quota[s]:
            gaps.append((filled, s, held[s]))
            filled += quota[s] - held[s]
    over = F.col("rank") - _by_shard(quota, F.col("at"), shards)
    number = (over + _by_shard(before, F.col("at"), shards)).cast("long")
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for first, s, free in gaps:
        shard = F.when(F.col("number") >= first, F.lit(s)).otherwise(shard)
        slot = F.when(F.col("number") >= first, F.col("number") - first + free).otherwise(slot)
    out = ranked.withColumn("number", F.when(over >= 0, number))
    stays = F.col("number").isNull()
    return out.select("doc_id", "size", "text_crc32", F.when(stays, F.col("at")).otherwise(shard).cast("int").alias("shard"), F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
