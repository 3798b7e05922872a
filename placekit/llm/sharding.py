"""Sharding over fixed virtual slots.

Records are hashed into ``SLOTS`` slots that never change. Bytes are summed per slot, and a stored, versioned map says
which shard has which slot. Rebalancing and adding a shard edit the map: a new version with few slots moved. A map
has ``SLOTS`` rows at any size of the data, so it is edited in the driver and broadcast.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.llm.common import cut

SLOTS = 4096
SHARDS = 8


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt in turn."""
    return [s % shards for s in range(slots)]


def _loads(shard_of: list[int], weight: list[int], shards: int) -> list[int]:
    out = [0] * shards
    for s, w in zip(shard_of, weight, strict=True):
        out[s] += w
    return out


def rebalance(shard_of: list[int], weight: list[int], shards: int) -> list[int]:
    """A map edited until no move or swap between the fullest and the emptiest shard brings the two closer.

    Each step moves the slot, or swaps the two slots, whose difference is nearest half the gap; ties go to the
    lower slot number.
    """
    out, load = list(shard_of), _loads(shard_of, weight, shards)
    held: list[list[tuple[int, int]]] = [sorted((weight[s], s) for s in range(len(out)) if out[s] == k and weight[s]) for k in range(shards)]
    while True:
        hi, lo = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap, best = load[hi] - load[lo], None
        for given, back in [(x, None) for x in held[hi]] + [(x, y) for x in held[hi] for y in _near(held[lo], x[0] - gap / 2)]:
            moved = given[0] - (back[0] if back else 0)
            if 0 < moved < gap and (best is None or (abs(gap - 2 * moved), given[1]) < best[0]):
                best = ((abs(gap - 2 * moved), given[1]), given, back)
        if best is None:
            return out
        _, given, back = best
        for x, a, b in [(given, hi, lo)] + ([(back, lo, hi)] if back else []):
            held[a].remove(x)
            held[b].insert(bisect_left(held[b], x), x)
            out[x[1]] = b
            load[a] -= x[0]
            load[b] += x[0]


def _near(held: list[tuple[int, int]], want: float) -> list[tuple[int, int]]:
    at = bisect_left(held, (want, -1))
    return held[max(0, at - 1):at + 1]


def grow(shard_of: list[int], weight: list[int], shards: int) -> list[int]:
    """A map with one more shard, which takes slots from the fullest ones until it has its share; others keep theirs."""
    out, load = list(shard_of), [*_loads(shard_of, weight, shards), 0]
    share = sum(load) / (shards + 1)
    for s in sorted(range(len(out)), key=lambda s: (-weight[s], s)):
        if weight[s] and load[out[s]] - weight[s] >= share * 0.98 and load[-1] + weight[s] <= share:
            load[out[s]] -= weight[s]
            load[-1] += weight[s]
            out[s] = shards
    return out


def store_map(spark: SparkSession, versions: list[list[int]], weight: list[int], rows: list[int]) -> DataFrame:
    """All versions as a stored table: ``version, virtual_slot, shard, bytes, start``; ``start`` counts the shard's rows before."""
    table = []
    for v, shard_of in enumerate(versions, 1):
        seen = [0] * (max(shard_of) + 1)
        for s, k in enumerate(shard_of):
            table.append((v, s, k, weight[s], seen[k]))
            seen[k] += rows[s]
    return cut(spark.createDataFrame(table, "version int, virtual_slot int, shard int, bytes long, start long").coalesce(1))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shard of each document by the law of near-equal bytes.

    ``docs`` needs ``doc_id, text``; other columns are ignored. Returns ``doc_id, size, text_crc32, law, shard, slot,
    grown_shard, virtual_slot, map_version``, one row per document; ``slot`` numbers a shard's rows from 0 without a
    gap, in order of virtual slot, then hash, id and text. Size is the text's UTF-8 bytes (null: none) plus 1; a null
    text has the checksum of an empty one. Rows that repeat share a virtual slot and have numbers of their own. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = cut(rows.withColumn("hash", F.xxhash64("doc_id", "text_crc32")).withColumn("virtual_slot", F.pmod("hash", F.lit(SLOTS)).cast("int")))
    weight, count = [0] * SLOTS, [0] * SLOTS
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():  # SLOTS rows at most
        weight[r["virtual_slot"]], count[r["virtual_slot"]] = r["bytes"], r["n"]
    start = first_map(shards)
    versions = store_map(spark, [start, rebalance(start, weight, shards)], weight, count)
    newest = versions.where(F.col("version") == 2).select("virtual_slot", "shard", "start", F.col("version").alias("map_version"))
    within = F.row_number().over(W.partitionBy("virtual_slot").orderBy("hash", "doc_id", "text_crc32", "size"))
    # the map has SLOTS rows, so it may be broadcast
    return rows.join(F.broadcast(newest), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + within - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
