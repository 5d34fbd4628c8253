"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's virtual slot is a hash of its id and its text's checksum and never changes.  Bytes are summed up for each of
``n_slots`` virtual slots, and a versioned table, stored beside the shards, says which shard has which virtual slot.
Version 0 deals slots in turn.  Each rebalancing starts from the latest stored version, moves only slots that must
move, and appends a version; older ones stay, so a reader can name the version it wants.  The law is ``bytes``: sizes are near equal.

Defined cases: a null text has size 1 and the crc of no bytes; rows with a null id, or of one id, are told apart by
their text's checksum; very long texts count with their size, and no shard is nearer to the mean than the largest
slot allows; repeated rows are kept, each with a place of its own; no documents give no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolake.llm.common import materialize, pick, scratch_path

N_SLOTS, N_SHARDS = 8192, 8


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_stats(rows: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot: at most n_slots rows."""
    return rows.groupBy("vslot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def first_map(n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> list[int]:
    return [s % n_shards for s in range(n_slots)]


def rebalance(shard_of: list[int], weight: dict[int, int], n_shards: int) -> list[int]:
    """The edited map: moves slots until bytes are near equal, the fewest bytes it can.

    Shards above the mean give slots, largest first, as long as they stay at the mean or above; the slots given
    then go, largest first, to the lightest shard.  New shards start empty and so only receive.
    A last pass swaps nothing but moves small slots from the heaviest to the lightest shard while that helps.
    """
    new = list(shard_of)
    load = [0] * n_shards
    mine: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(new):
        load[shard] += weight.get(slot, 0)
        mine[shard].append((weight.get(slot, 0), slot))
    mean = sum(load) / n_shards
    free = []
    for shard in range(n_shards):
        kept = []
        for w, slot in sorted(mine[shard], reverse=True):
            if w and load[shard] - w >= mean:
                load[shard] -= w
                free.append((w, slot))
            else:
                kept.append((w, slot))
        mine[shard] = kept
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for w, slot in sorted(free, reverse=True):
        x, shard = heapq.heappop(heap)
        new[slot] = shard
        load[shard] = x + w
        mine[shard].append((w, slot))
        heapq.heappush(heap, (x + w, shard))
    for _ in range(len(new)):
        hi, lo = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        best = max((x for x in mine[hi] if 0 < x[0] <= gap // 2), default=None)
        if best is None:
            break
        mine[hi].remove(best)
        mine[lo].append(best)
        new[best[1]] = lo
        load[hi] -= best[0]
        load[lo] += best[0]
    return new


def map_table(spark: SparkSession, versions: list[list[int]], first: int = 0) -> DataFrame:
    """version, vslot, shard: what a writer stores beside the shards.  n_slots rows for each version."""
    parts = [f"SELECT {v} AS version, pos AS vslot, col AS shard FROM (SELECT posexplode(from_json('{json.dumps(m)}', 'array<int>')))" for v, m in enumerate(versions, first)]
    return spark.sql(" UNION ALL ".join(parts))


def stored_versions(spark: SparkSession, map_path: str) -> DataFrame | None:
    """All versions of the map that are stored at map_path; None where nothing is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(map_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema("version int, vslot int, shard int").parquet(map_path) if there else None


def next_version(spark: SparkSession, weight: dict[int, int], n_shards: int, n_slots: int, map_path: str) -> tuple[int, list[int]]:
    """The latest stored map edited for these weights, and its number; stored, if it differs from the one before."""
    known = stored_versions(spark, map_path)
    last = known.agg(F.max("version")).first()[0] if known is not None else None
    if last is None:
        last, old = 0, first_map(n_slots, n_shards)
        map_table(spark, [old]).write.parquet(map_path)
    else:
        shard_of = {r.vslot: r["shard"] for r in known.where(F.col("version") == last).collect()}  # n_slots rows
        if len(shard_of) != n_slots:
            raise ValueError(f"the map at {map_path} has {len(shard_of)} slots, not {n_slots}")
        old = [shard_of[k] for k in range(n_slots)]
    new = rebalance(old, weight, n_shards)
    if new == old:
        return last, old
    map_table(spark, [new], last + 1).write.mode("append").parquet(map_path)
    return last + 1, new


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place within the shard), grown_shard; and vslot, version.

    The versions of the slot-to-shard map are kept at map_path; without one, in a scratch folder of the session.
    """
    spark = docs.sparkSession
    rows = materialize(records(docs, n_slots), "records")
    weight = {r.vslot: r.n_bytes for r in slot_stats(rows).collect()}  # n_slots rows at most
    version, shard_of = next_version(spark, weight, n_shards, n_slots, map_path or scratch_path(spark, "shard-map"))
    table = map_table(spark, [shard_of], version)
    counts = slot_stats(rows).join(F.broadcast(table), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("vslot", "shard", "version", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base"))
    place = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(place).cast("long") - 1)
        .join(F.broadcast(base), "vslot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot", "version",
        )
    )
