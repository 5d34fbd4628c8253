"""Best-fit packing planned over a length histogram.

The pieces of all documents are counted by length; a table of at most ``capacity`` counts is all that the
planner sees.  It runs best-fit decreasing over counts: sequences with the same room left form one group,
and a whole run of equal pieces goes into a group at once.  The plan is a few rows for each length.
Pieces then take planned places by their rank within their length: ranks are counted in
blocks of documents, and the blocks' totals are summed up, so that a length which most pieces
have is dealt over all tasks.

Defined cases: a null text is empty and gives one piece of one id (the end id); documents longer than the
capacity alone are cut, however long; repeated rows are packed each on its own (equal pieces get ranks of their own);
null ids are kept, and pieces of one id fall into blocks by their ids' checksum; no documents give no pieces; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolake.llm.common import materialize, pick, shuffle_partitions
from fotolake.llm.tokens import encoder, prove, read_vocabulary

CAPACITY, END_ID = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row for each piece; keep_ids adds the ids themselves as little-endian unsigned 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(prove(read_vocabulary(vocabulary_path)))
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(t.as_py() for t in b.column(1)), strict=True):
                ids += end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc, k, at, len(part) // 4, zlib.crc32(part), *[part] * keep_ids))
                if keep_ids and len(rows) >= 2000:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)

    return pick(docs, "doc_id", "text").mapInArrow(work, PIECES + ", ids binary" * keep_ids)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, pieces to a sequence, first sequence, offset there).

    Best-fit decreasing: a piece goes where the least room is left after it.  All sequences of a group
    have the same room, so one step places a run of equal pieces: each takes as many as fit.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, sequences)
    rooms: list[int] = []
    rows = []
    fresh = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    del rooms[at]
            else:
                room, first = capacity, fresh
                n = -(-left // (capacity // length))
                fresh += n
            each = room // length
            full, part = divmod(min(left, n * each), each)
            rows.append((length, rank, full * each + part, each, first, capacity - room))
            put(room - each * length, first, full)
            if part:
                put(room - part * length, first + full, 1)
            put(room, first + full + bool(part), n - full - bool(part))
            rank += full * each + part
            left -= full * each + part
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset.  ``pieces`` is read twice: give a table, not a long plan."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows come to the driver, whatever the input.
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    planned = _table(spark, plan(histogram, capacity))
    blocks = max(64, 4 * shuffle_partitions(spark))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    place = Window.partitionBy("_block", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_in", F.row_number().over(place).cast("long") - 1)
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        dealt.groupBy("_block", "length").agg(F.count("*").alias("_n"))
        .select("_block", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    ranked = ranked.join(base, ["_block", "length"]).withColumn("_rank", F.col("_base") + F.col("_in"))
    hit = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_rank")) & (F.col("_rank") < F.col("p_rank") + F.col("p_n"))
    # The plan has a few rows for each of at most ``capacity`` lengths.
    nth = F.col("_rank") - F.col("p_rank")
    return ranked.join(F.broadcast(planned), hit).select(
        *pieces.columns,
        (F.col("p_first") + F.expr("(_rank - p_rank) div p_each")).alias("sequence_id"),
        (F.col("p_offset") + (nth % F.col("p_each")) * F.col("length")).alias("offset"),
    )


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    columns = "p_length long, p_rank long, p_n long, p_each long, p_first long, p_offset long"
    names = [c.split()[0] for c in columns.split(", ")]
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)}))


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenize, plan and place all documents."""
    return pack(materialize(tokenize_pieces(docs, vocabulary_path, capacity, end_id, keep_ids), "pieces"), capacity)
