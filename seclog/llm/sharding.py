"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A key belongs to the first virtual node at or after its place on the ring. Each shard takes
at most its share of the rows, floor or ceiling of rows / shards; rows that find their shard
full continue clockwise to the next virtual node. So the counts of two shards differ by one
row at most, and a row moves only if its own arc or a shard on its way changed.

The walk needs only the number of rows on each arc: ``shards * virtual`` numbers, whatever
the size of the data. ``place`` gives back stretches of an arc's rows; rows find theirs by
their position on the arc, counted in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seclog.llm import text as X
from seclog.llm.ranking import ranked
from seclog.llm.store import Scratch

VIRTUAL = 128
RING = 1 << 32


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of the virtual nodes and the shard of each. A shard's places don't depend on the others."""
    ids = np.arange(shards * virtual, dtype=np.uint64)
    places = (X.mix(ids + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((ids, places))
    return places[order], (ids[order] // np.uint64(virtual)).astype(np.int64)


def place(counts: np.ndarray, owner: np.ndarray, shards: int) -> np.ndarray:
    """Stretches (arc, first rank, end rank, shard, first slot): where the rows of each arc go.

    All arcs offer their rows to their own node first, then step by step to the next one
    clockwise, each time in ring order, up to what room the shards have.
    """
    total, arcs = int(counts.sum()), len(counts)
    room = np.full(shards, total // shards, np.int64)
    room[:total % shards] += 1
    used, done, out = np.zeros(shards, np.int64), np.zeros(arcs, np.int64), []
    for step in range(arcs):
        waiting = np.flatnonzero(done < counts)
        if not len(waiting):
            break
        for arc in waiting.tolist():
            shard = int(owner[(arc + step) % arcs])
            take = int(min(counts[arc] - done[arc], room[shard] - used[shard]))
            if take:
                out.append((arc, done[arc], done[arc] + take, shard, used[shard]))
                done[arc] += take
                used[shard] += take
    return np.array(out, np.int64).reshape(-1, 5)


def shard(docs: DataFrame, shards: int = 24, virtual: int = VIRTUAL) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs`` (doc_id, text).

    size: UTF-8 bytes of the text plus 8; a null text has none and the checksum 0. Null ids
    hash like any value. Repeated rows take slots of their own. No rows give no rows.
    """
    spark = docs.sparkSession
    places, owner = ring(shards, virtual)
    arcs = len(places)

    def arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(places, batch.column(3).to_numpy(), "left") % arcs
            yield pa.record_batch([*batch.columns[:3], pa.array(at, pa.int32())], ["doc_id", "size", "text_crc32", "arc"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scratch = Scratch(spark, "shards")
    rows = scratch.keep(
        docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                    F.pmod(F.xxhash64("doc_id"), F.lit(RING)).alias("place"))
        .mapInArrow(arc, "doc_id long, size long, text_crc32 long, arc int"), "arcs")
    counts = np.zeros(arcs, np.int64)
    for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect():  # at most shards * virtual rows
        counts[r.arc] = r.n
    stretches = place(counts, owner, shards)
    stretches = stretches[np.lexsort((stretches[:, 1], stretches[:, 0]))]
    keys = stretches[:, 0] * (1 << 44) + stretches[:, 1]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(4).to_numpy()
            at = np.searchsorted(keys, batch.column(3).to_numpy().astype(np.int64) * (1 << 44) + rank, "right") - 1
            yield pa.record_batch([*batch.columns[:3], pa.array(stretches[at, 3], pa.int32()), pa.array(stretches[at, 4] + rank - stretches[at, 1])],
                                  ["doc_id", "size", "text_crc32", "shard", "slot"])

    return ranked(rows, "arc", int(counts.sum())).mapInArrow(settle, "doc_id long, size long, text_crc32 long, shard int, slot long")
