"""Token-id files: every text's ids in ascending doc_id order, range-coded in checked blocks.

Texts are dealt by ranges of doc_id, and of a hash where an id repeats, into parts of about ``PART_BYTES`` of text; a part is put in
order and written as segments of about ``SEGMENT_IDS`` ids, whole texts each. A file row is a
segment: part, place in the part, the texts' ids and lengths, and the coded blocks
(``idcoder``). Rows are kept in Parquet, so that Spark's committers write them to any store
and a lost executor costs its part only. Reading back decodes the blocks, whose checksums
must hold, and needs nothing but the files.

A null text is empty; every text ends with an end id. A null doc_id comes first. Rows that
repeat a doc_id are all written, in the order of a hash of their texts; they may fill many parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seclog.llm import idcoder, text as X
from seclog.llm.packing import with_end
from seclog.llm.tokens import default_vocabulary, encoder

PART_BYTES = 24 << 20
SEGMENT_IDS = 12_000_000

ROW = "part int, segment int, n_ids long, doc_ids array<long>, lengths array<int>, coded binary"


def write(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``path``."""
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        names, ids, lengths, segment = [], [], [], 0

        def emit() -> pa.RecordBatch:
            stream = np.concatenate(ids)
            ids.clear()
            return pa.record_batch([
                pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(stream)], pa.int64()),
                pa.array([[x for n in names for x in n]], pa.list_(pa.int64())), pa.array([np.concatenate(lengths).tolist()], pa.list_(pa.int32())),
                pa.array([idcoder.encode(stream)], pa.binary())], ["part", "segment", "n_ids", "doc_ids", "lengths", "coded"])

        for batch in batches:
            for own, _, _ in X.slices(batch, "text", X.SMALL_BYTES):
                found, first = with_end(*encode(own.column(1)), end_id)
                names.append(own.column(0).to_pylist())
                ids.append(idcoder.narrow(found))
                lengths.append(np.diff(first))
                if sum(map(len, ids)) >= SEGMENT_IDS:
                    yield emit()
                    names, ids, lengths, segment = [], [], [], segment + 1
        if ids:
            yield emit()

    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]
    (keyed.repartitionByRange(max(1, -(-int(size) // PART_BYTES)), *order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(run, ROW).write.mode("errorifexists").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, position, doc_id, ids) of every text in the files at ``path``."""
    return _decoded(spark, path, False)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every text in the files at ``path``; start: ids of all texts before it."""
    found = _decoded(spark, path, True)
    # ids before each segment: parts in groups, so that no window holds more than a group's parts or all groups
    sizes = spark.read.parquet(path).select("part", "segment", "n_ids").withColumn("group", F.floor(F.col("part") / 1024))
    groups = sizes.groupBy("group").agg(F.sum("n_ids").alias("n"))
    before = groups.select("group", (F.sum("n").over(W.orderBy("group").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = W.partitionBy("group").orderBy("part", "segment").rowsBetween(W.unboundedPreceding, 0)
    starts = (sizes.withColumn("inside", F.sum("n_ids").over(own) - F.col("n_ids")).join(before, "group")
              .select("part", "segment", (F.col("inside") + F.col("before")).alias("first")))
    return found.join(starts, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")


def _decoded(spark: SparkSession, path: str, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = idcoder.decode(row.column(5)[0].as_buffer())
                lengths = row.column(4).flatten().to_numpy().astype(np.int64)
                if len(ids) != row.column(2)[0].as_py() or lengths.sum() != len(ids):
                    raise ValueError("a segment's directory and ids differ")
                end = np.cumsum(lengths)
                start, n = end - lengths, len(lengths)
                columns = [row.column(0).take(pa.array(np.zeros(n, np.int64))), row.column(1).take(pa.array(np.zeros(n, np.int64))), pa.array(start), row.column(3).flatten()]
                if digests:
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    checks = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start.tolist(), end.tolist())]
                    yield pa.record_batch([*columns, pa.array(lengths), pa.array(checks, pa.int64())], ["part", "segment", "position", "doc_id", "n_tokens", "ids_crc32"])
                    continue
                for j in range(0, n, 1000):
                    some = [ids[a:b].astype(np.int64) for a, b in zip(start[j:j + 1000], end[j:j + 1000])]
                    yield pa.record_batch([*(c.slice(j, 1000) for c in columns), pa.array(some, pa.list_(pa.int64()))], ["part", "segment", "position", "doc_id", "ids"])

    stored = spark.read.schema(ROW).parquet(path)
    last = "n_tokens long, ids_crc32 long" if digests else "ids array<long>"
    return stored.mapInArrow(run, f"part int, segment int, position long, doc_id long, {last}")
