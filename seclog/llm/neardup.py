"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming search.

A document is the set of its ``k``-word shingles (words: runs of bytes other than space and
9-13, A-Z lower-cased; with fewer than ``k`` words the whole sequence is one shingle).
Two documents are linked when their sets have a Jaccard similarity of ``percent`` / 100.

1. Rows with the same set are one node; copies cost nothing further on.
2. A node's signature holds one b-bit value per MinHash: 16 bits for the first
   ``chunks * CHUNK`` places, 8 bits for ``EXTRA`` more. Two signatures differ in about
   (1 - similarity) of their places. The first places are split into chunks. By the pigeonhole principle two signatures that differ in at most
   ``2 * chunks - 1`` places have a chunk with at most one error. A chunk is stored under
   each of its ``CHUNK`` patterns with one place left open, which stands for every value an
   error can take there, so all pairs under that distance meet under some pattern.
   ``plan`` picks the number of chunks such that the distance lies ``REACH`` standard
   deviations above what the wanted similarity gives.
3. First pass: every node under a pattern is paired with one of its nodes only, the one that meets
   most others, linear in the rows. Pairs are confirmed on the full sets, components follow.
4. Second pass: under patterns whose nodes still belong to different components, each pair
   across components is looked at once, under the first pattern that it shares; the others
   of the signature's places estimate its similarity, and what lies more than ``MARGIN``
   deviations under the threshold is left out. The rest is confirmed on the full sets.
   Pairs inside one component need no further look: they could not change it.

Sets are compared as sorted 64-bit shingle hashes. A null or empty text, or one of white
space only, has an empty set, is linked with nothing and is kept. Rows that repeat a doc_id
are rows of their own; a null doc_id never becomes a component's name unless all are null.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seclog.llm import text as X
from seclog.llm.components import components
from seclog.llm.store import Scratch

CHUNK = 6
#: Standard deviations by which the index's distance exceeds the expected one, and estimates may fall short.
REACH, MARGIN = 4.0, 4.0
#: Places of a signature beyond the index, for the estimate.
EXTRA = 640
#: Places of the short sketch that a first-pass pair is held against.
SKETCH = 128


def plan(percent: int) -> int:
    """Chunks such that 2 * chunks - 1 errors lie REACH deviations above the expected ones."""
    error = 1 - percent / 100
    chunks = 2
    while 2 * chunks - 1 < error * CHUNK * chunks + REACH * math.sqrt(error * (1 - error) * CHUNK * chunks):
        chunks += 1
    return chunks


def _floor(percent: int, places: int) -> int:
    """Fewest equal places that a pair at the threshold shows, MARGIN deviations down."""
    t = percent / 100
    return math.floor(places * t - MARGIN * math.sqrt(places * t * (1 - t)))


@functools.cache
def _constants(places: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(977))
    factor = rng.integers(0, 1 << 31, places, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factor[:, None], rng.integers(0, 1 << 32, places, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, index: int) -> bytes:
    """MinHash values of a set: ``index`` of 16 bits, then EXTRA of 8 bits."""
    factor, shift = _constants(index + EXTRA)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(index + EXTRA, np.uint32(0xFFFFFFFF))
    for i in range(0, len(short), 128):
        np.minimum(low, (short[None, i:i + 128] * factor + shift).min(axis=1), out=low)
    low = X.mix(low.astype(np.uint64)) >> np.uint64(48)
    return low[:index].astype(np.uint16).tobytes() + low[index:].astype(np.uint8).tobytes()


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(shingles):
        return 0, 0
    return int(shingles.sum(dtype=np.uint64).view(np.int64)), int(X.mix(shingles ^ np.uint64(0xABCDEF0123456789)).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, k: int, index: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig) of every row; sig is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.slices(batch, "text", X.SMALL_BYTES):
                sets = X.shingle_sets(data, offsets, k)
                keys = [_set_key(s) for s in sets]
                yield pa.record_batch([
                    rows.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()),
                    pa.array([signature(s, index) if len(s) else None for s in sets], pa.binary()),
                ], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of ``width`` bytes as rows."""
    if not len(column):
        return np.empty((0, width), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, width)


def _signature_parts(column: pa.Array, index: int) -> tuple[np.ndarray, np.ndarray]:
    raw = _matrix(column, 2 * index + EXTRA)
    return np.ascontiguousarray(raw[:, :2 * index]).view(np.uint16), raw[:, 2 * index:]


def _patterns(sig: np.ndarray, chunks: int) -> np.ndarray:
    """Hash of each chunk with one place left open, its low byte the pattern's number: rows x (chunks * CHUNK)."""
    out = np.empty((len(sig), chunks * CHUNK), np.uint64)
    for c in range(chunks):
        part = sig[:, c * CHUNK:(c + 1) * CHUNK].astype(np.uint64)
        for o in range(CHUNK):
            total = np.full(len(sig), np.uint64(c * CHUNK + o + 1))
            for i in range(CHUNK):
                if i != o:
                    total = X.mix(total + (part[:, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            out[:, c * CHUNK + o] = (total & ~np.uint64(255)) | np.uint64(c * CHUNK + o)
    return out


def index_rows(nodes: DataFrame, chunks: int) -> DataFrame:
    """(pattern, node): every node under all its patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                patterns = _patterns(_signature_parts(part.column(1), chunks * CHUNK)[0], chunks)
                node = np.repeat(part.column(0).to_numpy(), patterns.shape[1])
                yield pa.record_batch([pa.array(patterns.ravel().view(np.int64)), pa.array(node)], ["pattern", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "pattern long, node long")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, sa, sb) whose sketches agree in enough places."""
    least = _floor(percent, SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_matrix(batch.column(2), SKETCH) == _matrix(batch.column(3), SKETCH)).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _across(rows: DataFrame, percent: int, chunks: int, block: int = 512) -> DataFrame:
    """(a, b): pairs across components, each under its first shared pattern only.

    A pattern's nodes are dealt into blocks; a task sees two blocks of a pattern.
    """
    index = chunks * CHUNK
    least = _floor(percent, index + EXTRA)

    def side(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
        return rows.field("node").to_numpy(), rows.field("component").to_numpy(), *_signature_parts(rows.field("sig"), index)

    def tile(pattern: int, left: pa.StructArray, right: pa.StructArray, same: bool) -> tuple[list, list]:
        n1, c1, one, more1 = side(left)
        n2, c2, two, more2 = side(right)
        a, b = [], []
        for i in range(len(n1)):
            at = np.flatnonzero((c2 != c1[i]) & (n2 > n1[i]) if same else c2 != c1[i])
            equal = two[at] == one[i]
            near = equal.sum(axis=1) + (more2[at] == more1[i]).sum(axis=1) >= least
            if not near.any():
                continue
            at, equal = at[near], equal[near]
            errors = CHUNK - equal.reshape(len(at), chunks, CHUNK).sum(axis=2)
            first = np.argmax(errors <= 1, axis=1)
            inside = equal[np.arange(len(at))[:, None], first[:, None] * CHUNK + np.arange(CHUNK)]
            place = np.argmin(inside, axis=1)  # the error's place, or place 0 if there is none
            mine = at[first * CHUNK + place == pattern & 255]
            a += [int(n1[i])] * len(mine)
            b += n2[mine].tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(1), batch.column(2)
            for i, (pattern, same) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                a, b = tile(pattern, left[i].values, right[i].values, same)
                if a:
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sized = rows.groupBy("pattern").agg(F.count("*").alias("n"))
    dealt = (rows.join(sized, "pattern").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    tiles = dealt.select(
        "pattern", F.struct("node", "component", "sig").alias("x"), "own",
        F.explode(F.expr("transform(sequence(0, blocks - 1), i -> struct(least(i, own) AS p, greatest(i, own) AS q))")).alias("t"))
    pairs = (tiles.groupBy("pattern", "t.p", "t.q")
             .agg(F.collect_list(F.when(F.col("own") == F.col("t.p"), F.col("x"))).alias("left"),
                  F.collect_list(F.when(F.col("own") == F.col("t.q"), F.col("x"))).alias("right"))
             .select("pattern", "left", "right", (F.col("p") == F.col("q")).alias("same")))
    return pairs.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets (node, shingles: sorted 64-bit hashes as binary) reach the similarity."""
    share = 256
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
    heads = many.select(F.col("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("node"), F.lit(0).alias("role"))
    tails = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("node"), F.lit(1).alias("role"))
    rows = heads.unionByName(tails).join(sets, "node").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, owner = None, None
        for batch in batches:
            a, b = [], []
            for own, salt, role, node, blob in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own_set = np.frombuffer(blob, np.uint64)
                if role == 0:
                    head, owner = own_set, (own, salt)
                    continue
                assert owner == (own, salt)
                small, large = sorted((head, own_set), key=len)
                total = len(small) + len(large)
                # at most len(small) are shared, so the union has at least len(large)
                if 100 * len(small) < percent * len(large):
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if 100 * both >= percent * (total - both):
                    a.append(own)
                    b.append(node)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("a", "salt", "role", "node", "shingles").mapInArrow(run, "a long, b long")


def full_sets(needed: DataFrame, nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the nodes in ``needed``, made again from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.slices(batch, "text", X.SMALL_BYTES):
                node, blob = [], []
                for name, k1, k2, shingles in zip(*(rows.column(i).to_pylist() for i in range(3)), X.shingle_sets(data, offsets, k)):
                    if _set_key(shingles) == (k1, k2):  # a doc_id may name several texts
                        node.append(name)
                        blob.append(shingles.tobytes())
                yield pa.record_batch([pa.array(node, pa.int64()), pa.array(blob, pa.binary())], ["node", "shingles"])

    wanted = nodes.join(needed, "node").select("node", "k1", "k2", F.col("doc_id").alias("of"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (wanted.join(texts, F.col("of").eqNullSafe(F.col("doc_id"))).select("node", "k1", "k2", "text")
            .mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    kept: the row's doc_id names its component; of rows that repeat that doc_id all are kept.
    """
    signed, named, _ = _solved(docs, k, percent)
    # an empty set's row names itself; the key (0, 0) never names a node
    return (signed.drop("sig").join(named.select("k1", "k2", "component_id"), ["k1", "k2"], "left")
            .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: one that has the smallest doc_id. Rows with empty sets stay."""
    _, named, scratch = _solved(docs, k, percent)
    heads = named.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("c", "component_id").agg(F.min(F.struct("k1", "k2")).alias("head"))
    heads = scratch.keep(heads.select(F.col("head.k1").alias("__k1"), F.col("head.k2").alias("__k2"), F.col("component_id").alias("__component")), "heads")
    scratch.drop("signatures", "nodes", "first", "second", "named")
    own = docs.columns
    schema = T.StructType(docs.schema.fields + [T.StructField(n, T.LongType()) for n in ("__n", "__k1", "__k2")])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.slices(batch, "text", X.SMALL_BYTES):
                sets = X.shingle_sets(data, offsets, k)
                keys = [_set_key(s) for s in sets]
                yield pa.record_batch([*rows.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in keys], pa.int64()),
                                       pa.array([b for _, b in keys], pa.int64())], [*own, "__n", "__k1", "__k2"])

    rows = docs.mapInArrow(keyed, schema)
    kept = (rows.filter("__n > 0").join(heads, ["__k1", "__k2"]).filter(F.col("doc_id").cast("long").eqNullSafe(F.col("__component")))
            .dropDuplicates(["__k1", "__k2"]))
    return kept.select(own).union(rows.filter("__n = 0").select(own))


def _solved(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """Signed rows, and of every node (k1, k2, doc_id, c, component_id): its component's number and name."""
    spark = docs.sparkSession
    chunks = plan(percent)
    index = chunks * CHUNK
    scratch = Scratch(spark, "neardup")
    signed = scratch.keep(signatures(docs, k, index), "signatures")
    nodes = scratch.keep(
        signed.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = index_rows(nodes, chunks)
    sizes = keys.groupBy("pattern").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.keep(keys.join(sizes, "pattern"), "shared")
    # the head of a pattern is the node that meets most others anywhere: an original among its copies
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    heads = (shared.join(degree, "node").groupBy("pattern")
             .agg(F.max(F.struct(F.col("degree"), (-F.col("node")).alias("m"))).alias("best"))
             .select("pattern", (-F.col("best.m")).alias("head")))
    sketch = nodes.select("node", F.expr(f"substring(sig, {2 * index + 1}, {SKETCH})").alias("sketch"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.keep(pairs, f"pairs-{name}")
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        links = scratch.keep(verify(pairs, full_sets(needed, nodes, docs, k), percent), f"links-{name}")
        scratch.drop(f"pairs-{name}")
        return links

    stars = (shared.join(heads, "pattern").filter("head <> node")
             .select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct())
    stars = _likely(stars.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b"), percent)
    first = scratch.keep(components(confirmed(stars, "stars"), scratch, "first"), "first")
    scratch.drop("links-stars")

    placed = shared.join(first, "node", "left").select("pattern", "node", F.coalesce("component", "node").alias("component"))
    torn = placed.groupBy("pattern").agg((F.min("component") != F.max("component")).alias("torn")).filter("torn").select("pattern")
    rows = placed.join(torn, "pattern").join(nodes.select("node", "sig"), "node")
    across = confirmed(_across(rows, percent, chunks), "across")
    scratch.drop("shared")
    label = first.toDF("node", "c")
    joined = (across.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left")
              .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    second = scratch.keep(components(joined, scratch, "second"), "second")

    where = (nodes.select("node", "k1", "k2", "doc_id").join(label, "node", "left")
             .withColumn("c", F.coalesce("c", "node")).join(second.toDF("c", "c2"), "c", "left")
             .select("k1", "k2", "doc_id", F.coalesce("c2", "c").alias("c")))
    names = where.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = scratch.keep(where.join(names, "c"), "named")
    scratch.drop("links-across")
    return signed, named, scratch
