"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

1. Equal vectors are one node, which keeps the ``k + 1`` smallest of its ids: no other copy
   can be among anyone's ``k`` nearest. So a vector shared by a third of all rows costs as
   much as any other.
2. The tree is fitted on a bounded sample (about ``SAMPLE`` nodes, chosen by hash):
   each level parts a node into ``BRANCH`` clusters until a leaf holds about 1 / ``LEAVES``
   of it, so a query meets a bounded number of leaves. Every node of the table is put into a leaf.
3. A query goes down the tree with a priority queue over all branches seen so far, nearest
   centre first, and visits leaves in that order.
4. Visits are calibrated: for ``CALIBRATION`` queries the true neighbours are found by brute
   force over all nodes; the number of leaves is widened until their mean recall reaches
   ``TARGET``. It is measured on this table, not assumed. A query whose leaves hold fewer
   than ``k + 1`` ids goes on until they do, or the tree is spent.
5. Queries and nodes meet by leaf. Leaves of many nodes or many queries are dealt into cells
   of at most about ``CELL`` nodes and ``CELL`` queries each.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
those with another number of components than most. Repeated rows of one id are one row.
Inner products are in double precision; equal ones rank by id.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seclog.llm.store import Scratch

SAMPLE, BRANCH, LEAVES = 20_000, 16, 96
CALIBRATION, TARGET = 200, 0.96
CELL = 2048


class Tree:
    """Centres of all clusters; leaves are numbered in the order they were made."""

    def __init__(self, rows: np.ndarray, per_leaf: float):
        self.rng = np.random.Generator(np.random.PCG64(5))
        self.children: list[list[tuple[np.ndarray, int]]] = []  # for each inner cluster: (centre, inner number or ~leaf)
        self.leaves = 0
        self.root = self._grow(rows.astype(np.float64), per_leaf)
        self.packed = [(np.stack([c for c, _ in x]), [n for _, n in x]) for x in self.children]

    def _grow(self, rows: np.ndarray, per_leaf: float) -> int:
        if len(rows) <= max(per_leaf, 1):
            self.leaves += 1
            return ~(self.leaves - 1)
        centres, own = self._cluster(rows, min(BRANCH, max(2, int(len(rows) / max(per_leaf, 1)) + 1)))
        if len(centres) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        me = len(self.children)
        self.children.append([])
        self.children[me] = [(c, self._grow(rows[own == i], per_leaf)) for i, c in enumerate(centres)]
        return me

    def _cluster(self, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        centres = rows[self.rng.choice(len(rows), n, replace=False)]
        own = np.zeros(len(rows), np.int64)
        for _ in range(10):
            own = np.argmin((centres ** 2).sum(axis=1) - 2 * rows @ centres.T, axis=1)
            used = np.unique(own)
            centres = np.stack([rows[own == i].mean(axis=0) for i in used])
            own = np.searchsorted(used, own)
        return centres, own

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest centre at every level."""
        out = np.zeros(len(rows), np.int32)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = ~node
                continue
            centres, below = self.packed[node]
            own = np.argmin((centres ** 2).sum(axis=1) - 2 * rows[at] @ centres.T, axis=1)
            todo += [(n, at[own == i]) for i, n in enumerate(below) if (own == i).any()]
        return out

    def best_bins(self, query: np.ndarray, visits: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves, best bin first, and more until they hold ``least`` ids; ``sizes`` has the ids of each leaf."""
        heap: list[tuple[float, int]] = [(0.0, self.root)]
        out: list[int] = []
        ids = 0
        while heap and (len(out) < visits or ids < least):
            _, node = heapq.heappop(heap)
            if node < 0:
                out.append(~node)
                ids += (sizes or {}).get(~node, 0)
                continue
            centres, below = self.packed[node]
            for score, child in zip((centres @ query).tolist(), below):
                heapq.heappush(heap, (-score, child))
        return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)


def _nodes(table: DataFrame, dim: int, k: int) -> DataFrame:
    """(key, vec, vec_id): rows of usable vectors, locally at most ``k + 1`` ids of a vector and its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[bytes, list[int]]] = {}

        def emit() -> pa.RecordBatch:
            rows = [(key, vec, i) for key, (vec, ids) in held.items() for i in sorted(set(ids))[:k + 1]]
            held.clear()
            return pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["key", "vec", "vec_id"])

        for batch in batches:
            vectors = np.array(batch.column(1).flatten().to_numpy(), np.float32).reshape(-1, dim) + np.float32(0)  # -0 is 0
            for i, vec in zip(batch.column(0).to_pylist(), vectors):
                raw = vec.tobytes()
                _, ids = held.setdefault(hashlib.blake2b(raw, digest_size=16).digest(), (raw, []))
                ids.append(i)
                if len(ids) > 4 * k + 4:
                    ids[:] = sorted(set(ids))[:k + 1]
            if len(held) > 20_000:
                yield emit()
        if held:
            yield emit()

    return table.mapInArrow(run, "key binary, vec binary, vec_id long")


def _keys(table: DataFrame, dim: int) -> DataFrame:
    """(query_id, key, vec) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.array(batch.column(1).flatten().to_numpy(), np.float32).reshape(-1, dim) + np.float32(0)
            raw = [v.tobytes() for v in vectors]
            yield pa.record_batch([batch.column(0), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                                  ["query_id", "key", "vec"])

    return table.mapInArrow(run, "query_id long, key binary, vec binary")


def _top(scores: np.ndarray, ids: list[list[int]], k: int) -> tuple[list[float], list[int]]:
    """The ``k + 1`` best (score, id) of nodes with the given ids, ties by id."""
    if len(scores) > k + 1:
        least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    best = sorted((-scores[i], x) for i in at.tolist() for x in ids[i])[:k + 1]
    return [-s for s, _ in best], [x for _, x in best]


def _search(queries: np.ndarray, nodes: np.ndarray, ids: list[list[int]], k: int) -> Iterator[tuple[list[float], list[int]]]:
    for i in range(0, len(queries), 256):
        for scores in queries[i:i + 256] @ nodes.T:
            yield _top(scores, ids, k)


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows whose vector is of finite components, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
            .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad & F.exists("embedding", lambda x: x != 0)))


def nearest(table: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    scratch = Scratch(spark, "neighbours")
    good = usable(table)
    sizes = good.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0].dim
    good = good.filter(F.size("embedding") == dim)
    from pyspark.sql import Window as W

    order = W.partitionBy("key").orderBy("vec_id")
    nodes = scratch.keep(
        _nodes(good, dim, k).distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
        .groupBy("key").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    queries = scratch.keep(_keys(good.filter(F.col("vec_id") % every == 0), dim).distinct(), "queries")
    total = nodes.count()
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(total, 1)))
    sample = nodes.filter(share).orderBy("key").select("vec").collect()  # about SAMPLE rows
    rows = np.frombuffer(b"".join(bytes(r.vec) for r in sample), np.float32).reshape(-1, dim)
    tree = Tree(rows, max(4.0, len(rows) / LEAVES))
    held = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = held.value.place(_vectors(batch.column(1), dim))
            yield pa.record_batch([*batch.columns, pa.array(leaf, pa.int32())], ["key", "vec", "ids", "leaf"])

    placed = scratch.keep(nodes.mapInArrow(place, "key binary, vec binary, ids array<long>, leaf int"), "placed")
    asked = scratch.keep(queries.groupBy("key").agg(F.first("vec").alias("vec")), "asked")
    visits = calibrate(placed, asked, tree, dim, k)
    counts = placed.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect()  # a row for each leaf
    sizes = spark.sparkContext.broadcast({r.leaf: r.n for r in counts})

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [held.value.best_bins(q, visits, sizes.value, k + 1) for q in _vectors(batch.column(1), dim)]
            yield pa.record_batch([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], ["key", "vec", "leaves"])

    asked_at = asked.mapInArrow(visit, "key binary, vec binary, leaves array<int>").select("key", "vec", F.explode("leaves").alias("leaf"))
    asked_at = scratch.keep(asked_at, "asked-at")
    cells = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    shape = cells(placed, "nb").join(cells(asked_at, "qb"), "leaf")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (asked_at.join(shape, "leaf").withColumn("q", F.pmod(F.xxhash64("key"), "qb").cast("int")).select("leaf", "q", spread("nb").alias("b"), "key", "vec"))
    right = (placed.join(shape, "leaf").withColumn("b", F.pmod(F.xxhash64("key"), "nb").cast("int")).select("leaf", spread("qb").alias("q"), "b", "vec", "ids"))

    def cell(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            keys, found = [], []
        else:
            keys = one.column("key").to_pylist()
            found = list(_search(_vectors(one.column("vec"), dim), _vectors(two.column("vec"), dim), two.column("ids").to_pylist(), k))
        return pa.table({"key": pa.array(keys, pa.binary()), "scores": pa.array([s for s, _ in found], pa.list_(pa.float64())),
                         "ids": pa.array([i for _, i in found], pa.list_(pa.int64()))})

    found = (left.groupBy("leaf", "q", "b").cogroup(right.groupBy("leaf", "q", "b"))
             .applyInArrow(cell, "key binary, scores array<double>, ids array<long>"))
    pairs = F.expr("transform(arrays_zip(scores, ids), x -> struct(-x.scores AS s, x.ids AS i))")
    best = (found.select("key", pairs.alias("pairs")).groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("pairs"))), 1, k + 1).alias("best")))
    best = scratch.keep(best, "best")
    scratch.drop("asked-at", "asked", "nodes", "placed")
    own = F.slice(F.filter("best", lambda x: x["i"] != F.col("query_id")), 1, k)
    return (queries.select("query_id", "key").join(best, "key").select("query_id", F.posexplode(own).alias("rank", "x"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score")))


def calibrate(placed: DataFrame, asked: DataFrame, tree: Tree, dim: int, k: int) -> int:
    """Leaves to visit: widened until the mean recall of the calibration queries reaches ``TARGET``."""
    some = asked.orderBy("key").select("vec").limit(CALIBRATION).collect()
    if not some:
        return 1
    probes = np.frombuffer(b"".join(bytes(r.vec) for r in some), np.float32).reshape(-1, dim).astype(np.float64)
    held = placed.sparkSession.sparkContext.broadcast(probes)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in range(len(held.value))]
        for batch in batches:
            scores, leaf = held.value @ _vectors(batch.column(1), dim).T, batch.column(3).to_numpy()
            for i, own in enumerate(scores):
                at = np.argpartition(-own, min(k, len(own) - 1))[:k + 1]
                best[i] = sorted(best[i] + [(-own[j], int(leaf[j])) for j in at.tolist()])[:k + 1]
        yield pa.record_batch([pa.array([i for i, x in enumerate(best) for _ in x], pa.int32()), pa.array([s for x in best for s, _ in x], pa.float64()),
                               pa.array([n for x in best for _, n in x], pa.int32())], ["probe", "s", "leaf"])

    parts = (placed.mapInArrow(brute, "probe int, s double, leaf int").groupBy("probe")
             .agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "leaf"))), 1, k + 1).alias("best")).collect())  # CALIBRATION rows
    at = []  # for each true neighbour, how many visits reach it
    for row in parts:
        order = {leaf: i + 1 for i, leaf in enumerate(tree.best_bins(probes[row.probe], tree.leaves))}
        at.append(sorted(order[x.leaf] for x in row.best[1:]) or [1])  # the first is the probe itself, or as near
    for visits in range(1, tree.leaves + 1):
        if np.mean([np.mean([a <= visits for a in x]) for x in at]) >= TARGET:
            return visits
    return tree.leaves
