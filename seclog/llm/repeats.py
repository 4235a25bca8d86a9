"""Repeated passages: every byte covered by a 200-byte string that also starts anywhere else.

Sorting every suffix of a corpus moves each text many times over. Here only suffixes that
can matter are sorted:

1. Anchors. A window of ``LENGTH`` bytes is assigned to the smallest-hashed ``GRAM``-gram
   among its first ``REACH`` positions (the leftmost, if several). Equal windows choose the
   same anchor at the same offset, so a window repeats only if another anchor owns an equal
   window. Neighbouring windows share anchors: there is about one for 50 bytes. An anchor's
   context is the stretch of all windows that it owns.
2. All windows of an anchor hold the ``SHARED`` bytes from it on. Anchors whose shared bytes
   occur once are done (counts by hash). If all contexts with the same shared bytes are
   equal, all their windows repeat. What is left are contexts at the edges of repetitions.
3. These are sorted by their suffix from the anchor on, in a distributed merge sort that
   knows common prefixes: tasks sort their part, cut it at sampled splitters and send it as
   front-coded runs (length of the prefix shared with the suffix before, and the rest); the
   receiver merges the runs with a loser tree that holds each run's common prefix with the
   last output and so never compares known bytes again. Neighbours in that order and in the
   order of what stands left of the anchor give the longest repeated window on either side.
   The windows of an anchor all hold the anchor, so what they cover is one stretch.
4. Groups of more than ``GROUP`` contexts with the same shared bytes are not brought into one
   task: their windows are counted by hash, spread over all tasks.
5. Texts with repeated anchors get their stretches back and are cut.

Matches never cross rows. A null text is empty; texts under ``LENGTH`` bytes repeat nothing.
Equal rows repeat each other. Hashes of strings have 64 bits; the suffixes that decide edges
are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from seclog.llm import text as X
from seclog.llm.store import Scratch

LENGTH, REACH, GRAM = 200, 100, 32
SHARED = LENGTH - REACH + 1
GROUP = 4096
#: Contexts that a merging task gets, on average.
MERGE_ROWS = 20_000
SAMPLE = 20_000


class Anchors:
    """Anchors of a slice: place, first and last window, hashes of shared bytes and context, and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.total = X.prefix_hash(data)
        n = len(data) - LENGTH + 1
        empty = np.empty(0, np.int64)
        self.at = self.first = self.last = self.row = empty
        self.shared = self.context = np.empty(0, np.uint64)
        if n <= 0:
            return
        grams = np.arange(len(data) - GRAM + 1)
        key = (X.span_hash(self.total, grams, grams + GRAM) & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
        wide = 1
        while wide * 2 <= REACH:
            key = np.minimum(key[:-wide], key[wide:])
            wide *= 2
        low = np.minimum(key[:n], key[REACH - wide:REACH - wide + n])
        chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.searchsorted(offsets, np.arange(n), "right") - 1
        valid = np.arange(n) + LENGTH <= offsets[row + 1]
        start = valid.copy()
        start[1:] &= (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
        end = valid.copy()
        end[:-1] &= (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]) | ~valid[1:]
        self.first, self.last = np.flatnonzero(start), np.flatnonzero(end)
        self.at, self.row = chosen[self.first], row[self.first]
        self.shared = X.span_hash(self.total, self.at, self.at + SHARED)
        self.context = X.mix(X.span_hash(self.total, self.first, self.last + LENGTH) + (self.at - self.first).astype(np.uint64))


def _text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit names of the texts of a slice."""
    return X.span_hash(X.prefix_hash(data), offsets[:-1], offsets[1:]).view(np.int64)


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(shared, context, key) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in X.slices(batch, "text"):
                found, keys = Anchors(data, offsets), _text_keys(data, offsets)
                yield pa.record_batch([pa.array(found.shared.view(np.int64)), pa.array(found.context.view(np.int64)), pa.array(keys[found.row])],
                                      ["shared", "context", "key"])

    return texts.select("text").mapInArrow(run, "shared long, context long, key long")


def _packed(texts: DataFrame) -> DataFrame:
    """(key, packed): texts that hold a window, compressed for the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for _, data, offsets in X.slices(batch, "text"):
                long = np.flatnonzero(np.diff(offsets) >= LENGTH)
                keys, at = np.unique(_text_keys(data, offsets)[long], return_index=True)
                yield pa.record_batch([pa.array(keys), pa.array([pack.compress(data[offsets[i]:offsets[i + 1]].tobytes()) for i in long[at].tolist()], pa.binary())],
                                      ["key", "packed"])

    return texts.select("text").mapInArrow(run, "key long, packed binary")


def _opened(packed: bytes, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(unpack.decompress(packed), np.uint8)


def _contexts(wanted: DataFrame) -> DataFrame:
    """(shared, context, left, right) of the anchors in ``wanted`` (packed, contexts); left is read backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed, contexts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = _opened(packed, unpack)
                found = Anchors(data, np.array([0, len(data)]))
                names, at = np.unique(found.context.view(np.int64), return_index=True)
                at = at[np.isin(names, contexts)]
                left = [data[a:b][::-1].tobytes() for a, b in zip(found.first[at].tolist(), found.at[at].tolist())]
                right = [data[a:b + LENGTH].tobytes() for a, b in zip(found.at[at].tolist(), found.last[at].tolist())]
                yield pa.record_batch([pa.array(found.shared[at].view(np.int64)), pa.array(found.context[at].view(np.int64)), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                                      ["shared", "context", "left", "right"])

    return wanted.mapInArrow(run, "shared long, context long, left binary, right binary")


# --- merge sort that knows common prefixes -----------------------------------------------

def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of which ``known`` bytes are known."""
    n, i = min(len(a), len(b)), known
    while i < n and a[i:i + 32] == b[i:i + 32]:
        i += 32
    i = min(i, n)
    while i < n and a[i] == b[i]:
        i += 1
    return i


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix with the suffix before, and the rest, of sorted suffixes."""
    shared = [0] + [common_prefix(a, b) for a, b in zip(suffixes, suffixes[1:])]
    return shared, [s[n:] for s, n in zip(suffixes, shared)]


class Run:
    """A front-coded run, read one suffix at a time."""

    def __init__(self, shared: list[int], rests: list[bytes], rows: list):
        self.items = iter(zip(shared, rests, rows))
        self.suffix: bytes | None = b""
        self.row = None
        self.known = 0  # common prefix with the last output of the merge
        self.advance()

    def advance(self) -> None:
        """To the next suffix; the one before was the last output, so the coded prefix is what is known."""
        item = next(self.items, None)
        if item is None:
            self.suffix, self.known = None, -1
            return
        self.known = item[0]
        self.suffix, self.row = self.suffix[:item[0]] + item[1], item[2]


class LoserTree:
    """Merges runs. Each match compares known prefixes first, and bytes only beyond them."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.losers: list[Run | None] = [None] * self.size
        winners: list[Run | None] = [None] * self.size + runs + [None] * (self.size - len(runs))
        for i in range(self.size - 1, 0, -1):
            winners[i], self.losers[i] = self._play(winners[2 * i], winners[2 * i + 1])
        self.winner = winners[1]
        self.slots = {id(run): self.size + i for i, run in enumerate(runs)}

    @staticmethod
    def _play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """(winner, loser). The loser's known prefix is then the one with the winner."""
        if a is None or a.suffix is None:
            return b, a
        if b is None or b.suffix is None:
            return a, b
        if a.known != b.known:  # the one that shares more with the last output is smaller
            return (a, b) if a.known > b.known else (b, a)
        n = common_prefix(a.suffix, b.suffix, a.known)
        first = len(a.suffix) == n or (len(b.suffix) > n and a.suffix[n] < b.suffix[n])
        winner, loser = (a, b) if first else (b, a)
        loser.known = n
        return winner, loser

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(common prefix with the output before, suffix, row) in order."""
        while self.winner is not None and self.winner.suffix is not None:
            run = self.winner
            yield run.known, run.suffix, run.row
            run.advance()
            i, best = self.slots[id(run)] // 2, run
            while i >= 1:
                best, self.losers[i] = self._play(best, self.losers[i])
                i //= 2
            self.winner = best


def _sorted_runs(contexts: DataFrame, splitters: list[bytes]) -> DataFrame:
    """(target, shared, rests, contexts, lefts): front-coded runs, cut at the splitters."""

    def cut(rows: list[tuple[bytes, int, bytes]]) -> Iterator[pa.RecordBatch]:
        rows.sort()
        targets = [bisect_right(splitters, r[0][:SHARED]) for r in rows]
        at = 0
        while at < len(rows):
            end = bisect_right(targets, targets[at], at)
            shared, rests = front_code([r[0] for r in rows[at:end]])
            yield pa.record_batch([
                pa.array([targets[at]], pa.int32()), pa.array([shared], pa.list_(pa.int16())), pa.array([rests], pa.list_(pa.binary())),
                pa.array([[r[1] for r in rows[at:end]]], pa.list_(pa.int64())), pa.array([[r[2] for r in rows[at:end]]], pa.list_(pa.binary())),
            ], ["target", "shared", "rests", "contexts", "lefts"])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            if len(held) > 200_000:
                yield from cut(held)
                held = []
        if held:
            yield from cut(held)

    return contexts.select("right", "context", "left").mapInArrow(
        run, "target int, shared array<short>, rests array<binary>, contexts array<long>, lefts array<binary>")


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(s) for s in strings])
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width), length


def longest(shared: list[int], rights: list[bytes], lefts: list[bytes]) -> list[tuple[int, int]]:
    """For contexts with the same shared bytes, in suffix order: longest repeated reach to the left and to the right.

    ``shared`` are the common prefixes of neighbours. A pair counts if left and right reach
    together make a whole window. Each context walks away from its place, in suffix order and
    in the order of what stands to its left, until the first partner that counts: no later
    one can reach further on that side. (-1, -1): no window repeats.
    """
    n = len(rights)
    order = sorted(range(n), key=lambda i: lefts[i])
    left_bytes, left_length = _matrix([lefts[i] for i in order], max(max(map(len, lefts)), 1))
    right_bytes, right_length = _matrix([rights[i] for i in order], max(map(len, rights)))
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)

    def reach(a: np.ndarray, b: np.ndarray, matrix: np.ndarray, length: np.ndarray) -> np.ndarray:
        differ = matrix[a] != matrix[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
        return np.minimum(first, np.minimum(length[a], length[b]))

    def walk(places: np.ndarray, near: np.ndarray, other: np.ndarray, other_length: np.ndarray, most: np.ndarray) -> np.ndarray:
        """places: rows in walking order; near: common reach of neighbours; most: best reach on the other side."""
        best = np.full(n, -1)
        for way in (1, -1):
            todo = np.arange(n)
            have = np.full(n, 1 << 20)
            step = 1
            while len(todo):
                there = todo + way * step
                todo, there = todo[(there >= 0) & (there < n)], there[(there >= 0) & (there < n)]
                have[todo] = np.minimum(have[todo], near[there if way < 0 else there - 1])
                go = (have[todo] > best[todo]) & (have[todo] + most[places[todo]] >= LENGTH)
                todo, there = todo[go], there[go]
                for i in range(0, len(todo), 4096):
                    a, b = todo[i:i + 4096], there[i:i + 4096]
                    fits = have[a] + reach(places[a], places[b], other, other_length) >= LENGTH
                    best[a[fits]] = have[a[fits]]
                todo = todo[best[todo] < have[todo]]
                step += 1
        out = np.empty(n, np.int64)
        out[places] = best
        return out

    near_left = np.append(reach(np.arange(n - 1), np.arange(1, n), left_bytes, left_length), 0)
    near_right = np.append(np.array(shared[1:], np.int64), 0)
    most_left = np.maximum(near_left, np.concatenate([[0], near_left[:-1]]))
    most_right = np.empty(n, np.int64)
    most_right[back] = np.maximum(near_right, np.concatenate([[0], near_right[:-1]]))
    right = walk(back, near_right, left_bytes, left_length, most_left)
    left = walk(np.arange(n), near_left, right_bytes, right_length, most_right)
    return [(int(left[back[i]]), int(right[back[i]])) for i in range(n)]


def _merged(runs: DataFrame) -> DataFrame:
    """(context, left, right): reaches of contexts, from the merged runs of each target."""

    def merge(table: pa.Table) -> pa.Table:
        tree = LoserTree([Run(s, r, list(zip(c, x))) for s, r, c, x in zip(*(table.column(name).to_pylist() for name in ("shared", "rests", "contexts", "lefts")))])
        names, lefts, rights = [], [], []
        group: list[tuple[int, bytes, tuple[int, bytes]]] = []

        def close() -> None:
            if len(group) > 1:
                names.extend(row[0] for _, _, row in group)
                for a, b in longest([g[0] for g in group], [g[1] for g in group], [g[2][1] for g in group]):
                    lefts.append(a)
                    rights.append(b)
            group.clear()

        for item in tree:
            if item[0] < SHARED:
                close()
            group.append(item)
        close()
        return pa.table({"context": pa.array(names, pa.int64()), "left": pa.array(lefts, pa.int32()), "right": pa.array(rights, pa.int32())})

    return runs.groupBy("target").applyInArrow(merge, "context long, left int, right int")


def _counted_windows(wanted: DataFrame) -> DataFrame:
    """(context, left, right) for groups of any size: windows of the contexts in ``wanted`` counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed, contexts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = _opened(packed, unpack)
                found = Anchors(data, np.array([0, len(data)]))
                names, at = np.unique(found.context.view(np.int64), return_index=True)
                at = at[np.isin(names, contexts)]
                n = found.last[at] - found.first[at] + 1
                own = np.repeat(at, n)
                start = found.first[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window = X.span_hash(found.total, start, start + LENGTH)
                yield pa.record_batch([pa.array(window.view(np.int64)), pa.array(found.context[own].view(np.int64)), pa.array((found.at[own] - start).astype(np.int32))],
                                      ["window", "context", "before"])

    windows = wanted.mapInArrow(run, "window long, context long, before int")
    again = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    return windows.join(again, "window").groupBy("context").agg(F.max("before").alias("left"), (LENGTH - F.min("before")).cast("int").alias("right"))


def stretches(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, packed, found): texts with repeated windows and the reach of each such context (context, left, right)."""
    rows = _anchor_rows(texts)
    counts = rows.groupBy("shared").agg(F.count("*").alias("n")).filter("n > 1").select("shared")
    touched = scratch.keep(rows.join(counts, "shared").groupBy("shared", "context", "key").agg(F.count("*").alias("n")), "touched")
    classes = scratch.keep(touched.groupBy("shared", "context").agg(F.sum("n").alias("n"), F.min("key").alias("key")), "classes")
    # one class only: it is there more than once, since its shared bytes are
    kinds = classes.groupBy("shared").agg(F.count("*").alias("kinds"))
    edges = scratch.keep(classes.join(kinds.filter("kinds > 1"), "shared"), "edges")
    packed = _packed(texts).dropDuplicates(["key"])

    def wanted(some: DataFrame) -> DataFrame:
        """One text of each class."""
        return packed.join(some.groupBy("key").agg(F.collect_list("context").alias("contexts")), "key").select("packed", "contexts")

    contexts = scratch.keep(_contexts(wanted(edges.filter(F.col("kinds") <= GROUP))), "contexts")
    total = contexts.count()
    share = F.pmod(F.xxhash64("context"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(total, 1)))
    sample = sorted({bytes(r.head) for r in contexts.filter(share).select(F.expr(f"substring(right, 1, {SHARED})").alias("head")).collect()})  # about SAMPLE rows
    targets = max(1, -(-total // MERGE_ROWS))
    splitters = sorted({sample[i * len(sample) // targets] for i in range(1, targets)}) if sample else []
    merged = _merged(_sorted_runs(contexts, splitters))
    large = edges.filter(F.col("kinds") > GROUP)
    counted = _counted_windows(wanted(large)) if not large.isEmpty() else merged.limit(0)
    reach = merged.unionByName(counted).filter("left >= 0")
    # a class that is there more than once repeats whole, whatever its neighbours
    known = (classes.join(kinds, "shared").join(reach, "context", "left")
             .select("context", F.when((F.col("n") > 1) | (F.col("kinds") == 1), F.lit(LENGTH)).otherwise(F.col("left")).alias("left"),
                     F.when((F.col("n") > 1) | (F.col("kinds") == 1), F.lit(2 * LENGTH)).otherwise(F.col("right")).alias("right"))
             .filter(F.col("left").isNotNull()))
    known = scratch.keep(known, "known")
    own = touched.join(known, "context").groupBy("key").agg(F.collect_list(F.struct("context", "left", "right")).alias("found"))
    return packed.join(own, "key")


def _covered(data: np.ndarray, found: dict[int, tuple[int, int]]) -> np.ndarray:
    """Which bytes of a text are repeated."""
    anchors = Anchors(data, np.array([0, len(data)]))
    edge = np.zeros(len(data) + 1, np.int64)
    for name, at, first, last in zip(anchors.context.view(np.int64).tolist(), anchors.at.tolist(), anchors.first.tolist(), anchors.last.tolist()):
        reach = found.get(name)
        if reach is not None:
            edge[max(first, at - reach[0])] += 1
            edge[min(last + LENGTH, at + reach[1])] -= 1
    return np.cumsum(edge)[:-1] > 0


def spans(covered: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs."""
    turn = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return turn.reshape(-1, 2)


def cut(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) of every row of ``docs`` (doc_id, text): remaining bytes and removed (start, end)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i, (key, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                rows = batch.column(2)[i].values
                data = _opened(packed, unpack)
                found = dict(zip(rows.field("context").to_pylist(), zip(rows.field("left").to_pylist(), rows.field("right").to_pylist())))
                covered = _covered(data, found)
                kept = data[~covered].tobytes()
                yield pa.record_batch([pa.array([key]), pa.array([[{"start": a, "end": b} for a, b in spans(covered).tolist()]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                                       pa.array([hashlib.sha256(kept).hexdigest()])], ["key", "spans", "kept_sha256"])

    found = stretches(texts, scratch).select("key", "packed", "found").mapInArrow(run, "key long, spans array<struct<start:int,end:int>>, kept_sha256 string")
    found = scratch.keep(found, "spans")
    scratch.drop("touched", "classes", "edges", "contexts", "known")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.slices(batch, "text"):
                raw = data.tobytes()
                yield pa.record_batch([rows.column(0), pa.array(np.diff(offsets)), pa.array(_text_keys(data, offsets)),
                                       pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())])],
                                      ["doc_id", "n_bytes", "key", "whole_sha256"])

    rows = texts.mapInArrow(keyed, "doc_id long, n_bytes long, key long, whole_sha256 string")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return rows.join(found, "key", "left").select("doc_id", "n_bytes", F.coalesce("spans", empty).alias("spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return cut(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
