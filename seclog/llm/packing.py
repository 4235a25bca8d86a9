"""Best-fit packing of token sequences after a dominance reduction.

Every document's ids, with an end id, are cut into pieces of at most ``size`` ids (only
longer ones are cut) and the pieces are packed into as few sequences of ``size`` as the
method finds. Packing depends on piece lengths only, so it works on the histogram of at most
``size`` lengths, whatever the number of documents:

1. Dominance reduction after Martello and Toth: a set of pieces is fixed as a sequence for
   good when it provably dominates every other feasible set with its longest piece. That is
   so for a piece that fills a sequence; for a pair that fills one exactly; for a piece that
   nothing fits beside; for a piece and the longest that fits beside it, when no two or when
   no three others fit and no two reach its length.
2. The rest is packed best-fit, longest first, over counts of open sequences with equal room.

Both steps give stretches: ranks of pieces of one length, and the sequences and places they
take. Pieces find theirs by their rank among the pieces of their length, which is counted in
parallel (``ranking``).
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seclog.llm import text as X
from seclog.llm.ranking import ranked
from seclog.llm.store import Scratch
from seclog.llm.tokens import default_vocabulary, encoder


class Plan:
    """Stretches (length, first rank, first sequence, pieces in each sequence, offset there) over a histogram."""

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.counts, self.used = size, counts.astype(np.int64).copy(), np.zeros(size + 1, np.int64)
        self.sequences, self.stretches = 0, []
        self.fixed = 0
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def _take(self, length: int, n: int, base: int, per: int, offset: int) -> None:
        self.stretches.append((length, int(self.used[length]), base, per, offset))
        self.used[length] += n
        self.counts[length] -= n

    def _fix(self, n: int, *lengths: int) -> None:
        """``n`` sequences of these lengths each, longest first."""
        offset = 0
        if len(lengths) == 2 and lengths[0] == lengths[1]:
            self._take(lengths[0], 2 * n, self.sequences, 2, 0)
        else:
            for length in lengths:
                self._take(length, n, self.sequences, 1, offset)
                offset += length
        self.sequences += n

    def _left(self, without: int) -> list[int]:
        """The three shortest pieces left besides one of length ``without``."""
        out: list[int] = []
        for length in np.flatnonzero(self.counts).tolist():
            out += [length] * min(3, int(self.counts[length]) - (length == without))
            if len(out) >= 3:
                break
        return out[:3]

    def _best_pair(self, room: int, without: int) -> int:
        """Largest sum of two pieces left that fit ``room``, 0 if none do."""
        counts = self.counts.copy()
        counts[without] -= 1
        lengths = np.flatnonzero(counts[:room + 1])
        best, j = 0, len(lengths) - 1
        for i, a in enumerate(lengths.tolist()):
            while j >= i and a + lengths[j] > room:
                j -= 1
            if j < i:
                break
            if j > i or counts[a] > 1:
                best = max(best, a + int(lengths[j]))
            elif j - 1 >= i + 1:
                best = max(best, a + int(lengths[j - 1]))
        return best

    def reduce(self) -> None:
        size = self.size
        if self.counts[size]:
            self._fix(int(self.counts[size]), size)
        for long in range(size - 1, 0, -1):
            while self.counts[long]:
                room, n = size - long, int(self.counts[long])
                if room == long and n > 1:
                    self._fix(n // 2, long, long)
                    continue
                if room != long and self.counts[room]:
                    self._fix(min(n, int(self.counts[room])), *sorted((long, room), reverse=True))
                    continue
                small = self._left(long)
                if not small or small[0] > room:
                    self._fix(n if not small or small[0] != long else 1, long)
                    continue
                fits = np.flatnonzero(self.counts[:room + 1])
                fits = fits[(fits != long) | (n > 1)]
                other = int(fits[-1])
                no_two = len(small) < 2 or small[0] + small[1] > room
                no_three = len(small) < 3 or sum(small) > room
                if no_two or (no_three and self._best_pair(room, long) <= other):
                    self._fix(1 if other == long else min(n, int(self.counts[other])), *sorted((long, other), reverse=True))
                    continue
                break

    def best_fit(self) -> None:
        rooms: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = {}

        def add(room: int, base: int, n: int) -> None:
            if n and room:
                if room not in open_:
                    bisect.insort(rooms, room)
                open_.setdefault(room, []).append((base, n))

        for length in range(self.size, 0, -1):
            while n := int(self.counts[length]):
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    base, there = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[at]
                else:
                    room, base = self.size, self.sequences
                    there = -(-n // (room // length))
                    self.sequences += there
                per = room // length
                full = min(there, n // per)
                if full:
                    self._take(length, full * per, base, per, self.size - room)
                    add(room - per * length, base, full)
                rest = min(n - full * per, per - 1) if full < there else 0
                if rest:
                    self._take(length, rest, base + full, rest, self.size - room)
                    add(room - rest * length, base + full, 1)
                add(room, base + full + (rest > 0), there - full - (rest > 0))

    def table(self) -> np.ndarray:
        """Stretches in the order of (length, first rank)."""
        out = np.array(self.stretches, np.int64).reshape(-1, 5)
        return out[np.lexsort((out[:, 1], out[:, 0]))]


def pieces(docs: DataFrame, size: int, end_id: int, vocabulary: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null text has only its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for rows, _, _ in X.slices(batch, "text"):
                ids, first = encode(rows.column(1))
                ids, first = with_end(ids, first, end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                n = np.maximum(1, -(-np.diff(first) // size))
                row = np.repeat(np.arange(rows.num_rows), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a = first[row] + piece * size
                b = np.minimum(a + size, first[row + 1])
                yield pa.record_batch([
                    rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()), pa.array(b - a, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(a.tolist(), b.tolist())], pa.int64()),
                ], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """An end id behind each row's ids."""
    return np.insert(ids, first[1:], np.uint32(end_id)), first + np.arange(len(first))


def pack(docs: DataFrame, size: int = 4096, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text).

    Repeated rows are packed each; equal pieces are interchangeable. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, size, end_id, vocabulary or default_vocabulary()), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r.n
    table = Plan(counts, size).table()
    keys = table[:, 0] * (1 << 44) + table[:, 1]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            _, low, base, per, offset = table[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1].T
            yield pa.record_batch([*batch.columns[:5], pa.array(base + (rank - low) // per), pa.array(offset + (rank - low) % per * length)],
                                  ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(cut, "length", int(counts.sum())).mapInArrow(
        settle, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
