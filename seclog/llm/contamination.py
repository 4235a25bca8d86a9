"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned over every document.

Words are runs of 0-9, a-z (A-Z lower-cased) and everything beyond ASCII. An item's windows
are its runs of ``width`` words; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit. Hits found by hash are verified on
the words themselves.

The benchmark is cut into pieces of at most ``PIECE`` words and dealt into as many slices as
keep a broadcast under ``SLICE_WORDS`` words; each slice is one more pass over the
documents, chained without a shuffle. Null or empty texts have no words. Repeated items
and rows are treated like any others; an item without an id counts under the empty id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seclog.llm import text as X

PIECE = 4096
SLICE_WORDS = 2_000_000

FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def benchmark_pieces(items: DataFrame, width: int) -> DataFrame:
    """(item_id, words): normalised words joined by spaces, cut with an overlap of width - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.slices(batch, "text"):
                data = X.LOWER[data]
                starts, ends, first = X.words(data, offsets, X.ALNUM)
                ids, out = [], []
                for name, a, b in zip(rows.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    for i in range(a, max(b - width + 1, a + (b > a)), PIECE - width + 1):
                        own = [data[s:e].tobytes() for s, e in zip(starts[i:min(b, i + PIECE)], ends[i:min(b, i + PIECE)])]
                        ids.append(name)
                        out.append(b" ".join(own))
                yield pa.record_batch([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["item_id", "words"])

    return (items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string"))
            .mapInArrow(run, "item_id string, words binary"))


class Windows:
    """Hash set of the windows of some pieces."""

    def __init__(self, pieces: list[tuple[str, bytes]], width: int):
        self.at: dict[int, dict[int, list[tuple[str, bytes]]]] = {}
        for item, joined in pieces:
            own = joined.split(b" ")
            data = np.frombuffer(joined, np.uint8)
            hashes, _ = X.word_hashes(data, np.array([0, len(data)]), X.ALNUM)
            n = min(width, len(own))
            table = self.at.setdefault(n, {})
            for i, h in enumerate(X.sequence_hashes(hashes, n).tolist()):
                known = table.setdefault(h, [])
                entry = (item, b" ".join(own[i:i + n]))
                if entry not in known:
                    known.append(entry)
        self.keys, self.bits = {}, {}
        for n, table in self.at.items():
            self.keys[n] = np.array(sorted(table), np.uint64)
            self.bits[n] = np.zeros(1 << 20, bool)
            self.bits[n][self.keys[n] & np.uint64((1 << 20) - 1)] = True

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list], list[set]]:
        """Words of each row, its hit byte spans and the items found in it."""
        data = X.LOWER[data]
        starts, ends, first = X.words(data, offsets, X.ALNUM)
        hashes = X.span_hash(X.prefix_hash(data), starts, ends)
        edge = np.zeros(len(starts) + 1, np.int64)
        items: list[set] = [set() for _ in range(len(first) - 1)]
        for n, keys in self.keys.items():
            runs = X.sequence_hashes(hashes, n)
            at = np.flatnonzero(self.bits[n][runs & np.uint64((1 << 20) - 1)])
            at = at[np.isin(runs[at], keys)]
            row = np.searchsorted(first, at, "right") - 1
            inside = at + n <= first[row + 1]
            for i, r in zip(at[inside].tolist(), row[inside].tolist()):
                own = b" ".join(data[s:e].tobytes() for s, e in zip(starts[i:i + n], ends[i:i + n]))
                found = [item for item, words in self.at[n][int(runs[i])] if words == own]
                if found:
                    items[r].update(found)
                    edge[i] += 1
                    edge[i + n] -= 1
        hit = np.cumsum(edge)[:-1] > 0
        spans: list[list] = [[] for _ in range(len(first) - 1)]
        if hit.any():
            turn = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
                r = int(np.searchsorted(first, a, "right")) - 1
                while a < b:  # runs that touch across rows are cut
                    stop = min(b, int(first[r + 1]))
                    if a < stop:
                        spans[r].append((a - int(first[r]), stop - int(first[r])))
                    a, r = max(a, stop), r + 1
        return np.diff(first), spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """``docs`` (any columns, among them text) with n_words, spans of hit words (first, end) and items found."""
    spark = docs.sparkSession
    pieces = benchmark_pieces(items, width)
    n_words = pieces.agg(F.sum(F.size(F.split(F.decode("words", "UTF-8"), " ")))).first()[0] or 0
    slices = max(1, -(-n_words // SLICE_WORDS))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:int,end:int>>"),
                            "items": F.array().cast("array<string>")})
    dealt = pieces.withColumn("slice", F.pmod(F.xxhash64("item_id", "words"), F.lit(slices)))
    for i in range(slices):
        held = spark.sparkContext.broadcast([(r.item_id, bytes(r.words)) for r in dealt.filter(F.col("slice") == i).collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            windows = Windows(held.value, width)
            for batch in batches:
                names = batch.schema.names
                for rows, data, offsets in X.slices(batch, "text"):
                    n, spans, found = windows.scan(data, offsets)
                    before = rows.column(names.index("spans")).to_pylist(), rows.column(names.index("items")).to_pylist()
                    fresh = {
                        "n_words": pa.array(n, pa.int64()),
                        "spans": pa.array([[{"start": a, "end": b} for a, b in _merge(x + [(y["start"], y["end"]) for y in old])]
                                           for x, old in zip(spans, before[0])], rows.schema.field("spans").type),
                        "items": pa.array([sorted(x | set(old)) for x, old in zip(found, before[1])], pa.list_(pa.string())),
                    }
                    yield pa.record_batch([fresh.get(c, rows.column(j)) for j, c in enumerate(names)], names)

        out = out.mapInArrow(run, out.schema)
    return out


def report(docs: DataFrame, items: DataFrame, width: int = 13, parts: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated): contaminated if hit words are at least 1/parts of all."""
    found = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), items, width)
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]), F.lit(0).cast("long"))
    return (found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")})
            .select("doc_id", "n_words", "n_hit", "n_items", "items", (_contaminated(parts)).alias("contaminated")))


def _contaminated(parts: int):
    return (F.col("n_hit") > 0) & (parts * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, parts: int = 20, cut: bool = False) -> DataFrame:
    """The documents without the contaminated ones; with ``cut``, all documents without the hit passages."""
    own = docs.columns
    clash = [c for c in ("n_words", "spans", "items") if c in own]
    held = docs.withColumnsRenamed({c: f"__{c}" for c in clash})
    found = find(held, items, width)
    if cut:
        out = found.withColumn("text", cut_words("text", "spans"))
    else:
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
        out = found.withColumn("n_hit", n_hit).filter(~_contaminated(parts))
    return out.select([F.col(f"__{c}").alias(c) if c in clash else F.col(f"`{c}`") for c in own])


def cut_words(text: str, spans: str):
    """Texts without their hit words and what stands between those."""
    import pandas as pd

    def cut(texts, spans):
        out = []
        for own, cuts in zip(texts, spans):
            if own is None or not len(cuts):
                out.append(own)
                continue
            data = np.frombuffer(own.encode(), np.uint8)
            starts, ends, _ = X.words(data, np.array([0, len(data)]), X.ALNUM)
            keep, at = [], 0
            for x in cuts:
                keep.append(data[at:starts[x["start"]]].tobytes())
                at = int(ends[x["end"] - 1])
            out.append((b"".join(keep) + data[at:].tobytes()).decode())
        return pd.Series(out)

    cut.__annotations__ = {"texts": pd.Series, "spans": pd.Series, "return": pd.Series}
    return F.pandas_udf(cut, "string")(text, spans)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
