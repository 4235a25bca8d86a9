"""Captures of any size: one file's records, found by many tasks.

Spark splits a text file by bytes; a task has to find where records start in its range (a
*block*, named by its first byte).

* Event text starts its records at lines ``Event[``, so that is the line separator.
* JSON captures have no such mark. They are read in fragments that end with a closing
  brace. Whether a brace counts depends on all quotes before it, so each block first
  says what it does to either state it may start in, outside a string or inside one (quotes,
  depth of braces, objects that start at each depth). Blocks are few; their effects, applied
  in order file by file, give the true state at each block's start, and a second pass cuts the
  objects. An object that crosses blocks is put together from its pieces.

Records keep the number they have in their file. Files that Spark reads in one piece need no first pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Spark's JSON parser goes no deeper, so deeper objects are no records.
MAX_DEPTH = 1000
_QUOTE, _ESCAPE, _OPEN, _CLOSE = b'"\\{}'


def fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, size, value) of text cut at ``separator``; the rows of a block stand together, in order."""
    return (spark.read.option("lineSep", separator).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value")))


def split_bytes(spark: SparkSession) -> int:
    """No file of at most so many bytes is split."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return min(as_bytes(spark.conf.get("spark.sql.files.%s" % name)) for name in ("maxPartitionBytes", "openCostInBytes"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file, block, rows): runs of rows of one block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        change = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files.indices.to_numpy()) != 0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            yield batch.column("file")[a].as_py(), int(blocks[a]), batch.slice(a, b - a)


def _before(rows: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the sum of ``counts`` (file, block, n) over the file's earlier blocks."""
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(name))
    return rows.join(bases, ["file", "block"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


# --- objects of a JSON capture ------------------------------------------------------------


def braces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of braces, the quotes before each (modulo 2), and all quotes (modulo 2); escaped quotes don't count.

    ``data`` starts behind a brace, so no escape reaches into it.
    """
    quotes = np.flatnonzero(data == _QUOTE)
    if len(quotes) and (data == _ESCAPE).any():
        plain = np.flatnonzero(data != _ESCAPE)
        last = np.searchsorted(plain, quotes) - 1  # the last other byte before the quote
        run = quotes - 1 - np.where(last >= 0, plain[np.maximum(last, 0)], -1)
        quotes = quotes[run % 2 == 0]
    places = np.flatnonzero((data == _OPEN) | (data == _CLOSE))
    return places, np.searchsorted(quotes, places) & 1, len(quotes) & 1


def _joined(rows: pa.RecordBatch) -> np.ndarray:
    """The fragments of a run with their closing braces."""
    values = rows.column("value").to_pylist()
    return np.frombuffer(b"}".join([*values, b""]), np.uint8)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, quotes, depths, lowest, starts): what a block does, for a start outside of a string and inside one.

    starts[s][k]: objects that start in it if it starts at depth k.
    """
    held: dict[tuple[str, int], list] = {}
    for file, block, rows in _by_block(batches):
        state = held.setdefault((file, block), [0, [0, 0], [0, 0], [{}, {}]])
        data = _joined(rows)
        places, inside, quotes = braces(data)
        opens = data[places] == _OPEN
        for s in (0, 1):
            own = opens[(inside ^ s ^ state[0]) == 0]
            depth = state[1][s] + np.cumsum(np.where(own, 1, -1))
            at = (depth - 1)[own]
            for v, n in zip(*np.unique(at[(at <= 0) & (at >= -MAX_DEPTH)], return_counts=True)):
                state[3][s][-int(v)] = state[3][s].get(-int(v), 0) + int(n)
            if len(depth):
                state[1][s], state[2][s] = int(depth[-1]), min(state[2][s], int(depth.min()))
        state[0] ^= quotes
    if held:
        yield pa.record_batch(
            [pa.array([f for f, _ in held]), pa.array([b for _, b in held], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()),
             *(pa.array([v[i] for v in held.values()], pa.list_(pa.int64())) for i in (1, 2)),
             pa.array([[list(x.items()) for x in v[3]] for v in held.values()], pa.list_(pa.map_(pa.int64(), pa.int64())))],
            ["file", "block", "quotes", "depths", "lowest", "starts"])


def _states(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each block of a file: inside a string, depth, the block in which the open object started."""
    inside, depth, owner, out = 0, 0, -1, []
    for r in pdf.sort_values("block").itertuples():
        out.append((r.file, r.block, inside, depth, owner, int(dict(r.starts[inside]).get(depth, 0))))
        ended = depth + int(r.lowest[inside]) <= 0
        if ended or owner < 0:
            owner = r.block
        depth = max(0, depth + int(r.depths[inside]))
        owner = owner if depth else -1
        inside ^= int(r.quotes)
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth", "owner", "n"])


def _objects(known: dict[tuple[str, int], tuple[int, int, int]]):
    """Cut the objects of each block: (file, owner, idx, block, text, whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, depth, owner, idx, rest = None, 0, 0, -1, -1, []

        def leave() -> list[tuple]:
            """What is still open at the end of a block."""
            return [(now[0], owner, idx if owner == now[1] else None, now[1], b"".join(rest), False)] if now and depth and rest else []

        for file, block, rows in _by_block(batches):
            out = []
            if (file, block) != now:
                out += leave()
                now, idx, rest = (file, block), -1, []
                inside, depth, owner = known.get(now, (0, 0, -1))
            data = _joined(rows)
            places, odd, quotes = braces(data)
            real = (odd ^ inside) == 0
            places, opens = places[real], data[places[real]] == _OPEN
            after = depth + np.cumsum(np.where(opens, 1, -1))
            starts, ends = places[opens & (after == 1)].tolist(), (places[~opens & (after == 0)] + 1).tolist()
            raw, at = data.tobytes(), 0
            if depth and ends:  # the object that was open ends here
                whole = owner == block
                out.append((file, owner, idx if whole else None, block, b"".join([*rest, raw[:ends[0]]]), whole))
                rest, at = [], 1
            elif depth:
                rest.append(raw)
            for k, start in enumerate(starts):
                idx += 1
                if k + at < len(ends):
                    out.append((file, block, idx, block, raw[start:ends[k + at]], True))
                else:
                    rest, owner = [raw[start:]], block
            depth = max(0, int(after[-1])) if len(after) else depth
            inside ^= quotes
            if out:
                yield _pieces(out)
        out = leave()
        if out:
            yield _pieces(out)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "owner", "idx", "block", "text", "whole"])


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, item_no, text) of the outermost objects of JSON files: the items of an array, or one object, or several.

    The states of the blocks of split files are broadcast: some ten numbers for each block, so 1 MB for 1 TB.
    """
    parts = fragments(spark, path, "}")
    effects = (parts.filter(F.col("size") > split_bytes(spark)).select("file", "block", "value")
               .mapInArrow(_effects, "file string, block long, quotes long, depths array<long>, lowest array<long>, starts array<map<long, long>>"))
    states = effects.groupBy("file").applyInPandas(_states, "file string, block long, inside int, depth long, owner long, n long")
    found = states.collect()  # one row per block of a split file
    known = {(r.file, r.block): (r.inside, r.depth, r.owner) for r in found}
    pieces = parts.select("file", "block", "value").mapInArrow(
        _objects(known), "file string, owner long, idx long, block long, text binary, whole boolean")
    if not found:
        return pieces.filter("whole").select("file", F.col("idx").alias("item_no"), F.col("text").cast("string").alias("text"))
    whole = pieces.filter("whole").select("file", "owner", "idx", F.col("text").cast("string").alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", F.col("text").cast("string").alias("text")))), lambda p: p["text"])
    crossing = pieces.filter("NOT whole").groupBy("file", "owner").agg(F.max("idx").alias("idx"), F.array_join(ordered, "").alias("text"))
    counts = spark.createDataFrame([(r.file, r.block, r.n) for r in found], "file string, block long, n long")
    items = _before(whole.unionByName(crossing).withColumnRenamed("owner", "block"), counts, "base")
    return items.select("file", (F.col("base") + F.col("idx")).alias("item_no"), "text")


# --- records of event text ----------------------------------------------------------------


#: A line that starts a record, blanks before it aside.
_MARK = re.compile(rb"^[ \t\r]*Event\[", re.M)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, text, first, marks, ahead): fragments with the mark that was their separator, their marks, and those before them in the block."""
    now, total = None, 0
    for file, block, rows in _by_block(batches):
        fresh = (file, block) != now
        if fresh:
            now, total = (file, block), 0
        values = rows.column("value").to_pylist()
        first = [fresh and block == 0 and i == 0 for i in range(len(values))]
        texts = [v if f else b"Event[" + v for v, f in zip(values, first)]
        marks = np.array([len(_MARK.findall(t)) for t in texts], np.int64)
        ahead = total + np.cumsum(marks) - marks
        total += int(marks.sum())
        yield pa.record_batch([rows.column("file"), rows.column("block"), pa.array(texts, pa.binary()), pa.array(first), pa.array(marks), pa.array(ahead)],
                              ["file", "block", "text", "first", "marks", "ahead"])


def event_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, item_no, record) of event text with trimmed lines; item 0 is what stands before the first record.

    Lines that start with blanks are no separators for Spark's reader; the records they start are cut here.
    """
    parts = fragments(spark, path, "\nEvent[")
    schema = "file string, block long, text binary, first boolean, marks long, ahead long"
    rows = parts.select("file", "block", "value").mapInArrow(_marked, schema)
    counts = (parts.filter(F.col("size") > split_bytes(spark)).select("file", "block", "value").mapInArrow(_marked, schema)
              .groupBy("file", "block").agg(F.sum("marks").alias("n")))
    return (_before(rows, counts, "base")
            .select("file", "base", "ahead", "first", F.posexplode(record_texts(F.col("text").cast("string"))).alias("at", "record"))
            .filter(F.col("first") | (F.col("at") > 0))
            .select("file", (F.col("base") + F.col("ahead") + F.col("at")).alias("item_no"), "record"))


def record_texts(text: Column) -> Column:
    """Every line trimmed, then cut into records at the start markers; what stands before the first comes first."""
    trimmed = F.regexp_replace(F.make_valid_utf8(text), r"(?dm)^[ \t\r]+|[ \t\r]+$", "")
    return F.split(F.concat(F.lit("\n"), trimmed), r"\nEvent\[[^\n]*")
