"""Cooldown suppression: per key and in time order, let a row through only if at least
``gap`` has passed since the last row let through.

The rule is sequential, yet one key may hold much of the data, so a key is never folded
in one task. Time is cut into blocks of ``fan`` gaps. Seen from outside, a block is a
monotone step function: "an instant x at which the next row may pass" -> "the time of the
last row that passes in this block". Blocks compute their functions in parallel; rows of
neighbouring paths merge fast, so a function has few steps. Functions of blocks combine
into functions of larger blocks in the same way (``levels``). Only then does a walk per
key run over the few steps left, and its result goes back down to find the rows.

A step has ``upper``, the last instant x it serves, and ``exit``, the time from which the
next gap counts. A plain event at time t is the step (t, t).

The Python side works on sorted partitions and handles all groups of a batch at once with
numpy, since most keys are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seclog.operators.rates import MICROS
from seclog.storage import cut_lineage

START = -(1 << 62)


def group_starts(pdf: pd.DataFrame, group: list[str]) -> np.ndarray:
    """True on the first row of each group of a sorted frame."""
    first = np.zeros(len(pdf), dtype=bool)
    first[:1] = True
    for name in group:
        values = pdf[name].to_numpy()
        first[1:] |= values[1:] != values[:-1]
    return first


def whole_groups(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no group spans two of them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        if held and all(held[-1][name].iloc[-1] == pdf[name].iloc[0] for name in group):
            tail_is_one_group = not group_starts(pdf, group)[1:].any()
            if tail_is_one_group:
                held.append(pdf)
                continue
        last_start = int(np.flatnonzero(group_starts(pdf, group))[-1])
        if last_start or held:
            done = pd.concat(held + [pdf.iloc[:last_start]], ignore_index=True) if held else pdf.iloc[:last_start]
            yield done.reset_index(drop=True)
        held = [pdf.iloc[last_start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _seek(g: np.ndarray, upper: np.ndarray, query_g: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Index of the first step of group ``query_g`` with upper >= query, else -1."""
    n = len(upper)
    ranked = np.sort(upper)
    position = g * (n + 1) + np.searchsorted(ranked, upper, "left")
    wanted = query_g * (n + 1) + np.searchsorted(ranked, query, "left")
    found = np.searchsorted(position, wanted, "left")
    inside = (found < n) & (g[np.minimum(found, n - 1)] == query_g)
    return np.where(inside, found, -1)


def _combine(group: list[str], block_at: str, span: int, gap: int, bounded: bool):
    """Step function of each block from its sorted steps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, group):
            first = group_starts(pdf, group)
            g = np.cumsum(first) - 1
            upper, exits = pdf["upper"].to_numpy(), pdf["exit"].to_numpy()
            follow = _seek(g, upper, g, exits + gap)
            follow = np.where(follow < 0, np.arange(len(g)), follow)
            while True:
                further = follow[follow]
                if np.array_equal(further, follow):
                    break
                follow = further
            final = exits[follow]
            last_of_run = np.ones(len(g), dtype=bool)
            last_of_run[:-1] = (final[1:] != final[:-1]) | first[1:]
            if bounded:
                heads = np.flatnonzero(first)
                limits = pdf[block_at].to_numpy()[heads] * span + gap
                beyond = _seek(g, upper, np.arange(len(heads)), limits)
                beyond = np.where(beyond < 0, len(g), beyond)[g]
                index = np.arange(len(g))
                keep = (index == beyond) | (last_of_run & (index < beyond))
            else:
                keep = last_of_run
            out = pdf.loc[keep, group + ["upper"]].copy()
            out["exit"] = final[keep]
            yield out

    return run


def _walk(group: list[str], out: list[str], gap: int, from_start: bool):
    """Follow the steps of each group from its entry row, which sorts first.

    A group without one is skipped, or walked from its first step (``from_start``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, group):
            first = group_starts(pdf, group)
            g = np.cumsum(first) - 1
            is_step = pdf["is_step"].to_numpy().astype(bool)
            rows = np.flatnonzero(is_step)
            heads = np.flatnonzero(first if from_start else first & ~is_step)
            if not len(heads) or not len(rows):
                continue
            steps_g, upper, exits = g[rows], pdf["upper"].to_numpy()[rows], pdf["exit"].to_numpy()[rows]
            entered = np.where(is_step[heads], START, pdf["upper"].to_numpy()[heads])
            at = _seek(steps_g, upper, g[heads], entered)
            follow = _seek(steps_g, upper, steps_g, exits + gap)
            seen, when = [], []
            while True:
                live = at >= 0
                at, entered = at[live], entered[live]
                if not len(at):
                    break
                seen.append(at)
                when.append(entered)
                at, entered = follow[at], exits[at] + gap
            if seen:
                taken = rows[np.concatenate(seen)]
                yield pdf.iloc[taken].assign(entered=np.concatenate(when))[out]

    return run


def _fields(schema, names):
    return ", ".join("`%s` %s" % (n, "bigint" if n == "entered" else schema[n].dataType.simpleString()) for n in names)


def _grouped(df: DataFrame, group: list[str], order: list[str], run, fields: str) -> DataFrame:
    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, fields)


def passing_instants(steps: DataFrame, keys: list[str], gap_us: int, carry: DataFrame | None = None,
                     fan: int = 16, levels: int = 2, bounded_entry: bool = True) -> DataFrame:
    """(keys, exit) of the steps that pass. Keys must not be null.

    ``steps`` holds keys, ``upper`` and ``exit`` in microseconds, sorted alike.
    ``bounded_entry`` says that ``exit`` equals ``upper``, so a path enters a block at
    most one gap after the block starts and later steps need no entry.
    ``carry`` (keys, last_us) gives the last passing time of earlier data. It may let a
    path enter in the middle of a block.
    """
    if gap_us <= 0:  # nothing is ever silenced
        return steps.select(*keys, "exit").distinct()
    bounded_entry = bounded_entry and carry is None
    blocks = ["_b%d" % level for level in range(1, levels + 1)]
    spans = [gap_us * fan ** level for level in range(1, levels + 1)]
    layers = [steps.select(*keys, *[
        F.floor(F.col("upper") / F.lit(span)).cast("bigint").alias(block)
        for block, span in zip(blocks, spans)], "upper", "exit")]
    for level, span in enumerate(spans):
        below, group = layers[level], keys + blocks[level:]
        layers.append(_grouped(below.select(*group, "upper", "exit"), group, ["upper"],
                               _combine(group, blocks[level], span, gap_us, bounded_entry),
                               _fields(below.schema, group + ["upper", "exit"])))

    entries = None if carry is None else carry.select(*keys, (F.col("last_us") + gap_us).alias("entered"))
    for level in reversed(range(levels + 1)):
        below, group = layers[level], keys + blocks[level:]
        child = blocks[level - 1] if level else "exit"
        rows = below.withColumn("is_step", F.lit(True))
        if entries is not None:
            # The numbers of the enclosing blocks follow from the number of this one.
            outer = [F.floor(F.col(blocks[level]) / F.lit(fan ** (up - level))).cast("bigint").alias(blocks[up])
                     for up in range(level + 1, levels)]
            doors = entries.select(*keys, *blocks[level:level + 1], *outer, F.col("entered").alias("upper"),
                                   F.lit(False).alias("is_step"))
            rows = rows.unionByName(doors, allowMissingColumns=True).fillna(0, ["exit", child])
        out = keys + [child] + (["entered"] if level else [])
        entries = _grouped(rows, group, ["is_step", "upper"], _walk(group, out, gap_us, level == levels),
                           _fields(below.schema, out))
    return entries.select(*keys, "exit")


def cooldown(df: DataFrame, keys: list[str], gap_seconds: float, ts: str = "ts", order: list[str] = ("id",),
             carry: DataFrame | None = None, fan: int = 16, levels: int = 2, stored: bool = False) -> DataFrame:
    """Rows of ``df`` that pass; among rows of one key and instant the first by ``order``.

    ``stored`` writes the passing instants first. They are few where much is silenced, and with
    their size known many rows of ``df`` need no shuffle to meet them.
    """
    rows = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    steps = rows.select(*keys, F.col("_us").alias("upper")).distinct().withColumn("exit", F.col("upper"))
    passed = passing_instants(steps, keys, int(gap_seconds * MICROS), carry, fan, levels)
    if stored:
        passed = cut_lineage(passed)
    hits = rows.join(passed.withColumnRenamed("exit", "_us"), keys + ["_us"])
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    return hits.groupBy(*keys, "_us").agg(first.alias("_row")).select("_row.*")
