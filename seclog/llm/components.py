"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seclog.llm.store import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) of every node named in ``links`` (a, b longs); component is the smallest node reachable.

    Each round hooks neighbours to the smallest one, first from above, then from below.
    Rounds are written tables; a node with very many links is a skewed join key, which
    adaptive execution splits. Loops and repeated links are harmless; no links give no rows.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = scratch.keep(edges, f"{name}-0")
    seen, turn = _print(edges), 0
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        turn += 1
        fresh = scratch.keep(small, f"{name}-{turn}")
        now = _print(fresh)
        scratch.drop(f"{name}-{turn - 1}")
        edges = fresh
        if now == seen:
            break
        seen = now
    return nodes.join(edges.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def _print(edges: DataFrame) -> tuple:
    """What tells two edge tables apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
