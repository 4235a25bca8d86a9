"""Positions of rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Rows of a group that are put in order in one task, on average.
BUCKET = 50_000


def ranked(df: DataFrame, by: str, total: int, bucket: int = BUCKET) -> DataFrame:
    """``df`` with ``rank`` (long, gapless from 0 inside each value of ``by``).

    Equal rows become one row with a count and are written out again at the end, so no
    ordering sees them one by one. The rest is dealt into hash buckets, ordered inside
    each, and shifted by the sizes of the buckets before it; a group that holds all rows
    is still spread over total / bucket tasks.
    """
    columns = df.columns
    buckets = max(1, -(-total // bucket))
    dealt = (df.groupBy(*columns).agg(F.count("*").alias("__n"))
             .withColumn("__bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")))
    inside = W.partitionBy(by, "__bucket").orderBy(*columns).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)
    sizes = dealt.groupBy(by, "__bucket").agg(F.sum("__n").alias("__size"))
    shifts = sizes.select(F.col(by).alias("__by"), F.col("__bucket").alias("__b"),
                          (F.sum("__size").over(before) - F.col("__size")).alias("__shift"))
    placed = dealt.withColumn("__within", F.sum("__n").over(inside) - F.col("__n"))
    return (placed.join(shifts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__bucket") == F.col("__b")))
            .select(*columns, (F.col("__shift") + F.col("__within")).alias("__first"), F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__i"))
            .select(*columns, (F.col("__first") + F.col("__i")).alias("rank")))
