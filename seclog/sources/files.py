"""File-state snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_state(spark: SparkSession, paths: list[str], modes: DataFrame | None = None, default_mode: int = 0o644) -> DataFrame:
    """(path, sha256, size, mode) of files and of the direct children of folders.

    Spark's file listing carries no permission bits, so they come from ``modes`` (path,
    mode), a listing made where the files live. Unreadable files are skipped.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "false")
             .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(paths))
    state = files.select(F.regexp_replace("path", "^file:", "").alias("path"),
                         F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")).distinct()
    if modes is None:
        return state.withColumn("mode", F.lit(default_mode))
    return (state.join(modes.select("path", "mode"), "path", "left")
            .withColumn("mode", F.coalesce("mode", F.lit(default_mode))))
