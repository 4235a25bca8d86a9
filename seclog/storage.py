"""Lineage cuts and table maintenance: append, baseline versions, retention, acknowledgements."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from seclog import refdata as R
from seclog.functions.text import octal_mode, parse_octal_mode
from seclog.schema import complete


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. A private one only if none is set and all runs on one machine (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="seclog-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def cut_lineage(df: DataFrame, *folders: str) -> DataFrame:
    """Write to the shared folder, in folders by the columns ``folders``, and read back.

    Iterative operators stay small plans, survive lost executors, and later steps read
    only the columns they need.
    """
    spark = df.sparkSession
    path = "%s/seclog-%s" % (checkpoint_dir(spark).rstrip("/"), uuid.uuid4().hex)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def log_entries(spark: SparkSession, path: str) -> DataFrame:
    """Stored entries. Filters on event_date and category prune folders."""
    return spark.read.parquet(path)


def alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_entries(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Entries of ``new`` whose id is not stored yet, each id once."""
    return new.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti").select(new.columns)


def write_entries(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the table partitioned by day and category.

    Rows are brought together by (day, category); adaptive execution then cuts what is
    large, so a category that dominates a day is written by as many tasks as it needs.
    """
    (entries.withColumns({"event_date": F.to_date("ts"), "ingested_at": F.current_timestamp()})
     .hint("rebalance", "event_date", "category")
     .write.mode(mode).partitionBy("event_date", "category").parquet(path))


def append_alerts(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_baseline(state: DataFrame, path: str, version: int, as_of) -> str:
    """Write a whole new baseline version; readers of the old one are not disturbed."""
    target = "%s/version=%d" % (path.rstrip("/"), version)
    (state.select("path", "sha256", "size", octal_mode(F.col("mode")).alias("mode"),
                  F.lit(as_of).cast("timestamp").alias("updated_at"))
     .write.mode("overwrite").parquet(target))
    return target


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Newest version of the baseline."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version").alias("version"))
    return (versions.join(F.broadcast(newest), "version")  # one row
            .select("path", "sha256", "size", parse_octal_mode(F.col("mode")).alias("mode")))


def retention_plan(overrides: dict | None = None) -> dict:
    """Days to keep per level; overrides replace defaults level by level, None keeps for ever."""
    return {**R.RETENTION_DAYS, **(overrides or {})}


def retain(entries: DataFrame, as_of, overrides: dict | None = None) -> DataFrame:
    """Entries that survive severity-based retention. Without a level or time nothing expires."""
    expired = F.lit(False)
    for level, days in retention_plan(overrides).items():
        if days is not None:
            cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
            expired = expired | ((F.col("level") == level) & (F.col("ts") < cutoff))
    return entries.filter(~F.coalesce(expired, F.lit(False)))


def retain_alerts(df: DataFrame, as_of, days: int = R.ALERT_RETENTION_DAYS) -> DataFrame:
    """Alerts except acknowledged ones older than ``days``."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return df.filter(~F.coalesce(F.col("acknowledged") & (F.col("ts") < cutoff), F.lit(False)))


def apply_acks(df: DataFrame, acks: DataFrame) -> DataFrame:
    """Mark the alerts named in ``acks`` (alert_id) as acknowledged."""
    marks = acks.select("alert_id").distinct().withColumn("_acked", F.lit(True))
    return (df.join(marks, "alert_id", "left")
            .withColumn("acknowledged", F.coalesce("_acked", "acknowledged")).select(df.columns))


def ack_all(df: DataFrame) -> DataFrame:
    return df.withColumn("acknowledged", F.lit(True))


def merge_scores(entries: DataFrame, scores: DataFrame) -> DataFrame:
    """Replace the anomaly columns of the entries listed in ``scores`` (id, is_anomaly, anomaly_score)."""
    fresh = scores.select("id", F.col("is_anomaly").alias("_flag"), F.col("anomaly_score").alias("_score"))
    return (entries.join(fresh, "id", "left")
            .withColumns({"is_anomaly": F.coalesce("_flag", "is_anomaly"),
                          "anomaly_score": F.coalesce("_score", "anomaly_score")}).select(entries.columns))


def all_entries(*collectors: DataFrame) -> DataFrame:
    """One entry stream from all collectors."""
    first, *rest = [complete(df) for df in collectors]
    for df in rest:
        first = first.unionByName(df)
    return first
