"""Filtered, newest-first views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SEARCH_COLUMNS = [
    "id", "ts", "source", "level", "message", "platform", "is_anomaly", "anomaly_score", "matched_rules", "tags",
    "mitre_tactic", "mitre_tactic_id", "mitre_technique", "mitre_technique_id", "mitre_subtechnique_id",
    "category", "src_ip", "dst_ip", "dst_port", "protocol", "filepath", "file_hash"]


def newest(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Newest first; no limit gives all."""
    ordered = df.orderBy(F.desc("ts"), "id")
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def _holds(column: str, text: str) -> Column:
    """Case-insensitive 'contains'; % and _ in the text are wildcards, a backslash is plain."""
    return F.col(column).ilike("%" + text.replace("\\", "\\\\") + "%")


def search_entries(df: DataFrame, level: str | None = None, source: str | None = None, search: str | None = None,
                   anomaly_only: bool = False, since=None, until=None, category: str | None = None,
                   mitre_tactic: str | None = None, mitre_technique_id: str | None = None,
                   limit: int | None = 200, offset: int = 0) -> DataFrame:
    """Entries that meet all given conditions; both time bounds are included."""
    tests = []
    if level:
        tests.append(F.col("level") == level.upper())
    if source:
        tests.append(_holds("source", source))
    if search:
        tests.append(_holds("message", search))
    if anomaly_only:
        tests.append(F.col("is_anomaly"))
    if since is not None:
        tests.append(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        tests.append(F.col("ts") <= F.lit(until).cast("timestamp"))
    if category:
        tests.append(F.col("category") == category)
    if mitre_tactic:
        tests.append(F.col("mitre_tactic") == mitre_tactic)
    if mitre_technique_id:
        tests.append(F.col("mitre_technique_id") == mitre_technique_id)
    for test in tests:
        df = df.filter(test)
    return newest(df.select([c for c in SEARCH_COLUMNS if c in df.columns]), limit, offset)


def fim_events(df: DataFrame, limit: int = 100) -> DataFrame:
    return newest(df.filter(F.col("category") == "fim").select(
        "id", "ts", "message", "level", "filepath", "file_hash", "mitre_tactic", "mitre_technique_id"), limit)


def network_events(df: DataFrame, limit: int = 200) -> DataFrame:
    return newest(df.filter(F.col("category").isin("network", "portscan")).select(
        "id", "ts", "message", "level", "src_ip", "dst_ip", "dst_port", "protocol", "matched_rules", "mitre_tactic",
        "mitre_technique_id"), limit)


def latest_per_key(df: DataFrame, keys: list[str], n: int, newest_first: list[Column]) -> DataFrame:
    """The ``n`` rows of each key that sort first.

    Spark keeps only ``n`` rows per key and task before the shuffle, so a hot key stays small.
    """
    order = W.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")
