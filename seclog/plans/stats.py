"""Counts and roll-ups. ``as_of`` is the instant that relative ranges end at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclog import refdata as R
from seclog.functions.text import lookup
from seclog.functions.technique import COLUMNS as TECHNIQUE_COLUMNS


def _since(as_of, **back) -> Column:
    unit = {name: F.lit(value) for name, value in back.items()}
    return F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_interval(**unit)


def overview(entries: DataFrame, alerts: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """One row of totals; the recent rate counts the last five minutes."""
    totals = entries.agg(F.count(F.lit(1)).alias("total_entries"), F.count_if("is_anomaly").alias("anomaly_count"),
                         F.count_if(_since(as_of, mins=minutes)).alias("recent_rate"))
    open_alerts = alerts.agg(F.count_if(~F.col("acknowledged")).alias("unacked_alerts"))
    return totals.crossJoin(open_alerts)  # one row each


def level_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("level").agg(F.count(F.lit(1)).alias("cnt"))


def timeline(entries: DataFrame, as_of, minutes: int = 60) -> DataFrame:
    return (entries.filter(_since(as_of, mins=minutes))
            .groupBy(F.date_trunc("minute", "ts").alias("minute"), "level").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy("minute", "level"))


def heatmap(entries: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Hits per technique; the other columns are those of its newest entry."""
    others = [c for c in TECHNIQUE_COLUMNS if c != "mitre_technique_id"]
    return (entries.filter((F.col("mitre_tactic") != "") & _since(as_of, hours=hours))
            .groupBy("mitre_technique_id")
            .agg(F.count(F.lit(1)).alias("cnt"), F.max_by(F.struct(*others), F.struct("ts", "id")).alias("_newest"))
            .select("mitre_technique_id", "cnt", "_newest.*")
            .orderBy(F.desc("cnt"), "mitre_technique_id"))


def tactic_counts(entries: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return (entries.filter((F.col("mitre_tactic") != "") & _since(as_of, hours=hours))
            .groupBy("mitre_tactic").agg(F.count(F.lit(1)).alias("cnt")))


def tactic_counts_ordered(entries: DataFrame) -> DataFrame:
    """Hits per tactic in kill-chain order; tactics without hits are left out."""
    position = lookup({name: i for i, (_, name) in enumerate(R.TACTICS)}, F.col("mitre_tactic"), len(R.TACTICS))
    return (entries.filter(F.col("mitre_tactic") != "").groupBy("mitre_tactic").agg(F.count(F.lit(1)).alias("cnt"))
            .withColumn("position", position).orderBy("position", "mitre_tactic"))


def technique_summary(entries: DataFrame) -> DataFrame:
    """Hits per technique with the attributes of the first entry that showed it."""
    first = F.min_by(F.struct("mitre_technique", "mitre_tactic", "mitre_tactic_id"), F.struct("ts", "id"))
    return (entries.filter(F.col("mitre_technique_id") != "").groupBy("mitre_technique_id")
            .agg(F.count(F.lit(1)).alias("cnt"), first.alias("_first"))
            .select("mitre_technique_id", "cnt", "_first.*").orderBy(F.desc("cnt"), "mitre_technique_id"))


def category_counts(entries: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return entries.filter(_since(as_of, hours=hours)).groupBy("category").agg(F.count(F.lit(1)).alias("cnt"))


def top_scanners(entries: DataFrame, k: int = 10) -> DataFrame:
    return (entries.filter((F.col("category") == "portscan") & (F.col("src_ip") != ""))
            .groupBy(F.col("src_ip").alias("ip")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "ip").limit(k))


def channel_counts(entries: DataFrame) -> DataFrame:
    from seclog.operators.annotate import with_channel

    return with_channel(entries).groupBy("channel").agg(F.count(F.lit(1)).alias("cnt"))


def _as_map(counts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One row with a map; used for a handful of rows such as levels, tactics or top-k lists."""
    pairs = F.array_sort(F.collect_list(F.struct(key, value)))
    return counts.agg(F.map_from_entries(pairs).alias(name))


def dashboard(entries: DataFrame, alerts: DataFrame, attempts: DataFrame, fired: DataFrame, baseline: DataFrame, as_of,
              model=None, hours: int = 24) -> DataFrame:
    """One row with every figure of the dashboard.

    ``model`` is the metadata row of a stored forest, or None.
    """
    from seclog.operators.correlate import correlation_stats
    from seclog.operators.scans import live_scanners

    parts = [
        overview(entries, alerts, as_of),
        _as_map(level_counts(entries), "level", "cnt", "by_level"),
        _as_map(category_counts(entries, as_of, hours), "category", "cnt", "categories"),
        _as_map(tactic_counts(entries, as_of, hours), "mitre_tactic", "cnt", "tactic_counts"),
        _as_map(live_scanners(attempts, 5), "ip", "unique_ports", "top_scanners"),
        correlation_stats(fired, entries),
        alerts.agg(F.count(F.lit(1)).alias("alerts_fired")),
        baseline.agg(F.count(F.lit(1)).alias("fim_baseline")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out.withColumns({
        "ml_ready": F.lit(model is not None),
        "ml_trained_at": F.lit(model.trained_at if model else None).cast("timestamp"),
        "ml_train_size": F.lit(model.train_size if model else R.FOREST_TRAIN_SIZE)})
