"""Alerts: one per matched rule and source, each silent for two minutes after it fired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclog import refdata as R
from seclog.functions.text import alert_level, at_least, cut, display_time, iso, lookup, parent_technique
from seclog.operators.cooldown import cooldown

ANOMALY_RULE = "Anomaly Detected"
_NEEDED = ["id", "ts", "source", "level", "message", "matched_rules", "is_anomaly", "anomaly_score"]


def candidates(entries: DataFrame) -> DataFrame:
    """(id, ts, source, rule_name, level, message) before deduplication.

    Rule alerts come from matched rules; an anomalous entry without any gives one
    anomaly alert. One explode serves both, so the entries are read once.
    """
    rules = F.when(F.size("matched_rules") > 0, F.col("matched_rules")).when(F.col("is_anomaly"), F.array(F.lit(None).cast("string")))
    rows = entries.select(*_NEEDED, F.explode(rules).alias("rule"))
    by_rule = F.col("rule").isNotNull()
    note = F.concat(F.lit("Statistical anomaly from "), "source", F.lit(" (score="),
                    F.format_string("%.3f", "anomaly_score"), F.lit("): "), "message")
    return rows.select(
        "id", "ts", "source", F.coalesce("rule", F.lit(ANOMALY_RULE)).alias("rule_name"),
        F.when(by_rule, alert_level(F.col("level"))).otherwise("warning").alias("level"),
        F.when(by_rule, F.col("message")).otherwise(note).alias("message"))


def alerts_from(entries: DataFrame, cooldown_seconds: int = R.ALERT_COOLDOWN_SECONDS,
                carry: DataFrame | None = None) -> DataFrame:
    """Alerts that fire, in the alert schema."""
    fired = cooldown(candidates(entries), ["rule_name", "source"], cooldown_seconds, carry=carry, stored=True)
    key = F.sha2(F.concat_ws("\u0001", "rule_name", "source", F.unix_micros(F.col("ts").cast("timestamp")).cast("string")), 256)
    return fired.select(key.alias("alert_id"), "rule_name", "level", "message", "source",
                        F.col("id").alias("log_id"), "ts", F.lit(False).alias("acknowledged"))


def alert_list(alerts: DataFrame, unacknowledged_only: bool = False, limit: int = 100) -> DataFrame:
    rows = alerts.filter(~F.col("acknowledged")) if unacknowledged_only else alerts
    return rows.orderBy(F.desc("ts"), "alert_id").limit(limit)


def with_technique_of_entry(alerts: DataFrame, entries: DataFrame) -> DataFrame:
    """Add the technique columns of the entry that caused each alert."""
    told = entries.select(F.col("id").alias("log_id"), "mitre_tactic", "mitre_tactic_id", "mitre_technique",
                          "mitre_technique_id")
    return alerts.join(told, "log_id", "left")


def alert_history(alerts: DataFrame, entries: DataFrame, limit: int = 500) -> DataFrame:
    """Newest alerts with the description of their parent technique.

    The limit comes first, so only the listed alerts meet the entries.
    """
    listed = alert_list(alerts, limit=limit)
    described = with_technique_of_entry(listed, entries)
    text = lookup(R.TECHNIQUE_DESCRIPTIONS, parent_technique(F.coalesce("mitre_technique_id", F.lit(""))), "")
    return described.withColumn("tech_description", text)


def _optional(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) if column in df.columns else F.lit("")


def notification_payloads(alerts: DataFrame, kind: str = "slack", min_level: str = "WARNING",
                          footer: str = "seclog") -> DataFrame:
    """(alert_id, payload): JSON for 'slack', 'discord' or a generic endpoint."""
    level = F.upper("level")
    tactic, tactic_id = _optional(alerts, "mitre_tactic"), _optional(alerts, "mitre_tactic_id")
    technique, technique_id = _optional(alerts, "mitre_technique"), _optional(alerts, "mitre_technique_id")
    colour = lookup(R.LEVEL_COLOUR, level, "#607080")
    when = display_time(F.col("ts"))
    message = F.coalesce("message", F.lit(""))

    def slack_field(title: str, value: Column, short: bool | None = True) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).cast("boolean").alias("short"))

    def discord_field(name: str, value: Column, inline: bool | None = True) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).cast("boolean").alias("inline"))

    if kind == "slack":
        note = F.when(tactic != "", F.concat(F.lit("\n*MITRE:* "), tactic_id, F.lit(" "), tactic, F.lit(" / "),
                                             technique_id, F.lit(" "), F.substring_index(technique, ":", 1))).otherwise("")
        body = F.struct(
            F.concat(lookup(R.LEVEL_EMOJI, level, "⚪"), F.lit(" *"), level, F.lit("* — "), "rule_name").alias("text"),
            F.array(F.struct(
                colour.alias("color"),
                F.array(slack_field("Rule", F.col("rule_name")), slack_field("Source", F.col("source")),
                        slack_field("Time", when), slack_field("Message", cut(message, 300), None)).alias("fields"),
                F.concat(F.lit(footer), note).alias("footer"),
                F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))).alias("attachments"))
    elif kind == "discord":
        fields = [discord_field("Source", F.when(F.col("source") == "", "—").otherwise(F.col("source"))),
                  discord_field("Level", level), discord_field("Time", when),
                  discord_field("Message", cut(message, 1024), None)]
        mitre = discord_field("MITRE", F.concat(tactic_id, F.lit(" "), tactic, F.lit(" / "), technique_id), False)
        body = F.struct(F.array(F.struct(
            F.col("rule_name").alias("title"), cut(message, 200).alias("description"),
            F.conv(F.substring(colour, 2, 6), 16, 10).cast("int").alias("color"),
            F.when(tactic != "", F.array(*fields, mitre)).otherwise(F.array(*fields)).alias("fields"),
            F.struct(F.lit(footer).alias("text")).alias("footer"))).alias("embeds"))
    else:
        body = F.struct(
            F.lit("alert").alias("event"), F.col("rule_name").alias("rule"), level.alias("level"), F.col("source"),
            cut(message, 500).alias("message"), iso(F.col("ts")).alias("timestamp"),
            F.struct(tactic.alias("tactic"), tactic_id.alias("tactic_id"), technique.alias("technique"),
                     technique_id.alias("technique_id")).alias("mitre"))
    return alerts.filter(at_least(F.col("level"), min_level)).select("alert_id", F.to_json(body).alias("payload"))
