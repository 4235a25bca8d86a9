"""The log entry: one record shape for every source and detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Field -> (Spark type, default). Empty text and port 0 mean "none".
ENTRY = {
    "id": ("string", None),
    "ts": ("timestamp", None),
    "source": ("string", ""),
    "level": ("string", "INFO"),
    "message": ("string", ""),
    "platform": ("string", "linux"),
    "raw": ("string", ""),
    "is_anomaly": ("boolean", False),
    "anomaly_score": ("double", 0.0),
    "matched_rules": ("array<string>", []),
    "tags": ("array<string>", []),
    "mitre_tactic": ("string", ""),
    "mitre_tactic_id": ("string", ""),
    "mitre_technique": ("string", ""),
    "mitre_technique_id": ("string", ""),
    "mitre_subtechnique_id": ("string", ""),
    "category": ("string", "log"),
    "src_ip": ("string", ""),
    "dst_ip": ("string", ""),
    "dst_port": ("int", 0),
    "protocol": ("string", ""),
    "filepath": ("string", ""),
    "file_hash": ("string", ""),
}
ALERT_DDL = ("alert_id string, rule_name string, level string, message string, source string, log_id string, "
             "ts timestamp, acknowledged boolean")
BASELINE_DDL = "path string, sha256 string, size bigint, mode string, updated_at timestamp"


def complete(df: DataFrame, *more: str) -> DataFrame:
    """All entry fields in order, with defaults for those that ``df`` lacks and for nulls, and the columns ``more`` as they are."""

    def field(name: str):
        kind, default = ENTRY[name]
        value = (F.array() if default == [] else F.lit(default)).cast(kind)
        if name not in df.columns:
            return value.alias(name)
        own = F.col(name).cast(kind)
        return (own if default is None else F.coalesce(own, value)).alias(name)

    return df.select(*[field(name) for name in ENTRY], *more)
