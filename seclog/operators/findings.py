"""Findings of the detectors as log entries with the common schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclog.functions.text import basename
from seclog.operators.snapshots import CONNECTION_KEY
from seclog.schema import complete


def _tags(*items) -> Column:
    return F.array(*[item if isinstance(item, Column) else F.lit(item) for item in items])


def _prefixed(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _entry(df: DataFrame, own: list[str] | tuple = (), **columns) -> DataFrame:
    """Entry with the given columns; raw repeats the message, the rest takes defaults.

    The id names source, instant and text, and the columns ``own``: what tells two findings of
    one instant and text apart (addresses, ports, process, hashes). Findings of a table with
    a ``host`` column name it in source and tags too, so that hosts have alerts and
    cooldowns of their own.
    """
    values = {name: value if isinstance(value, Column) else F.lit(value) for name, value in columns.items()}
    values.setdefault("raw", values["message"])
    if "host" in df.columns:
        there = F.coalesce(F.col("host"), F.lit("")) != ""
        values["source"] = F.when(there, F.concat(values["source"], F.lit("@"), F.col("host"))).otherwise(values["source"])
        values["tags"] = F.when(there, F.concat(values["tags"], F.array(_prefixed("host:", "host")))).otherwise(values["tags"])
    parts = [values["source"], F.unix_micros(values["ts"]), values["raw"], *[F.col(c) for c in own if c in df.columns]]
    values["id"] = F.sha2(F.concat_ws("\u0001", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts]), 256)
    return complete(df.select(*[value.alias(name) for name, value in values.items()]))


def _network(df: DataFrame, level: str, message: Column, rules: list[str], tags: Column, **more) -> DataFrame:
    values = {"protocol": F.lit("TCP"), **more}
    return _entry(df, [*CONNECTION_KEY, "proc_name"], ts=F.col("snapshot_ts"), source="network-monitor", level=level, message=message,
                  matched_rules=F.array(*[F.lit(r) for r in rules]).cast("array<string>"), tags=tags, category="network",
                  is_anomaly=level in ("WARNING", "CRITICAL"), anomaly_score=0.8 if level == "CRITICAL" else 0.5,
                  **values)


def from_suspicious_outbound(df: DataFrame) -> DataFrame:
    message = F.format_string("Suspicious outbound connection to %s:%d (%s) — process: %s",
                              "raddr_ip", "raddr_port", "reason", "proc_name")
    return _network(df, "CRITICAL", message, ["Suspicious Outbound"],
                    _tags("suspicious_port", _prefixed("port:", "raddr_port")),
                    src_ip=F.col("laddr_ip"), dst_ip=F.col("raddr_ip"), dst_port=F.col("raddr_port"),
                    protocol=F.coalesce("type", F.lit("TCP")))


def from_smtp_outbound(df: DataFrame) -> DataFrame:
    message = F.format_string("Outbound SMTP-like connection to %s:%d — possible exfiltration — process: %s",
                              "raddr_ip", "raddr_port", "proc_name")
    return _network(df, "WARNING", message, ["Large Outbound Transfer"], _tags("smtp_outbound"),
                    src_ip=F.col("laddr_ip"), dst_ip=F.col("raddr_ip"), dst_port=F.col("raddr_port"))


def from_new_listeners(df: DataFrame) -> DataFrame:
    message = F.format_string("New listening service on port %d — process: %s", "laddr_port", "proc_name")
    return _network(df, "INFO", message, [], _tags("new_listener", _prefixed("port:", "laddr_port")),
                    dst_port=F.col("laddr_port"))


def from_beacons(df: DataFrame) -> DataFrame:
    message = F.format_string("Beaconing detected to %s: %d connections in 5m with interval %.1fs ±%.1fs",
                              "raddr_ip", "connections", "mean_s", "std_s")
    return _network(df.withColumn("snapshot_ts", F.timestamp_micros("us")), "WARNING", message,
                    ["Beaconing Detected"], _tags("beaconing", _prefixed("remote:", "raddr_ip")),
                    dst_ip=F.col("raddr_ip"))


def from_dns(df: DataFrame) -> DataFrame:
    tld = F.concat(F.lit("."), F.substring_index("domain", ".", -1))
    whole = F.col("amount").cast("int")
    message = (F.when(F.col("signal") == "bad_tld",
                      F.format_string("DNS query to suspicious TLD %s: %s  src=%s", tld, "domain", "client"))
               .when(F.col("signal") == "entropy",
                     F.format_string("High-entropy DNS subdomain (%.2f bits): %s  src=%s", "amount", "domain", "client"))
               .when(F.col("signal") == "long",
                     F.format_string("Unusually long DNS subdomain (%d chars): %s  src=%s", whole, "domain", "client"))
               .when(F.col("signal") == "rate",
                     F.format_string("High DNS query rate from %s: %d queries/min", "client", whole))
               .otherwise(F.format_string("NXDOMAIN storm from %s: %d failures/min (possible DGA cycling)", "client", whole)))
    tags = (F.when(F.col("signal") == "bad_tld", _tags("bad_tld", F.concat(F.lit("tld:"), tld)))
            .when(F.col("signal") == "entropy", _tags("high_entropy_dns"))
            .when(F.col("signal") == "long", _tags("long_subdomain"))
            .when(F.col("signal") == "rate", _tags("high_dns_rate", _prefixed("src:", "client")))
            .otherwise(_tags("nxdomain_storm")))
    return _entry(df, ["signal", "domain", "client"], ts=F.col("ts"), source="dns-monitor", level=F.col("level"), message=message,
                  matched_rules=_tags("DNS Tunneling"), tags=tags, category="network", protocol="DNS",
                  is_anomaly=True, anomaly_score=F.when(F.col("level") == "WARNING", 0.8).otherwise(0.95))


def from_port_scans(df: DataFrame, seconds: int = 60) -> DataFrame:
    message = F.format_string("Port scan detected from %s: %d unique ports probed in " + str(seconds)
                              + "s (%d total attempts, detected via %s)",
                              "src_ip", "unique_ports", "attempts", "method")
    return _entry(df, ["src_ip", "dst_port"], ts=F.col("ts"), source=_prefixed("portscan/", "src_ip"), level="CRITICAL", message=message,
                  matched_rules=_tags("Port Scan Detected"),
                  tags=_tags("portscan", _prefixed("src:", "src_ip"), _prefixed("method:", "method")),
                  category="portscan", src_ip=F.col("src_ip"), dst_port=F.col("dst_port"),
                  is_anomaly=True, anomaly_score=0.97)


def from_processes(df: DataFrame) -> DataFrame:
    """The message shows 120 characters of a malicious command, raw holds all of it."""
    who = ["pid", "username"]
    bad, known = F.col("finding") == "bad_process", "Known malicious process: %s (pid=%d, user=%s)  cmd: %s"
    message = (F.when(bad, F.format_string(known, "name", *who, F.substring("cmdline", 1, 120)))
               .when(F.col("finding") == "tmp_execution",
                     F.format_string("Process running from temp dir: %s (pid=%d, user=%s)", "exe", *who))
               .when(F.col("finding") == "suspicious_spawn",
                     F.format_string("Suspicious child process: %s spawned %s (pid=%d, user=%s) — possible webshell or RCE",
                                     "parent_name", "name", *who))
               .otherwise(F.format_string("High CPU process: %s at %.1f%% (pid=%d, user=%s)", "name", "cpu", *who)))
    spawn = F.col("finding") == "suspicious_spawn"
    tags = (F.when(spawn, _tags("suspicious_spawn", _prefixed("parent:", "parent_name"), _prefixed("child:", "name")))
            .otherwise(F.array(F.col("finding"), _prefixed("proc:", "name"))))
    source = F.concat(F.lit("procmon/"), F.when(spawn, F.concat("parent_name", F.lit("→"))).otherwise(""), "name")
    raw = F.when(bad, F.format_string(known, "name", *who, "cmdline")).otherwise(message)
    return _entry(df, ["pid", "ppid", "exe", "cmdline", "username"], ts=F.col("snapshot_ts"), source=source, level=F.col("level"), message=message, raw=raw,
                  matched_rules=F.array("rule"), tags=tags, is_anomaly=True,
                  anomaly_score=F.when(F.col("level") == "WARNING", 0.85).otherwise(0.95))


def from_files(df: DataFrame, ts: Column) -> DataFrame:
    message = F.format_string("FIM [%s] %s — %s", F.upper("change"), "path", "details")
    name = basename(F.col("path"))
    return _entry(df, ["path", "old_sha256", "new_sha256", "old_mode", "new_mode"], ts=ts, source=F.concat(F.lit("fim/"), name), level=F.col("level"), message=message,
                  matched_rules=_tags("File Integrity Violation"),
                  tags=F.array(F.lit("fim"), F.col("change"), F.concat(F.lit("file:"), name)),
                  category="fim", filepath=F.col("path"),
                  file_hash=F.coalesce("new_sha256", "old_sha256"), is_anomaly=True,
                  anomaly_score=F.when(F.col("level") == "CRITICAL", 0.9).otherwise(0.6))


def from_chains(df: DataFrame) -> DataFrame:
    """Entries of fired chains; they carry the chain as technique and skip rules and scoring."""
    return _entry(df, ["chain", "key"], ts=F.col("ts"), source=_prefixed("correlation/", "key"), level=F.col("severity"),
                  message=F.col("summary"), matched_rules=F.array("chain"),
                  tags=F.concat(_tags("correlated", "multi-stage"),
                                F.transform("tactics", lambda t: F.concat(F.lit("tactic:"), t))),
                  platform=F.col("platform"), category="log",
                  src_ip=F.when(F.col("src_ip") != "", F.col("src_ip")).otherwise(F.col("key")),
                  mitre_tactic=F.element_at("tactics", -1), mitre_technique=F.col("chain"),
                  mitre_technique_id="CORR", is_anomaly=True, anomaly_score=0.99)
