"""Views, statistics, sinks and table maintenance over the stored entries and alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.detect import (ALERTS, ATTEMPTS, BEACONS, CHAIN_FIRES, CONNS, DNS_FINDINGS, FILES, FINDING, LIVE, NEW_CONNS, PROCS, SCANS, acked,
                           alerts, attempts, beats, files, procs, snapshots)
from checks.fixtures import q
from checks.registry import ANNOTATED, DUCK, annotated, check, entries, with_
from checks.scalars import LOG_ATTEMPTS
from seclog import refdata as R, storage
from seclog.operators import annotate as A, correlate as C, findings, scans, snapshots as S
from seclog.plans import stats, views

AS_OF = X.AS_OF
NOW = f"TIMESTAMP '{AS_OF}'"

_PAGE = "id, ts, source, level, message, is_anomaly, anomaly_score, array_to_string(matched_rules, '|') AS matched_rules, mitre_tactic, mitre_technique_id, category"
_PAGE_COLUMNS = ["id", "ts", "source", "level", "message", "is_anomaly", "anomaly_score", "matched_rules", "mitre_tactic",
                 "mitre_technique_id", "category"]


def _search(name: str, where: str, tail: str = "LIMIT 200", **filters):
    sql = with_(ANNOTATED, f"SELECT {_PAGE} FROM ann WHERE {where} ORDER BY ts DESC, id {tail}")
    check(name, sql)(lambda spark, sf: views.search_entries(annotated(spark, sf), **filters).select(_PAGE_COLUMNS))


_search("search_all", "true", "LIMIT 5000", limit=5000)
_search("search_level", "level = 'CRITICAL'", "LIMIT 100 OFFSET 50", level="critical", limit=100, offset=50)
_search("search_text", "message ILIKE '%PORT%' AND source ILIKE '%SSH%'", search="PORT", source="SSH")
_search("search_wildcard", "message ILIKE '%h_.bad%bit%'", search="h_.bad%bit")
_search("search_time_range", "ts >= TIMESTAMP '2024-01-01 00:10:00' AND ts <= TIMESTAMP '2024-01-01 00:20:00'", "LIMIT 300",
        since="2024-01-01 00:10:00", until="2024-01-01 00:20:00", limit=300)
_search("search_anomaly", "is_anomaly", anomaly_only=True)
_search("search_category_tactic", "category = 'network' AND mitre_tactic = 'Credential Access' AND mitre_technique_id = 'T1110'",
        category="network", mitre_tactic="Credential Access", mitre_technique_id="T1110")


@check("fim_events", with_(ANNOTATED, """SELECT id, ts, message, level, filepath, file_hash, mitre_tactic, mitre_technique_id FROM ann
    WHERE category = 'fim' ORDER BY ts DESC, id LIMIT 100"""))
def _(spark, sf):
    return views.fim_events(annotated(spark, sf))


@check("network_events", with_(ANNOTATED, """SELECT id, ts, message, level, src_ip, dst_ip, dst_port, protocol,
    array_to_string(matched_rules, '|') AS matched_rules, mitre_tactic, mitre_technique_id FROM ann
    WHERE category IN ('network', 'portscan') ORDER BY ts DESC, id LIMIT 200"""))
def _(spark, sf):
    return views.network_events(annotated(spark, sf))


@check("latest_per_key", """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
    FROM conversations) x WHERE rn <= 2""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return views.latest_per_key(rows, ["conv_id"], 2, [F.desc("turn")])


_OVERVIEW = f"""SELECT count(*) AS total_entries, count(*) FILTER (is_anomaly) AS anomaly_count,
    count(*) FILTER (ts >= {NOW} - INTERVAL 5 MINUTE) AS recent_rate, (SELECT count(*) FROM acked WHERE NOT acknowledged) AS unacked_alerts FROM ann"""


@check("overview", with_(ALERTS, _OVERVIEW, True))
def _(spark, sf):
    return stats.overview(annotated(spark, sf), acked(spark, sf), AS_OF)


@check("stats_push", with_(ALERTS, f"SELECT total_entries AS total, anomaly_count AS anomalies, unacked_alerts AS unacked, recent_rate AS rate FROM ({_OVERVIEW}) x", True))
def _(spark, sf):
    row = stats.overview(annotated(spark, sf), acked(spark, sf), AS_OF)
    return row.select(F.col("total_entries").alias("total"), F.col("anomaly_count").alias("anomalies"),
                      F.col("unacked_alerts").alias("unacked"), F.col("recent_rate").alias("rate"))


@check("level_counts", with_(ANNOTATED, "SELECT level, count(*) AS cnt FROM ann GROUP BY 1"))
def _(spark, sf):
    return stats.level_counts(annotated(spark, sf))


@check("timeline", with_(ANNOTATED, f"""SELECT date_trunc('minute', ts) AS minute, level, count(*) AS cnt FROM ann
    WHERE ts >= {NOW} - INTERVAL 60 MINUTE GROUP BY 1, 2"""))
def _(spark, sf):
    return stats.timeline(annotated(spark, sf), AS_OF)


_HEAT = f"""SELECT mitre_technique_id, count(*) AS cnt, max_by(mitre_tactic, (ts, id)) AS mitre_tactic, max_by(mitre_tactic_id, (ts, id)) AS mitre_tactic_id,
    max_by(mitre_technique, (ts, id)) AS mitre_technique, max_by(mitre_subtechnique_id, (ts, id)) AS mitre_subtechnique_id
  FROM ann WHERE mitre_tactic <> '' AND ts >= {NOW} - INTERVAL 24 HOUR GROUP BY 1"""


@check("heatmap", with_(ANNOTATED, _HEAT))
def _(spark, sf):
    return stats.heatmap(annotated(spark, sf), AS_OF)


@check("tactic_counts", with_(ANNOTATED, f"SELECT mitre_tactic, count(*) AS cnt FROM ann WHERE mitre_tactic <> '' AND ts >= {NOW} - INTERVAL 24 HOUR GROUP BY 1"))
def _(spark, sf):
    return stats.tactic_counts(annotated(spark, sf), AS_OF)


_POSITION = "CASE mitre_tactic %s ELSE 14 END" % " ".join(f"WHEN {q(n)} THEN {i}" for i, (_, n) in enumerate(R.TACTICS))


@check("tactic_killchain", with_(ANNOTATED, f"SELECT mitre_tactic, count(*) AS cnt, {_POSITION} AS position FROM ann WHERE mitre_tactic <> '' GROUP BY 1, 3"))
def _(spark, sf):
    return stats.tactic_counts_ordered(annotated(spark, sf))


@check("technique_summary", with_(ANNOTATED, """SELECT mitre_technique_id, count(*) AS cnt, min_by(mitre_technique, (ts, id)) AS mitre_technique,
    min_by(mitre_tactic, (ts, id)) AS mitre_tactic, min_by(mitre_tactic_id, (ts, id)) AS mitre_tactic_id FROM ann WHERE mitre_technique_id <> '' GROUP BY 1"""))
def _(spark, sf):
    return stats.technique_summary(annotated(spark, sf))


@check("category_counts", with_(ANNOTATED, f"SELECT category, count(*) AS cnt FROM ann WHERE ts >= {NOW} - INTERVAL 24 HOUR GROUP BY 1"))
def _(spark, sf):
    return stats.category_counts(annotated(spark, sf), AS_OF)


@check("top_scanners", with_(ANNOTATED, """SELECT src_ip AS ip, count(*) AS count FROM ann WHERE category = 'portscan' AND src_ip <> '' GROUP BY 1
    ORDER BY count DESC, ip LIMIT 10"""))
def _(spark, sf):
    return stats.top_scanners(annotated(spark, sf))


@check("channel_counts", with_(ANNOTATED, """SELECT CASE WHEN category IN ('network', 'portscan') THEN 'network' WHEN category = 'fim' THEN 'fim' ELSE 'log' END AS channel,
    count(*) AS cnt FROM ann GROUP BY 1"""))
def _(spark, sf):
    return stats.channel_counts(annotated(spark, sf))


_CHAIN_ROWS = " UNION ALL ".join(
    f"""SELECT {i} AS chain_no, {q(c.name)} AS chain, {q('|'.join(c.tactics))} AS tactics, {c.window_minutes} AS window_minutes, {q(c.severity)} AS severity,
  {q(c.description)} AS description, {c.cooldown_minutes} AS cooldown_minutes""" for i, c in enumerate(R.CHAINS))
_HITS = " + ".join(f"CASE WHEN mitre_tactic = {q(t)} THEN 1 ELSE 0 END" for t in sorted({t for c in R.CHAINS for t in c.tactics}))


@check("chains", with_(ANNOTATED + f", catalogue AS ({_CHAIN_ROWS})", """SELECT c.*, (SELECT count(*) FROM ann WHERE list_contains(string_split(c.tactics, '|'), mitre_tactic))
    AS entries FROM catalogue c"""))
def _(spark, sf):
    """Catalogue with the number of entries whose tactic belongs to each chain."""
    per_tactic = annotated(spark, sf).groupBy("mitre_tactic").agg(F.count(F.lit(1)).alias("n"))
    chain = C.chains_table(spark)
    counted = (chain.select("chain_no", F.explode("tactics").alias("mitre_tactic")).join(per_tactic, "mitre_tactic", "left")
               .groupBy("chain_no").agg(F.sum(F.coalesce("n", F.lit(0))).alias("entries")))
    return chain.join(counted, "chain_no")


_MAPPED = """array_to_string(list_sort(list(concat({key}, '=', {value}))), '|')"""


@check("dashboard", with_(ALERTS + CHAIN_FIRES[len(ANNOTATED):] + LIVE[len(X.entries(DUCK)):] + "," + FILES, f"""SELECT o.*,
    (SELECT {_MAPPED.format(key='level', value='cnt')} FROM (SELECT level, count(*) AS cnt FROM ann GROUP BY 1) x) AS by_level,
    (SELECT {_MAPPED.format(key='category', value='cnt')} FROM (SELECT category, count(*) AS cnt FROM ann WHERE ts >= {NOW} - INTERVAL 24 HOUR GROUP BY 1) x) AS categories,
    (SELECT {_MAPPED.format(key='mitre_tactic', value='cnt')} FROM (SELECT mitre_tactic, count(*) AS cnt FROM ann WHERE mitre_tactic <> ''
      AND ts >= {NOW} - INTERVAL 24 HOUR GROUP BY 1) x) AS tactic_counts,
    (SELECT {_MAPPED.format(key='ip', value='unique_ports')} FROM (SELECT * FROM live ORDER BY unique_ports DESC, ip LIMIT 5) x) AS top_scanners,
    (SELECT count(*) FROM fires) AS total_correlations, (SELECT count(DISTINCT key) FROM acts) AS active_sources, {len(R.CHAINS)} AS chains_defined,
    (SELECT count(*) FROM acked) AS alerts_fired, (SELECT count(*) FROM baseline) AS fim_baseline, false AS ml_ready,
    CAST(NULL AS TIMESTAMP) AS ml_trained_at, {R.FOREST_TRAIN_SIZE} AS ml_train_size FROM ({_OVERVIEW}) o""", True))
def _(spark, sf):
    rows = annotated(spark, sf)
    out = stats.dashboard(rows, acked(spark, sf), attempts(spark, sf), C.fires(rows), files(spark, sf)[0], AS_OF)
    maps = ["by_level", "categories", "tactic_counts", "top_scanners"]
    text = lambda m: F.array_join(F.array_sort(F.transform(
        F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), "|")
    return out.withColumns({m: text(m) for m in maps})


# --- sinks and maintenance ------------------------------------------------------------------

@check("idempotent_append", with_(ANNOTATED, """SELECT id, level, source FROM ann WHERE CAST(id AS BIGINT) % 5 <> 0"""))
def _(spark, sf):
    """A batch that repeats itself and overlaps the stored fifth of the entries."""
    rows = annotated(spark, sf).select("id", "level", "source")
    existing = rows.filter(F.col("id").cast("bigint") % 5 == 0)
    return storage.append_entries(rows.unionByName(rows), existing)


def _spread(column: str = "us") -> str:
    """Entries pushed back by up to 120 days, so that every level crosses its limit."""
    return f"make_timestamp(us - (CAST(id AS BIGINT) % 120) * 86400000000)"


@check("retention_entries", with_(ANNOTATED + f", aged AS (SELECT id, level, {_spread()} AS ts FROM ann)", f"""SELECT id, level, ts FROM aged
    WHERE NOT (level IN ('DEBUG', 'INFO') AND ts < {NOW} - INTERVAL 7 DAY) AND NOT (level = 'WARNING' AND ts < {NOW} - INTERVAL 30 DAY)
      AND NOT (level = 'ERROR' AND ts < {NOW} - INTERVAL 90 DAY)"""))
def _(spark, sf):
    aged = annotated(spark, sf).select("id", "level", F.timestamp_micros(
        F.unix_micros("ts") - (F.col("id").cast("bigint") % 120) * 86400000000).alias("ts"))
    return storage.retain(aged, AS_OF)


@check("retention_overrides", with_(ANNOTATED + f", aged AS (SELECT id, level, {_spread()} AS ts FROM ann)", f"""SELECT id, level, ts FROM aged
    WHERE NOT (level = 'DEBUG' AND ts < {NOW} - INTERVAL 7 DAY) AND NOT (level = 'WARNING' AND ts < {NOW} - INTERVAL 30 DAY)
      AND NOT (level = 'ERROR' AND ts < {NOW} - INTERVAL 90 DAY) AND NOT (level = 'CRITICAL' AND ts < {NOW} - INTERVAL 60 DAY)"""))
def _(spark, sf):
    aged = annotated(spark, sf).select("id", "level", F.timestamp_micros(
        F.unix_micros("ts") - (F.col("id").cast("bigint") % 120) * 86400000000).alias("ts"))
    return storage.retain(aged, AS_OF, {"INFO": None, "CRITICAL": 60})


@check("retention_alerts", with_(ALERTS + ", aged AS (SELECT alert_id, acknowledged, ts - (CAST(log_id AS BIGINT) % 60) * INTERVAL 1 DAY AS ts FROM acked)", f"""SELECT * FROM aged
    WHERE NOT (acknowledged AND ts < {NOW} - INTERVAL 30 DAY)""", True))
def _(spark, sf):
    aged = acked(spark, sf).select("alert_id", "acknowledged", F.timestamp_micros(
        F.unix_micros("ts") - (F.col("log_id").cast("bigint") % 60) * 86400000000).alias("ts"))
    return storage.retain_alerts(aged, AS_OF)


@check("merge_scores", with_(ANNOTATED, """SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN true ELSE is_anomaly END AS is_anomaly,
    CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 0.75::DOUBLE ELSE anomaly_score END AS anomaly_score FROM ann"""))
def _(spark, sf):
    rows = annotated(spark, sf)
    scores = rows.filter(F.col("id").cast("bigint") % 4 == 0).select(
        "id", F.lit(True).alias("is_anomaly"), F.lit(0.75).alias("anomaly_score"))
    return storage.merge_scores(rows, scores).select("id", "is_anomaly", "anomaly_score")


# --- findings as entries ---------------------------------------------------------------------

_ENTRY = ["ts", "source", "level", "message", "category", "src_ip", "dst_ip", "dst_port", "protocol", "matched_rules", "tags",
          "is_anomaly", "anomaly_score", "filepath", "file_hash"]
_REASON = "CASE raddr_port %s END" % " ".join(f"WHEN {p} THEN {q(r)}" for p, r in R.SUSPICIOUS_PORTS.items())


def _row(ts, source, level, message, category="'log'", src="''", dst="''", port="0", protocol="''", rules="''", tags="''", score="0.0",
         filepath="''", file_hash="''", anomaly="true"):
    return f"""{ts} AS ts, {source} AS source, {level} AS level, {message} AS message, {category} AS category, {src} AS src_ip, {dst} AS dst_ip,
  CAST({port} AS INT) AS dst_port, {protocol} AS protocol, {rules} AS matched_rules, {tags} AS tags, {anomaly} AS is_anomaly,
  CAST({score} AS DOUBLE) AS anomaly_score, {filepath} AS filepath, {file_hash} AS file_hash"""


@check("entries_suspicious", with_(NEW_CONNS, "SELECT " + _row(
    "snapshot_ts", "'network-monitor'", "'CRITICAL'", f"concat('Suspicious outbound connection to ', raddr_ip, ':', raddr_port, ' (', {_REASON}, ') — process: ', proc_name)",
    "'network'", "laddr_ip", "raddr_ip", "raddr_port", "type", "'Suspicious Outbound'", "concat('suspicious_port|port:', raddr_port)", "0.8")
    + f" FROM new_conns WHERE {_REASON} IS NOT NULL", True))
def _(spark, sf):
    return findings.from_suspicious_outbound(S.suspicious_outbound(S.new_connections(snapshots(spark, sf)))).select(_ENTRY)


@check("entries_listeners", with_(CONNS, "SELECT " + _row(
    "snapshot_ts", "'network-monitor'", "'INFO'", "concat('New listening service on port ', laddr_port, ' — process: ', proc_name)", "'network'",
    port="laddr_port", protocol="'TCP'", tags="concat('new_listener|port:', laddr_port)", score="0.5", anomaly="false") + """ FROM (
    SELECT *, row_number() OVER (PARTITION BY laddr_port ORDER BY snapshot_ts, pid, proc_name) AS rn FROM conns WHERE raddr_ip IS NULL AND status = 'LISTEN') x
  WHERE rn = 1 AND snapshot_ts > (SELECT min(snapshot_ts) FROM conns) AND laddr_port < 1024 AND proc_name <> 'unknown'"""))
def _(spark, sf):
    return findings.from_new_listeners(S.new_listeners(snapshots(spark, sf))).select(_ENTRY)


@check("entries_files", with_(FILES, "SELECT " + _row(
    NOW, "concat('fim/', regexp_extract(path, '[^/]*$'))", "CASE WHEN change IN ('modified', 'deleted') THEN 'CRITICAL' ELSE 'WARNING' END",
    """concat('FIM [', upper(change), '] ', path, ' — ', CASE WHEN change = 'permission_changed' THEN 'mode 0o644→0o777'
      WHEN h2 IS NOT NULL THEN concat('new_hash=', left(h2, 12), '…') ELSE concat('old_hash=', left(h1, 12), '…') END)""", "'fim'",
    rules="'File Integrity Violation'", tags="concat('fim|', change, '|file:', regexp_extract(path, '[^/]*$'))",
    score="CASE WHEN change IN ('modified', 'deleted') THEN 0.9 ELSE 0.6 END", filepath="path", file_hash="coalesce(h2, h1)") + """ FROM (
    SELECT coalesce(b.path, c.path) AS path, b.sha256 AS h1, c.sha256 AS h2, CASE WHEN c.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN NULL
      WHEN b.sha256 <> c.sha256 THEN 'modified' WHEN b.mode <> c.mode THEN 'permission_changed' END AS change
    FROM baseline b FULL JOIN current_files c ON b.path = c.path) x WHERE change IS NOT NULL"""))
def _(spark, sf):
    return findings.from_files(S.fim_diff(*files(spark, sf)), F.lit(AS_OF).cast("timestamp")).select(_ENTRY)


@check("entries_scans", with_(SCANS, "SELECT " + _row(
    "ts", "concat('portscan/', src_ip)", "'CRITICAL'", """concat('Port scan detected from ', src_ip, ': ', unique_ports, ' unique ports probed in 60s (', attempts,
      ' total attempts, detected via ', method, ')')""", "'portscan'", "src_ip", port="dst_port", rules="'Port Scan Detected'",
    tags="concat('portscan|src:', src_ip, '|method:', method)", score="0.97") + " FROM port_scans", True))
def _(spark, sf):
    return findings.from_port_scans(scans.port_scans(attempts(spark, sf))).select(_ENTRY)


@check("entries_dns", with_(DNS_FINDINGS, "SELECT " + _row(
    "ts", "'dns-monitor'", "level", """CASE signal WHEN 'bad_tld' THEN concat('DNS query to suspicious TLD .', string_split(domain, '.')[-1], ': ', domain, '  src=', client)
      WHEN 'entropy' THEN concat('High-entropy DNS subdomain (', printf('%.2f', amount), ' bits): ', domain, '  src=', client)
      WHEN 'long' THEN concat('Unusually long DNS subdomain (', CAST(amount AS INT), ' chars): ', domain, '  src=', client)
      WHEN 'rate' THEN concat('High DNS query rate from ', client, ': ', CAST(amount AS INT), ' queries/min')
      ELSE concat('NXDOMAIN storm from ', client, ': ', CAST(amount AS INT), ' failures/min (possible DGA cycling)') END""", "'network'",
    protocol="'DNS'", rules="'DNS Tunneling'", tags="""CASE signal WHEN 'bad_tld' THEN concat('bad_tld|tld:.', string_split(domain, '.')[-1])
      WHEN 'entropy' THEN 'high_entropy_dns' WHEN 'long' THEN 'long_subdomain' WHEN 'rate' THEN concat('high_dns_rate|src:', client) ELSE 'nxdomain_storm' END""",
    score="CASE level WHEN 'WARNING' THEN 0.8 ELSE 0.95 END") + """ FROM (SELECT s.* FROM first_rows s JOIN fire f ON f.signal = s.signal AND f.key = s.key
    AND f.us = s.us WHERE s.rn = 1) x""", True))
def _(spark, sf):
    from checks.scalars import dns_queries
    from seclog.operators import dns as D

    return findings.from_dns(D.dns_findings(dns_queries(spark, sf), rate_threshold=4, nxdomain_threshold=1)).select(_ENTRY)


@check("all_entries", with_(NEW_CONNS + f""", parts AS (
  SELECT source, level, message FROM (SELECT source, 'INFO' AS level, message FROM e0) x
  UNION ALL SELECT 'network-monitor', 'WARNING', concat('Outbound SMTP-like connection to ', raddr_ip, ':', raddr_port, ' — possible exfiltration — process: ', proc_name)
    FROM new_conns WHERE raddr_port IN (25, 465, 587) AND raddr_ip LIKE '203.%')""", "SELECT * FROM parts", True))
def _(spark, sf):
    logs = entries(spark, sf).withColumn("level", F.lit("INFO"))
    mail = findings.from_smtp_outbound(S.smtp_outbound(S.new_connections(snapshots(spark, sf))))
    return storage.all_entries(logs, mail).select("source", "level", "message")


@check("entries_smtp", with_(NEW_CONNS, "SELECT " + _row(
    "snapshot_ts", "'network-monitor'", "'WARNING'",
    "concat('Outbound SMTP-like connection to ', raddr_ip, ':', raddr_port, ' — possible exfiltration — process: ', proc_name)", "'network'", "laddr_ip",
    "raddr_ip", "raddr_port", "'TCP'", "'Large Outbound Transfer'", "'smtp_outbound'", "0.5")
    + " FROM new_conns WHERE raddr_port IN (25, 465, 587) AND raddr_ip LIKE '203.%'", True))
def _(spark, sf):
    return findings.from_smtp_outbound(S.smtp_outbound(S.new_connections(snapshots(spark, sf)))).select(_ENTRY)


def _tenth(value: str) -> str:
    """One decimal, halves away from zero as Java prints them."""
    return f"printf('%.1f', floor({value} * 10 + 0.5) / 10)"


@check("entries_beacons", with_(BEACONS, "SELECT " + _row(
    "make_timestamp(us)", "'network-monitor'", "'WARNING'",
    f"concat('Beaconing detected to ', raddr_ip, ': ', len(recent), ' connections in 5m with interval ', {_tenth('mean_s')}, 's ±', {_tenth('std_s')}, 's')",
    "'network'", dst="raddr_ip", protocol="'TCP'", rules="'Beaconing Detected'", tags="concat('beaconing|remote:', raddr_ip)", score="0.5")
    + " FROM walk WHERE hit", True))
def _(spark, sf):
    snaps = X.spark_table(spark, sf, beats, "conns")
    return findings.from_beacons(S.beacons(S.new_connections(snaps), S.ticks(snaps))).select(_ENTRY)


_WHO = "' (pid=', pid, ', user=', username, ')'"


@check("entries_processes", with_(PROCS, "SELECT " + _row(
    "snapshot_ts", "concat('procmon/', CASE finding WHEN 'suspicious_spawn' THEN concat(parent_name, '→') ELSE '' END, name)",
    "CASE finding WHEN 'high_cpu' THEN 'WARNING' ELSE 'CRITICAL' END",
    f"""CASE finding WHEN 'bad_process' THEN concat('Known malicious process: ', name, {_WHO}, '  cmd: ', left(cmdline, 120))
      WHEN 'tmp_execution' THEN concat('Process running from temp dir: ', exe, {_WHO})
      WHEN 'suspicious_spawn' THEN concat('Suspicious child process: ', parent_name, ' spawned ', name, {_WHO}, ' — possible webshell or RCE')
      ELSE concat('High CPU process: ', name, ' at ', {_tenth('cpu')}, '%', {_WHO}) END""",
    rules="CASE finding WHEN 'suspicious_spawn' THEN 'Reverse Shell Indicator' WHEN 'high_cpu' THEN 'Suspicious Process' ELSE 'Malware Indicator' END",
    tags="CASE finding WHEN 'suspicious_spawn' THEN concat('suspicious_spawn|parent:', parent_name, '|child:', name) ELSE concat(finding, '|proc:', name) END",
    score="CASE finding WHEN 'high_cpu' THEN 0.85 ELSE 0.95 END")
    + f" FROM (SELECT *, {FINDING} AS finding FROM family WHERE prev_ts IS NOT NULL) x WHERE finding IS NOT NULL"))
def _(spark, sf):
    return findings.from_processes(S.process_findings(procs(spark, sf))).select(_ENTRY)


# --- tables written and read back -------------------------------------------------------------

def _folder(spark) -> str:
    return "%s/check-%s" % (storage.checkpoint_dir(spark).rstrip("/"), uuid.uuid4().hex)


@check("entries_stored", with_(ANNOTATED, "SELECT id, ts, source, level, category, filepath FROM ann WHERE category IN ('fim', 'network')"))
def _(spark, sf):
    path = _folder(spark)
    storage.write_entries(annotated(spark, sf), path)
    return storage.log_entries(spark, path).filter("category IN ('fim', 'network')").select("id", "ts", "source", "level", "category", "filepath")


@check("alerts_stored", with_(ALERTS, "SELECT * FROM alerts", True))
def _(spark, sf):
    path, rows = _folder(spark), alerts(spark, sf)
    storage.append_alerts(rows.filter("level = 'critical'"), path)
    storage.append_alerts(rows.filter("level <> 'critical'"), path)
    return storage.alerts(spark, path)


@check("baseline_stored", with_(FILES, "SELECT path, sha256, CAST(size AS BIGINT) AS size, mode FROM current_files"))
def _(spark, sf):
    path, (old, new) = _folder(spark), files(spark, sf)
    storage.save_baseline(old, path, 1, AS_OF)
    storage.save_baseline(new, path, 2, AS_OF)
    return storage.load_baseline(spark, path)


@check("scan_attempts_with_sockets", with_(LOG_ATTEMPTS + """,
sockets AS (SELECT id, CASE WHEN num % 9 = 1 THEN '2001:db8::1' ELSE src_ip END AS src_ip, CAST(dst_port AS INT) AS dst_port FROM e0
  WHERE num % 9 <> 0 AND num % 4 < 2)""", f"""SELECT id, ts, src_ip, dst_port, kind, method FROM log_attempts
  UNION ALL SELECT id, {NOW}, src_ip, dst_port, 'socket', 'proc' FROM sockets"""))
def _(spark, sf):
    from seclog.sources.sockets import parse_proc_net_tcp

    found = parse_proc_net_tcp(X.spark_table(spark, sf, X.proc_lines, "lines"))
    feed = found.select("id", F.lit(AS_OF).cast("timestamp").alias("ts"), "src_ip", "dst_port", F.lit("socket").alias("kind"), F.lit("proc").alias("method"))
    out = scans.scan_attempts(scans.log_attempts(entries(spark, sf)), feed)
    return out.select("id", "ts", "src_ip", "dst_port", "kind", "method")
