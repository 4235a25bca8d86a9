"""Detectors: rates, scans, DNS, snapshots, chains, alerts, forest, pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.fixtures import q
from checks.registry import (ANNOTATED, DUCK, LEVELED, RATES, SCORED, annotated, check, cooldown_sql, entries, stored, with_)
from checks.scalars import _PRIVATE, _SUB, DNS, LOG_ATTEMPTS, SIGNAL, dns_queries, shannon_sql
from seclog import refdata as R, storage
from seclog.operators import (alerts as AL, annotate as A, correlate as C, dns as D, findings, forest as FO, rates as RT, scans,
                              snapshots as S)
from seclog.operators.cooldown import cooldown
from seclog.schema import complete
from seclog.sources.sockets import parse_proc_net_tcp

ENTRIES = X.entries(DUCK)
AS_OF = X.AS_OF


# --- rates ----------------------------------------------------------------------------

@check("source_rate", with_(LEVELED + "," + RATES, "SELECT id, source_rate FROM rates"))
def _(spark, sf):
    return RT.source_rate(entries(spark, sf)).select("id", "source_rate")


@check("global_rate", with_(LEVELED + "," + RATES, "SELECT id, global_rate FROM rates"))
def _(spark, sf):
    return RT.global_rate(entries(spark, sf)).select("id", "global_rate")


@check("sources_seen", with_(LEVELED + "," + RATES, "SELECT id, CAST(sources_seen AS BIGINT) AS sources_seen FROM rates"))
def _(spark, sf):
    return RT.sources_seen(entries(spark, sf)).select("id", "sources_seen")


@check("rate_anomaly", with_(SCORED, "SELECT id, is_anomaly AS stat_anomaly, anomaly_score AS stat_score FROM scored"))
def _(spark, sf):
    out = RT.rate_anomaly(A.apply_rules(entries(spark, sf)))
    return out.select("id", "stat_anomaly", F.round("stat_score", 4).alias("stat_score"))


@check("combined_score", with_(SCORED, "SELECT id, is_anomaly, anomaly_score FROM scored"))
def _(spark, sf):
    return RT.combine_scores(RT.rate_anomaly(A.apply_rules(entries(spark, sf)))).select("id", "is_anomaly", "anomaly_score")


# --- port scans -------------------------------------------------------------------------

# Attempts of the records themselves (adapter columns) next to those found in the text.
ATTEMPTS = LOG_ATTEMPTS + """,
attempts AS (SELECT id, ts, us, src_ip, dst_port, kind, method FROM log_attempts
  UNION ALL SELECT id, ts, us, src_ip, CAST(dst_port AS INT) AS dst_port, 'connection' AS kind, 'psutil' AS method FROM entries)"""


def attempts(spark, sf):
    rows = entries(spark, sf)
    return stored(spark, sf, "attempts", lambda: scans.scan_attempts(
        scans.log_attempts(rows), scans.connection_attempts(rows)))


@check("scan_attempts", with_(ATTEMPTS, "SELECT id, ts, src_ip, dst_port, kind, method FROM attempts"))
def _(spark, sf):
    return attempts(spark, sf)


FANOUT = ATTEMPTS + """,
per_port AS (SELECT src_ip, us, dst_port, count(*) AS n FROM attempts GROUP BY 1, 2, 3),
moments AS (SELECT DISTINCT src_ip, us FROM per_port),
fanout AS (SELECT m.src_ip, m.us, count(DISTINCT p.dst_port) AS unique_ports, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS attempts
  FROM moments m LEFT JOIN per_port p ON p.src_ip = m.src_ip AND p.us BETWEEN m.us - 60000000 AND m.us AND p.dst_port <> 0
  GROUP BY 1, 2)"""


@check("port_fanout", with_(FANOUT, """SELECT a.id, a.src_ip, a.dst_port, a.method, a.kind, f.unique_ports, f.attempts
    FROM attempts a JOIN fanout f ON f.src_ip = a.src_ip AND f.us = a.us"""))
def _(spark, sf):
    return scans.port_fanout(attempts(spark, sf)).select("id", "src_ip", "dst_port", "method", "kind", "unique_ports", "attempts")


SCANS = FANOUT + """,
wide AS (SELECT * FROM fanout WHERE unique_ports >= 12),""" + cooldown_sql("wide", ["src_ip"], 300_000_000, "scan") + """,
port_scans AS (SELECT s.src_ip, s.us, make_timestamp(s.us) AS ts, f.unique_ports, f.attempts, t.id, t.dst_port, t.method FROM scan s
  JOIN fanout f ON f.src_ip = s.src_ip AND f.us = s.us
  JOIN (SELECT *, row_number() OVER (PARTITION BY src_ip, us ORDER BY id, dst_port, method) AS rn FROM attempts) t
    ON t.src_ip = s.src_ip AND t.us = s.us AND t.rn = 1)"""


@check("port_scans", with_(SCANS, "SELECT src_ip, ts, unique_ports, attempts, id, dst_port, method FROM port_scans", True))
def _(spark, sf):
    return scans.port_scans(attempts(spark, sf)).drop("us")


LIVE = FANOUT + """,
live AS (SELECT src_ip AS ip, unique_ports, attempts AS count FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY us DESC) AS rn
  FROM fanout) x WHERE rn = 1 AND unique_ports > 0 ORDER BY unique_ports DESC, ip LIMIT 10)"""


@check("live_scanners", with_(LIVE, "SELECT * FROM live"))
def _(spark, sf):
    return scans.live_scanners(attempts(spark, sf))


@check("scanners_merged", with_(LIVE + """,
stored AS (SELECT src_ip AS ip, count(*) AS count FROM entries WHERE category = 'portscan' AND src_ip <> '' GROUP BY 1
  ORDER BY count DESC, ip LIMIT 20)""", """SELECT ip, coalesce(l.unique_ports, 0) AS unique_ports,
    greatest(coalesce(l.count, 0), coalesce(s.count, 0)) AS count FROM live l FULL JOIN stored s USING (ip)
    ORDER BY CASE WHEN coalesce(l.unique_ports, 0) > 0 THEN l.unique_ports ELSE s.count END DESC, ip LIMIT 20"""))
def _(spark, sf):
    from seclog.plans.stats import top_scanners

    return scans.merge_scanners(scans.live_scanners(attempts(spark, sf)), top_scanners(entries(spark, sf), 20))


# --- DNS ----------------------------------------------------------------------------------

DNS_RATES = DNS + """,
rated AS (SELECT *, count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS rate FROM queries),
failing AS (SELECT *, count(*) OVER (PARTITION BY domain ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS nx_rate
  FROM queries WHERE is_nxdomain)"""


@check("dns_rate", with_(DNS_RATES, "SELECT id, client, rate FROM rated"))
def _(spark, sf):
    return D.dns_rate(dns_queries(spark, sf)).select("id", "client", "rate")


@check("nxdomain_rate", with_(DNS_RATES, "SELECT id, domain, nx_rate FROM failing"))
def _(spark, sf):
    return D.nxdomain_rate(dns_queries(spark, sf)).select("id", "domain", "nx_rate")


# Thresholds fitted to the density of the fixture; the defaults are the reference values.
DNS_FINDINGS = DNS_RATES + f""",
named AS (SELECT *, {SIGNAL} AS signal FROM queries),
signals AS (
  SELECT id, ts, us, signal, domain AS key,
    CASE WHEN signal = 'bad_tld' THEN 'CRITICAL' ELSE 'WARNING' END AS level, domain, client,
    CASE signal WHEN 'entropy' THEN round({shannon_sql('(' + _SUB + ')')}, 2) WHEN 'long' THEN CAST(length({_SUB}) AS DOUBLE) ELSE 0.0 END AS amount
    FROM named WHERE signal IS NOT NULL
  UNION ALL SELECT id, ts, us, 'rate', client, 'WARNING', domain, client, CAST(rate AS DOUBLE) FROM rated WHERE rate > 4
  UNION ALL SELECT id, ts, us, 'nxdomain', client, 'WARNING', domain, client, CAST(nx_rate AS DOUBLE) FROM failing WHERE nx_rate > 1),""" + \
    cooldown_sql("signals", ["signal", "key"], 300_000_000) + """,
first_rows AS (SELECT *, row_number() OVER (PARTITION BY signal, key, us ORDER BY id) AS rn FROM signals)"""


@check("dns_findings", with_(DNS_FINDINGS, """SELECT s.id, s.ts, s.signal, s.key, s.level, s.domain, s.client, s.amount FROM first_rows s
    JOIN fire f ON f.signal = s.signal AND f.key = s.key AND f.us = s.us WHERE s.rn = 1""", True))
def _(spark, sf):
    return D.dns_findings(dns_queries(spark, sf), rate_threshold=4, nxdomain_threshold=1)


# --- snapshots -----------------------------------------------------------------------------

CONNS = X.connections(DUCK)


def snapshots(spark, sf):
    return X.spark_table(spark, sf, X.connections, "conns")


def new_connections_sql(grace_us: int = 300_000_000) -> str:
    """A connection is new if never seen, or if the snapshot before its return came at
    least the grace after the last time it was new."""
    key = ["laddr_ip", "laddr_port", "raddr_ip", "raddr_port", "pid"]
    ks = ", ".join(key)
    same = " AND ".join(f"s.{k} = f.{k}" for k in key)
    fs = ", ".join("f." + k for k in key)
    return f""",
clock AS (SELECT snapshot_ts, lag(snapshot_ts) OVER (ORDER BY snapshot_ts) AS prev_ts FROM (SELECT DISTINCT snapshot_ts FROM conns) x),
present AS (SELECT {ks}, snapshot_ts, min(struct_pack(status, type, proc_name)) AS rest FROM conns WHERE raddr_ip IS NOT NULL GROUP BY ALL),
seen AS (SELECT p.*, c.prev_ts, lag(p.snapshot_ts) OVER (PARTITION BY {ks} ORDER BY p.snapshot_ts) AS last_ts
  FROM present p JOIN clock c USING (snapshot_ts)),
back AS (SELECT *, epoch_us(snapshot_ts) AS us, epoch_us(prev_ts) AS prev_us FROM seen WHERE last_ts IS NULL OR prev_ts > last_ts),
fresh AS (SELECT {ks}, us FROM back WHERE last_ts IS NULL
  UNION ALL SELECT {fs}, min(s.us) FROM fresh f JOIN back s ON {same} AND s.us > f.us AND s.prev_us >= f.us + {grace_us} GROUP BY {fs}, f.us),
new_conns AS (SELECT {', '.join('b.' + k for k in key)}, b.snapshot_ts, b.rest.status AS status, b.rest.type AS type, b.rest.proc_name AS proc_name
  FROM back b JOIN fresh f ON {' AND '.join(f'b.{k} = f.{k}' for k in key)} AND b.us = f.us WHERE b.prev_ts IS NOT NULL)"""


NEW_CONNS = CONNS + new_connections_sql()


@check("new_connections", with_(NEW_CONNS, "SELECT * FROM new_conns", True))
def _(spark, sf):
    return S.new_connections(snapshots(spark, sf))


@check("new_connections_short_grace", with_(CONNS + new_connections_sql(60_000_000), "SELECT * FROM new_conns", True))
def _(spark, sf):
    return S.new_connections(snapshots(spark, sf), grace_seconds=60)


@check("new_listeners", with_(CONNS, """SELECT laddr_port, snapshot_ts, proc_name FROM (
    SELECT *, row_number() OVER (PARTITION BY laddr_port ORDER BY snapshot_ts, pid, proc_name) AS rn FROM conns
    WHERE raddr_ip IS NULL AND status = 'LISTEN') x
  WHERE rn = 1 AND snapshot_ts > (SELECT min(snapshot_ts) FROM conns) AND laddr_port < 1024 AND proc_name <> 'unknown'"""))
def _(spark, sf):
    return S.new_listeners(snapshots(spark, sf))


_REASON = "CASE raddr_port %s END" % " ".join(f"WHEN {p} THEN {q(r)}" for p, r in R.SUSPICIOUS_PORTS.items())


@check("suspicious_ports", with_(NEW_CONNS, f"SELECT *, {_REASON} AS reason FROM new_conns WHERE {_REASON} IS NOT NULL", True))
def _(spark, sf):
    return S.suspicious_outbound(S.new_connections(snapshots(spark, sf)))


@check("smtp_outbound", with_(NEW_CONNS, f"""SELECT * FROM new_conns WHERE raddr_port IN (25, 465, 587)
    AND NOT {_PRIVATE.replace('ip', 'raddr_ip')}""", True))
def _(spark, sf):
    return S.smtp_outbound(S.new_connections(snapshots(spark, sf)))


@check("active_connections", with_(CONNS, f"""SELECT concat(laddr_ip, ':', laddr_port) AS laddr, concat(raddr_ip, ':', raddr_port) AS raddr,
    raddr_ip AS rip, raddr_port AS rport, status, pid, proc_name AS proc, {_REASON} IS NOT NULL AS suspicious,
    NOT {_PRIVATE.replace('ip', 'raddr_ip')} AS external FROM conns
  WHERE raddr_ip IS NOT NULL ORDER BY raddr, laddr, pid, status, proc LIMIT 200"""))
def _(spark, sf):
    return S.active_connections(snapshots(spark, sf))


def beats(d) -> str:
    """One connection per address and snapshot from a fresh local port, so every one is new."""
    return X.base(d) + f""",
conns AS (SELECT DISTINCT {d.stamp('us - us % 15000000')} AS snapshot_ts, '10.0.0.1' AS laddr_ip,
    CAST(40000 + (us {d.div} 15000000) % 20000 AS INT) AS laddr_port,
    concat(CASE WHEN h < 8 THEN '203.0.113.' ELSE '10.0.0.' END, num % 150) AS raddr_ip,
    443 AS raddr_port, 1 AS pid, 'ESTABLISHED' AS status, 'TCP' AS type, 'agent' AS proc_name FROM e0)"""


BEACONS = beats(DUCK) + new_connections_sql() + f""",
arrivals AS (SELECT raddr_ip, epoch_us(snapshot_ts) AS us, count(*) AS n FROM new_conns
  WHERE NOT {_PRIVATE.replace('ip', 'raddr_ip')} GROUP BY 1, 2),
ticks AS (SELECT us, row_number() OVER (ORDER BY us) AS t FROM (SELECT DISTINCT epoch_us(snapshot_ts) AS us FROM conns) x),
steps AS (SELECT r.raddr_ip, k.t, k.us, coalesce(a.n, 0) AS n FROM (SELECT DISTINCT raddr_ip FROM arrivals) r CROSS JOIN ticks k
  LEFT JOIN arrivals a ON a.raddr_ip = r.raddr_ip AND a.us = k.us),
walk AS (SELECT raddr_ip, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS us, CAST([] AS BIGINT[]) AS held, CAST([] AS BIGINT[]) AS recent, false AS hit,
    CAST(0 AS DOUBLE) AS mean_s, CAST(0 AS DOUBLE) AS std_s FROM arrivals GROUP BY 1
  UNION ALL SELECT raddr_ip, t, us, CASE WHEN hit THEN CAST([] AS BIGINT[]) ELSE recent END, recent, hit, mean_s, std_s FROM (
    SELECT *, coalesce(len(recent) >= 5 AND mean_s > 0 AND mean_s < 120 AND std_s / mean_s < 0.25, false) AS hit FROM (
      SELECT *, list_avg(gaps) AS mean_s, list_stddev_pop(gaps) AS std_s FROM (
        SELECT *, CASE WHEN len(recent) < 2 THEN CAST([] AS DOUBLE[]) ELSE
          list_transform(range(1, len(recent)), lambda i: (recent[i + 1] - recent[i]) / 1000000.0) END AS gaps FROM (
          SELECT w.raddr_ip, s.t, s.us, list_filter(list_concat(w.held, list_transform(range(0, s.n), lambda i: s.us)),
            lambda x: x >= s.us - 300000000) AS recent FROM walk w JOIN steps s ON s.raddr_ip = w.raddr_ip AND s.t = w.t + 1) a) b) c) d)"""


@check("beacons", with_(BEACONS, """SELECT raddr_ip, us, CAST(len(recent) AS BIGINT) AS connections, round(mean_s, 4) AS mean_s,
    round(std_s, 4) AS std_s FROM walk WHERE hit""", True))
def _(spark, sf):
    snaps = X.spark_table(spark, sf, beats, "conns")
    out = S.beacons(S.new_connections(snaps), S.ticks(snaps))
    return out.withColumns({c: F.round(c, 4) for c in ("mean_s", "std_s")})


PROCS = X.processes(DUCK) + """,
clean AS (SELECT snapshot_ts, pid, ppid, lower(name) AS name, exe, array_to_string(cmdline, ' ') AS cmdline, username, cpu FROM procs),
clock AS (SELECT snapshot_ts, lag(snapshot_ts) OVER (ORDER BY snapshot_ts) AS prev_ts FROM (SELECT DISTINCT snapshot_ts FROM clean) x),
family AS (SELECT c.*, k.prev_ts, coalesce(p.name, '') AS parent_name, b.pid IS NULL AS is_new FROM clean c JOIN clock k USING (snapshot_ts)
  LEFT JOIN clean p ON p.snapshot_ts = c.snapshot_ts AND p.pid = c.ppid
  LEFT JOIN clean b ON b.snapshot_ts = k.prev_ts AND b.pid = c.pid)"""


def procs(spark, sf):
    return S.processes(X.spark_table(spark, sf, X.processes, "procs"))


@check("process_parent", with_(PROCS, "SELECT snapshot_ts, pid, ppid, name, parent_name, is_new FROM family"))
def _(spark, sf):
    return S.with_parent(procs(spark, sf)).select("snapshot_ts", "pid", "ppid", "name", "parent_name", "is_new")


def _in(names):
    return "(" + ", ".join(q(n) for n in names) + ")"


FINDING = f"""CASE WHEN name IN {_in(R.BAD_PROCESSES)} OR {' OR '.join(f"contains(lower(cmdline), {q(b)})" for b in R.BAD_PROCESSES)} THEN 'bad_process'
  WHEN regexp_matches(exe, {q(R.TEMP_DIR_PATTERN)}, 'i') THEN 'tmp_execution'
  WHEN is_new THEN CASE WHEN parent_name IN {_in(R.SUSPICIOUS_PARENTS)} AND name IN {_in(R.SUSPICIOUS_CHILDREN)} THEN 'suspicious_spawn' END
  WHEN cpu > 80 THEN 'high_cpu' END"""


@check("process_findings", with_(PROCS, f"""SELECT snapshot_ts, pid, ppid, name, exe, cmdline, username, cpu, parent_name, is_new, finding,
    CASE finding WHEN 'suspicious_spawn' THEN 'Reverse Shell Indicator' WHEN 'high_cpu' THEN 'Suspicious Process' ELSE 'Malware Indicator' END AS rule,
    CASE finding WHEN 'high_cpu' THEN 'WARNING' ELSE 'CRITICAL' END AS level
  FROM (SELECT *, {FINDING} AS finding FROM family WHERE prev_ts IS NOT NULL) x WHERE finding IS NOT NULL"""))
def _(spark, sf):
    return S.process_findings(procs(spark, sf))


FILES = X.files(DUCK)


def _fim_sql(created: bool) -> str:
    made = "'created'" if created else "NULL"
    return with_(FILES, f"""SELECT path, old_sha256, old_size, old_mode, new_sha256, new_size, new_mode, change,
    CASE WHEN change IN ('modified', 'deleted') THEN 'CRITICAL' ELSE 'WARNING' END AS level,
    CASE WHEN change = 'permission_changed' THEN concat('mode 0o', to_base(old_mode, 8), '→0o', to_base(new_mode, 8))
      WHEN new_sha256 IS NOT NULL THEN concat('new_hash=', left(new_sha256, 12), '…') ELSE concat('old_hash=', left(old_sha256, 12), '…') END AS details
  FROM (SELECT coalesce(b.path, c.path) AS path, b.sha256 AS old_sha256, b.size AS old_size, b.mode AS old_mode, c.sha256 AS new_sha256,
    c.size AS new_size, c.mode AS new_mode, CASE WHEN c.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN {made}
      WHEN b.sha256 <> c.sha256 THEN 'modified' WHEN b.mode <> c.mode THEN 'permission_changed' END AS change
    FROM baseline b FULL JOIN current_files c ON b.path = c.path) x WHERE change IS NOT NULL""")


def files(spark, sf):
    return X.spark_table(spark, sf, X.files, "baseline"), X.spark_table(spark, sf, X.files, "current_files")


@check("fim_diff", _fim_sql(False))
def _(spark, sf):
    return S.fim_diff(*files(spark, sf))


@check("fim_diff_created", _fim_sql(True))
def _(spark, sf):
    return S.fim_diff(*files(spark, sf), emit_created=True)


@check("fim_deleted", with_(FILES, "SELECT path FROM baseline WHERE path NOT IN (SELECT path FROM current_files)"))
def _(spark, sf):
    return S.deleted_paths(*files(spark, sf))


@check("baseline_view", with_(FILES, """SELECT path, concat(left(sha256, 16), '…') AS hash, size, concat('0o', to_base(mode, 8)) AS mode
    FROM baseline ORDER BY path LIMIT 500"""))
def _(spark, sf):
    return S.baseline_view(files(spark, sf)[0])


# --- cooldown, alerts -------------------------------------------------------------------------

@check("cooldown", with_("keyed AS (SELECT event_id, user_id % 10 AS key, epoch_us(ts) AS us FROM events)," +
                         cooldown_sql("keyed", ["key"], 21600 * 1_000_000),
                         "SELECT min(k.event_id) AS event_id, f.key, f.us FROM fire f JOIN keyed k ON k.key = f.key AND k.us = f.us GROUP BY f.key, f.us", True))
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", (F.col("user_id") % 10).alias("key"))
    passed = cooldown(events, ["key"], 21600, order=["event_id"])
    return passed.select("event_id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


CANDIDATES = """,
cand AS (SELECT id, us, ts, source, rule AS rule_name, CASE WHEN level = 'CRITICAL' THEN 'critical' WHEN level IN ('ERROR', 'WARNING') THEN 'warning'
    ELSE 'info' END AS level, message FROM (SELECT *, unnest(matched_rules) AS rule FROM ann) x
  UNION ALL SELECT id, us, ts, source, 'Anomaly Detected', 'warning', concat('Statistical anomaly from ', source, ' (score=',
    printf('%.3f', anomaly_score), '): ', message) FROM ann WHERE is_anomaly AND len(matched_rules) = 0)"""
ALERTS = ANNOTATED + CANDIDATES + "," + cooldown_sql("cand", ["rule_name", "source"], 120_000_000, "alert_fire") + """,
cand_rows AS (SELECT *, row_number() OVER (PARTITION BY rule_name, source, us ORDER BY id) AS rn FROM cand),
alerts AS (SELECT sha256(concat(c.rule_name, chr(1), c.source, chr(1), c.us)) AS alert_id, c.rule_name, c.level, c.message, c.source,
    c.id AS log_id, c.ts, false AS acknowledged FROM cand_rows c JOIN alert_fire f ON f.rule_name = c.rule_name AND f.source = c.source
    AND f.us = c.us WHERE c.rn = 1),
acked AS (SELECT * EXCLUDE (acknowledged), CAST(log_id AS BIGINT) % 3 = 0 AS acknowledged FROM alerts)"""


def alerts(spark, sf):
    return stored(spark, sf, "alerts", lambda: AL.alerts_from(annotated(spark, sf)))


def acked(spark, sf):
    rows = alerts(spark, sf)
    acks = rows.filter(F.col("log_id").cast("bigint") % 3 == 0).select("alert_id")
    return storage.apply_acks(rows, acks)


@check("alerts_rule", with_(ALERTS, "SELECT * FROM alerts WHERE rule_name <> 'Anomaly Detected'", True))
def _(spark, sf):
    return AL.alerts_from(annotated(spark, sf)).filter(F.col("rule_name") != "Anomaly Detected")


@check("alerts_anomaly", with_(ALERTS, "SELECT * FROM alerts WHERE rule_name = 'Anomaly Detected'", True))
def _(spark, sf):
    return alerts(spark, sf).filter(F.col("rule_name") == "Anomaly Detected")


@check("alert_list", with_(ALERTS, "SELECT * FROM acked WHERE NOT acknowledged ORDER BY ts DESC, alert_id LIMIT 100", True))
def _(spark, sf):
    return AL.alert_list(acked(spark, sf), unacknowledged_only=True)


_DESCRIPTION = "CASE split_part(mitre_technique_id, '.', 1) %s ELSE '' END" % " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in R.TECHNIQUE_DESCRIPTIONS.items())


@check("alert_history", with_(ALERTS, f"""SELECT a.*, mitre_tactic, mitre_tactic_id, mitre_technique, mitre_technique_id,
    {_DESCRIPTION} AS tech_description FROM (SELECT * FROM alerts ORDER BY ts DESC, alert_id LIMIT 500) a LEFT JOIN ann n ON n.id = a.log_id""", True))
def _(spark, sf):
    return AL.alert_history(alerts(spark, sf), annotated(spark, sf))


@check("alerts_after_acks", with_(ALERTS, "SELECT * FROM acked", True))
def _(spark, sf):
    return acked(spark, sf)


@check("alerts_ack_all", with_(ALERTS, "SELECT * EXCLUDE (acknowledged), true AS acknowledged FROM alerts", True))
def _(spark, sf):
    return storage.ack_all(alerts(spark, sf))


NOTIFY = ALERTS + """,
told AS (SELECT a.*, upper(a.level) AS up, n.mitre_tactic, n.mitre_tactic_id, n.mitre_technique, n.mitre_technique_id,
    strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS shown FROM alerts a JOIN ann n ON n.id = a.log_id WHERE a.level IN ('warning', 'critical'))"""
_EMOJI = "CASE up WHEN 'CRITICAL' THEN '🔴' ELSE '🟡' END"
_COLOUR = "CASE up WHEN 'CRITICAL' THEN '#ff1744' ELSE '#ffd740' END"


def _notify(kind):
    def run(spark, sf):
        told = AL.with_technique_of_entry(alerts(spark, sf), annotated(spark, sf))
        return AL.notification_payloads(told, kind)

    return run


check("notify_slack", with_(NOTIFY, f"""SELECT alert_id, CAST(json_object('text', concat({_EMOJI}, ' *', up, '* — ', rule_name), 'attachments', [json_object(
    'color', {_COLOUR}, 'fields', [json_object('title', 'Rule', 'value', rule_name, 'short', true), json_object('title', 'Source', 'value', source, 'short', true),
      json_object('title', 'Time', 'value', shown, 'short', true), json_object('title', 'Message', 'value', left(message, 300))],
    'footer', concat('seclog', CASE WHEN mitre_tactic <> '' THEN concat(chr(10), '*MITRE:* ', mitre_tactic_id, ' ', mitre_tactic, ' / ', mitre_technique_id, ' ',
      split_part(mitre_technique, ':', 1)) ELSE '' END), 'ts', epoch_us(ts) // 1000000)]) AS VARCHAR) AS payload FROM told""", True))(_notify("slack"))
check("notify_discord", with_(NOTIFY, """SELECT alert_id, CAST(json_object('embeds', [json_object('title', rule_name, 'description', left(message, 200),
    'color', CASE up WHEN 'CRITICAL' THEN 16717636 ELSE 16766784 END, 'fields', CASE WHEN mitre_tactic <> '' THEN
      [json_object('name', 'Source', 'value', source, 'inline', true), json_object('name', 'Level', 'value', up, 'inline', true),
       json_object('name', 'Time', 'value', shown, 'inline', true), json_object('name', 'Message', 'value', left(message, 1024)),
       json_object('name', 'MITRE', 'value', concat(mitre_tactic_id, ' ', mitre_tactic, ' / ', mitre_technique_id), 'inline', false)]
      ELSE [json_object('name', 'Source', 'value', source, 'inline', true), json_object('name', 'Level', 'value', up, 'inline', true),
       json_object('name', 'Time', 'value', shown, 'inline', true), json_object('name', 'Message', 'value', left(message, 1024))] END,
    'footer', json_object('text', 'seclog'))]) AS VARCHAR) AS payload FROM told""", True))(_notify("discord"))
check("notify_generic", with_(NOTIFY, """SELECT alert_id, CAST(json_object('event', 'alert', 'rule', rule_name, 'level', up, 'source', source,
    'message', left(message, 500), 'timestamp', CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END,
    'mitre', json_object('tactic', mitre_tactic, 'tactic_id', mitre_tactic_id, 'technique', mitre_technique, 'technique_id', mitre_technique_id)) AS VARCHAR) AS payload
  FROM told""", True))(_notify("generic"))


# --- chains -------------------------------------------------------------------------------------

_LAST = {name: f"l{i}" for i, (_, name) in enumerate(R.TACTICS)}


def _valid(chain) -> tuple[str, str]:
    need = f"least({', '.join(_LAST[t] for t in chain.tactics)})"
    present = " AND ".join(f"{_LAST[t]} IS NOT NULL" for t in chain.tactics)
    return need, f"{present} AND {_LAST[chain.tactics[-1]]} = us AND {need} >= us - {chain.window_minutes * 60_000_000}"


CHAIN_LASTS = ANNOTATED + f""",
acts AS (SELECT id, us, coalesce(nullif(src_ip, ''), split_part(source, '/', 1)) AS key, mitre_tactic AS tactic, platform, src_ip FROM ann WHERE mitre_tactic <> ''),
lasts AS (SELECT *, {', '.join(f"max(CASE WHEN tactic = {q(t)} THEN us END) OVER w AS {c}" for t, c in _LAST.items())}
  FROM acts WINDOW w AS (PARTITION BY key ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bests AS (SELECT *, {', '.join(f"max(CASE WHEN {_valid(c)[1]} THEN {_valid(c)[0]} END) OVER w AS best{i}" for i, c in enumerate(R.CHAINS))}
  FROM lasts WINDOW w AS (PARTITION BY key ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sat AS (SELECT key, us, id, tactic, list_filter([{', '.join(f'CASE WHEN best{i} >= us - 7200000000 THEN {i} END' for i in range(len(R.CHAINS)))}],
  lambda x: x IS NOT NULL) AS satisfied FROM bests)"""


@check("chain_satisfied", with_(CHAIN_LASTS, "SELECT key, us, id, tactic, array_to_string(satisfied, '|') AS satisfied FROM sat WHERE len(satisfied) > 0"))
def _(spark, sf):
    return C.chain_satisfied(annotated(spark, sf))


# Replay entry by entry: the first satisfied chain whose last fire is at least 30 minutes back.
CHAIN_FIRES = CHAIN_LASTS + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, id) AS rn FROM sat WHERE len(satisfied) > 0),
replay AS (SELECT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS us, '' AS id, [%s] AS fired, CAST(NULL AS INT) AS chain_no FROM ordered GROUP BY key
  UNION ALL SELECT key, rn, us, id, list_transform(fired, lambda v, i: CASE WHEN i = chain_no + 1 THEN us ELSE v END), chain_no FROM (
    SELECT o.key, o.rn, o.us, o.id, r.fired, CAST((list_filter(o.satisfied, lambda c: o.us - r.fired[c + 1] >= 1800000000))[1] AS INT) AS chain_no
    FROM replay r JOIN ordered o ON o.key = r.key AND o.rn = r.rn + 1) x),
fires AS (SELECT key, us, id, chain_no FROM replay WHERE chain_no IS NOT NULL)""" % ", ".join(["CAST(-1000000000000000 AS BIGINT)"] * len(R.CHAINS))

_ANCHORS = " UNION ALL ".join(
    f"""SELECT key, id, us, {i} AS chain_no, {_valid(c)[0]} AS need, {q(c.name)} AS chain, {q(c.severity)} AS severity, {q('|'.join(c.tactics))} AS tactics,
  {q(c.description)} AS description, concat_ws(' → ', {', '.join(f"concat({q(t)}, ' (', strftime(make_timestamp({_LAST[t]}), '%H:%M:%S'), ')')" for t in c.tactics)}) AS steps
  FROM lasts WHERE {_valid(c)[1]}""" for i, c in enumerate(R.CHAINS))


@check("correlate", with_(CHAIN_FIRES + f""",
anchors AS ({_ANCHORS}),
chosen AS (SELECT f.key, f.us, f.id, f.chain_no, a.us AS anchor_us, a.chain, a.severity, a.tactics, a.description, a.steps,
  row_number() OVER (PARTITION BY f.key, f.id, f.chain_no ORDER BY a.us, a.id DESC) AS rn FROM fires f JOIN anchors a ON a.key = f.key AND a.chain_no = f.chain_no
  AND a.need >= f.us - 7200000000 AND (a.us < f.us OR (a.us = f.us AND a.id <= f.id)))""", """SELECT c.key, c.us, make_timestamp(c.us) AS ts, c.id, c.chain_no, chain, severity,
    tactics, description, anchor_us, concat('[CORRELATED] ', chain, ' from ', c.key, ': ', steps) AS summary, n.src_ip, n.platform
  FROM chosen c JOIN acts n ON n.id = c.id WHERE rn = 1""", True))
def _(spark, sf):
    return C.correlate(annotated(spark, sf))


@check("correlation_stats", with_(CHAIN_FIRES, f"""SELECT (SELECT count(*) FROM fires) AS total_correlations,
    (SELECT count(DISTINCT key) FROM acts) AS active_sources, {len(R.CHAINS)} AS chains_defined""", True))
def _(spark, sf):
    rows = annotated(spark, sf)
    return C.correlation_stats(C.fires(rows), rows)


# --- forest and pipeline ------------------------------------------------------------------------

@check("forest_nodes")
def _(spark, sf):
    features = FO.feature_rows(A.apply_rules(entries(spark, sf)))
    return FO.fit_forest(FO.training_rows(features))


@check("forest_scores")
def _(spark, sf):
    features = FO.feature_rows(A.apply_rules(entries(spark, sf)))
    model = FO.retrain(features)
    return FO.forest_scores(features, model.forest, model.training, model.sample)


@check("pipeline_entries", with_(ANNOTATED, """SELECT id, level, category, array_to_string(matched_rules, '|') AS matched_rules,
    is_anomaly, anomaly_score, mitre_tactic, mitre_technique_id, mitre_subtechnique_id,
    CASE WHEN category IN ('network', 'portscan') THEN 'network' WHEN category = 'fim' THEN 'fim' ELSE 'log' END AS channel FROM ann"""))
def _(spark, sf):
    out = A.with_channel(A.annotate(entries(spark, sf)))
    return out.select("id", "level", "category", "matched_rules", "is_anomaly", "anomaly_score", "mitre_tactic", "mitre_technique_id",
                      "mitre_subtechnique_id", "channel")


def monitors(spark, sf):
    """Entries that the network, process and file monitors make of the given tables."""
    # Detectors read their snapshots several times. Each is written on its own, so that no plan holds all detectors.
    snaps = stored(spark, sf, "snapshots", lambda: snapshots(spark, sf))
    beating = stored(spark, sf, "beats", lambda: X.spark_table(spark, sf, beats, "conns"))
    new = stored(spark, sf, "new", lambda: S.new_connections(snaps))
    parts = {
        "suspicious": lambda: findings.from_suspicious_outbound(S.suspicious_outbound(new)),
        "smtp": lambda: findings.from_smtp_outbound(S.smtp_outbound(new)),
        "listeners": lambda: findings.from_new_listeners(S.new_listeners(snaps)),
        "beacons": lambda: findings.from_beacons(S.beacons(stored(spark, sf, "beating", lambda: S.new_connections(beating)), S.ticks(beating))),
        "processes": lambda: findings.from_processes(S.process_findings(stored(spark, sf, "processes", lambda: procs(spark, sf)))),
        "files": lambda: findings.from_files(S.fim_diff(*files(spark, sf)), F.lit(AS_OF).cast("timestamp"))}
    return reduce(lambda a, b: a.unionByName(b), [stored(spark, sf, f"monitor {name}", build) for name, build in parts.items()])


def socket_feed(spark, sf):
    found = parse_proc_net_tcp(X.spark_table(spark, sf, X.proc_lines, "lines"))
    return found.select("id", F.lit(AS_OF).cast("timestamp").alias("ts"), "src_ip", "dst_port", F.lit("socket").alias("kind"),
                        F.lit("proc").alias("method"))


def whole_pipeline(spark, sf):
    """The pipeline with all its feeds; the forest scores the entries of the log and of the monitors."""
    rows = stored(spark, sf, "ruled", lambda: FO.with_features(A.apply_rules(entries(spark, sf))))
    found = stored(spark, sf, "ruled monitors", lambda: FO.with_features(A.apply_rules(complete(monitors(spark, sf)))))
    model = FO.retrain(rows.unionByName(found).select("id", "ts", *FO.NAMES))
    rows, found = (rows, found) if model is None else FO.scored_entries([rows, found], model)
    return A.run_pipeline(rows, monitors=(found,), sockets=socket_feed(spark, sf), dns=True, ruled=True)


@check("pipeline_alerts")
def _(spark, sf):
    return whole_pipeline(spark, sf).alerts


@check("pipeline_all")
def _(spark, sf):
    return whole_pipeline(spark, sf).entries.drop("tags")
