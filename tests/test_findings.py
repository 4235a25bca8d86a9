"""Entries of findings lose nothing of their texts."""

from pyspark.sql import functions as F

from seclog import storage
from seclog.operators import alerts as AL, annotate as A, findings, snapshots as S


def test_a_long_command_line_is_whole_in_its_entry(spark):
    head = "xmrig --config " + "a" * 150
    rows = [("2024-01-01 00:00:00", 7, "xmrig", "u", cmd, "bad_process", "Malware Indicator", "CRITICAL", "", "", 1.0)
            for cmd in (head + " ; rm -f /var/log/auth.log", head + " ; sleep 5")]
    found = spark.createDataFrame(rows, "at string, pid int, name string, username string, cmdline string, finding string, rule string, level string, "
                                        "exe string, parent_name string, cpu double").selectExpr("*", "CAST(at AS TIMESTAMP) AS snapshot_ts")
    made = findings.from_processes(found)
    entries = {r.raw.rsplit(" ; ")[-1]: r for r in A.apply_rules(made).collect()}
    assert set(entries) == {"rm -f /var/log/auth.log", "sleep 5"}
    # Commands that differ after character 120 are two entries, and rules see the end of the text.
    assert len({r.id for r in entries.values()}) == 2
    assert entries["rm -f /var/log/auth.log"].matched_rules != entries["sleep 5"].matched_rules
    assert all(r.message.endswith("cmd: " + head[:120]) for r in entries.values())


CONNS = ("host string, at string, laddr_ip string, laddr_port int, raddr_ip string, raddr_port int, pid int, status string, type string, proc_name string")


def connections(spark, rows):
    return spark.createDataFrame(rows, CONNS).selectExpr("*", "CAST(at AS TIMESTAMP) AS snapshot_ts").drop("at")


def test_findings_of_hosts_ports_and_processes_are_entries_of_their_own(spark):
    first, then = "2024-01-01 00:00:00", "2024-01-01 00:00:15"
    rows = [(h, first, "10.0.0.1", 1, "10.0.0.2", 2, 1, "ESTABLISHED", "TCP", "idle") for h in ("web1", "web2")]
    rows += [(h, then, "10.0.0.1", port, "203.0.113.5", 4444, pid, "ESTABLISHED", "TCP", "nc")
             for h in ("web1", "web2") for port, pid in ((40000, 7), (40001, 7), (40000, 8))]
    rows += [(h, then, None, 80, None, None, 9, "LISTEN", "TCP", "nginx") for h in ("web1", "web2")]
    snaps = connections(spark, rows)
    odd = findings.from_suspicious_outbound(S.suspicious_outbound(S.new_connections(snaps)))
    ports = findings.from_new_listeners(S.new_listeners(snaps))
    for found, n in ((odd, 6), (ports, 2)):
        got = found.collect()
        assert len(got) == len({r.id for r in got}) == n
        assert {r.source for r in got} == {"network-monitor@web1", "network-monitor@web2"}
        assert all(r.tags[-1] == "host:" + r.source.split("@")[1] for r in got)
        assert storage.append_entries(found, found.limit(0)).count() == n
        assert storage.append_entries(found, found).count() == 0
    # One host does not silence the other: an alert of each.
    assert AL.alerts_from(odd).groupBy("source").count().count() == 2


def test_files_are_compared_host_by_host(spark):
    old = spark.createDataFrame([("a", "/etc/passwd", "x", 1, 420), ("b", "/etc/passwd", "y", 1, 420)], "host string, path string, sha256 string, size long, mode int")
    new = spark.createDataFrame([("a", "/etc/passwd", "y", 1, 420), ("b", "/etc/passwd", "x", 1, 420)], old.schema)
    found = findings.from_files(S.fim_diff(old, new), F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted(r.source for r in found) == ["fim/passwd@a", "fim/passwd@b"] and len({r.id for r in found}) == 2
    assert S.fim_diff(old, old).count() == 0
