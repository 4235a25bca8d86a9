"""Files in, tables out."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from checks import registry
from seclog import storage
from seclog.operators import snapshots as S
from seclog.sources import files, sockets, text as T

AS_OF = "2024-06-01 00:00:00"


def test_syslog_file(spark, tmp_path):
    lines = ["Oct 15 10:30:00 web1 sshd[123]: Failed password for root from 1.2.3.4 port 22 ssh2",
             "Oct  5 01:02:03 h kernel: usb 1-1: new high speed", "", "no timestamp here error",
             "Oct  5 01:02:03 h kernel: usb 1-1: new high speed", "Xyz 99 01:02:03 h app: x"]
    path = tmp_path / "auth.log"
    path.write_bytes("\n".join(lines).encode() + b"\nbad \xff byte")
    rows = T.read_syslog(spark, str(path), 2024, AS_OF).orderBy("raw").collect()
    assert len(rows) == 6 and len({r.id for r in rows}) == 6
    by_raw = {r.raw: r for r in rows}
    first = by_raw[lines[0]]
    assert (first.source, str(first.ts), first.message) == ("auth/sshd", "2024-10-15 10:30:00", lines[0][32:])
    assert (by_raw[lines[3]].source, by_raw[lines[3]].level, str(by_raw[lines[3]].ts)) == ("auth", "ERROR", AS_OF)
    assert str(by_raw[lines[5]].ts) == AS_OF and by_raw[lines[5]].source == "auth/app"
    assert by_raw[lines[1]].source == "auth/kernel"
    again = T.read_syslog(spark, str(path), 2024, AS_OF)
    assert {r.id for r in again.collect()} == {r.id for r in rows}
    assert storage.append_entries(again, spark.createDataFrame(rows, again.schema)).isEmpty()


def test_copies_are_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "COPIES_PER_TASK", 7)
    lines = spark.createDataFrame([("a",)] * 50 + [("b",)], "value string")
    got = sorted((r.value, r.occurrence) for r in T.number_copies(lines, ["value"]).collect())
    assert got == [("a", i) for i in range(1, 51)] + [("b", 1)]


def test_unified_log_file(spark, tmp_path):
    items = [{"messageType": "Fault", "timestamp": "2024-05-01 10:00:00.250000+0000", "process": "p", "subsystem": "s", "eventMessage": "m%d" % i}
             for i in range(7)]
    (tmp_path / "cap.json").write_text(json.dumps(items, indent=1))
    rows = T.read_unified_log(spark, str(tmp_path), AS_OF, max_items=5).collect()
    assert len(rows) == 5 and {(r.source, r.level, str(r.ts)) for r in rows} == {("p/s", "CRITICAL", "2024-05-01 10:00:00.250000")}
    assert T.read_unified_log(spark, str(tmp_path), AS_OF, None).count() == 7


def test_windows_text_file(spark, tmp_path):
    (tmp_path / "sys.txt").write_text(
        "Event[0]:\r\n  Date: 2024-05-01T10:00:00Z\r\n  Level: Error\r\n  Provider: P\r\n  Description: a: b\r\nno colon line\r\n"
        "Event[1]:\r\n  Level: Verbose\r\n  Message: hi\r\n")
    rows = {r.message: r for r in T.read_wevt_text(spark, str(tmp_path), "System", AS_OF).collect()}
    assert set(rows) == {"a: b", "hi"}
    assert (rows["a: b"].source, rows["a: b"].level, str(rows["a: b"].ts)) == ("System/P", "ERROR", "2024-05-01 10:00:00")
    assert (rows["hi"].source, rows["hi"].level, str(rows["hi"].ts)) == ("System/System", "DEBUG", AS_OF)


def test_journald_and_sources(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"PRIORITY":"3","__REALTIME_TIMESTAMP":"1714557600000000","MESSAGE":["a","b"],"_COMM":"c"}\nnot json\n')
    (tmp_path / "auth.log").write_text("Oct 15 10:30:00 w sshd[1]: x\n")
    specs = [T.SourceSpec(str(tmp_path / "j"), "j", True, "journald"), T.SourceSpec(str(tmp_path / "auth.log"), "auth"),
             T.SourceSpec("/nowhere", "off", False)]
    rows = {r.source: r.message for r in T.read_sources(spark, specs, 2024, AS_OF).collect()}
    assert rows == {"c": "a b", "auth/sshd": "x"}
    assert [s.name for s in T.default_sources() if s.enabled] == ["syslog", "auth", "kernel"]


def test_socket_files(spark, tmp_path):
    (tmp_path / "tcp").write_text("  sl  local_address rem_address st\n   0: 0100007F:0016 0471CB00:D431 02 x\n   1: 0100007F:0016 0100007F:D431 02 x\n")
    rows = sockets.read_proc_net_tcp(spark, str(tmp_path / "tcp"), AS_OF).collect()
    assert [(r.src_ip, r.dst_port) for r in rows] == [("0.203.113.4", 22)]
    (tmp_path / "ss").write_text("0 0 x 10.0.0.1:22 [2001:db8::1]:40000\n0 0 x 10.0.0.1:http 1.2.3.4:1\n")
    assert [(r.src_ip, r.dst_port) for r in sockets.read_ss(spark, str(tmp_path / "ss"), AS_OF).collect()] == [("2001:db8::1", 22)]


def test_file_state_and_baseline(spark, tmp_path):
    folder = tmp_path / "etc"
    (folder / "sub").mkdir(parents=True)
    (folder / "a").write_text("one")
    (folder / "b").write_text("two")
    (folder / "sub" / "c").write_text("deep")
    modes = spark.createDataFrame([(str(folder / "a"), 0o600)], "path string, mode int")
    before = files.file_state(spark, [str(folder)], modes)
    assert {(r.path, r.sha256, r.mode) for r in before.collect()} == {
        (str(folder / "a"), hashlib.sha256(b"one").hexdigest(), 0o600),
        (str(folder / "b"), hashlib.sha256(b"two").hexdigest(), 0o644)}
    base = str(tmp_path / "baseline")
    storage.save_baseline(before, base, 1, AS_OF)
    (folder / "a").write_text("changed")
    storage.save_baseline(files.file_state(spark, [str(folder)], modes), base, 2, AS_OF)
    (folder / "b").write_text("changed too")
    newest = storage.load_baseline(spark, base)
    changes = S.fim_diff(newest, files.file_state(spark, [str(folder)], modes)).collect()
    assert [(r.path, r.change) for r in changes] == [(str(folder / "b"), "modified")]


def test_entry_and_alert_tables(spark, sf, tmp_path):
    rows = registry.annotated(spark, sf)
    path = str(tmp_path / "entries")
    storage.write_entries(rows, path)
    stored = storage.log_entries(spark, path)
    assert stored.count() == rows.count()
    assert storage.append_entries(rows, stored).isEmpty()
    pruned = stored.filter("category = 'fim' AND event_date = DATE'2024-01-01'")
    assert "PartitionFilters: [isnotnull(category" in pruned._jdf.queryExecution().executedPlan().toString()
    once = storage.retain(rows, "2024-03-01 00:00:00")
    assert 0 < once.count() < rows.count() and once.exceptAll(storage.retain(once, "2024-03-01 00:00:00")).isEmpty()


def test_checkpoint_folder_is_the_clusters(spark):
    assert storage.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_rule_table_of_any_size_skips_malformed_patterns(spark, sf):
    from seclog import refdata as R
    from seclog.operators.annotate import match_rules_table

    rows = registry.entries(spark, sf)
    rules = [(i, r.name, r.pattern, r.severity) for i, r in enumerate(R.RULES)]
    schema = "ord int, name string, pattern string, severity string"
    plain = match_rules_table(rows, spark.createDataFrame(rules, schema))
    cut = match_rules_table(rows, spark.createDataFrame(rules + [(99, "broken", "a(", "info")], schema), per_expression=4)
    assert cut.count() == plain.count() > 0 and cut.exceptAll(plain).isEmpty()


def test_ids_do_not_depend_on_the_reader(spark, tmp_path):
    """Another fallback time, another host's file, long lines, and the stream's way of reading."""
    from seclog.streaming.pipeline import syslog_entries

    long = "x" * 2000
    for host in ("h1", "h2"):
        (tmp_path / host).mkdir()
        (tmp_path / host / "auth.log").write_text("\n".join(["no date line", "no date line", long + "a", long + "b"]))
    path = str(tmp_path / "*")
    first = T.read_syslog(spark, path, 2024, AS_OF, "auth").collect()
    assert len({r.id for r in first}) == len(first) == 8 and {len(r.raw) for r in first} == {12, 2001}
    later = T.read_syslog(spark, path, 2024, "2025-01-01 00:00:00", "auth")
    assert {r.id for r in later.collect()} == {r.id for r in first}
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    assert {r.id for r in syslog_entries(lines, 2024, AS_OF, "auth").collect()} == {r.id for r in first}
    (tmp_path / "j.json").write_text("".join('{"__REALTIME_TIMESTAMP":"1714557600000000","MESSAGE":"%s%d"}\n' % (long, i) for i in range(3)))
    rows = T.read_journald(spark, str(tmp_path / "j.json"), AS_OF).collect()
    assert len({r.id for r in rows}) == 3 and all(len(r.message) == 2001 for r in rows)


def test_captures_keep_their_own_time(spark, tmp_path):
    import os

    from seclog.operators import scans

    for i in range(14):
        path = tmp_path / ("cap%02d" % i)
        path.write_text("0 0 x 10.0.0.1:%d 203.0.113.7:40000\n0 0 x 10.0.0.1:%d 203.0.113.7:40001\n" % (1000 + i, 1000 + i))
        os.utime(path, (1_700_000_000 + 600 * i,) * 2)
    rows = sockets.read_ss(spark, str(tmp_path))
    assert len({r.id for r in rows.collect()}) == 28 and rows.select("ts").distinct().count() == 14
    assert scans.port_scans(rows).isEmpty()
    assert scans.port_scans(sockets.read_ss(spark, str(tmp_path), AS_OF)).count() == 1


def test_retention_keeps_what_has_no_level_or_time(spark):
    rows = spark.createDataFrame([(None, "2020-01-01 00:00:00"), ("INFO", None), ("INFO", "2020-01-01 00:00:00")], "level string, ts string")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    assert storage.retain(rows, "2024-01-01 00:00:00").count() == 2
    alerts = spark.createDataFrame([(None, "2020-01-01 00:00:00"), (True, None), (True, "2020-01-01 00:00:00")], "acknowledged boolean, ts string")
    assert storage.retain_alerts(alerts.withColumn("ts", F.col("ts").cast("timestamp")), "2024-01-01 00:00:00").count() == 2


def test_null_fields_take_their_defaults(spark):
    from seclog.operators.annotate import apply_rules
    from seclog.operators.rates import source_rate
    from seclog.schema import complete

    rows = spark.createDataFrame([("1", "Failed password for root", None, None)], "id string, message string, raw string, source string")
    rows = complete(rows.withColumn("ts", F.lit(AS_OF).cast("timestamp")))
    assert apply_rules(rows).first().matched_rules
    assert source_rate(rows).first().source_rate == 1
