"""Monitors on streams of snapshots, cut anywhere, give what the batch operators give."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from seclog.operators import snapshots as S
from seclog.operators.annotate import run_pipeline
from seclog.streaming import monitors as M
from seclog.streaming.pipeline import EntryStream

START = datetime.datetime(2024, 1, 1)
CONNS = ("host string, snapshot_ts timestamp, laddr_ip string, laddr_port int, raddr_ip string, raddr_port int, pid int, status string, "
         "type string, proc_name string")
PROCS = "host string, snapshot_ts timestamp, pid int, ppid int, name string, exe string, cmdline array<string>, username string, cpu double"
FILES = "host string, snapshot_ts timestamp, path string, sha256 string, size bigint, mode int"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    old = {name: spark.conf.get(name) for name in (M._PROVIDER, "spark.sql.shuffle.partitions")}
    M.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store each
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def instants(rng, n):
    at = START
    for _ in range(n):
        at += datetime.timedelta(seconds=rng.choice([15, 15, 15, 40, 200]), microseconds=rng.choice([0, 1, 999]))
        yield at


def conns(rng, ticks=12):
    rows = []
    for host in ("web1", "web2", "db", None):
        for at in instants(rng, ticks):
            for port in range(40000, 40014):
                if rng.random() < 0.45:
                    pid = rng.choice([7, 7, None])
                    remote = ["203.0.113.5", "10.0.0.9", "198.51.100.2"][port % 3]
                    row = (host, at, rng.choice(["10.0.0.1"] * 9 + [None]), port, remote, [4444, 443, 587, 80][port % 4], pid, "ESTABLISHED", "TCP", rng.choice(["nc", None]))
                    rows += [row] * rng.choice([1, 1, 2])
            for port in (22, 80, 443, 8080):
                if rng.random() < 0.15:
                    rows.append((host, at, "0.0.0.0", port, None, None, rng.choice([1, 2, None]), rng.choice(["LISTEN", "LISTEN", "NONE"]), "TCP", rng.choice(["sshd", "nginx", "sshd", "", None])))
            rows.append((host, at, None, None, None, None, None, None, None, None))
    return rows


def streamed(spark, rows, schema, folder, make, parts=3, slack=50, rng=random.Random(0)):
    """``make`` of a stream that gets the rows in files cut anywhere, slightly out of order."""
    rows = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, slack / 2))
    marks = sorted(rng.sample(range(1, len(rows)), parts - 1))
    (folder / "in").mkdir(parents=True)
    last = max(r[1] for r in rows)
    hosts = {r[0] for r in rows}
    closing = [(h, last + datetime.timedelta(hours=1 + i), *[None] * (len(rows[0]) - 2)) for i in (0, 1) for h in hosts]
    for a, b in [*zip([0, *marks], [*marks, len(rows)])]:
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    for i in (0, 1):
        spark.createDataFrame(closing[i * len(hosts):(i + 1) * len(hosts)], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = (make(stream).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(str(folder / "out")).filter(F.col("snapshot_ts") <= F.lit(last))


def same(got, want, columns):
    got, want = (sorted(str(tuple(r)) for r in x.select(columns).collect()) for x in (got, want))
    assert got == want
    return len(got)


def batch(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("host", F.coalesce("host", F.lit("")))


def test_connections_and_listeners(spark, tmp_path):
    rows = conns(random.Random(4))
    table = batch(spark, rows, CONNS)
    got = streamed(spark, rows, CONNS, tmp_path / "new", lambda s: M.new_connections_stream(s, buckets=2))
    assert same(got, S.new_connections(table), table.columns) > 100
    got = streamed(spark, rows, CONNS, tmp_path / "ports", lambda s: M.new_listeners_stream(s, buckets=2))
    assert same(got, S.new_listeners(table), ["host", "laddr_port", "snapshot_ts", "proc_name"]) > 2


def test_one_host_without_its_name(spark, tmp_path):
    rows = [r for r in conns(random.Random(5), ticks=12) if r[0] == "db"]
    table = batch(spark, rows, CONNS).drop("host")
    got = streamed(spark, rows, CONNS, tmp_path, lambda s: M.new_connections_stream(s.drop("host"), buckets=3))
    assert same(got, S.new_connections(table), table.columns) > 20


def test_processes(spark, tmp_path):
    rng = random.Random(6)
    names = ["nginx", "sh", "bash", "xmrig", "init", "python", "apache2", "nc"]
    rows = []
    for host in ("a", "b"):
        for at in instants(rng, 10):
            for pid in range(1, 40):
                if rng.random() < 0.6:
                    rows.append((host, at, pid, pid // 2, rng.choice(names).upper() if pid % 9 == 0 else names[pid % 8], rng.choice(["/usr/bin/x", "/tmp/x", None]),
                                 rng.choice([["x", "y"], None]), "u", rng.choice([1.0, 95.0, None])))
    table = S.process_findings(S.processes(batch(spark, rows, PROCS)))
    got = streamed(spark, rows, PROCS, tmp_path, lambda s: M.process_findings_stream(S.processes(s)))
    assert same(got, table, table.columns) > 20


def test_files(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for host in ("a", "b"):
        state = {f"/etc/f{i}": ["h0", 10, 420] for i in range(30)}
        for at in instants(rng, 12):
            for path in list(state):
                dice = rng.random()
                if dice < 0.05:
                    del state[path]
                elif dice < 0.1:
                    state[path][0] = "h%d" % rng.randint(0, 3)
                elif dice < 0.15:
                    state[path][2] = rng.choice([420, 511])
            state.setdefault(f"/etc/f{rng.randint(0, 40)}", ["h9", None, 420])
            rows += [(host, at, p, *v) for p, v in state.items()]
    table = S.file_changes(batch(spark, rows, FILES))
    got = streamed(spark, rows, FILES, tmp_path, lambda s: M.file_changes_stream(s, buckets=2))
    assert same(got, table, table.columns) > 20
    assert {r.change for r in table.select("change").distinct().collect()} == {"modified", "deleted", "permission_changed"}


def test_entries_of_monitors_pass_the_pipeline(spark, tmp_path):
    rows = conns(random.Random(8), ticks=10)
    out = str(tmp_path / "out")
    target = EntryStream(spark, str(tmp_path / "state"), out, monitors=True)

    def run(stream):
        feed = M.monitor_entries(conns=stream, buckets=2)
        whole = feed[0]
        for df in feed[1:]:
            whole = whole.unionByName(df)
        return whole

    got = streamed(spark, rows, CONNS, tmp_path / "feed", lambda s: run(s).withColumn("snapshot_ts", F.col("ts")))
    entries = got.drop("snapshot_ts")
    assert entries.count() == entries.select("id").distinct().count() > 10
    target.process(entries, 0)
    want = run_pipeline(entries.limit(0), monitors=(entries,))
    columns = ["id", "source", "level", "message", "anomaly_score", "mitre_technique_id", "channel"]
    assert same(spark.read.parquet(out + "/entries"), want.entries, columns) > 10
    assert same(spark.read.parquet(out + "/alerts"), want.alerts, ["rule_name", "source", "level", "message", "log_id"]) > 2
