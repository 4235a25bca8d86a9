"""Entries to sinks: one pass, batches by size and by time."""

import json
import time

import pytest
from pyspark.sql import functions as F

from checks import registry
from seclog.operators import annotate as A
from seclog.schema import complete
from seclog.streaming import monitors as M, routing


def entries(spark, n, first=0):
    return complete(spark.range(first, first + n).selectExpr(
        "cast(id AS string) AS id", "timestamp_micros(1704067200000000 + id) AS ts", "'x' AS message",
        "element_at(array('log','log','network','portscan','fim'), cast(id % 5 + 1 AS int)) AS category"))


def test_each_channel_reaches_its_sink(spark, sf):
    rows = registry.entries(spark, sf)
    got = {}
    counts = A.route(rows, {name: lambda df, name=name: got.__setitem__(name, sorted(r.id for r in df.collect())) for name in ("log", "network", "fim")})
    want = A.with_channel(complete(rows)).select("id", "channel").collect()
    for name, ids in got.items():
        assert ids == sorted(r.id for r in want if r.channel == name) and counts[name] == len(ids)


@pytest.fixture
def stores(spark):
    """Two state stores, kept by RocksDB."""
    old = {name: spark.conf.get(name) for name in (M._PROVIDER, "spark.sql.shuffle.partitions")}
    M.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def test_batches_leave_by_size_and_by_time(spark, stores, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        entries(spark, 110, first=part * 110).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(entries(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    sent = {"log": [], "network": [], "fim": []}
    sinks = {name: lambda df, batch_id, name=name: sent[name].extend(tuple(r) for r in df.collect()) for name in sent}
    query = routing.start_route(stream, sinks, str(tmp_path / "cp"), wait_ms=1000)
    deadline = time.time() + 60
    while sum(r[3] for rows in sent.values() for r in rows) < 330 and time.time() < deadline:
        time.sleep(0.3)
    query.stop()
    want = {"log": 132, "network": 132, "fim": 66}
    for name, rows in sent.items():
        events = [json.loads(e) for r in rows for e in r[4]]
        assert len(events) == want[name] == len({e["id"] for e in events}) and all(r[3] == len(r[4]) <= 40 for r in rows)
        assert all(r[3] == 40 for r in rows if r[2] == "size")
    reasons = [r[2] for rows in sent.values() for r in rows]
    assert reasons.count("size") >= 6 and reasons.count("time") >= 1


def test_lanes_share_a_channel(spark, stores, tmp_path):
    folder = str(tmp_path / "in")
    entries(spark, 1000).filter("category = 'log'").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(entries(spark, 1).schema).parquet(folder)
    query = (routing.batches(stream, most=10, lanes=4).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="250 milliseconds").start())
    deadline = time.time() + 60
    while query.isActive and time.time() < deadline and not any(p["numInputRows"] for p in query.recentProgress):
        time.sleep(0.3)
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("lane").distinct().count() == 4 and got.agg(F.sum("n")).first()[0] >= 360
    assert all(r.events == sorted(r.events, key=lambda e: json.loads(e)["timestamp"]) for r in got.collect())
