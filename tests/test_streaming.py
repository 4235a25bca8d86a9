"""Streams fed in time order give what the batch operators give."""

import os

from pyspark.sql import functions as F

from checks import registry
from seclog.operators.annotate import run_pipeline
from seclog.operators.cooldown import cooldown
from seclog.streaming.cooldown import cooldown_stream
from seclog.streaming.pipeline import EntryStream, start_tail, tail_text

PARTS = 3


def write_in_order(rows, folder):
    """One file per time slice, written one after the other."""
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / PARTS
    for i in range(PARTS):
        upper = low + step * (i + 1) if i < PARTS - 1 else None
        part = rows.filter(F.col("ts") >= low + step * i)
        part = part.filter(F.col("ts") < upper) if upper is not None else part
        part.coalesce(1).write.mode("append").parquet(folder)


def test_cooldown_stream_equals_batch(spark, sf, tmp_path):
    rows = registry.entries(spark, sf).select("id", "ts", "source")
    folder = str(tmp_path / "in")
    write_in_order(rows, folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    query = (cooldown_stream(stream, ["source"], 120).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r.id for r in spark.read.parquet(out).collect()}
    assert got == {r.id for r in cooldown(rows, ["source"], 120).collect()}


def test_pipeline_stream_equals_batch(spark, sf, tmp_path):
    rows = registry.entries(spark, sf)
    folder = str(tmp_path / "in")
    write_in_order(rows, folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    target = EntryStream(spark, str(tmp_path / "state"), out)
    target.start(stream, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    batch = run_pipeline(rows)
    columns = ["source", "ts", "level", "message", "is_anomaly", "anomaly_score", "mitre_technique_id", "channel"]
    got = spark.read.parquet(out + "/entries").select(columns)
    want = batch.entries.select(columns)
    assert got.count() == want.count()
    assert got.exceptAll(want).isEmpty()
    columns = ["rule_name", "source", "ts", "level", "message", "log_id"]
    got, want = spark.read.parquet(out + "/alerts").select(columns), batch.alerts.select(columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_batch_can_be_repeated(spark, sf, tmp_path):
    rows = registry.entries(spark, sf)
    target = EntryStream(spark, str(tmp_path / "state"), str(tmp_path / "out"))
    target.process(rows, 0)
    first = {r.alert_id for r in spark.read.parquet(str(tmp_path / "out/alerts")).collect()}
    target.process(rows, 0)
    assert {r.alert_id for r in spark.read.parquet(str(tmp_path / "out/alerts")).collect()} == first


def test_tail(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    line = "Jan  1 00:00:%02d web1 sshd[1]: Failed password for root from 203.0.113.9 port %d ssh2"
    for part in range(2):
        lines = [line % (part * 20 + i, 1000 + part * 20 + i) for i in range(20)] + ["", "no date here"]
        target = folder / ("seg%d.log" % part)
        target.write_text("\n".join(lines))
        os.utime(target, (1_700_000_000 + part, 1_700_000_000 + part))
    out = str(tmp_path / "out")
    stream = EntryStream(spark, str(tmp_path / "state"), out)
    start_tail(tail_text(spark, str(folder), max_files=1), stream, 2024, "2024-01-01 00:01:00", "auth",
               str(tmp_path / "cp"), availableNow=True).awaitTermination()
    entries = spark.read.parquet(out + "/entries")
    assert entries.filter("source = 'auth/sshd'").count() == 40
    assert entries.filter("category = 'portscan'").count() == 1
    alerts = {r.rule_name for r in spark.read.parquet(out + "/alerts").collect()}
    assert {"SSH Brute Force", "Failed Login", "Port Scan Detected"} <= alerts


def test_all_feeds_of_the_stream_equal_the_batch(spark, sf, tmp_path):
    """Forest scores of a published model, DNS findings, socket attempts and monitors' entries."""
    from checks.detect import monitors, socket_feed
    from seclog.operators import annotate as A, forest as FO
    from seclog.schema import complete

    rows, found, sockets = registry.entries(spark, sf), monitors(spark, sf), socket_feed(spark, sf)
    everything = complete(rows).unionByName(found).dropDuplicates(["id"])
    features = FO.feature_rows(A.apply_rules(everything))
    model = FO.retrain(features)
    scores = FO.forest_scores(features, model.forest, model.training, model.sample)
    FO.publish_forest(model, str(tmp_path / "models"), 3, "2024-01-01")
    batch = run_pipeline(rows, forest=scores, monitors=(found,), sockets=sockets, dns=True)

    write_in_order(everything, str(tmp_path / "in"))
    stream = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in (*[sockets.limit(0)] * (PARTS - 1), sockets):  # their instant is the last
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "sockets"))
    attempts = spark.readStream.schema(sockets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "sockets"))
    target = EntryStream(spark, str(tmp_path / "state"), str(tmp_path / "out"), monitors=True, dns=True, forest=str(tmp_path / "models"))
    target.start(stream, str(tmp_path / "cp"), sockets=attempts, availableNow=True).awaitTermination()

    columns = ["source", "ts", "level", "message", "is_anomaly", "anomaly_score", "mitre_technique_id", "channel"]
    got, want = spark.read.parquet(str(tmp_path / "out/entries")).select(columns), batch.entries.dropDuplicates(["id"]).select(columns)
    assert want.filter("source = 'dns-monitor'").count() > 0 and want.filter("anomaly_score > 0.3 and not is_anomaly").count() > 0
    assert got.exceptAll(want).collect() == [] and got.count() == want.count()


def test_models_are_swapped_between_batches(spark, sf, tmp_path):
    from seclog.operators import forest as FO

    rows = registry.entries(spark, sf)
    model, path = FO.retrain(FO.feature_rows(rows)), str(tmp_path / "models")
    target = EntryStream(spark, str(tmp_path / "state"), str(tmp_path / "out"), forest=path)
    assert FO.newest_forest(spark, path) is None and target._model(0) is None
    FO.publish_forest(model, path, 0, "2024-01-01", threshold=-2.0)
    assert target._model(0) is None  # a repeated batch keeps its choice
    assert target._model(1) == 0
    FO.publish_forest(model, path, 1, "2024-01-02", threshold=0.0)
    assert target._model(1) == 0 and target._model(2) == 1
    some = rows.limit(20)
    for batch_id, flagged in ((0, 0), (1, 0), (2, 20)):
        target.process(some, batch_id)
        got = spark.read.parquet(str(tmp_path / f"out/entries/batch={batch_id}"))
        assert got.filter("source NOT LIKE 'portscan%' AND source NOT LIKE 'correlation%' AND is_anomaly").count() >= flagged
    assert not spark.read.parquet(str(tmp_path / "out/entries/batch=1")).filter("is_anomaly AND anomaly_score < 0.9 AND category = 'log'").count()


def test_repeats_across_batches_vanish(spark, sf, tmp_path):
    rows = registry.entries(spark, sf)
    folder = str(tmp_path / "in")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    target = EntryStream(spark, str(tmp_path / "state"), str(tmp_path / "out"))
    target.start(stream, str(tmp_path / "cp"), once=True, availableNow=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/entries"))
    assert got.filter("source NOT LIKE 'portscan%' AND source NOT LIKE 'correlation%'").count() == rows.select("id").distinct().count()
    plan = got.filter("event_date = DATE'2024-01-01' AND category = 'log'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
