"""what the whole pipeline does once for each row, it does once and in bulk."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from checks import detect, registry
from seclog import refdata as R
from seclog.functions import dns as D
from seclog.operators import annotate as A, forest as FO, scans
from seclog.schema import complete


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["Failed password for root from 203.0.113.9 port 22", "all well", "query[A] aaa.example.org from 10.0.0.4", "wget http://x.y/z", "disk error"]
    raw = spark.range(400).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("id"), F.timestamp_seconds(1704067200 + F.col("id") * 37).alias("ts"),
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"),
        F.concat(F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 5 + 1).cast("int")), F.repeat(F.lit("x"), (F.col("id") % 11).cast("int"))).alias("message"))
    return complete(raw.withColumns({"raw": F.col("message"), "level": F.when(F.col("id") < "000020", "ERROR").otherwise("INFO")})).localCheckpoint()


def scored_by_hand(point, nodes, sample):
    depth = 0.0
    for _, tree in nodes.groupby("tree_id"):
        at = 0
        while tree.feature.iloc[at] >= 0:
            at = tree.left_node.iloc[at] if point[tree.feature.iloc[at]] <= tree.threshold.iloc[at] else tree.right_node.iloc[at]
        depth += tree.path_length.iloc[at]
    return -(2.0 ** (-(depth / nodes.tree_id.nunique()) / float(FO.average_path(sample))))


def test_equal_vectors_are_scored_once(spark, rows):
    model = FO.retrain(FO.feature_rows(rows), least=10, trees=6, sample=64)
    nodes = FO.forest_nodes(model.forest)
    points = FO.feature_rows(rows).select(*FO.NAMES).toPandas().to_numpy()[:40]
    points[3, 1] = np.nan
    many = np.concatenate([points, points[::-1]])
    got = FO._raw_scores(many, FO._trees(nodes), float(FO.average_path(64)))
    assert np.allclose(got, [scored_by_hand(p, nodes, 64) for p in many], rtol=1e-12, atol=0)


def test_trees_are_chosen_without_an_array_for_each_row(spark, rows):
    training = FO.feature_rows(rows).localCheckpoint()
    assert "lambda" not in optimized(FO.fit_forest(training, 5, 16))
    h = F.pmod(F.xxhash64("id", "tree_id", F.lit(R.FOREST_SEED)), F.lit(1 << 40))
    plain = (training.crossJoin(spark.range(5).select(F.col("id").cast("int").alias("tree_id"))).withColumn("_h", h)
             .withColumn("_rn", F.row_number().over(W.partitionBy("tree_id").orderBy("_h", "id"))).filter("_rn <= 16").drop("_h", "_rn", "ts")
             .groupBy("tree_id").applyInPandas(FO._grow(R.FOREST_SEED), FO.NODE_DDL))
    assert sorted(FO.fit_forest(training, 5, 16).collect()) == sorted(plain.collect())


def test_scores_travel_with_their_rows(spark, rows):
    """No join by id; a row without an id has no score, and the scores are those of the table of scores."""
    entries = rows.unionByName(rows.filter("id < '000003'").withColumn("id", F.lit(None).cast("string")))
    features = FO.feature_rows(entries)
    model = FO.retrain(features, least=10, trees=6)
    apart = A.annotate(entries, forest=FO.forest_scores(model.training, model.forest, model.training, model.sample))
    tables = [FO.with_features(entries.filter(c)) for c in ("coalesce(id, '') < '000200'", "id >= '000200'")]
    first, second = FO.scored_entries(tables, model)
    together = A.annotate(complete(first, "forest_anomaly", "forest_score").unionByName(complete(second, "forest_anomaly", "forest_score")))
    assert optimized(together).count("Join") == 1 and optimized(apart).count("Join") == 2
    assert together.columns == apart.columns and together.count() == 403
    assert together.exceptAll(apart).isEmpty() and apart.exceptAll(together).isEmpty()
    assert together.filter("is_anomaly").count() > 0


def test_alerts_are_made_when_asked_for(spark, rows, monkeypatch):
    calls, make = [], A.A.alerts_from
    monkeypatch.setattr(A.A, "alerts_from", lambda entries: calls.append(1) or make(entries))
    result = A.run_pipeline(rows)
    assert result.entries.count() >= 400 and not calls
    assert result.alerts.count() > 0 and result.alerts is result.alerts and calls == [1]
    # What passes is stored, so its size is known when the candidates meet it.
    assert "MapInPandas" not in optimized(result.alerts)


def test_texts_without_any_piece_go_first(spark):
    texts = ["query[A] a.example.org from 10.0.0.4", "all well", "", None, "NXDOMAIN for h7.badhost.bit", "REſOLVED a.b.example to 1.2.3.4", "query about nothing"]
    seen = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = D.with_query(seen, F.col("text"))
    assert sorted((r.id, r.domain) for r in found.select("id", "domain").collect()) == [
        (0, "a.example.org"), (4, "h7.badhost.bit"), (5, "a.b.example")]
    assert [line for line in optimized(found).splitlines() if "Filter" in line and "Contains" in line]
    lines = ["Failed password for x from 203.0.113.9 port 22", "SRC=10.1.1.1 x DPT=80", "all well", None, "from nowhere"]
    entries = spark.createDataFrame([(str(i), None, t, "") for i, t in enumerate(lines)], "id string, ts timestamp, message string, raw string")
    attempts = scans.log_attempts(entries)
    assert sorted((r.id, r.src_ip, r.dst_port) for r in attempts.select("id", "src_ip", "dst_port").distinct().collect()) == [
        ("0", "203.0.113.9", 22), ("1", "10.1.1.1", 80)]
    assert [line for line in optimized(attempts).splitlines() if "Filter" in line and "Contains" in line]


def test_monitors_read_stored_snapshots(spark, tmp_path, monkeypatch):
    sf = str(tmp_path)
    spark.range(300).select(F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") * 8640).cast("timestamp_ntz").alias("ts"),
                            (F.col("id") % 50).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"),
                            F.concat(F.lit('{"k": '), (F.col("id") % 100).cast("string"), F.lit("}")).alias("props")).write.parquet(sf + "/events.parquet")
    spark.createDataFrame([(1, "text", "en", "web", 4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(sf + "/documents.parquet")
    spark.createDataFrame([(1, "text")], "item_id long, text string").write.parquet(sf + "/benchmark.parquet")
    monkeypatch.setattr(registry, "_STORED", {})
    plans, new, family = [], detect.S.new_connections, detect.S.process_findings
    monkeypatch.setattr(detect.S, "new_connections", lambda snaps: plans.append(optimized(snaps)) or new(snaps))
    monkeypatch.setattr(detect.S, "process_findings", lambda procs: plans.append(optimized(procs)) or family(procs))
    assert detect.monitors(spark, sf).count() > 0
    assert len(plans) == 3 and not [p for p in plans if "get_json_object" in p]
