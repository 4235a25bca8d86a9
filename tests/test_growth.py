"""Work stays in proportion: rules run once a row, and on all cores however a file is cut."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks import fixtures as X
from seclog import refdata as R
from seclog.functions.technique import from_text
from seclog.functions.text import folded, parse_level
from seclog.operators import annotate as A, forest as FO, rates
from seclog.schema import complete
from seclog.sources.sockets import parse_proc_net_tcp


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("per_expression", [200, 1])
def test_rules_are_not_run_again_in_a_filter(spark, per_expression):
    raw = spark.createDataFrame([("a", "Failed password for root"), ("b", "all well"), ("c", None)], "id string, text string")
    rows = raw.select("id", F.concat("text", F.lit(" ssh")).alias("message"), F.col("text").alias("raw"))
    rules = spark.createDataFrame([(i, r.name, r.pattern, r.severity) for i, r in enumerate(R.RULES)],
                                  "ord int, name string, pattern string, severity string")
    out = A.match_rules_table(rows, rules, per_expression)
    assert [tuple(r) for r in out.collect()] == [("a", ["SSH Brute Force", "Failed Login"])]
    assert not [line for line in optimized(out).splitlines() if "Filter" in line and ("RLIKE" in line or "regexp_like" in line)]


def test_few_row_groups_do_not_leave_cores_idle(spark, tmp_path):
    n = 40_000
    table = pa.table({"event_id": list(range(n)), "ts": list(range(n)), "k": [i * 7919 % 104729 for i in range(n)]})
    path = str(tmp_path / "events.parquet")
    pq.write_table(table, path, row_group_size=n, compression="none", use_dictionary=False)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in old:
        spark.conf.set(key, "32k")
    try:
        raw = spark.read.parquet(path)
        assert raw.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # all rows are in one of them
        sizes = [r["count"] for r in X.spread(raw).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert sum(sizes) == n and max(sizes) < n / spark.sparkContext.defaultParallelism


def test_filters_stay_above_the_dealing_and_columns_below(spark):
    raw = spark.range(100).select(F.col("id").alias("event_id"), F.col("id").alias("ts"), F.col("id").cast("string").alias("text"),
                                  F.lit("x").alias("unused")).repartition(2)
    plan = optimized(X.spread(raw).filter(F.col("text").rlike("9")).select("event_id"))
    assert plan.index("RLIKE") < plan.index("RepartitionByExpression")
    assert "unused" not in plan


def test_one_frequent_key_is_dealt_out(spark):
    raw = spark.range(8_000).select(F.lit(1).alias("event_id"), F.col("id").alias("ts")).repartition(2)
    sizes = [r["count"] for r in X.spread(raw).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8_000 and max(sizes) < 2_000


def test_shorter_text_work_gives_the_same(spark):
    texts = ["FAİLED", "ſUDO K", "plain ASCII", "", None, "ERRor 1", "Ünknown DEBUG", "Fatal warn", "rm x.log", "su - root"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    old_fold = F.lower(F.translate(a, "İıſK", "iisk"))
    level = F
    for name, words in R.LEVEL_WORDS:
        level = level.when(F.lower(a).rlike("|".join(words)), name)
    checks = rows.select(folded(a).eqNullSafe(old_fold).alias("fold"), parse_level(a).eqNullSafe(level.otherwise("INFO")).alias("level"))
    assert checks.filter("not (fold and level)").isEmpty()
    # A technique of two texts is the same in either order, whether or not they are equal.
    assert rows.filter("a = b or a is null or b is null").filter(
        ~from_text(a, b)["technique_id"].eqNullSafe(from_text(b, a)["technique_id"])).isEmpty()


MESSAGES = ["Failed password for root from 203.0.113.7 port 22 ssh2", "query[A] a.example.org from 10.0.0.9", "wget http://198.51.100.7/a.sh",
            "NXDOMAIN for h1.badhost.bit", "session opened for user root", "all well", "NXDOMAIN for h1.badhost.bit"]


def some_entries(spark):
    rows = [("e%03d" % i, "s%d" % (i % 3), MESSAGES[i % len(MESSAGES)], i // 4) for i in range(140)]
    raw = spark.createDataFrame(rows, "id string, source string, message string, t int")
    return complete(raw.select("id", "source", "message", F.col("message").alias("raw"), F.timestamp_seconds(F.col("t") + 1704067200).alias("ts")))


def test_rows_meet_stored_anomalous_instants(spark):
    """the few anomalous instants are known before the rows are joined, which then stay where they are."""
    plan = optimized(rates.rate_anomaly(some_entries(spark)))
    assert "Window" not in plan and plan.count("Join") == 1


def test_the_pipeline_searches_texts_once(spark, monkeypatch):
    """DNS texts are searched once for three readers; ruled entries are not ruled again."""
    rows, seen, findings = some_entries(spark), [], A.D.dns_findings
    monkeypatch.setattr(A.D, "dns_findings", lambda queries: seen.append(optimized(queries)) or findings(queries))
    plain = A.run_pipeline(rows, dns=True)
    assert seen and "regexp" not in seen[0].lower() and "Generate" not in seen[0]
    ruled = A.apply_rules(rows)
    monkeypatch.setattr(A, "apply_rules", None)
    again = A.run_pipeline(ruled, dns=True, ruled=True)
    assert plain.entries.count() > 140
    for one, other in ((plain.entries, again.entries), (plain.alerts.drop("alert_id"), again.alerts.drop("alert_id"))):
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_training_rows_are_scored_once(spark, monkeypatch):
    """one pass gives the cut and the scores of rows that are the training rows."""
    features, calls, score = FO.feature_rows(some_entries(spark)), [], FO.score_forest
    model = FO.retrain(features, least=10, trees=5)
    apart = FO.forest_scores(features, model.forest, model.training, model.sample).collect()
    monkeypatch.setattr(FO, "score_forest", lambda *a: calls.append(1) or score(*a))
    once = FO.forest_scores(model.training, model.forest, model.training, model.sample).collect()
    assert len(calls) == 1 and sorted(once) == sorted(apart)


def test_socket_lines_are_split_once(spark):
    """filters on the parts of a line are not copied below the split."""
    lines = spark.createDataFrame([("a", " 1: 0100007F:01BB 070100CB:D431 02 0:0"), ("b", "sl local_address rem_address"), ("c", None), ("d", "")],
                                  "id string, value string")
    out = parse_proc_net_tcp(lines.withColumn("value", F.concat("value", F.lit(" "))))
    assert [(r.id, r.src_ip, r.dst_port) for r in out.collect()] == [("a", "203.0.1.7", 443)]
    assert not [line for line in optimized(out).splitlines() if "Filter" in line and "split(" in line and "trim" in line]
