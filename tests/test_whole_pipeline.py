"""The registered pipeline holds what every feed brings."""

import __spark_entry__ as entry_point
from pyspark.sql import functions as F


def test_all_feeds_reach_the_registered_pipeline(spark, sf):
    from checks import detect, registry
    from seclog.operators import annotate as A

    made = entry_point.queries()["pipeline_all"](spark, sf).cache()
    rows, found = registry.entries(spark, sf), detect.monitors(spark, sf)
    sources = {r.s for r in made.select(F.substring_index("source", "/", 1).alias("s")).distinct().collect()}
    assert {"network-monitor", "procmon", "fim", "dns-monitor", "portscan"} <= sources
    # One row for each entry of the log and of the monitors, also where findings share an id.
    fed = made.filter("NOT (source = 'dns-monitor' OR source LIKE 'portscan/%' OR source LIKE 'correlation/%')")
    assert fed.count() == rows.count() + found.count()
    # Monitors keep their preset score or gain; rates alone never give the scores in between.
    low = found.groupBy("id").agg(F.max("anomaly_score").alias("preset")).join(made, "id").filter("anomaly_score < preset")
    assert low.isEmpty()
    plain = A.annotate(rows).select("id", F.col("anomaly_score").alias("rates_only"))
    both = made.join(plain, "id")
    assert both.filter("anomaly_score < rates_only").isEmpty() and both.filter("anomaly_score > rates_only").count() > 0
    rules = {r.rule_name for r in entry_point.queries()["pipeline_alerts"](spark, sf).select("rule_name").distinct().collect()}
    assert {"DNS Tunneling", "Malware Indicator", "File Integrity Violation", "Suspicious Outbound"} <= rules
    made.unpersist()


def test_sockets_bring_scans_of_their_own(spark, sf):
    from checks import detect

    whole = detect.whole_pipeline(spark, sf).entries
    assert whole.filter("category = 'portscan' AND message LIKE '%detected via proc%'").count() > 0
