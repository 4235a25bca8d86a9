"""Captures of the unified log stay bounded as the table grows."""

from pyspark.sql import functions as F


def test_captures_are_bounded_and_hold_every_item_once(spark):
    from checks.scalars import CAPTURE, captures

    n = 8 * CAPTURE
    items = spark.range(n).selectExpr("id % 3 AS doc", "id AS num", "concat('{\"n\":', id, '}') AS item")
    got = captures(items).select("doc", F.from_json("value", "array<struct<n:bigint>>").alias("x")).collect()
    assert len(got) >= n // CAPTURE and max(len(r.x) for r in got) <= CAPTURE
    assert sorted(x.n for r in got for x in r.x) == list(range(n))
    assert all(x.n % 3 == r.doc for r in got for x in r.x)
