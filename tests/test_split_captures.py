"""Captures that Spark splits give what a whole read gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seclog.schema import complete
from seclog.sources import captures, text as S

AS_OF = "2024-01-01 00:00:00"
SPLITS = {"spark.sql.files.maxPartitionBytes": "3000b", "spark.sql.files.openCostInBytes": "64b"}


@pytest.fixture(params=["whole", "split"])
def cutting(spark, request):
    """With Spark's own settings, and with splits of 3,000 bytes."""
    if request.param == "whole":
        yield request.param
        return
    old = {k: spark.conf.get(k) for k in SPLITS}
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def whole_files(spark, folder):
    return spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def same(got, want):
    got, want = ([tuple(r) for r in x.collect()] for x in (got, want))
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r[0] for r in got}) == len(got)
    return len(got)


def item(rng, i):
    message = rng.choice(["plain", 'say "hi" {x}', "back\\slash}", 'end\\"', "{{{", "}}}", "[1, {2}]", "é 中 \U0001f600", "line\nbreak", "\\\\", '"', ""]) * rng.randint(1, 4)
    if i % 97 == 5:
        message = '{"a": "}' * 1500  # longer than several splits
    return {"traceID": i, "eventMessage": message, "messageType": rng.choice(["Error", "Fault", "Default", None]), "nested": {"a": [{"b": "}"}, {}], "c": {}},
            "timestamp": "2024-01-01 00:00:%02d.000000+0000" % (i % 60), "subsystem": rng.choice(["", "com.x"]), "process": f"p{i % 5}"}


@pytest.mark.parametrize("style", [{"indent": 2}, {}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_unified_log(spark, tmp_path, cutting, style):
    rng = random.Random(1)
    (tmp_path / "big.json").write_text(json.dumps([item(rng, i) for i in range(400)], **style))
    (tmp_path / "one.json").write_text(json.dumps(item(rng, 1), **style) + "\n")
    (tmp_path / "two.json").write_text("[" + json.dumps(item(rng, 2)) + "," + json.dumps(item(rng, 102)) + "]\n\n")
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "nothing.json").write_text("")
    got = S.read_unified_log(spark, str(tmp_path), AS_OF)
    want = complete(S.parse_unified_log(whole_files(spark, str(tmp_path)), AS_OF).withColumn("id", S.entry_id("file", "item_no", "raw")))
    assert same(got, want) == 403
    if cutting == "split":
        blocks = captures.fragments(spark, str(tmp_path / "big.json"), "}").select("block").distinct().count()
        assert blocks > 20
    assert S.read_unified_log(spark, str(tmp_path), AS_OF, max_items=1).count() == 3


def test_an_item_that_is_no_json_is_lost_alone(spark, tmp_path, cutting):
    rng = random.Random(2)
    items = [json.dumps(item(rng, i)) for i in range(1, 5)]
    (tmp_path / "a.json").write_text("[" + items[0] + ', {"eventMessage": nonsense here}, ' + ",".join(items[1:]) + ', {"eventMessage": "cut off')
    assert S.read_unified_log(spark, str(tmp_path), AS_OF).count() == 4


def record(rng, i, blank=""):
    text = rng.choice(["Logon", "a: b", "two\n  lines: here", "Event[ inside a line", "é 中", ""]) * rng.randint(1, 3)
    if i % 50 == 7:
        text = "long line of text " * 800
    return (f"{blank}Event[{i}]:\r\n  Log Name: Security\n  Date: 2024-01-01T00:00:{i % 60:02d}\n\tLevel: {rng.choice(['Error', 'Warning', 'Information'])}  \n"
            f"  Provider: P{i % 3}\n  Description: {text}\n\n")


def test_event_text(spark, tmp_path, cutting):
    rng = random.Random(3)
    (tmp_path / "big.txt").write_text("".join(record(rng, i, blank=" " if i % 11 == 3 else "") for i in range(300)))
    (tmp_path / "preface.txt").write_text("head: of the file\n" + "".join(record(rng, i) for i in range(3)))
    (tmp_path / "blank.txt").write_text("\n" + record(rng, 1).rstrip("\n"))
    (tmp_path / "none.txt").write_text("no records, but Date: 2024\n")
    (tmp_path / "empty.txt").write_text("")
    got = S.read_wevt_text(spark, str(tmp_path), "Security", AS_OF)
    documents = whole_files(spark, str(tmp_path))
    want = complete(S.parse_wevt_text(documents, "Security", AS_OF).withColumn("id", S.entry_id("file", "item_no", "raw")))
    assert same(got, want) == 306


def test_one_capture_is_read_by_many_tasks(spark, tmp_path):
    old = {k: spark.conf.get(k) for k in SPLITS}
    for k in SPLITS:
        spark.conf.set(k, "200000b")
    try:
        (tmp_path / "a.json").write_text(json.dumps([{"eventMessage": "x" * 90, "process": "p", "num": i} for i in range(20_000)]))
        rows = S.read_unified_log(spark, str(tmp_path), AS_OF).select(F.spark_partition_id().alias("p"), "raw")
        assert rows.count() == 20_000 and rows.select("p").distinct().count() >= 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_escapes():
    import numpy as np

    for text in ('{"a\\"b": "\\\\"}', '"\\\\\\""{', '{"x{y": {"}": 1}}', "\\\\\"{\"}"):
        data = np.frombuffer(text.encode(), np.uint8)
        places, odd, quotes = captures.braces(data)
        inside, want, back = 0, [], 0
        for i, c in enumerate(text):
            if c in "{}":
                want.append((i, inside))
            if c == '"' and back % 2 == 0:
                inside ^= 1
            back = back + 1 if c == "\\" else 0
        assert list(zip(places.tolist(), odd.tolist())) == want and quotes == inside
