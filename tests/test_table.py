"""The entry table: appends without repeats, retention by partition, versions."""

import datetime

import pytest
from pyspark.sql import functions as F

from checks import registry
from seclog import table as T
from seclog.schema import complete
from seclog.storage import retain


def rows(spark, n=400, days=6, first=0):
    """Entries over several days, categories and levels."""
    return complete(spark.range(first, first + n).selectExpr(
        "sha2(cast(id AS string), 256) AS id", f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % {days} AS int), 0, cast(id % 60 AS int)) AS ts",
        "concat('s', id % 3) AS source", "element_at(array('DEBUG','INFO','WARNING','ERROR','CRITICAL'), cast(id % 5 + 1 AS int)) AS level",
        "cast(id AS string) AS message", "element_at(array('log','network','fim'), cast(id % 3 + 1 AS int)) AS category"))


def files(table, version=None):
    return {p["dir"] for p in table.manifest(version)[1]}


def test_appends_drop_what_is_stored(spark, tmp_path):
    table = T.EntryTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.append(rows(spark).limit(0)) == 0
    assert table.append(rows(spark).union(rows(spark))) == 400
    assert table.append(rows(spark, n=500, first=100)) == 200
    assert table.append(rows(spark, n=300)) == 0
    got = table.read()
    assert got.count() == got.select("id").distinct().count() == 600
    assert table.versions() == [0, 1]
    assert table.read(0).count() == 400  # an older version is still there


def test_only_days_with_a_possible_repeat_are_read(spark, tmp_path, monkeypatch):
    table = T.EntryTable(spark, str(tmp_path / "t"))
    table.append(rows(spark))
    read = []
    own = T.EntryTable._read
    monkeypatch.setattr(T.EntryTable, "_read", lambda self, parts: read.append({p["event_date"] for p in parts}) or own(self, parts))
    assert table.append(rows(spark, first=10_000, n=300)) == 300  # new ids on old days: the filters answer
    assert read == [set()]
    read.clear()
    mixed = rows(spark, n=6).union(rows(spark, first=20_000, n=50)).filter("ts < '2024-01-02' or ts >= '2024-01-04'")
    assert table.append(mixed) > 0
    assert read == [{"2024-01-01", "2024-01-04", "2024-01-05", "2024-01-06"}]
    plan = table.read().filter(F.col("event_date") == datetime.date(2024, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_entries_without_a_time_of_their_own(spark, tmp_path):
    table = T.EntryTable(spark, str(tmp_path / "t"))
    undated = rows(spark, n=30).withColumn("ts", F.lit("2024-03-01 00:00:00").cast("timestamp"))
    assert table.append(undated) == 30
    later = undated.withColumn("ts", F.lit("2024-04-01 00:00:00").cast("timestamp"))
    assert table.append(later.union(rows(spark, first=50, n=10)), fallback=F.col("ts") == F.lit("2024-04-01 00:00:00").cast("timestamp")) == 10
    nowhen = rows(spark, first=900, n=5).withColumn("ts", F.lit(None).cast("timestamp"))
    assert table.append(nowhen) == 5 and table.append(nowhen) == 0


def test_retention_leaves_untouched_partitions_alone(spark, tmp_path):
    table = T.EntryTable(spark, str(tmp_path / "t"))
    table.append(rows(spark))
    before, reader = files(table), table.read()
    as_of = "2024-01-11 00:00:00"  # DEBUG and INFO of the first days expire
    want = {r.id for r in retain(rows(spark), as_of).collect()}
    done = table.expire(as_of)
    after = files(table)
    assert {r.id for r in table.read().collect()} == want and 0 < len(want) < 400
    kept = before & after
    assert done["kept"] == len(kept) > 0 and done["rewritten"] > 0
    assert all(p["event_date"] >= "2024-01-04" for p in table.manifest()[1] if p["dir"] in kept)
    assert reader.count() == 400  # a reader of the version before is not disturbed
    assert table.expire(as_of) == {"kept": len(after), "rewritten": 0, "dropped": 0} and table.versions() == [0, 1]
    assert table.append(rows(spark).filter(~F.col("id").isin(list(want)))) > 0  # what expired is gone from the index too


def test_partitions_that_expire_whole_are_dropped(spark, tmp_path):
    table = T.EntryTable(spark, str(tmp_path / "t"))
    table.append(rows(spark).filter("level <> 'CRITICAL'"))
    done = table.expire("2030-01-01 00:00:00")
    assert done["rewritten"] == 0 and done["dropped"] > 0 and table.read() is None


def test_a_run_that_died_can_be_repeated(spark, tmp_path, monkeypatch):
    table = T.EntryTable(spark, str(tmp_path / "t"))
    table.append(rows(spark))
    commit = T.EntryTable._commit

    def dies(self, version, parts):
        raise OSError("lost")

    monkeypatch.setattr(T.EntryTable, "_commit", dies)
    for run in (lambda: table.expire("2024-01-11 00:00:00"), lambda: table.append(rows(spark, first=5000, n=20))):
        with pytest.raises(OSError):
            run()
    monkeypatch.setattr(T.EntryTable, "_commit", commit)
    assert table.read().count() == 400
    assert table.append(rows(spark, first=5000, n=20)) == 20
    table.expire("2024-01-11 00:00:00")
    want = table.read().count()
    assert table.vacuum() > 0 and table.read().count() == want and table.versions() == [2]


def test_of_two_writers_one_tries_again(spark, tmp_path, monkeypatch):
    table, other = (T.EntryTable(spark, str(tmp_path / "t")) for _ in range(2))
    table.append(rows(spark))
    commit, once = T.EntryTable._commit, []

    def overtaken(self, version, parts):
        if not once:
            once.append(1)
            other.append(rows(spark, first=390, n=20))
        commit(self, version, parts)

    monkeypatch.setattr(T.EntryTable, "_commit", overtaken)
    assert table.append(rows(spark, first=395, n=25)) == 10  # 400 to 409 came from the other one meanwhile
    got = table.read()
    assert got.count() == got.select("id").distinct().count() == 420


def test_filters_hold_their_ids():
    ids = [f"{i:064x}" for i in range(5000)]
    bits = T.bloom(ids)
    assert T.maybe_in(ids, bits).all() and len(bits) == 5000 * T.BITS // 8
    assert T.maybe_in([f"x{i}" for i in range(100_000)], bits).mean() < 1e-4


def test_registered_entries(spark, sf, tmp_path):
    entries = registry.entries(spark, sf)
    table = T.EntryTable(spark, str(tmp_path / "t"))
    assert table.append(entries) == entries.select("id").distinct().count()
    assert table.append(entries) == 0
