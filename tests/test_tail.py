"""Growing, rotated and truncated log files give each line once."""

import os
import random
import time

import pytest

from seclog.sources import tail as T
from seclog.sources.text import read_syslog
from seclog.streaming.pipeline import EntryStream, number_lines, start_tail


class Tail:
    """A query over a folder that is run, stopped and started again between writes."""

    def __init__(self, spark, root, **options):
        self.spark, self.root, self.options = spark, root, options
        (root / "logs").mkdir()

    def run(self):
        lines = T.tail_lines(self.spark, str(self.root / "logs"), **self.options)
        (lines.writeStream.format("parquet").option("path", str(self.root / "out")).option("checkpointLocation", str(self.root / "cp"))
         .trigger(availableNow=True).start().awaitTermination())

    def lines(self):
        return sorted(r.value for r in self.spark.read.parquet(str(self.root / "out")).collect())


def append(path, text):
    with open(path, "a") as file:
        file.write(text)


def test_a_growing_file_gives_each_line_once(spark, tmp_path):
    tail = Tail(spark, tmp_path)
    log = tmp_path / "logs" / "auth.log"
    append(log, "one\ntwo\nthr")
    tail.run()
    assert tail.lines() == ["one", "two"]
    append(log, "ee\n\nfour\r\nfive")
    tail.run()
    tail.run()
    assert tail.lines() == ["", "four", "one", "three", "two"]
    append(tmp_path / "logs" / "kern.log", "other\n")
    append(tmp_path / "logs" / ".hidden", "no\n")
    append(tmp_path / "logs" / "old.log.gz", "no\n")
    append(log, "\n")
    tail.run()
    assert tail.lines() == ["", "five", "four", "one", "other", "three", "two"]
    places = {r.value: (os.path.basename(r.file), r.position) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert places["one"] == ("auth.log", 0) and places["three"] == ("auth.log", 8) and places["other"] == ("kern.log", 0)


def test_rotation_and_truncation(spark, tmp_path):
    tail = Tail(spark, tmp_path)
    log = tmp_path / "logs" / "auth.log"
    append(log, "".join(f"Jan  1 00:00:{i:02d} h sshd[1]: line {i} before\n" for i in range(20)))
    tail.run()
    append(log, "Jan  1 00:01:00 h sshd[1]: between look and rotation\n")
    log.rename(tmp_path / "logs" / "auth.log.1")
    append(log, "Jan  1 00:02:00 h sshd[1]: of the new file\n")
    tail.run()
    assert len(tail.lines()) == 22 == len(set(tail.lines()))
    (tmp_path / "logs" / "auth.log.1").rename(tmp_path / "logs" / "auth.log.2")
    log.write_text("Jan  1 00:03:00 h sshd[1]: truncated in place\n")  # shorter than what was read
    tail.run()
    assert len(tail.lines()) == 23 == len(set(tail.lines()))


def test_starting_at_the_end(spark, tmp_path):
    tail = Tail(spark, tmp_path, startingPosition="end")
    log = tmp_path / "logs" / "a.log"
    append(log, "old\n")
    lines = T.tail_lines(spark, str(tmp_path / "logs"), **tail.options)
    query = (lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(processingTime="100 milliseconds").start())
    deadline = time.time() + 30
    while not query.lastProgress and time.time() < deadline:
        time.sleep(0.2)
    append(log, "new\n")
    while not any(p["numInputRows"] for p in query.recentProgress) and time.time() < deadline:
        time.sleep(0.2)
    query.stop()
    append(log, "while stopped\n")
    tail.run()
    assert tail.lines() == ["new", "while stopped"]


def test_ranges_cut_anywhere_hold_each_line_once(tmp_path):
    rng = random.Random(3)
    data = b"".join(bytes(rng.choice(b"ab\r ") for _ in range(rng.choice([0, 1, 3, 40]))) + b"\n" for _ in range(300))
    path = tmp_path / "x.log"
    path.write_bytes(data + b"unfinished")
    whole = len(data)
    from pyarrow import fs

    for first in (0, data.index(b"\n", 50) + 1):
        for split in (1, 7, 64, 1000, whole):
            got = []
            for at in range(first, whole, split):
                with fs.LocalFileSystem().open_input_file(str(path)) as file:
                    for batch in T.range_lines(file, T.Range(str(path), "x", first, at, min(at + split, whole), {})):
                        got += zip(batch.column(2).to_pylist(), batch.column(0).to_pylist())
            assert [v for _, v in got] == T._BREAK.split(data[first:])[:-1], (first, split)
            assert all(data[p:p + len(v)] == v for p, v in got)


def test_long_lines_and_many_ranges(spark, tmp_path):
    tail = Tail(spark, tmp_path, splitBytes=1 << 16)
    lines = [f"{i} " + "x" * (3_000_000 if i == 50 else i % 500) for i in range(2000)]
    append(tmp_path / "logs" / "big.log", "\n".join(lines) + "\n")
    tail.run()
    assert tail.lines() == sorted(lines)


def test_a_repeated_batch_finds_a_file_renamed_meanwhile(tmp_path):
    (tmp_path / "a.log").write_text("first line of some length, long enough to tell files apart by it\nsecond\n")
    reader = T.TailReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    part, = reader.partitions({}, end)
    os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
    (tmp_path / "a.log").write_text("another file that took the name, and is as long as the one before was\nx\n")
    assert [v for b in reader.read(part) for v in b.column(0).to_pylist()][1] == b"second"
    os.remove(tmp_path / "a.log.1")
    with pytest.raises(FileNotFoundError):
        list(reader.read(part))
    assert list(T.TailReader({"path": str(tmp_path), "failOnDataLoss": "false"}).read(part)) == []


def test_predecessors():
    def file(pos, *heads):
        return {"pos": pos, "head": dict(heads)}

    a, b = ("64", "aa"), ("64", "bb")
    start = {"x": file(100, a), "y": file(90, b), "gone": file(70, ("64", "cc"))}
    got = T.predecessors(start, {"x": file(120, b), "x.1": file(150, a), "y": file(80, b), "z": file(10)})
    assert got == {"x": ("y", 90), "x.1": ("x", 100), "y": ("y", 0), "z": ("z", 0)}
    assert T.predecessors({}, {"x": file(5)}) == {"x": ("x", 0)}


def test_ids_are_those_of_a_batch_read(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log, out = folder / "auth é%20 x.log", str(tmp_path / "out")
    line = "Jan  1 00:00:%02d web1 sshd[1]: Failed password for root from 203.0.113.9 port %d ssh2\n"
    target = EntryStream(spark, str(tmp_path / "state"), out)
    for part in range(3):
        append(log, "".join(line % (part * 10 + i % 5, 1000 + part) for i in range(20)) + "same line\n" * (part + 2) + "unfini")
        lines = T.tail_lines(spark, str(folder))
        start_tail(lines, target, 2024, "2024-01-01 00:01:00", "auth", str(tmp_path / "cp"), availableNow=True).awaitTermination()
    append(log, "shed\n")
    lines = T.tail_lines(spark, str(folder))
    start_tail(lines, target, 2024, "2024-01-01 00:01:00", "auth", str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out + "/entries").filter("raw like '%Failed%' or raw like '%same%' or raw like '%unfini%'").select("id", "raw").collect()]
    want = {(r.id, r.raw) for r in read_syslog(spark, str(folder), 2024, "2024-01-01 00:01:00", "auth").collect()}
    assert len(got) == len(set(got))
    assert {raw for _, raw in got} == {raw for _, raw in want} and len(got) == len(want)
    assert {i for i, _ in got} == {i for i, _ in want}


def test_numbers_go_on_from_batch_to_batch(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for part in range(3):
        append(folder / "a.log", "hot\n" * 25_000 + f"rare {part}\nsometimes\n")
        rows = number_lines(T.tail_lines(spark, str(folder)))
        (rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("value").agg({"occurrence": "max", "*": "count"}).collect()
    assert {r.value: (r["max(occurrence)"], r["count(1)"]) for r in got} == {
        "hot": (75_000, 75_000), "sometimes": (3, 3), "rare 0": (1, 1), "rare 1": (1, 1), "rare 2": (1, 1)}
