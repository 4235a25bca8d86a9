"""The entry table as versions: appends without repeats, retention that rewrites little.

Data lies in partitions ``data/write=W/event_date=D/category=C``; ``W`` is one append or
rewrite. A *manifest*, one JSON lines file for each version, lists the partitions that make up the table,
with their rows and the oldest instant of each level. Files are never changed:

* Readers take the newest manifest and keep reading its files, whatever is written meanwhile.
* An append or a retention run writes new partitions, then the next manifest. A manifest is
  created only if its number is still free, so of two writers one tries again with what the
  other did. A run that dies before that leaves files that nobody reads.
* ``vacuum`` deletes files that only older versions name.

Repeats: next to each write lies an index of its ids, Bloom filters of at most ``FILTER_IDS``
ids by day and the first byte of the id. An append tests its ids against the filters of its
own days; only days with a possible repeat have ids read for the exact answer. An entry's id and
instant go together, so an id is looked for on its own day. Entries that took their time
from the reader (``fallback``) are looked for on every day.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seclog.storage import cut_lineage, retain, retention_plan

FILTER_IDS = 65_536
#: Bits and probes for each id: about one false alarm in 100,000.
BITS, PROBES = 24, 16
_INDEX = "event_date date, block int, n int, bits binary"


# --- Bloom filters ------------------------------------------------------------------------


def probes(ids: list[str], bits: int) -> np.ndarray:
    """Places of each id in a filter of ``bits`` bits: two halves of a 128-bit hash, stepped."""
    import hashlib

    raw = b"".join(hashlib.blake2b(i.encode(), digest_size=16).digest() for i in ids)
    halves = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) % np.uint64(bits)


def bloom(ids: list[str]) -> bytes:
    bits = np.zeros(-(-len(ids) * BITS // 8) * 8, np.uint8)
    bits[probes(ids, len(bits)).reshape(-1).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def maybe_in(ids: list[str], filter_bytes: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(filter_bytes, np.uint8))
    return bits[probes(ids, len(bits)).astype(np.int64)].all(axis=1)


def _block(ids: Column) -> Column:
    return (F.pmod(F.xxhash64(ids), F.lit(256))).cast("int")


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of rows (event_date, block, id) sorted by day and block."""
    key, held = None, []

    def emit() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key[0]], pa.date32()), pa.array([key[1]], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([bloom(held)], pa.binary())],
                               ["event_date", "block", "n", "bits"])

    for batch in batches:
        for day, block, one in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and ((day, block) != key or len(held) == FILTER_IDS):
                yield emit()
                held.clear()
            key = (day, block)
            held.append(one)
    if held:
        yield emit()


def _suspects(left, right) -> pa.Table:
    """Ids of a (day, block) that one of its filters may hold."""
    ids = left["id"].to_pylist()
    found = np.zeros(len(ids), bool)
    for bits in right["bits"].to_pylist():
        found |= maybe_in(ids, bits)
    return left.select(["id", "day"]).filter(pa.array(found))


# --- table --------------------------------------------------------------------------------


class Conflict(RuntimeError):
    """Another writer made this version first."""


class EntryTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        root = self._path(f"{self.path}/manifest")
        if not self._fs.exists(root):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(root) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[dict]]:
        """(version, partitions); version -1 is the empty table."""
        version = max(self.versions(), default=-1) if version is None else version
        if version < 0:
            return -1, []
        stream = self._fs.open(self._path(f"{self.path}/manifest/{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [json.loads(line) for line in text.splitlines()]

    def _commit(self, version: int, parts: list[dict]) -> None:
        """Make ``version`` if it is still free: written aside, then renamed to a name that must not exist."""
        target = self._path(f"{self.path}/manifest/{version}.json")
        aside = self._path(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write("".join(json.dumps(p, sort_keys=True) + "\n" for p in parts).encode())
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} of {self.path} is taken")

    # reading

    def read(self, version: int | None = None) -> DataFrame | None:
        """The entries of a version (the newest), None if there are none yet; filters on event_date and category prune files."""
        return self._read(self.manifest(version)[1])

    def _read(self, parts: list[dict]) -> DataFrame | None:
        if not parts:
            return None
        return (self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{p['dir']}" for p in parts]).drop("write"))

    # writing

    def _write(self, entries: DataFrame) -> list[dict]:
        """New partitions of ``entries``, with an index of their ids."""
        name = uuid.uuid4().hex
        root = f"{self.path}/data/write={name}"
        (entries.hint("rebalance", "event_date", "category").write.partitionBy("event_date", "category").parquet(root))
        if not any(s.isDirectory() and s.getPath().getName().startswith("event_date=") for s in self._fs.listStatus(self._path(root))):
            return []
        written = self.spark.read.option("basePath", root).parquet(root)
        where = F.regexp_extract(F.col("_metadata.file_path"), r"/(event_date=[^/]*/category=[^/]*)/[^/]*$", 1)
        oldest = written.groupBy(where.alias("dir"), "event_date", "category", "level").agg(F.count("*").alias("n"), F.min(F.unix_micros("ts")).alias("us"))
        parts: dict[str, dict] = {}
        for r in oldest.collect():  # one row per partition and level
            part = parts.setdefault(r.dir, {"dir": f"write={name}/{r.dir}", "event_date": r.event_date and r.event_date.isoformat(), "category": r.category, "rows": 0, "oldest": {}})
            part["rows"] += r.n
            part["oldest"][r.level] = r.us
        rows = written.select("event_date", _block(F.col("id")).alias("block"), "id").repartition("event_date", "block").sortWithinPartitions("event_date", "block")
        rows.mapInArrow(_filters, _INDEX).write.parquet(f"{self.path}/index/write={name}")
        return list(parts.values())

    def _index(self, parts: list[dict]) -> DataFrame | None:
        writes = sorted({p["dir"].split("/")[0] for p in parts})
        return self.spark.read.schema(_INDEX).parquet(*[f"{self.path}/index/{w}" for w in writes]) if writes else None

    def _fresh(self, new: DataFrame, parts: list[dict], fallback: Column | None) -> DataFrame:
        """Rows of ``new`` (ids differ) that no partition of the table holds."""
        if not parts:
            return new
        days = [r.event_date for r in new.select("event_date").distinct().collect()]
        undated = fallback is not None and not new.filter(fallback).isEmpty()
        near = parts if undated else [p for p in parts if p["event_date"] in {d and d.isoformat() for d in days}]
        index = self._index(near)
        if index is None:
            return new
        day = F.coalesce(F.col("event_date").cast("string"), F.lit("none")).alias("day")
        named = sorted({p["event_date"] or "none" for p in near})
        index = index.select(day, "block", "bits").filter(F.col("day").isin(named))
        own = new.select("id", _block(F.col("id")).alias("block"), day, (F.lit(False) if fallback is None else F.coalesce(fallback, F.lit(False))).alias("_any"))
        asked = own.filter("NOT _any").drop("_any")
        if undated:  # a row for each day of the table
            asked = asked.unionByName(own.filter("_any").select("id", "block", F.explode(F.array(*map(F.lit, named))).alias("day")))
        suspects = cut_lineage(asked.groupBy("day", "block").cogroup(index.groupBy("day", "block"))
                               .applyInArrow(_suspects, "id string, day string").distinct())
        hit = {r.day for r in suspects.select("day").distinct().collect()}
        stored = self._read([p for p in near if (p["event_date"] or "none") in hit])
        if stored is None:
            return new
        known = suspects.join(stored.select("id", day), ["id", "day"], "left_semi").select("id").distinct()
        return new.join(known, "id", "left_anti")

    def append(self, entries: DataFrame, fallback: Column | None = None, tries: int = 5) -> int:
        """Add the entries whose id is not stored yet, each id once; the number added.

        ``fallback`` tells the rows whose time came from the reader. Rows without a time make a day of their own.
        """
        new = cut_lineage(entries.dropDuplicates(["id"]).withColumns({"event_date": F.to_date("ts"), "ingested_at": F.current_timestamp()}))
        for _ in range(tries):
            version, parts = self.manifest()
            added = self._write(self._fresh(new, parts, fallback).select(new.columns))
            if not added:
                return 0
            try:
                self._commit(version + 1, parts + added)
                return sum(p["rows"] for p in added)
            except Conflict:  # what the other writer stored counts now
                continue
        raise Conflict(f"{self.path}: {tries} tries, each overtaken by another writer")

    def expire(self, as_of, overrides: dict | None = None, tries: int = 5) -> dict[str, int]:
        """Severity-based retention: only partitions that hold an expired row are read and written anew.

        Returns how many partitions were kept, rewritten and dropped. A version is made only if something expired.
        """
        end = self.spark.range(1).select(F.unix_micros(F.lit(as_of).cast("timestamp"))).first()[0]
        limits = {level: end - days * 86_400_000_000 for level, days in retention_plan(overrides).items() if days is not None}
        for _ in range(tries):
            version, parts = self.manifest()
            old = [p for p in parts if any(us is not None and us < limits.get(level, us) for level, us in p["oldest"].items())]
            done = {"kept": len(parts) - len(old), "rewritten": 0, "dropped": 0}
            if not old:
                return done
            left = self._write(retain(self._read(old), as_of, overrides))
            done["rewritten"] = len({(p["event_date"], p["category"]) for p in left})
            done["dropped"] = len(old) - done["rewritten"]
            names = {p["dir"] for p in old}
            try:
                self._commit(version + 1, [p for p in parts if p["dir"] not in names] + left)
                return done
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {tries} tries, each overtaken by another writer")

    def vacuum(self, keep: int = 1) -> int:
        """Delete what only versions before the newest ``keep`` name; the number of partitions deleted.

        No writer may be at work, nor a reader of an older version.
        """
        versions = self.versions()
        used = {p["dir"] for v in versions[-keep:] for p in self.manifest(v)[1]}
        writes = {d.split("/")[0] for d in used}
        data, gone = self._path(f"{self.path}/data"), 0
        if not self._fs.exists(data):
            return 0
        for write in self._fs.listStatus(data):
            name = write.getPath().getName()
            for day in self._fs.listStatus(write.getPath()):
                if not day.isDirectory():
                    continue
                for part in self._fs.listStatus(day.getPath()):
                    if f"{name}/{day.getPath().getName()}/{part.getPath().getName()}" not in used:
                        gone += bool(self._fs.delete(part.getPath(), True))
            if name not in writes:
                self._fs.delete(write.getPath(), True)
                self._fs.delete(self._path(f"{self.path}/index/{name}"), True)
        for version in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/{version}.json"), False)
        return gone
