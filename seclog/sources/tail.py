"""Log files that are still written to, as a stream of their complete lines.

A streaming data source whose offset says, for each file, up to which byte its lines were
handed on, and how the file begins: hashes of its first 1, 2, 4, ... bytes. Files are
known by their beginnings, not by their names:

* A file that grew goes on where it stopped. An unfinished last line waits for its end.
* A file that was renamed (``log`` to ``log.1``) goes on under its new name, so lines
  written between the last look and the rotation come too; the new file of the old name
  starts at 0.
* A file that was truncated in place begins anew.

New bytes are cut into ranges of about ``splitBytes``, read by as many tasks; a line belongs
to the range it starts in. A range is checked against the file's beginning when it is read, and
looked for among the folder's other files if it was renamed meanwhile, so a batch that is
repeated after a failure gives the same lines.

Files are opened through Arrow's file systems (local and mounted folders, hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value binary, file string, position bigint"
SPLIT_BYTES = 32 << 20
_BLOCK = 1 << 20
_HEAD = 1024
#: A renamed file must share so many first bytes, or all there were, with the file it was.
_ALIKE = 64
_PACKED = (".gz", ".bz2", ".xz", ".zst", ".zip")
#: ASCII characters that a path of a URI escapes.
_QUOTED = re.compile(r"[\x00-\x7f](?<![A-Za-z0-9_\-!.~'()*,;:$&+=@/])")
_BREAK = re.compile(rb"\r\n|\n|\r")


class Range(InputPartition):
    def __init__(self, path: str, label: str, first: int, start: int, end: int, head: dict):
        self.path, self.label, self.first, self.start, self.end, self.head = path, label, first, start, end, head


class Folder:
    """The files that a path names: a folder, a file, or a pattern for file names."""

    def __init__(self, path: str):
        from pyarrow import fs

        uri = re.match(r"^([a-z][a-z0-9+.-]*):(//[^/]*)?", path)
        if uri is None or uri.group(1) == "file":
            self.system, self.prefix = fs.LocalFileSystem(), "file:"
            path = path if uri is None else path[uri.end():]
        else:
            self.system, path = fs.FileSystem.from_uri(path)
            self.prefix = uri.group(0) if path.startswith("/") else f"{uri.group(1)}://"
        self.kinds = fs.FileType
        self.selector = fs.FileSelector
        path = path.rstrip("/")
        if self.system.get_file_info(path).type == fs.FileType.Directory:
            self.base, self.pattern = path, "*"
        else:
            self.base, _, self.pattern = path.rpartition("/")

    def files(self, every: bool = False) -> dict[str, int]:
        """Sizes by path, without hidden and compressed files; ``every`` file of the folder, or those of the pattern."""
        found = self.system.get_file_info(self.selector(self.base, allow_not_found=True))
        return {x.path: x.size for x in found
                if x.type == self.kinds.File and not x.base_name.startswith((".", "_")) and not x.base_name.endswith(_PACKED)
                and (every or fnmatch.fnmatch(x.base_name, self.pattern))}

    def open(self, path: str):
        return self.system.open_input_file(path)

    def label(self, path: str) -> str:
        """The name Spark's readers give the file."""
        return self.prefix + _QUOTED.sub(lambda m: "%%%02X" % ord(m.group()), path)


def beginnings(file, size: int) -> dict[str, str]:
    """Hashes of the first 1, 2, 4, ... bytes, as far as ``size`` goes."""
    file.seek(0)
    data, out, n = file.read(min(size, _HEAD)), {}, 1
    while n <= len(data):
        out[str(n)] = hashlib.blake2b(data[:n], digest_size=12).hexdigest()
        n *= 2
    return out


def alike(old: dict[str, str], new: dict[str, str]) -> int:
    """How many first bytes two files are known to share; -1 if they differ."""
    common = max((int(n) for n in old if n in new), default=0)
    return common if not common or old[str(common)] == new[str(common)] else -1


def lines_end(file, size: int, known: int) -> int:
    """End of the last complete line, looked for backwards from ``size`` to ``known``, an earlier line's end."""
    end = size
    while end > known:
        start = max(known, end - _BLOCK)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return known


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        options = {name.lower(): value for name, value in options.items()}
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.at_end = options.get("startingposition", "start") == "end"
        self.lenient = options.get("failondataloss", "true").lower() == "false"
        self.seen: dict[str, dict] = {}

    def _listing(self) -> dict[str, dict]:
        folder, out = Folder(self.path), {}
        for path, size in sorted(folder.files().items()):
            try:
                with folder.open(path) as file:
                    size = min(size, file.size())
                    before = self.seen.get(path)
                    head = beginnings(file, size)
                    known = before["pos"] if before and before["pos"] <= size and alike(before["head"], head) >= 0 else 0
                    pos = lines_end(file, size, known)
                    out[path] = {"pos": pos, "head": {n: h for n, h in head.items() if int(n) <= pos}}
            except FileNotFoundError:  # renamed or deleted meanwhile: the next look sees what became of it
                continue
        self.seen = out
        return out

    def initialOffset(self) -> dict:
        return self._listing() if self.at_end else {}

    def latestOffset(self) -> dict:
        return self._listing()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, folder = [], Folder(self.path)
        for path, (name, first) in predecessors(start, end).items():
            last = end[path]["pos"]
            for at in range(first, last, self.split):
                out.append(Range(path, folder.label(name), first, at, min(at + self.split, last), end[path]["head"]))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.path)
        path = located(folder, partition)
        if path is None:
            if self.lenient:
                return
            raise FileNotFoundError(f"{partition.path}: the file that held bytes {partition.start} to {partition.end} is gone; "
                                    "failOnDataLoss=false goes on without them")
        with folder.open(path) as file:
            yield from range_lines(file, partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def predecessors(start: dict, end: dict) -> dict[str, tuple[str, int]]:
    """For each file of ``end``: the name its new lines go by and where they begin."""
    out, free = {}, dict(start)
    for path, now in end.items():
        before = start.get(path)
        if before is not None and before["pos"] <= now["pos"] and alike(before["head"], now["head"]) >= 0:
            out[path] = path, before["pos"]
            free.pop(path)
    for path, now in end.items():
        if path in out:
            continue
        was = [(alike(old["head"], now["head"]), name) for name, old in free.items()
               if 0 < old["pos"] <= now["pos"] and alike(old["head"], now["head"]) >= min(_ALIKE, 1 << (old["pos"].bit_length() - 1))]
        if was:
            name = max(was)[1]
            out[path] = name, free.pop(name)["pos"]
        else:
            out[path] = path, 0
    return out


def located(folder: Folder, part: Range) -> str | None:
    """Where the range's file is now: its path, or another file of the folder that begins alike."""
    sizes = folder.files(every=True)
    for path in [part.path, *sorted(p for p in sizes if p != part.path)]:
        if sizes.get(path, -1) < part.end:
            continue
        try:
            with folder.open(path) as file:
                if alike(part.head, beginnings(file, part.end)) == max(map(int, part.head), default=0):
                    return path
        except FileNotFoundError:
            continue
    return None


def range_lines(file, part: Range) -> Iterator[pa.RecordBatch]:
    """Lines that start inside the range, about a MB at a time."""
    begin = part.start
    if begin > part.first:  # the line that runs into this range belongs to the one before
        begin -= 1
        file.seek(begin)
        while True:
            block = file.read(_BLOCK)
            found = block.find(b"\n")
            if found >= 0 or not block:
                break
            begin += len(block)
        begin += found + 1
        if begin >= part.end or not block:
            return
    file.seek(begin)
    buffer = bytearray()
    while True:
        block = file.read(_BLOCK)
        buffer += block
        over = begin + len(buffer) >= part.end  # then the line that holds the range's last byte is its last one
        cut = (buffer.find(b"\n", max(0, part.end - 1 - begin)) if over else buffer.rfind(b"\n")) + 1
        if cut:
            yield _batch(bytes(buffer[:cut]), begin, part.label)
            begin += cut
            del buffer[:cut]
        if not block or (over and cut):
            return


def _batch(data: bytes, begin: int, label: str) -> pa.RecordBatch:
    values, places, at = [], [], 0
    for mark in _BREAK.finditer(data):
        values.append(data[at:mark.start()])
        places.append(begin + at)
        at = mark.end()
    return pa.record_batch([pa.array(values, pa.binary()), pa.array([label] * len(values), pa.string()), pa.array(places, pa.int64())], ["value", "file", "position"])


class TailSource(DataSource):
    """``spark.readStream.format("log_tail").load(path)``.

    Options: ``splitBytes``, ``startingPosition`` (start, or end: only what is written from
    now on; a query that stopped before its first batch looks for the end anew), ``failOnDataLoss`` (true: a batch fails if a file with unread lines is gone).
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Complete lines of growing files as a stream: (value, file, position), position the line's first byte."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("log_tail")
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(path).withColumn("value", F.col("value").cast("string"))
