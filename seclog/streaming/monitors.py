"""Host monitors on streams of snapshots: connections, listeners, processes and files.

A monitor compares each snapshot of a host with what the snapshots before it showed. So a
snapshot is judged when it is complete, once the watermark has passed its instant, and
snapshots are judged in order; rows may arrive in any order and a snapshot may be cut by
triggers anywhere. Results are those of the batch operators of ``operators.snapshots``.

State lives in a stateful operator (``transformWithState``) with three parts for each group:
the last instants, rows that wait for the watermark, and what is known. A timer at each
instant wakes the group up. A host may make up much of all rows, so its records are dealt
by key into ``buckets``; every group has to know every instant of its host, also those in
which it has no record, so each task adds one marker for each instant it reads and bucket.

The state store must be RocksDB: ``use_rocksdb`` sets it on a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from seclog import refdata as R
from seclog.operators import findings, snapshots as S
from seclog.operators.rates import MICROS
from seclog.schema import complete

#: Groups that the records of one host are dealt into.
BUCKETS = 16

# The names of the operator's own columns: pandas keeps no names that start with an underscore.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: (instant, previous instant or None, records, known) -> (results, known)
Step = Callable[[int, int | None, pd.DataFrame, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _packed(pdf: pd.DataFrame, schema: pa.Schema) -> bytes:
    table = pa.Table.from_pandas(pdf[schema.names], schema=schema, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    """Rows with nulls as None, and whole numbers as such."""
    return pa.ipc.open_stream(raw).read_all().to_pandas(integer_object_nulls=True)


class Monitor(StatefulProcessor):
    """Runs ``step`` over the complete snapshots of a group, in order."""

    def __init__(self, step: Step, records: StructType, known: str, output: list[str]):
        self.step, self.output = step, output
        self.records = to_arrow_schema(records)
        self.known_schema = to_arrow_schema(StructType.fromDDL(known))

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")
        self.known = handle.getValueState("known", "rows binary")
        self.waiting = handle.getListState("waiting", "us bigint, rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for pdf in rows:
            for us, part in pdf.groupby("monitor_us"):
                real = part[~part["monitor_marker"].astype(bool)]
                parts.append((int(us), _packed(real, self.records)))
        if parts:
            self.waiting.appendList(parts)
            for ms in {-(-us // 1000) for us, _ in parts}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted({us for us, _ in rows if us <= due})
        if not ready:
            return
        prev = self.last.get()[0] if self.last.exists() else None
        known = _unpacked(self.known.get()[0]) if self.known.exists() else self.known_schema.empty_table().to_pandas()
        for us in ready:
            here = pd.concat([_unpacked(raw) for at, raw in rows if at == us], ignore_index=True)
            found, known = self.step(us, prev, here, known)
            prev = us
            if len(found):
                yield found.assign(**dict(zip(self.host_columns, key)), monitor_us=us)[self.output]
        self.last.update((prev,))
        self.known.update((_packed(known, self.known_schema),))
        left = [(us, raw) for us, raw in rows if us > due]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()

    host_columns = ("monitor_host",)

    def close(self) -> None:
        pass


def _marked(buckets: int, names: list[str]):
    """Rows, and a marker for each instant of each batch and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            yield pa.RecordBatch.from_arrays(batch.columns, names)
            ticks = pa.table(batch).select(["monitor_host", "snapshot_ts"]).group_by(["monitor_host", "snapshot_ts"]).aggregate([])
            n = ticks.num_rows * buckets
            own = {"monitor_host": pa.concat_arrays(ticks["monitor_host"].chunks * buckets), "snapshot_ts": pa.concat_arrays(ticks["snapshot_ts"].chunks * buckets),
                   "monitor_bucket": pa.array([b for b in range(buckets) for _ in range(ticks.num_rows)], pa.int32()), "monitor_marker": pa.array([True] * n)}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(n, batch.schema.field(c).type) for c in names], names)

    return run


def monitored(snapshots: DataFrame, bucket: Column | None, step: Step, known: str, results: str, delay: str = "1 minute",
              buckets: int = BUCKETS) -> DataFrame:
    """Results of ``step`` over each host's snapshots, with the host (if the table has one) and snapshot_ts.

    ``bucket`` deals a host's records into groups that are judged apart; None: a host is one group.
    Records older than the watermark (``delay`` behind the newest) are dropped.
    """
    own = S.scope(snapshots)
    count = buckets if bucket is not None else 1
    host = F.coalesce(F.col("host").cast("string"), F.lit("")) if own else F.lit("")
    rows = snapshots.withColumns({
        "monitor_host": host, "monitor_bucket": (F.pmod(F.xxhash64(bucket), F.lit(count)) if bucket is not None else F.lit(0)).cast("int"), "monitor_marker": F.lit(False)}).drop(*own)
    nullable = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields])  # markers have nothing else
    payload = StructType([f for f in nullable.fields if f.name not in ("monitor_host", "monitor_bucket", "monitor_marker", "snapshot_ts")])
    stream = (rows.mapInArrow(_marked(count, rows.columns), nullable).withWatermark("snapshot_ts", delay)
              .withColumn("monitor_us", F.unix_micros("snapshot_ts")))
    names = [f.name for f in StructType.fromDDL(results).fields]
    schema = f"{results}, monitor_host string, monitor_us bigint"
    out = stream.groupBy("monitor_host", "monitor_bucket").transformWithStateInPandas(
        Monitor(step, payload, known, [*names, "monitor_host", "monitor_us"]), schema, "append", "eventTime")
    hosts = {"host": F.col("monitor_host")} if own else {}
    return out.withColumns({**hosts, "snapshot_ts": F.timestamp_micros("monitor_us")}).drop("monitor_host", "monitor_us")


# --- connections and listeners ------------------------------------------------------------


def _new_connections(rest: list[str], grace_us: int) -> Step:
    key = S.CONNECTION_KEY

    def step(us, prev, rows, known):
        rows = rows[rows["raddr_ip"].notna()].copy()
        for name, default in (("laddr_ip", ""), ("laddr_port", 0), ("pid", 0)):
            rows[name] = [default if v is None or v != v else v for v in rows[name]]
        # Of repeats the smallest, nulls first, as the batch operator has it.
        rank = [tuple((v is not None and v == v, v if v is not None and v == v else 0) for v in r) for r in rows[rest].itertuples(index=False)]
        rows = rows.assign(_rank=rank).sort_values("_rank", kind="stable").drop_duplicates(key).drop(columns="_rank") if len(rows) else rows
        place = {tuple(r[:-2]): (r[-2], r[-1]) for r in known[[*key, "first", "last"]].itertuples(index=False, name=None)}
        fresh = []
        for k in rows[key].itertuples(index=False, name=None):
            first, last = place.get(k, (None, None))
            new = first is None or (last != prev and prev - first >= grace_us)
            place[k] = (us if new else first, us)
            fresh.append(new)
        left = [(*k, first, last) for k, (first, last) in place.items() if last == us or first > us - grace_us]
        known = pd.DataFrame(left, columns=[*key, "first", "last"])
        return rows[pd.Series(fresh, index=rows.index, dtype=bool)] if prev is not None else rows.iloc[:0], known

    return step


def new_connections_stream(snapshots: DataFrame, grace_seconds: int = R.CONNECTION_GRACE_SECONDS, **options) -> DataFrame:
    """``new_connections`` on a stream. State: the connections of the last snapshot and those first seen within the grace."""
    kinds = dict(snapshots.dtypes)
    columns = [c for c in snapshots.columns if c not in ("host", "snapshot_ts")]
    known = ", ".join(f"{c} {kinds[c]}" for c in S.CONNECTION_KEY) + ", first bigint, last bigint"
    step = _new_connections([c for c in columns if c not in S.CONNECTION_KEY], grace_seconds * MICROS)
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("0" if c in ("laddr_port", "pid") else "")) for c in S.CONNECTION_KEY])
    out = monitored(snapshots, key, step, known, ", ".join(f"`{c}` {kinds[c]}" for c in columns), **options)
    return out.select(snapshots.columns)


def _new_listeners(us, prev, rows, known):
    rows = rows[rows["raddr_ip"].isna() & rows["laddr_port"].notna() & (rows["status"] == "LISTEN")]
    rows = rows[~rows["laddr_port"].isin(known["laddr_port"])]
    rank = [((p is not None and p == p, p if p is not None and p == p else 0), (n is not None, n or "")) for p, n in zip(rows["pid"], rows["proc_name"])]
    rows = rows.assign(_rank=rank).sort_values("_rank", kind="stable").drop_duplicates("laddr_port")[["laddr_port", "proc_name"]] if len(rows) else rows[["laddr_port", "proc_name"]]
    known = pd.concat([known, rows[["laddr_port"]]], ignore_index=True)
    if prev is None:
        return rows.iloc[:0], known
    return rows[(rows["laddr_port"] < 1024) & rows["proc_name"].notna() & ~rows["proc_name"].isin(["", "unknown"])], known


def new_listeners_stream(snapshots: DataFrame, **options) -> DataFrame:
    """``new_listeners`` on a stream: (host, laddr_port, snapshot_ts, proc_name). State: the ports seen, 65,536 a host at most."""
    return monitored(snapshots, F.coalesce("laddr_port", F.lit(0)), _new_listeners, "laddr_port int", "laddr_port int, proc_name string", **options)


# --- processes ----------------------------------------------------------------------------


def _with_parent(us, prev, rows, known):
    names = rows.groupby("pid")["name"].min()
    # Ids beyond those of the last snapshot need not be kept: a process is new if that one lacked it.
    out = rows.assign(prev_ts=pd.NaT if prev is None else pd.Timestamp(prev, unit="us"),
                      parent_name=rows["ppid"].map(names).fillna("").astype(object), is_new=~rows["pid"].isin(known["pid"]))
    return out if prev is not None else out.iloc[:0], names.index.to_frame(index=False)


def process_findings_stream(procs: DataFrame, **options) -> DataFrame:
    """``process_findings`` on a stream of ``processes``. State: the process ids of a host's last snapshot.

    Parent and child can have any ids, so a host is one group: its processes at one instant, and no more.
    """
    kinds = dict(procs.dtypes)
    columns = [c for c in procs.columns if c not in ("host", "snapshot_ts")]
    results = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", prev_ts timestamp, parent_name string, is_new boolean"
    out = monitored(procs, None, _with_parent, f"pid {kinds['pid']}", results, **options)
    return S.judged_processes(out.select(*procs.columns, "prev_ts", "parent_name", "is_new"))


# --- files --------------------------------------------------------------------------------


def _file_changes(us, prev, rows, known):
    state = rows[["path", "sha256", "size", "mode"]].drop_duplicates("path")
    both = known.add_prefix("old_").merge(state.add_prefix("new_"), how="outer", left_on="old_path", right_on="new_path")
    both["path"] = both["old_path"].where(both["old_path"].notna(), both["new_path"])
    return both if prev is not None else both.iloc[:0], state


def file_changes_stream(snapshots: DataFrame, **options) -> DataFrame:
    """``file_changes`` on a stream of file states (host, snapshot_ts, path, sha256, size, mode). State: the last snapshot's files."""
    fields = ["sha256 string", "size bigint", "mode int"]
    results = "path string, " + ", ".join(f"{side}_{f}" for side in ("old", "new") for f in fields) + ", old_path string, new_path string"
    rows = snapshots.withColumns({"size": F.col("size").cast("bigint"), "mode": F.col("mode").cast("int")})
    out = monitored(rows, F.col("path"), _file_changes, "path string, " + ", ".join(fields), results, **options)
    return S.judged_files(out.withColumns({"_o": F.when(F.col("old_path").isNotNull(), 1), "_n": F.when(F.col("new_path").isNotNull(), 1)})
                          .drop("old_path", "new_path"), emit_created=False)


# --- all of them --------------------------------------------------------------------------


def monitor_entries(conns: DataFrame | None = None, procs: DataFrame | None = None, files: DataFrame | None = None, **options) -> list[DataFrame]:
    """Streams of entries of all monitors of the given snapshot streams, for ``EntryStream.start``.

    Beacons need all arrivals of an address; they are found by the batch operator.
    """
    out = []
    if conns is not None:
        new = new_connections_stream(conns, **options)
        out += [findings.from_suspicious_outbound(S.suspicious_outbound(new)), findings.from_smtp_outbound(S.smtp_outbound(new)),
                findings.from_new_listeners(new_listeners_stream(conns, **options))]
    if procs is not None:
        out.append(findings.from_processes(process_findings_stream(procs, **options)))
    if files is not None:
        out.append(findings.from_files(file_changes_stream(files, **options), F.col("snapshot_ts")))
    return [complete(df) for df in out]
