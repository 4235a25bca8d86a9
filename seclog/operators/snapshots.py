"""Host snapshots: connections, listeners, processes and files compared over time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from seclog import refdata as R
from seclog.functions import net
from seclog.functions.text import cut, lookup, octal_mode, rx
from seclog.operators.cooldown import group_starts, passing_instants, whole_groups
from seclog.operators.rates import MICROS

CONNECTION_KEY = ["laddr_ip", "laddr_port", "raddr_ip", "raddr_port", "pid"]


def scope(snapshots: DataFrame) -> list[str]:
    """A table of several hosts has a ``host`` column; each host then has its own clock and state."""
    return ["host"] if "host" in snapshots.columns else []


def ticks(snapshots: DataFrame) -> DataFrame:
    """([host], snapshot_ts, prev_ts): one row per snapshot instant, however many records it holds."""
    own = scope(snapshots)
    order = W.partitionBy(*own).orderBy("snapshot_ts")
    return (snapshots.select(*own, "snapshot_ts").distinct()
            .withColumn("prev_ts", F.lag("snapshot_ts").over(order)))


def connections(snapshots: DataFrame) -> DataFrame:
    """Records with a remote end; missing local parts and pid become '' and 0."""
    return snapshots.filter(F.col("raddr_ip").isNotNull()).withColumns({
        "laddr_ip": F.coalesce("laddr_ip", F.lit("")), "laddr_port": F.coalesce("laddr_port", F.lit(0)),
        "pid": F.coalesce("pid", F.lit(0))})


def listeners(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(F.col("raddr_ip").isNull() & F.col("laddr_port").isNotNull()
                            & (F.col("status") == "LISTEN"))


def new_connections(snapshots: DataFrame, grace_seconds: int = R.CONNECTION_GRACE_SECONDS) -> DataFrame:
    """Connections that were not known when their snapshot was taken.

    A connection stays known while present, or until ``grace_seconds`` after it was first
    seen. So after an absence it is new again only if the snapshot before its return came
    at least that long after the last time it was new: a cooldown whose test instant is
    that previous snapshot. The first snapshot only teaches.
    """
    columns, own = snapshots.columns, scope(snapshots)
    key = own + CONNECTION_KEY
    per_tick = (connections(snapshots).groupBy(*key, "snapshot_ts")
                .agg(F.min(F.struct(*[c for c in columns if c not in key + ["snapshot_ts"]])).alias("_rest")))
    by_key = W.partitionBy(*key).orderBy("snapshot_ts")
    clock = ticks(snapshots)
    seen = (per_tick.join(clock, own + ["snapshot_ts"])
            .withColumn("_last", F.lag("snapshot_ts").over(by_key)))
    # Back after an absence, or never seen; unbroken presence is never new.
    returns = seen.filter(F.col("_last").isNull() | (F.col("prev_ts") > F.col("_last")))
    instant = F.unix_micros("snapshot_ts")
    steps = returns.select(*key, instant.alias("exit"),
                           F.when(F.col("_last").isNull(), instant).otherwise(F.unix_micros("prev_ts")).alias("upper"))
    fresh = passing_instants(steps, key, grace_seconds * MICROS, bounded_entry=False)
    return (returns.filter(F.col("prev_ts").isNotNull()).withColumn("exit", instant)
            .join(fresh, key + ["exit"])
            .select(*key, "snapshot_ts", "_rest.*").select(columns))


def new_listeners(snapshots: DataFrame) -> DataFrame:
    """Ports below 1024 that start to listen after the first snapshot, with a known process."""
    own = scope(snapshots)
    first_tick = snapshots.groupBy(*own).agg(F.min("snapshot_ts").alias("_start"))
    first = (listeners(snapshots).groupBy(*own, "laddr_port")
             .agg(F.min("snapshot_ts").alias("snapshot_ts"),
                  F.min_by("proc_name", F.struct("snapshot_ts", F.col("pid"), F.col("proc_name"))).alias("proc_name")))
    both = first.join(first_tick, own) if own else first.crossJoin(F.broadcast(first_tick))  # one row
    return (both.filter(F.col("snapshot_ts") > F.col("_start")).filter((F.col("laddr_port") < 1024) & ~F.coalesce("proc_name", F.lit("")).isin("", "unknown"))
            .drop("_start"))


def suspicious_outbound(new: DataFrame) -> DataFrame:
    reason = net.suspicious_port_reason(F.col("raddr_port"))
    return new.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def smtp_outbound(new: DataFrame) -> DataFrame:
    return new.filter(F.col("raddr_port").isin(R.SMTP_PORTS) & ~net.is_private(F.col("raddr_ip"))
                      & ~F.col("raddr_port").isin(list(R.SUSPICIOUS_PORTS)))


def active_connections(snapshots: DataFrame, limit: int = 200) -> DataFrame:
    """Display rows of one snapshot."""
    end = lambda ip, port: F.concat_ws(":", F.col(ip), F.col(port).cast("string"))
    return (snapshots.filter(F.col("raddr_ip").isNotNull()).select(
        F.when(F.col("laddr_ip").isNotNull(), end("laddr_ip", "laddr_port")).otherwise("").alias("laddr"),
        end("raddr_ip", "raddr_port").alias("raddr"), F.col("raddr_ip").alias("rip"),
        F.col("raddr_port").alias("rport"), F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("pid", F.lit(0)).alias("pid"), F.coalesce("proc_name", F.lit("unknown")).alias("proc"),
        F.col("raddr_port").isin(list(R.SUSPICIOUS_PORTS)).alias("suspicious"),
        (~net.is_private(F.col("raddr_ip"))).alias("external"))
        .orderBy("raddr", "laddr", "pid", "status", "proc").limit(limit))


class _Arrivals:
    """Arrivals of many addresses, one row per address and instant, and the regularity of any stretch of them.

    ``first`` marks the first row of each address, ``n`` counts the arrivals of a row. Sums of
    gaps and of their squares come from running totals, so a stretch costs the same however long it is.
    """

    def __init__(self, us: np.ndarray, n: np.ndarray, first: np.ndarray, keep: int | None, least: int):
        self.us, self.keep, self.least = us, keep, least
        self.upto = np.cumsum(n)  # arrivals up to and with each row
        rows = np.flatnonzero(n > 0)
        gaps = np.diff(us[rows], prepend=us[rows[:1]])
        # Whole numbers that may run over: differences within a window don't.
        self.gap = np.zeros(len(us), np.int64)
        self.gap[rows] = gaps
        self.squares = np.cumsum(self.gap.astype(np.uint64) ** 2)
        self.head = np.maximum.accumulate(np.where(first, np.arange(len(us)), 0))  # first row of the row's address

    def stretch(self, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(arrivals, row of the first, row of the last) from row ``start`` to row ``at``, the last ``keep`` of them."""
        before = np.where(start > 0, self.upto[start - 1], 0)
        count = self.upto[at] - before
        count = count if self.keep is None else np.minimum(count, self.keep)
        some = np.maximum(count, 1)
        return count, np.searchsorted(self.upto, self.upto[at] - some, "right"), np.searchsorted(self.upto, self.upto[at] - 1, "right")

    def regular(self, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether the stretch is a beacon: enough arrivals, less than 120 s apart, deviation below a quarter of the mean."""
        count, begin, end = self.stretch(at, start)
        steps = np.maximum(count - 1, 1).astype(np.longdouble)
        length = (self.us[end] - self.us[begin]).astype(np.longdouble)
        spread = np.maximum((self.squares[end] - self.squares[begin]).astype(np.longdouble) * steps - length ** 2, 0)  # (deviation * steps)^2
        return (count >= max(self.least, 2)) & (length > 0) & (length < 120 * MICROS * steps) & (16 * spread < length ** 2)

    def figures(self, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(arrivals, mean gap, its deviation) in seconds."""
        count, begin, end = self.stretch(at, start)
        steps, size = count - 1, end - begin
        mean = (self.us[end] - self.us[begin]) / MICROS / steps
        rows = np.repeat(begin + 1 - np.cumsum(size) + size, size) + np.arange(size.sum())
        rows, own = rows[self.gap[rows] > 0], np.repeat(np.arange(len(at)), size)[self.gap[rows] > 0]
        away = np.bincount(own, (self.gap[rows] / MICROS - mean[own]) ** 2, len(at))
        zero = steps - np.bincount(own, minlength=len(at))  # arrivals at the instant of the one before
        return count, mean, np.sqrt((away + zero * mean ** 2) / steps)


def _beacon_scan(group: list[str], window_us: int, keep: int | None, least: int):
    """Hits of all addresses of a batch: a hit clears its address's history.

    For every row, as if it were a hit, the next hit is looked for: among the rows whose window
    still reaches back to it, step by step for all rows at once, then the first later row that is regular
    over its whole window. Hits are the rows that the first ones lead to.
    """

    def run(batches):
        for pdf in whole_groups(batches, group):
            first = group_starts(pdf, group)
            us, rows = pdf["us"].to_numpy(), np.arange(len(pdf))
            a = _Arrivals(us, pdf["n"].to_numpy(), first, keep, least)
            close = np.append(np.flatnonzero(first)[1:], len(pdf))[np.cumsum(first) - 1]  # one behind the address's last row
            low = _reach(us, a.head, window_us)
            plain = np.append(a.regular(rows, low), True)  # regular with no hit near; a stop at the end
            later = np.minimum.accumulate(np.where(plain, np.arange(len(pdf) + 1), len(pdf))[::-1])[::-1]
            follow = np.full(len(pdf) + 1, len(pdf))
            open_rows, far = rows, 1
            while len(open_rows):
                at = open_rows + far
                inside = at < close[open_rows]
                inside[inside] = low[at[inside]] <= open_rows[inside]
                done = open_rows[~inside]
                follow[done] = later[np.minimum(done + far, len(pdf))]
                open_rows, at = open_rows[inside], at[inside]
                hit = a.regular(at, np.maximum(low[at], open_rows + 1))
                follow[open_rows[hit]] = at[hit]
                open_rows, far = open_rows[~hit], far + 1
            follow[:-1][follow[:-1] >= close] = len(pdf)
            heads = later[np.flatnonzero(first)]
            heads = heads[heads < close[np.flatnonzero(first)]]
            hits = _led_to(heads, follow)
            if not len(hits):
                continue
            before = np.append(-1, hits[:-1])  # the hit before, if it is the same address's
            start = np.maximum(low[hits], np.where(before >= a.head[hits], before + 1, 0))
            count, mean, std = a.figures(hits, start)
            yield pdf.iloc[hits][[*group, "us"]].assign(connections=count, mean_s=mean, std_s=std)

    return run


def _reach(us: np.ndarray, head: np.ndarray, window_us: int) -> np.ndarray:
    """First row of the same address inside each row's window, from sorted rows."""
    heads = np.unique(head)
    low = np.empty(len(us), np.int64)
    for a, b in zip(heads, np.append(heads[1:], len(us))):  # one search per address
        low[a:b] = a + np.searchsorted(us[a:b], us[a:b] - window_us, "left")
    return low


def _led_to(heads: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """All rows that ``heads`` lead to, sorted: jumps of 1, 2, 4, ... steps; the last number is the end."""
    end = len(follow) - 1
    follow[end] = end
    jumps = [follow]
    while len(heads) and (jumps[-1][heads] != end).any():
        jumps.append(jumps[-1][jumps[-1]])
    on = np.zeros(len(follow), bool)
    on[heads] = True
    for jump in reversed(jumps):
        on[jump[np.flatnonzero(on)]] = True
    on[end] = False
    return np.flatnonzero(on)


def beacons(new: DataFrame, clock: DataFrame, window_seconds: int = 300, keep: int | None = None, least: int = 5) -> DataFrame:
    """External addresses contacted at regular intervals, tested at every snapshot, for each host if there are several.

    Input of the scan is one row per address and snapshot, so a busy address costs no more
    rows than there are snapshots. ``keep`` limits the arrivals remembered.
    """
    window_us, own = window_seconds * MICROS, scope(new)
    group = own + ["raddr_ip"]
    bucket = lambda us: F.floor(us / F.lit(window_us)).cast("bigint")
    fresh = (new.filter(~net.is_private(F.col("raddr_ip")))
             .groupBy(*group, F.unix_micros("snapshot_ts").alias("us"))
             .agg(F.count(F.lit(1)).alias("n")))
    # A snapshot is tested for an address if it had a new connection within the window.
    spans = fresh.select(*group, F.col("us").alias("seen"), F.explode(
        F.array(bucket(F.col("us")), bucket(F.col("us")) + 1)).alias("_b"))
    instants = clock.select(*own, F.unix_micros("snapshot_ts").alias("us")).withColumn("_b", bucket(F.col("us")))
    probes = (spans.join(instants, own + ["_b"])
              .filter((F.col("us") >= F.col("seen")) & (F.col("us") <= F.col("seen") + window_us))
              .select(*group, "us", F.lit(0).cast("bigint").alias("n")))
    rows = fresh.unionByName(probes).groupBy(*group, "us").agg(F.max("n").alias("n"))
    kinds = dict(rows.dtypes)
    return (rows.repartition(*group).sortWithinPartitions(*group, "us").mapInPandas(
        _beacon_scan(group, window_us, keep, least),
        ", ".join(f"{c} {kinds[c]}" for c in group) + ", us bigint, connections bigint, mean_s double, std_s double"))


def processes(snapshots: DataFrame) -> DataFrame:
    """Process records with names in lower case, defaults for nulls and the command as text."""
    return snapshots.select(
        *scope(snapshots), "snapshot_ts", "pid", F.coalesce("ppid", F.lit(0)).alias("ppid"),
        F.lower(F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("exe", F.lit("")).alias("exe"),
        F.coalesce(F.array_join("cmdline", " "), F.lit("")).alias("cmdline"),
        F.coalesce("username", F.lit("")).alias("username"), F.coalesce("cpu", F.lit(0.0)).alias("cpu"))


def with_parent(procs: DataFrame) -> DataFrame:
    """Add ``parent_name`` ('' if gone) and ``is_new`` (pid absent from the previous snapshot).

    A snapshot should list a pid once; if it repeats, the smallest name stands for the parent.
    """
    clock, own = ticks(procs), scope(procs)
    names = procs.groupBy(*own, "snapshot_ts", "pid").agg(F.min("name").alias("parent_name"))
    parents = names.withColumnRenamed("pid", "ppid")
    before = names.select(*own, F.col("snapshot_ts").alias("prev_ts"), "pid", F.lit(True).alias("_known"))
    return (procs.join(clock, own + ["snapshot_ts"])
            .join(parents, own + ["snapshot_ts", "ppid"], "left")
            .join(before, own + ["prev_ts", "pid"], "left")
            .withColumns({"parent_name": F.coalesce("parent_name", F.lit("")), "is_new": F.col("_known").isNull()})
            .select(*procs.columns, "prev_ts", "parent_name", "is_new"))


def process_findings(procs: DataFrame) -> DataFrame:
    """First check that hits per process; the first snapshot only teaches."""
    return judged_processes(with_parent(procs))


def judged_processes(procs: DataFrame) -> DataFrame:
    """Findings among processes of ``with_parent``."""
    bad = F.col("name").isin(R.BAD_PROCESSES) | F.lower("cmdline").rlike("|".join(R.BAD_PROCESSES))
    spawn = F.col("parent_name").isin(R.SUSPICIOUS_PARENTS) & F.col("name").isin(R.SUSPICIOUS_CHILDREN)
    check = (F.when(bad, "bad_process")
             .when(F.col("exe").rlike(rx(R.TEMP_DIR_PATTERN)), "tmp_execution")
             .when(F.col("is_new"), F.when(spawn, F.lit("suspicious_spawn")))
             .when(F.col("cpu") > R.CPU_THRESHOLD, "high_cpu"))
    rules = {"bad_process": "Malware Indicator", "tmp_execution": "Malware Indicator",
             "suspicious_spawn": "Reverse Shell Indicator", "high_cpu": "Suspicious Process"}
    return (procs.filter(F.col("prev_ts").isNotNull()).withColumn("finding", check)
            .filter(F.col("finding").isNotNull())
            .withColumns({"rule": lookup(rules, F.col("finding")),
                          "level": F.when(F.col("finding") == "high_cpu", "WARNING").otherwise("CRITICAL")})
            .drop("prev_ts"))


def fim_diff(baseline: DataFrame, current: DataFrame, emit_created: bool = False) -> DataFrame:
    """Files that were modified, changed permissions, vanished or (optionally) appeared.

    Where both tables have a ``host`` column, a host's files are compared with its own baseline;
    where both have ``snapshot_ts``, those of one instant.
    """
    key = [c for c in ("host", "snapshot_ts") if c in baseline.columns and c in current.columns] + ["path"]
    old = baseline.select(*key, *[F.col(c).alias("old_" + c) for c in ("sha256", "size", "mode")], F.lit(1).alias("_o"))
    new = current.select(*key, *[F.col(c).alias("new_" + c) for c in ("sha256", "size", "mode")], F.lit(1).alias("_n"))
    return judged_files(old.join(new, key, "full_outer"), emit_created)


def file_changes(snapshots: DataFrame) -> DataFrame:
    """``fim_diff`` of each snapshot ([host], snapshot_ts, path, sha256, size, mode) with the one before; new files are learnt silently."""
    own, order = scope(snapshots), W.partitionBy(*scope(snapshots)).orderBy("snapshot_ts")
    clock = ticks(snapshots).withColumn("next_ts", F.lead("snapshot_ts").over(order))
    known = (snapshots.join(clock, own + ["snapshot_ts"]).filter(F.col("next_ts").isNotNull())
             .select(*own, F.col("next_ts").alias("snapshot_ts"), "path", "sha256", "size", "mode"))
    current = snapshots.join(clock, own + ["snapshot_ts"]).filter(F.col("prev_ts").isNotNull()).select(*own, "snapshot_ts", "path", "sha256", "size", "mode")
    return fim_diff(known, current)


def judged_files(pairs: DataFrame, emit_created: bool = False) -> DataFrame:
    """What happened to files, from their old and new state (old_*, new_*; _o and _n tell which of them exist)."""
    change = (F.when(F.col("_n").isNull(), "deleted")
              .when(F.col("_o").isNull(), F.lit("created") if emit_created else F.lit(None))
              .when(F.col("old_sha256") != F.col("new_sha256"), "modified")
              .when(F.col("old_mode") != F.col("new_mode"), "permission_changed"))
    critical = F.col("change").isin("modified", "deleted")
    shown = lambda c, label: F.concat(F.lit(label), cut(F.col(c), 12), F.lit("…"))
    details = (F.when(F.col("change") == "permission_changed",
                      F.concat(F.lit("mode "), octal_mode(F.col("old_mode")), F.lit("→"), octal_mode(F.col("new_mode"))))
               .when(F.col("_n").isNotNull(), shown("new_sha256", "new_hash="))
               .otherwise(shown("old_sha256", "old_hash=")))
    return (pairs.withColumn("change", change).filter(F.col("change").isNotNull())
            .withColumns({"level": F.when(critical, "CRITICAL").otherwise("WARNING"), "details": details})
            .drop("_o", "_n"))


def deleted_paths(baseline: DataFrame, current: DataFrame) -> DataFrame:
    return baseline.select("path").join(current.select("path"), "path", "left_anti")


def baseline_view(baseline: DataFrame, limit: int = 500) -> DataFrame:
    return (baseline.select("path", F.concat(cut(F.col("sha256"), 16), F.lit("…")).alias("hash"), "size",
                            octal_mode(F.col("mode")).alias("mode")).orderBy("path").limit(limit))
