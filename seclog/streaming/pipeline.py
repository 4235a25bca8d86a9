"""Micro-batch pipeline: the batch operators plus small state tables.

Each micro-batch runs the same skew-safe operators as a batch job over its rows and the
bounded history they look back on. State and results of batch n are written to folders
named n, and state is read from folder n - 1, so a repeated batch gives the same result.

Every row is stored and judged when it arrives. History is kept ``SLACK_SECONDS`` longer
than the detectors look back, so rows late by up to that see all they need; a row later
than that sees less, and a batch re-run is the repair.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from seclog import refdata as R
from seclog.functions.technique import with_technique
from seclog.operators import alerts as A, correlate as C, dns as D, findings, forest as FO, rates, scans
from seclog.operators.annotate import annotate, apply_rules, with_channel
from seclog.operators.rates import MICROS
from seclog.schema import complete
from seclog.sources.text import number_copies, parse_syslog, trimmed_lines, with_ids
from seclog.storage import cut_lineage

STATE = {
    "clock": "us bigint",
    "rates": "source string, us bigint, n bigint",
    "attempts": "id string, ts timestamp, src_ip string, dst_port int, kind string, method string",
    "scans": "src_ip string, last_us bigint",
    "tactics": "id string, ts timestamp, source string, src_ip string, platform string, mitre_tactic string",
    "fires": "key string, chain_no int, last_us bigint",
    "alerts": "rule_name string, source string, last_us bigint",
    "queries": "id string, ts timestamp, domain string, client string, is_nxdomain boolean",
    "dns": "signal string, key string, last_us bigint",
    "model": "version int",
}


SLACK_SECONDS = 600


class StatePath:
    """Versions of the state tables under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, name: str, version: int) -> DataFrame:
        ddl = STATE[name]
        if version < 0:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet("%s/%s/v=%d" % (self.root, name, version))

    def find(self, name: str, version: int) -> DataFrame | None:
        """A version if it was written to its end."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path("%s/%s/v=%d/_SUCCESS" % (self.root, name, version))
        return self.read(name, version) if done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done) else None

    def write(self, name: str, df: DataFrame, version: int) -> None:
        fields = [part.strip().split(" ")[0] for part in STATE[name].split(",")]
        df.select(fields).write.mode("overwrite").parquet("%s/%s/v=%d" % (self.root, name, version))


def _last_per_key(old: DataFrame, new: DataFrame, keys: list[str], newest: int, gap_seconds: int) -> DataFrame:
    """Latest instant per key; keys whose gap has passed no longer matter."""
    both = old.select(*keys, "last_us").unionByName(new.select(*keys, "last_us"))
    return (both.groupBy(*keys).agg(F.max("last_us").alias("last_us"))
            .filter(F.col("last_us") > newest - (gap_seconds + SLACK_SECONDS) * MICROS))


def port_scans_batch(state: StatePath, attempts: DataFrame, batch_id: int, newest: int) -> DataFrame:
    """Scan findings of a micro-batch; keeps one window of attempts and the last findings."""
    before = state.read("attempts", batch_id - 1)
    known = cut_lineage(before.unionByName(attempts.select(before.columns)))
    fresh = attempts.select("src_ip", F.unix_micros("ts").alias("us"))
    found = cut_lineage(scans.port_scans(known, carry=state.read("scans", batch_id - 1), only=fresh))
    window = newest - (R.SCAN_WINDOW_SECONDS + SLACK_SECONDS) * MICROS
    state.write("attempts", known.filter(F.unix_micros("ts") >= window), batch_id)
    state.write("scans", _last_per_key(state.read("scans", batch_id - 1), found.withColumnRenamed("us", "last_us"),
                                       ["src_ip"], newest, R.SCAN_COOLDOWN_SECONDS), batch_id)
    return found


def chains_batch(state: StatePath, entries: DataFrame, batch_id: int, newest: int, chains=R.CHAINS) -> DataFrame:
    """Chains fired in a micro-batch; keeps the longest window of entries with a tactic twice over."""
    before = state.read("tactics", batch_id - 1)
    known = cut_lineage(before.unionByName(entries.filter(F.col("mitre_tactic") != "").select(before.columns)))
    fired = cut_lineage(C.correlate(known, chains, only=entries, carry=state.read("fires", batch_id - 1)))
    reach = newest - 2 * max(c.window_minutes for c in chains) * C.MINUTE - SLACK_SECONDS * MICROS
    state.write("tactics", known.filter(F.unix_micros("ts") >= reach), batch_id)
    state.write("fires", _last_per_key(state.read("fires", batch_id - 1), fired.withColumnRenamed("us", "last_us"),
                                       ["key", "chain_no"], newest, max(c.cooldown_minutes for c in chains) * 60), batch_id)
    return fired


def dns_batch(state: StatePath, entries: DataFrame, batch_id: int, newest: int) -> DataFrame:
    """DNS findings of a micro-batch; keeps one window of queries, from which the rates follow, and the last findings."""
    before, fired = state.read("queries", batch_id - 1), state.read("dns", batch_id - 1)
    fresh = cut_lineage(D.queries_from(entries).select(before.columns))
    known = cut_lineage(before.unionByName(fresh))
    found = cut_lineage(D.dns_findings(known, carry=fired, only=fresh))
    window = newest - (R.RATE_WINDOW_SECONDS + SLACK_SECONDS) * MICROS
    state.write("queries", known.filter(F.unix_micros("ts") >= window), batch_id)
    state.write("dns", _last_per_key(fired, found.withColumn("last_us", F.unix_micros("ts")), ["signal", "key"], newest, R.DNS_COOLDOWN_SECONDS), batch_id)
    return found


class EntryStream:
    """Annotates a stream of entries and raises alerts, with results under ``out``.

    ``monitors`` says that the stream holds entries of host monitors (``monitors.monitor_entries``),
    which keep a higher preset score, ``dns`` that names and rates in the log text are judged, as in
    ``run_pipeline``. ``forest`` is a folder of published models (``forest.publish_forest``): a batch is
    scored by the version that was the newest when it was first tried; a new version takes
    over between batches. Entries lie by batch, day and category.
    """

    def __init__(self, spark: SparkSession, state_dir: str, out: str, rules=R.RULES, chains=R.CHAINS, monitors: bool = False,
                 dns: bool = False, forest: str | None = None):
        self.state, self.out = StatePath(spark, state_dir), out.rstrip("/")
        self.rules, self.chains, self.monitors, self.dns, self.forest = rules, chains, monitors, dns, forest

    def _model(self, batch_id: int) -> int | None:
        """The model version of this batch; a repeated batch takes the one it took before."""
        chosen = self.state.find("model", batch_id)
        if chosen is None:
            version = FO.newest_forest(self.state.spark, self.forest)
            self.state.write("model", self.state.spark.createDataFrame([(version,)], STATE["model"]), batch_id)
            return version
        return chosen.first().version

    def process(self, entries: DataFrame, batch_id: int, sockets: DataFrame | None = None) -> None:
        """One micro-batch of entries, and of attempts read from socket captures."""
        state = self.state
        rows = cut_lineage(complete(entries).dropDuplicates(["id"]))
        moments = rows.select(F.unix_micros("ts").alias("us")).unionByName(state.read("clock", batch_id - 1))
        sockets = None if sockets is None else cut_lineage(sockets)  # the entries are the clock: captures may run ahead of them
        newest = moments.agg(F.coalesce(F.max("us"), F.lit(0)).alias("us")).first().us
        history = state.read("rates", batch_id - 1)
        version = None if self.forest is None else self._model(batch_id)
        scores = None if version is None else FO.published_scores(FO.feature_rows(apply_rules(rows, self.rules)), self.forest, version)
        noted = cut_lineage(annotate(rows, self.rules, preserve_preset=self.monitors, history=history, forest=scores))
        state.write("rates", rates.rate_history(rows, history, R.RATE_WINDOW_SECONDS + SLACK_SECONDS), batch_id)

        fired = chains_batch(state, noted, batch_id, newest, self.chains)
        links = noted.filter((F.col("category") == "network") & (F.col("src_ip") != "") & (F.col("dst_port") != 0))
        logs = noted.filter(F.col("category") == "log")
        feeds = [scans.log_attempts(logs), scans.connection_attempts(links)]
        attempts = scans.scan_attempts(*feeds, *([] if sockets is None else [sockets.select(feeds[0].columns)]))
        found = findings.from_port_scans(port_scans_batch(state, attempts, batch_id, newest))
        if self.dns:
            found = found.unionByName(findings.from_dns(dns_batch(state, logs, batch_id, newest)))
        extra = cut_lineage(with_technique(found).unionByName(findings.from_chains(fired)))
        everything = noted.unionByName(extra)

        before = state.read("alerts", batch_id - 1)
        alerts = cut_lineage(A.alerts_from(everything, carry=before))
        state.write("alerts", _last_per_key(before, alerts.withColumn("last_us", F.unix_micros("ts")), ["rule_name", "source"],
                                            newest, R.ALERT_COOLDOWN_SECONDS), batch_id)
        (with_channel(everything).withColumn("event_date", F.to_date("ts")).write.mode("overwrite").partitionBy("event_date", "category")
         .parquet("%s/entries/batch=%d" % (self.out, batch_id)))
        alerts.write.mode("overwrite").parquet("%s/alerts/batch=%d" % (self.out, batch_id))
        state.write("clock", state.spark.range(1).select(F.lit(newest).cast("bigint").alias("us")), batch_id)

    def start(self, entries: DataFrame, checkpoint: str, sockets: DataFrame | None = None, once: bool = False, **trigger):
        """Run over a streaming DataFrame of entries, and one of socket attempts; default trigger 250 milliseconds.

        ``once`` drops entries whose id any earlier batch had. The state store then holds every id for as
        long as the query lives; batch appends by ``EntryTable`` need no such state.
        """
        rows = complete(entries)
        rows = rows.dropDuplicates(["id"]) if once else rows
        both = rows.select(F.struct(*rows.columns).alias("entry"))
        kind = StructType.fromDDL(STATE["attempts"])
        if sockets is not None:
            both = both.unionByName(sockets.select(F.struct(*kind.names).cast(kind).alias("attempt")), allowMissingColumns=True)

        def step(batch: DataFrame, batch_id: int) -> None:
            stored = batch if sockets is None else cut_lineage(batch)
            self.process(stored.filter("entry IS NOT NULL").select("entry.*"), batch_id,
                         None if sockets is None else stored.filter("attempt IS NOT NULL").select("attempt.*"))

        return (both.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"processingTime": "250 milliseconds"})).start())


def tail_text(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of a folder of closed segments as a stream: (value, file).

    The file source reads each file once, when it appears; ``sources.tail`` follows files that grow.
    """
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("file"))


def syslog_entries(lines: DataFrame, year: int, as_of, name: str) -> DataFrame:
    """Entries of one micro-batch of tailed lines, with the ids that a batch read of the same files gives."""
    numbered = lines if "occurrence" in lines.columns else number_copies(trimmed_lines(lines), ["file", "value"])
    return complete(with_ids(parse_syslog(numbered, year, as_of, name)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal lines of a batch as one row, so that a line that fills the log travels once a batch."""
    for batch in batches:
        yield from pa.table(batch).group_by(["file", "value"]).aggregate([([], "count_all")]).rename_columns(["file", "value", "n"]).to_batches()


def _numbered(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    first = state.get[0] if state.exists else 0
    for pdf in batches:
        ends = first + pdf["n"].cumsum()
        yield pd.DataFrame({"file": pdf["file"], "value": pdf["value"], "first": ends - pdf["n"] + 1, "n": pdf["n"]})
        first = int(ends.iloc[-1])
    state.update((first,))


def number_lines(lines: DataFrame) -> DataFrame:
    """``number_copies`` on a stream of lines (value, file): each line's number among the equal lines of its file.

    The state is one count for each different line of a file, for as long as the query lives
    (RocksDB keeps it on disk). Equal lines are counted before they are shuffled; their rows are written out after.
    """
    few = trimmed_lines(lines).select("file", "value").mapInArrow(_counted, "file string, value string, n long")
    rows = (few.withColumn("line", F.unhex(F.md5("value"))).groupBy("file", "line")
            .applyInPandasWithState(_numbered, "file string, value string, first long, n long", "n long", "append", GroupStateTimeout.NoTimeout))
    return rows.select("file", "value", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("occurrence"))


def start_tail(lines: DataFrame, target: EntryStream, year: int, as_of, name: str, checkpoint: str, **trigger):
    """Tail syslog through the pipeline; default trigger 30 seconds.

    Lines of ``sources.tail`` (with ``position``) are numbered over the whole file, so ids are those
    of a batch read however the file was cut into triggers. Closed segments are whole in their batch.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        target.process(syslog_entries(batch, year, as_of, name), batch_id)

    rows = number_lines(lines) if "position" in lines.columns else lines
    return (rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start())
