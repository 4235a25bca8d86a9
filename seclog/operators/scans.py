"""Port scans: distinct destination ports per source address in a sliding range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from seclog import refdata as R
from seclog.functions import net
from seclog.operators.cooldown import cooldown
from seclog.operators.rates import MICROS, halo, sliding_sum
from seclog.storage import cut_lineage


def log_attempts(entries: DataFrame) -> DataFrame:
    """Attempts found in log text: one per entry and pattern that hits."""
    text = F.concat_ws(" ", F.coalesce("message", F.lit("")), F.coalesce("raw", F.lit("")))
    texts = entries.select("id", "ts", text.alias("_text")).filter(net.may_probe(F.col("_text")))
    found = texts.select("id", "ts", F.explode(net.probes(F.col("_text"))).alias("p")).select("id", "ts", "p.*")
    return found.filter(~net.is_skipped(F.col("src_ip"))).withColumn("method", F.lit("log"))


def connection_attempts(connections: DataFrame, method: str = "psutil") -> DataFrame:
    """Attempts from records that already hold src_ip and dst_port."""
    return (connections.filter((F.col("src_ip") != "") & ~net.is_skipped(F.col("src_ip")))
            .select("id", "ts", "src_ip", "dst_port", F.lit("connection").alias("kind"),
                    F.lit(method).alias("method")))


def scan_attempts(*feeds: DataFrame) -> DataFrame:
    """One attempt stream from several feeds."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def fanout_table(attempts: DataFrame, seconds: int = R.SCAN_WINDOW_SECONDS) -> DataFrame:
    """(src_ip, us, unique_ports, attempts) for every instant of every address.

    Port 0 triggers an evaluation but is not counted. A distinct count over a sliding
    range is a running sum: +1 when a port appears after more than ``seconds`` of
    silence, -1 when its last attempt leaves the range. Both come from the neighbours of
    an attempt on the same port, so no row carries a set, and an address has at most a
    few marks per port and bucket.
    """
    width = seconds * MICROS
    rows = attempts.select("src_ip", "dst_port", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    per_port = rows.groupBy("src_ip", "dst_port", "us").agg(F.count(F.lit(1)).alias("n"))
    by_port = W.partitionBy("src_ip", "dst_port", "_bucket").orderBy("us")
    ports = (halo(per_port.filter("dst_port != 0"), width)
             .withColumns({"_prev": F.lag("us").over(by_port), "_next": F.lead("us").over(by_port)}))
    appears = (F.col("_prev").isNull() | (F.col("_prev") < F.col("us") - width)).cast("bigint")
    leaves = (F.col("_next").isNull() | (F.col("_next") > F.col("us") + width)).cast("bigint")
    marks = ports.select("src_ip", "_bucket", F.explode(F.array(
        F.struct(F.col("us").alias("us"), appears.alias("delta")),
        F.struct((F.col("us") + width + 1).alias("us"), (-leaves).alias("delta")))).alias("m")
    ).select("src_ip", "_bucket", "m.us", "m.delta").filter("delta != 0")
    marks = marks.groupBy("src_ip", "_bucket", "us").agg(F.sum("delta").alias("delta"))

    tries = per_port.groupBy("src_ip", "us").agg(
        F.sum(F.when(F.col("dst_port") != 0, F.col("n")).otherwise(0)).alias("n"))
    rated = sliding_sum(tries, ["src_ip"], seconds, out="attempts")
    asked = rated.withColumn("_bucket", F.floor(F.col("us") / F.lit(width)).cast("bigint"))
    both = (asked.withColumn("delta", F.lit(0).cast("bigint"))
            .unionByName(marks, allowMissingColumns=True))
    running = W.partitionBy("src_ip", "_bucket").orderBy("us").rangeBetween(W.unboundedPreceding, 0)
    return (both.withColumn("unique_ports", F.sum("delta").over(running))
            .filter(F.col("attempts").isNotNull())
            .select("src_ip", "us", "unique_ports", "attempts"))


def port_fanout(attempts: DataFrame, seconds: int = R.SCAN_WINDOW_SECONDS) -> DataFrame:
    """Add unique_ports and attempts in [ts - seconds, ts] to every attempt."""
    rows = attempts.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.join(fanout_table(attempts, seconds), ["src_ip", "us"])


def port_scans(attempts: DataFrame, threshold: int = R.SCAN_PORT_THRESHOLD, seconds: int = R.SCAN_WINDOW_SECONDS,
               cooldown_seconds: int = R.SCAN_COOLDOWN_SECONDS, carry: DataFrame | None = None,
               only: DataFrame | None = None) -> DataFrame:
    """Scan findings: at least ``threshold`` distinct ports, then silent for the cooldown.

    With ``only`` (src_ip, us) just these instants are judged and other attempts fill the
    window; ``carry`` (src_ip, last_us) holds the last findings.
    """
    # Read several times by the cooldown, so the few instants above the threshold are stored.
    wide = fanout_table(attempts, seconds).filter(F.col("unique_ports") >= threshold)
    if only is not None:
        wide = wide.join(only.distinct(), ["src_ip", "us"], "left_semi")
    wide = cut_lineage(wide.withColumn("ts", F.timestamp_micros("us")))
    fired = cooldown(wide, ["src_ip"], cooldown_seconds, order=["us"], carry=carry)
    rows = attempts.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    trigger = (rows.join(fired.drop("ts"), ["src_ip", "us"])
               .groupBy("src_ip", "us", "unique_ports", "attempts")
               .agg(F.min_by(F.struct("id", "dst_port", "method"), F.struct("id", "dst_port", "method")).alias("t")))
    return trigger.select("src_ip", "us", F.timestamp_micros("us").alias("ts"), "unique_ports", "attempts",
                          "t.id", "t.dst_port", "t.method")


def live_scanners(attempts: DataFrame, k: int = 10, seconds: int = R.SCAN_WINDOW_SECONDS) -> DataFrame:
    """Addresses by distinct ports in the window that ends at their last attempt.

    Only the attempts of that last window are counted, so no sliding state is needed.
    """
    rows = attempts.select("src_ip", "dst_port", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    counts = rows.groupBy("src_ip", "dst_port", "us").agg(F.count(F.lit(1)).alias("n"))
    last = counts.groupBy("src_ip").agg(F.max("us").alias("last_us"))
    recent = (counts.join(last, "src_ip")
              .filter((F.col("us") >= F.col("last_us") - seconds * MICROS) & (F.col("dst_port") != 0)))
    return (recent.groupBy("src_ip").agg(F.countDistinct("dst_port").alias("unique_ports"),
                                         F.sum("n").alias("count"))
            .withColumnRenamed("src_ip", "ip")
            .orderBy(F.desc("unique_ports"), "ip").limit(k))


def merge_scanners(live: DataFrame, stored: DataFrame, k: int = 20) -> DataFrame:
    """Live and stored scanners side by side; live ports decide the order where there are any."""
    joined = live.withColumnRenamed("count", "live_count").join(
        stored.withColumnRenamed("count", "stored_count"), "ip", "full_outer")
    ports = F.coalesce("unique_ports", F.lit(0))
    count = F.greatest(F.coalesce("live_count", F.lit(0)), F.coalesce("stored_count", F.lit(0)))
    return (joined.select("ip", ports.cast("bigint").alias("unique_ports"), count.cast("bigint").alias("count"))
            .orderBy(F.desc(F.when(F.col("unique_ports") > 0, F.col("unique_ports")).otherwise(F.col("count"))), "ip")
            .limit(k))
