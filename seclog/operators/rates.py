"""Event rates over sliding time ranges, and the statistical anomaly score.

A range window over the raw rows of one source would put a busy source on one task.
Rows are therefore first reduced to one count per (key, microsecond), which combines
before the shuffle. Windows then run per (key, time bucket) over those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seclog import refdata as R
from seclog.storage import cut_lineage

MICROS = 1_000_000


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def halo(df: DataFrame, width_us: int, us: str = "us") -> DataFrame:
    """Copy each row to its own time bucket and to the next one.

    A look-back of ``width_us`` from any own row then stays inside one bucket.
    """
    bucket = F.floor(F.col(us) / F.lit(width_us)).cast("bigint")
    copies = F.explode(F.array(
        F.struct(bucket.alias("_bucket"), F.lit(True).alias("_own")),
        F.struct((bucket + 1).alias("_bucket"), F.lit(False).alias("_own"))))
    return df.withColumn("_copy", copies).select(*df.columns, "_copy._bucket", "_copy._own")


def instants(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per (keys, us)."""
    return df.groupBy(*keys, "us").agg(F.count(F.lit(1)).alias("n"))


def sliding_sum(counts: DataFrame, keys: list[str], seconds: float, value: str = "n", out: str = "rate") -> DataFrame:
    """(keys, us, out): sum of ``value`` in [us - seconds, us] for every (keys, us); peers count.

    Spark evaluates a bounded range frame anew for every row. A running sum is linear, so
    each count enters at its instant and leaves again after ``seconds``. Buckets as long as
    the range keep the running sums apart: a bucket starts with the total of the one
    before, whose counts leave in it.
    """
    width = int(seconds * MICROS)
    bucket = F.floor(F.col("us") / F.lit(width)).cast("bigint")
    rows = counts.select(*keys, "us", F.col(value).alias("_v"), bucket.alias("_bucket"))
    moves = rows.select(*keys, F.explode(F.array(
        F.struct("_bucket", "us", "_v", F.lit(True).alias("_own")),
        F.struct((F.col("_bucket") + 1).alias("_bucket"), (F.col("us") + width + 1).alias("us"),
                 (-F.col("_v")).alias("_v"), F.lit(False).alias("_own")))).alias("m")).select(*keys, "m.*")
    carried = (rows.groupBy(*keys, "_bucket").agg(F.sum("_v").alias("_v"))
               .select(*keys, (F.col("_bucket") + 1).alias("_bucket"), ((F.col("_bucket") + 1) * width).alias("us"), "_v",
                       F.lit(False).alias("_own")))
    running = W.partitionBy(*keys, "_bucket").orderBy("us").rangeBetween(W.unboundedPreceding, 0)
    return (moves.unionByName(carried).withColumn(out, F.sum("_v").over(running))
            .filter("_own").select(*keys, "us", out))


def source_rate(df: DataFrame, seconds: int = R.RATE_WINDOW_SECONDS, key: str = "source",
                out: str = "source_rate") -> DataFrame:
    """Add the number of events of the same source in the last ``seconds``."""
    rows = df.withColumns({"us": micros(), key: F.coalesce(key, F.lit(""))})
    rates = sliding_sum(instants(rows, [key]), [key], seconds, out=out)
    return rows.join(rates, [key, "us"])


def global_rate(df: DataFrame, seconds: int = R.RATE_WINDOW_SECONDS) -> DataFrame:
    rows = df.withColumn("us", micros())
    rates = sliding_sum(instants(rows, []), [], seconds, out="global_rate")
    return rows.join(rates, "us")


def instant_table(per_source: DataFrame, seconds: int) -> DataFrame:
    """(us, global_rate, sources_seen) for every instant.

    ``sources_seen`` counts the sources with an event at or before us. Both are running sums
    inside time buckets. A bucket starts with what earlier ones hand on: the counts of the
    bucket before, and all sources seen so far. That needs one row per bucket only, so the
    window without keys below is small.
    """
    width = seconds * MICROS
    none = F.lit(0).cast("bigint")
    news = per_source.groupBy("source").agg(F.min("us").alias("us")).select("us", none.alias("n"), F.lit(1).alias("k"))
    bucket = F.floor(F.col("us") / F.lit(width)).cast("bigint").alias("_bucket")
    rows = (per_source.select("us", "n", none.alias("k")).unionByName(news)
            .groupBy("us").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select("us", "n", "k", bucket))
    moves = rows.select(F.explode(F.array(
        F.struct("_bucket", "us", "n", "k", F.lit(True).alias("_own")),
        F.struct((F.col("_bucket") + 1).alias("_bucket"), (F.col("us") + width + 1).alias("us"), (-F.col("n")).alias("n"),
                 none.alias("k"), F.lit(False).alias("_own")))).alias("m")).select("m.*")
    order = W.orderBy("_bucket")
    handed = rows.groupBy("_bucket").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(
        "_bucket", (F.col("_bucket") * width).alias("us"),
        F.coalesce(F.sum("n").over(order.rangeBetween(-1, -1)), none).alias("n"),
        F.coalesce(F.sum("k").over(order.rowsBetween(W.unboundedPreceding, -1)), none).alias("k"),
        F.lit(False).alias("_own"))
    running = W.partitionBy("_bucket").orderBy("us").rangeBetween(W.unboundedPreceding, 0)
    return (moves.unionByName(handed)
            .select("us", "_own", F.sum("n").over(running).alias("global_rate"), F.sum("k").over(running).alias("sources_seen"))
            .filter("_own").drop("_own"))


def sources_seen(df: DataFrame, seconds: int = R.RATE_WINDOW_SECONDS) -> DataFrame:
    """Add the number of distinct sources seen so far; it never shrinks."""
    rows = df.withColumn("us", micros())
    return rows.join(instant_table(instants(rows, ["source"]), seconds).drop("global_rate"), "us")


def rate_table(df: DataFrame, seconds: int = R.RATE_WINDOW_SECONDS, history: DataFrame | None = None) -> DataFrame:
    """(source, us, source_rate, global_rate, sources_seen) for every instant of every source.

    ``history`` (source, us, n) adds counts of earlier data, as ``rate_history`` keeps them.
    """
    per_source = instants(df.select("source", micros().alias("us")), ["source"])
    if history is not None:
        per_source = per_source.unionByName(history).groupBy("source", "us").agg(F.sum("n").alias("n"))
    own = sliding_sum(per_source, ["source"], seconds, out="source_rate")
    return own.join(instant_table(per_source, seconds), "us")


def rate_history(df: DataFrame, history: DataFrame | None, seconds: int = R.RATE_WINDOW_SECONDS) -> DataFrame:
    """(source, us, n) that later data needs: the last ``seconds`` of counts, and each
    source's first instant with a count of zero if it is older."""
    counts = instants(df.select("source", micros().alias("us")), ["source"])
    if history is not None:
        counts = counts.unionByName(history)
    newest = counts.agg(F.max("us").alias("_max"))
    firsts = counts.groupBy("source").agg(F.min("us").alias("us")).withColumn("n", F.lit(0).cast("bigint"))
    recent = (counts.crossJoin(F.broadcast(newest))  # one row
              .filter(F.col("us") >= F.col("_max") - seconds * MICROS).drop("_max"))
    return recent.unionByName(firsts).groupBy("source", "us").agg(F.sum("n").alias("n"))


def rate_anomaly(df: DataFrame, seconds: int = R.RATE_WINDOW_SECONDS, history: DataFrame | None = None) -> DataFrame:
    """Add ``stat_anomaly`` and ``stat_score``.

    A source is anomalous while its rate exceeds three times the mean rate per source
    seen. Only the anomalous (source, instant) pairs are joined to the rows. They are stored
    first: the side is small in normal traffic, and with its size known the rows need no shuffle then.
    """
    average = F.col("global_rate") / F.greatest(F.col("sources_seen"), F.lit(1))
    flagged = cut_lineage(rate_table(df, seconds, history)
                          .filter((average > 0) & (F.col("source_rate") > 3 * average))
                          .select("source", "us", F.lit(True).alias("_hot")))
    boost = F.when(F.col("level").isin("ERROR", "CRITICAL"), 0.3).otherwise(0.0)
    rows = df.withColumn("us", micros()).join(flagged, ["source", "us"], "left")
    return rows.withColumns({
        "stat_anomaly": F.coalesce("_hot", F.lit(False)),
        "stat_score": F.when(F.col("_hot"), F.least(F.lit(0.9) + boost, F.lit(1.0))).otherwise(boost),
    }).select(*df.columns, "stat_anomaly", "stat_score")


def combine_scores(df: DataFrame, preserve_preset: bool = False) -> DataFrame:
    """Set ``anomaly_score`` to the larger of the two scores and ``is_anomaly`` to their OR.

    The forest columns are optional. ``preserve_preset`` keeps a higher score that a
    monitor set before.
    """
    forest = "forest_score" in df.columns
    score = F.greatest("stat_score", "forest_score") if forest else F.col("stat_score")
    flag = F.col("stat_anomaly") | F.col("forest_anomaly") if forest else F.col("stat_anomaly")
    if preserve_preset:
        score = F.greatest(score, F.col("anomaly_score"))
        flag = flag | F.col("is_anomaly")
    return (df.withColumns({"anomaly_score": F.round(score, 4), "is_anomaly": flag})
            .drop("stat_score", "stat_anomaly", "forest_score", "forest_anomaly"))
