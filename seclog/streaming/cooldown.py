"""Cooldown as a stateful stream operator: one instant of state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from seclog.operators.rates import MICROS


def _step(gap_us: int, columns: list[str], order: list[str]):
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["_us", *order])
        last = state.get[0] if state.exists else None
        hits = []
        for i, us in enumerate(pdf["_us"].tolist()):
            if last is None or us - last >= gap_us:
                last = us
                hits.append(i)
        state.update((last,))
        expiry = (last + gap_us) // 1000
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pdf.iloc[hits][columns]

    return run


def cooldown_stream(df: DataFrame, keys: list[str], gap_seconds: int, ts: str = "ts", order: list[str] = ("id",),
                    delay: str = "10 minutes") -> DataFrame:
    """Rows that pass, per key and micro-batch in time order.

    Rows older than the watermark are dropped. A key's state leaves once its gap has passed
    the watermark, when it could no longer hold back a row.

    Repeats of one key and instant are removed before the shuffle's stateful side: they
    can never pass twice.
    """
    stream = (df.withWatermark(ts, delay).withColumn("_us", F.unix_micros(F.col(ts)))
              .dropDuplicatesWithinWatermark([*keys, "_us"]))
    schema = ", ".join("`%s` %s" % (f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return stream.groupBy(*keys).applyInPandasWithState(
        _step(gap_seconds * MICROS, df.columns, list(order)), schema, "last bigint", "append",
        GroupStateTimeout.EventTimeTimeout)
