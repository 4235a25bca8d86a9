"""Entries to several sinks in one pass, in batches of bounded size and age.

A channel's events wait in a stateful operator until ``most`` of them are there, or until
the oldest has waited ``wait_ms``; then they leave as one batch, in the order they came. The load may
be dealt over ``lanes``: each lane has its own batches, so a channel with most of the
events is not one task.

``route`` hands the batches of each micro-batch to the sinks of their channels, from one
stored copy. Sinks get a DataFrame and the micro-batch's number, which a sink that must not act
twice can remember: a micro-batch repeated after a failure holds the same batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from seclog.operators.annotate import channel, entry_json
from seclog.schema import complete
from seclog.storage import cut_lineage

#: Events that make a batch, and how long the first of them waits (milliseconds).
BATCH_EVENTS, BATCH_MILLIS = 40, 250

BATCHES = "channel string, lane int, reason string, n int, events array<string>"


class Batcher(StatefulProcessor):
    def __init__(self, most: int, wait_ms: int):
        self.most, self.wait = most, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event string")
        self.alarm = handle.getValueState("alarm", "ms bigint")

    def _batch(self, key, reason: str, events: list[str]) -> tuple:
        return (key[0], int(key[1]), reason, len(events), events)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [e for e, in self.waiting.get()] if self.waiting.exists() else []
        out = []
        for pdf in rows:
            held += pdf.sort_values("place", kind="stable")["event"].tolist()
            while len(held) >= self.most:
                out.append(self._batch(key, "size", held[:self.most]))
                held = held[self.most:]
        if out and self.alarm.exists():  # the events it was set for have left
            self.handle.deleteTimer(self.alarm.get()[0])
            self.alarm.clear()
        if held:
            self.waiting.put([(e,) for e in held])
            if not self.alarm.exists():
                ms = timerValues.getCurrentProcessingTimeInMs() + self.wait
                self.handle.registerTimer(ms)
                self.alarm.update((ms,))
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["channel", "lane", "reason", "n", "events"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [e for e, in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        self.alarm.clear()
        if held:
            yield pd.DataFrame([self._batch(key, "time", held)], columns=["channel", "lane", "reason", "n", "events"])

    def close(self) -> None:
        pass


def batches(entries: DataFrame, most: int = BATCH_EVENTS, wait_ms: int = BATCH_MILLIS, lanes: int = 1) -> DataFrame:
    """(channel, lane, reason, n, events) of a stream of entries: JSON events, at most ``most`` a batch.

    reason: size or time. Needs the RocksDB state store (``monitors.use_rocksdb``).
    """
    rows = complete(entries).select(
        channel(F.col("category")).alias("channel"), F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int").alias("lane"),
        F.concat_ws(" ", F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), "id").alias("place"), entry_json().alias("event"))
    return rows.groupBy("channel", "lane").transformWithStateInPandas(Batcher(most, wait_ms), BATCHES, "append", "processingTime")


def start_route(entries: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, most: int = BATCH_EVENTS,
                wait_ms: int = BATCH_MILLIS, lanes: int = 1, **trigger):
    """Send a stream of entries to ``sinks`` (by channel) in batches; default trigger 250 milliseconds."""

    def step(ready: DataFrame, batch_id: int) -> None:
        stored = cut_lineage(ready, "channel")
        for name, sink in sinks.items():
            sink(stored.filter(F.col("channel") == name), batch_id)

    return (batches(entries, most, wait_ms, lanes).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": f"{BATCH_MILLIS} milliseconds"})).start())
