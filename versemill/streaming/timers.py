"""Keyed state with timers (R10, R11): what must happen when nothing comes any more.

State is kept by account with ``transformWithState``: a timer in event time fires as soon as the watermark passes it, moved by
whatever other accounts do, and with timers in processing time as soon as the clock does, without any event at all. Timers
also clear the state of accounts that have gone silent, so it is bounded by what is active. State rows can be read back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .pipelines import ADMITTED, Admission

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state where timers are supported."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The state of a stopped stream: a row for each key."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


class QuietTrigger(StatefulProcessor):
    """(key, at, n) when a key has had no event for ``quiet_ms``: the time to act on one's own, and the events since the time before."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.active.get() or (None, 0)
        before = last
        fired = []
        for t in sorted(x for pdf in rows for x in pdf["at_ms"].tolist()):  # one batch's times of one key
            if last is not None and t - last >= self.quiet_ms:
                fired.append((key[0], last + self.quiet_ms, n))
                n = 0
            last, n = t if last is None else max(last, t), n + 1
        if before is not None:
            self.handle.deleteTimer(before + self.quiet_ms)
        self.handle.registerTimer(last + self.quiet_ms)
        self.active.update((last, n))
        yield pd.DataFrame(fired, columns=["key", "at_ms", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, n = self.active.get()
        self.active.clear()
        yield pd.DataFrame([(key[0], last + self.quiet_ms, n)], columns=["key", "at_ms", "n"])

    def close(self) -> None:
        pass


def quiet_triggers(stream: DataFrame, key: str, at: str, quiet_seconds: int = 2700, late: str = "0 seconds") -> DataFrame:
    """(key, at, n) of every quiet period as soon as it is over; a stream with event time ``at`` as a timestamp."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at")).withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    fired = rows.groupBy("key").transformWithStateInPandas(QuietTrigger(quiet_seconds * 1000), "key string, at_ms long, n long", "append", "eventTime")
    return fired.select("key", F.timestamp_millis("at_ms").alias("at"), "n")


class AdmissionState(StatefulProcessor):
    """R10 by account: times of the last day's admissions, in total and for each text, and when they are cleared, a day after the last.

    They are one value of state, read once and written once for an account and batch: what a batch costs is calls to the state.
    """

    def __init__(self, rules: Admission):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long, posts array<double>, texts array<string>, times array<array<double>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, posts, texts, times = self.until.get() or (None, [], [], [])
        posts, seen = [*posts], {text: [*at] for text, at in zip(texts, times)}
        for at, number, text in sorted(((r.at, r.id, r.text or "") for r in rows), key=lambda r: r[:2]):  # one batch's items of one account
            reason = self.rules.decide(at, text, posts, seen)
            yield Row(id=number, key=key[0], admitted=not reason, reason=reason)
        if not posts:
            if before is not None:
                self.handle.deleteTimer(before)
                self.until.clear()
            return
        kept = self.rules.recent(posts, seen)
        until = int(max(posts) * 1000) + DAY_MS
        if before != until:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        self.until.update((until, posts, [*kept], [*kept.values()]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def admission(stream: DataFrame, rules: Admission | None = None, late: str = "0 seconds") -> DataFrame:
    """R10 on a stream (id, key, ts, text) in order of time."""
    rows = stream.select("id", "key", "ts", "text").withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / 1e6)
    return rows.groupBy("key").transformWithState(AdmissionState(rules or Admission()), ADMITTED, "append", "eventTime")


def drain_with_timers(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Run a stream with timers over what is there and stop, as ``pipelines.drain``."""
    from .pipelines import drain

    with timer_state(stream.sparkSession):
        drain(stream, checkpoint, "append", sink)
