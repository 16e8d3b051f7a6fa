"""Live cooldowns, each with the reset hour and zone of its own key.

Per key the state store holds the end of its cooldown until the watermark has passed it; a timer
then emits a row that lifts the cooldown and drops the state, so the state holds what is cooling down
and no more. Errors may come late by ``delay`` and in any order: a cooldown ends at the latest reset
after any of them. Later ones are dropped and counted by ``sinks.DroppedRows``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from relaylens.functions import clock
from relaylens.operators import cooldown, state
from relaylens.sources import schemas
from relaylens.sources.keyed_table import BUCKETS, KeyedTable
from relaylens.streaming.jobs import event_time
from relaylens.streaming.sinks import each_batch, write_batch

SET, LIFTED = "set", "lifted"
CHANGES = "model_key STRING, change STRING, until_us BIGINT"


class _CooldownProcessor(StatefulProcessor):
    """Takes plain rows: a key has few of them, and a frame for each would cost more than its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until_us BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        until = max((row["until_us"] for row in rows if row["until_us"] is not None), default=None)
        stored = self.until.get()
        if until is not None and (stored is None or until > stored[0]):
            self.until.update((until,))
            self.handle.registerTimer(until // 1000)
            yield self._row(key, SET, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        stored = self.until.get()
        if stored is not None and stored[0] <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.until.clear()
            yield self._row(key, LIFTED, stored[0])

    def _row(self, key, change: str, until: int) -> Row:
        return Row(model_key=key[0], change=change, until_us=until)

    def close(self) -> None:
        pass


def live_cooldowns(errors: DataFrame, settings: DataFrame,
                   delay: str = "10 minutes") -> DataFrame:
    """(model_key, change, cooldown_until): cooldowns set, moved on and lifted; needs RocksDB.

    ``settings(model_key, hour, zone)`` has a row at most for a key; others reset at 0:00 UTC.
    """
    known = cooldown.with_settings(errors, settings)
    until = clock.next_reset(F.col("ts"), F.col("hour"), F.col("zone"))
    timed = event_time(known.withColumn("until_us", F.unix_micros(until.cast("timestamp"))),
                       delay=delay)
    changes = timed.select("model_key", "ts", "until_us").groupBy(
        "model_key").transformWithState(
        statefulProcessor=_CooldownProcessor(), outputStructType=CHANGES, outputMode="Append",
        timeMode="EventTime")
    return changes.select("model_key", "change", F.timestamp_micros("until_us").cast(
        "timestamp_ntz").alias("cooldown_until"))


def cooldown_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, path, schemas.COOLDOWNS, ["model_key"],
                      {"cooldown_until": state.GREATEST}, ["cooldown_until"], buckets)


def cooldown_event_stream(errors: DataFrame, settings: DataFrame, cooldowns: KeyedTable, out: str,
                          checkpoint: str, delay: str = "10 minutes",
                          every: str | None = None, compact_every: int = 16) -> DataStreamWriter:
    """Cooldowns merged into a table as deltas, and all changes written below ``out``."""
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            write_batch(batch, out, epoch)
            version = cooldowns.version_of(batch, epoch)
            cooldowns.merge(batch.filter(F.col("change") == SET), version=version)
            if version % compact_every == compact_every - 1:
                cooldowns.compact()
        finally:
            batch.unpersist()

    return each_batch(live_cooldowns(errors, settings, delay), checkpoint, handle, every=every)
