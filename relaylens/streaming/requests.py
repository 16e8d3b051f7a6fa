"""Requests whose messages arrive in several batches, held until they can be judged as a whole.

A request's messages wait in the state store until as many are there as the request says it has,
or until the watermark has passed the hold time after its first message; then all of
them leave in one batch, so that ``jobs.screen_stream`` sees the request whole and a hit in its last
message still blocks its first. ``complete`` tells the two apart. A request that has left leaves a mark for
the rest of the hold time, so that repeated messages do not start it again. A request is one call, so what
is held of it was one value of the client's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from relaylens.streaming.jobs import event_time

RELEASED = "request_id STRING, turn BIGINT, message STRING, complete BOOLEAN"
DONE = -1  # instead of the number of messages: the request has left


class _HoldProcessor(StatefulProcessor):
    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", "expected BIGINT, until BIGINT")
        self.messages = handle.getMapState("messages", "turn BIGINT", "message STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        stored = self.request.get()
        expected, until = stored if stored is not None else (None, None)
        if expected == DONE:
            for _ in rows:
                pass
            return
        for batch in rows:
            known = batch["expected"].dropna()
            if len(known):
                expected = max(int(known.max()), expected or 0)
            first = int(batch["ts_ms"].min()) + self.hold_ms
            if until is None or first < until:
                until = first
                self.handle.registerTimer(until)
            for turn, message in zip(batch["turn"].tolist(), batch["message"]):
                self.messages.updateValue((turn,), (message,))
        self.request.update((expected, until))
        if expected is not None:
            held = list(self.messages.iterator())
            if len(held) >= expected:
                yield self._left(key, held, True)
                self.request.update((DONE, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        stored = self.request.get()
        if stored is None or stored[1] > timerValues.getCurrentWatermarkInMs():
            return
        if stored[0] != DONE:
            held = list(self.messages.iterator())
            if held:
                yield self._left(key, held, False)
        self.request.clear()

    def _left(self, key, held: list, complete: bool) -> pd.DataFrame:
        self.messages.clear()
        return pd.DataFrame({"request_id": [key[0]] * len(held), "turn": [k[0] for k, _ in held],
                             "message": [v[0] for _, v in held], "complete": complete})

    def close(self) -> None:
        pass


def _opened(released: DataFrame, schema: StructType) -> DataFrame:
    return released.select(F.from_json("message", schema).alias("m"), "complete").select(
        "m.*", "complete")


def held_requests(messages: DataFrame, expected: str, hold: str = "10 minutes",
                  delay: str = "10 minutes") -> DataFrame:
    """The stream's rows again, all of a request in one batch, and whether it is ``complete``.

    ``messages`` has request_id, turn and ts; the column ``expected`` tells on any of a request's
    rows how many messages it has, or is null. Needs RocksDB.
    """
    minutes, unit = hold.split()
    if not unit.startswith("minute"):
        raise ValueError("the hold time is given in minutes")
    packed = messages.select(
        F.col("request_id").cast("string").alias("request_id"), F.col("turn").cast("bigint").alias(
            "turn"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col(expected).cast("bigint").alias("expected"),
        F.to_json(F.struct(*messages.columns)).alias("message"))
    released = event_time(packed, delay=delay).groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=_HoldProcessor(int(minutes) * 60_000), outputStructType=RELEASED,
        outputMode="Append", timeMode="EventTime")
    return _opened(released, messages.schema)


def left_over(spark: SparkSession, checkpoint: str, schema: StructType) -> DataFrame:
    """The rows of the requests that a drained query still holds. Only for the end of the input."""
    held = spark.read.format("statestore").option("stateVarName", "messages").load(checkpoint)
    return _opened(held.select(F.col("user_map_value.message").alias("message"),
                               F.lit(False).alias("complete")), schema)
