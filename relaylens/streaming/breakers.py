"""Live circuit breakers over events that arrive out of order.

Per module the state store holds the machine and a reorder buffer: the events of each span of time
(a minute by default) that is not over yet, as packed pieces that are written once. A span is over once the watermark has
passed its end; a timer fires at the end of the first one, and the spans of the module that are over
are folded in order of time and id by the fold of the batch replay. So events that come up to ``delay`` late give what a replay of the whole
log gives; later ones are dropped before they reach the state, and ``sinks.DroppedRows`` counts them.

An opened breaker sets a second timer at the end of its recovery time. The row that it emits
(``kind`` is ``recovered``) tells from when calls are admitted again, whether or not one comes.

A module's events pass one task a batch, ``delay`` of them at most between two timers; buffers are read
and written span by span; the rows of a span go out before the next one is read. ``jobs.breaker_stream`` replays logs that arrive in order, and
deals a hot module over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from relaylens.operators import breaker
from relaylens.streaming.chunks import LAST_BATCH
from relaylens.streaming.jobs import event_time
from relaylens.streaming.sinks import each_batch, write_batch

HELD = ["event_id", "ts_us", "ok", "reset", "failure_threshold", "recovery_timeout",
        "success_threshold"]
CALL, RECOVERED = "call", "recovered"
OUT = ("kind STRING, event_id BIGINT, module_name STRING, ts TIMESTAMP_NTZ, state_before STRING, "
       "admitted BOOLEAN, state_after STRING, failure_count BIGINT, success_count BIGINT, "
       "last_failure_at TIMESTAMP_NTZ")
OUT_US = OUT.replace("ts TIMESTAMP_NTZ", "ts_us BIGINT").replace(
    "last_failure_at TIMESTAMP_NTZ", "last_failure_us BIGINT")
COLUMNS = [c.split()[0] for c in OUT_US.split(", ")]
PIECE_ROWS = 500_000  # a task gathers so many events of a module before it writes a piece a span


def packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows[HELD], preserve_index=False).replace_schema_metadata()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_all().to_pandas()


def recoveries(rows: pd.DataFrame, recovery_us: int, pending: int | None
               ) -> tuple[list[int], int | None]:
    """Ends of recovery times among replayed rows, and the one that lies beyond them."""
    opened = (rows["admitted"] & (rows["state_after"] == breaker.OPEN)).to_numpy(dtype=bool)
    closed = (rows["reset"] & (rows["state_before"] == breaker.OPEN)).to_numpy(dtype=bool)
    out = []
    for ts, opens in zip(rows["ts_us"][opened | closed], opened[opened | closed]):
        if pending is not None and pending <= ts:
            out.append(pending)
        pending = int(ts) + recovery_us if opens else None
    return out, pending


class _BreakerProcessor(StatefulProcessor):
    def __init__(self, span_seconds: int):
        self.span_us = span_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = breaker.BreakerFold()
        self.machine = handle.getValueState(
            "machine", "kind STRING, failures BIGINT, last BIGINT, pending BIGINT")
        self.buffer = handle.getMapState("buffer", "span BIGINT, piece BIGINT", "rows BINARY")
        self.pieces = handle.getValueState("pieces", "next BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        first, gathered, n = None, [], 0
        piece = (self.pieces.get() or (0,))[0]
        for batch in rows:
            gathered.append(batch[HELD])
            n += len(batch)
            if n >= PIECE_ROWS:
                first = self._write(gathered, piece, first)
                gathered, n, piece = [], 0, piece + 1
        if n:
            first = self._write(gathered, piece, first)
            piece += 1
        self.pieces.update((piece,))
        if first is not None:
            self._wake_after(first)
        return iter(())

    def _write(self, gathered: list[pd.DataFrame], piece: int, first: int | None) -> int | None:
        """A piece for each span of the rows; the earliest span so far."""
        rows = pd.concat(gathered)
        for span, part in rows.groupby(rows["ts_us"] // self.span_us):
            span = int(span)
            self.buffer.updateValue((span, piece), (packed(part),))
            first = span if first is None else min(first, span)
        return first

    def _wake_after(self, span: int) -> None:
        self.handle.registerTimer((span + 1) * self.span_us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        kind, failures, last, pending = self.machine.get() or (breaker.CLOSED, 0, None, None)
        state = [kind, failures] + ([] if kind == breaker.CLOSED else [last])
        waited, pieces = pending, {}
        for span, piece in sorted(self.buffer.keys()):
            pieces.setdefault(span, []).append(piece)
        for span in sorted(pieces):
            if (span + 1) * self.span_us > now:
                self._wake_after(span)  # the others wait for this one
                break
            rows = pd.concat([unpacked(self.buffer.getValue((span, piece))[0])
                              for piece in pieces[span]])
            rows = rows.assign(rank=~rows["reset"].astype(bool), module_name=key[0]).sort_values(
                ["ts_us", "event_id", "rank"], kind="stable", ignore_index=True)
            state, replayed = self.fold.advance(state, rows, True)
            ends, pending = recoveries(
                replayed, int(rows["recovery_timeout"].iloc[0]) * 1_000_000, pending)
            yield replayed.assign(kind=CALL).reindex(columns=COLUMNS)
            if ends:
                yield self._recovered(key, ends)
            for piece in pieces[span]:
                self.buffer.removeKey((span, piece))
        if pending is not None and pending <= now:
            yield self._recovered(key, [pending])
            pending = None
        if pending is not None and pending != waited:
            self.handle.registerTimer(-(-pending // 1000))
        kind, failures, *rest = state
        self.machine.update((kind, failures, rest[0] if rest else None, pending))

    def _recovered(self, key, ends: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"kind": RECOVERED, "module_name": key[0], "ts_us": ends,
                             "state_before": breaker.OPEN, "state_after": breaker.HALF_OPEN}
                            ).reindex(columns=COLUMNS)

    def close(self) -> None:
        pass


def _timed(rows: DataFrame) -> DataFrame:
    def moment(column):
        return F.timestamp_micros(column).cast("timestamp_ntz")

    return rows.withColumns({"ts": moment("ts_us"), "last_failure_at": moment("last_failure_us")}
                            ).select(*[c.split()[0] for c in OUT.split(", ")])


def live_breakers(log: DataFrame, configs: DataFrame, delay: str = "10 minutes",
                  span_seconds: int = 60) -> DataFrame:
    """State before and after every event of a stream, in the order of events; needs RocksDB.

    ``span_seconds`` is by how much rows may wait beyond ``delay``; longer spans are cheaper.
    """
    calls = breaker.outcomes(log, configs).withColumn(
        "ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return _timed(event_time(calls, delay=delay).select("module_name", "ts", *HELD).groupBy(
        "module_name").transformWithStateInPandas(
        statefulProcessor=_BreakerProcessor(span_seconds), outputStructType=OUT_US, outputMode="Append",
        timeMode="EventTime"))


def breaker_event_stream(log: DataFrame, configs: DataFrame, out: str, checkpoint: str,
                         delay: str = "10 minutes", span_seconds: int = 60,
                         every: str | None = None):
    """The rows of ``live_breakers``, a folder for each micro-batch."""
    return each_batch(live_breakers(log, configs, delay, span_seconds), checkpoint,
                      lambda batch, epoch: write_batch(batch, out, epoch), every=every)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def left_over(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The events that a drained query still holds, replayed from its machines by the batch
    operator, and the recovery times that are still to end. Only for the end of the input."""
    machines = _state(spark, checkpoint, "machine").select("key.module_name", "value.*")
    initial = machines.select("module_name", breaker.as_initial(
        F.col("kind"), F.col("failures"), F.col("last"),
        F.timestamp_micros("last").cast("timestamp_ntz")).alias("initial"))
    types = {"event_id": "BIGINT", "ts_us": "BIGINT", "ok": "BOOLEAN", "reset": "BOOLEAN"}
    schema = "module_name STRING, " + ", ".join(f"{c} {types.get(c, 'INT')}" for c in HELD)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, blob in zip(batch["module_name"], batch["rows"]):
                yield unpacked(blob).assign(module_name=name)[["module_name", *HELD]]

    held = _state(spark, checkpoint, "buffer").select(
        "key.module_name", "user_map_value.rows").mapInPandas(rows, schema)
    calls = held.withColumn("ts", F.timestamp_micros("ts_us").cast("timestamp_ntz")).drop("ts_us")
    known = calls.join(initial.withColumnRenamed("module_name", "_name"),
                       F.col("module_name").eqNullSafe(F.col("_name")), "left").drop("_name")
    replayed = breaker.replay(known).withColumn("kind", F.lit(CALL))
    opened = replayed.filter(F.col("admitted") & (F.col("state_after") == breaker.OPEN)).join(
        calls.groupBy("module_name").agg(F.max("recovery_timeout").alias("secs")).withColumnRenamed(
            "module_name", "_name"), F.col("module_name").eqNullSafe(F.col("_name")))
    ends = opened.select("module_name", (F.col("ts") + F.make_dt_interval(secs="secs")).alias(
        "ts")).unionByName(machines.filter("pending IS NOT NULL").select(
            "module_name", F.timestamp_micros("pending").cast("timestamp_ntz").alias("ts")))
    recovered = ends.select(
        F.lit(RECOVERED).alias("kind"), "module_name", "ts",
        F.lit(breaker.OPEN).alias("state_before"), F.lit(breaker.HALF_OPEN).alias("state_after"))
    return replayed.drop("reset", "ok").unionByName(recovered, allowMissingColumns=True).select(
        *[c.split()[0] for c in OUT.split(", ")])


def write_left_over(spark: SparkSession, out: str, checkpoint: str) -> None:
    """Writes ``left_over`` as the last batch of a drained query."""
    write_batch(left_over(spark, checkpoint), out, LAST_BATCH)
