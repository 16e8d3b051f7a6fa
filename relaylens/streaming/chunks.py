"""Restoring tokens in streamed responses, where a token may be cut by a chunk boundary.

Each chunk is emitted without the end that may still become a token; that end is held and put
before the next chunk. The concatenated output equals the restored concatenated input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from relaylens.functions import pii
from relaylens.operators.pii import restore
from relaylens.operators.slices import Fold, run_fold, sorted_slices
from relaylens.streaming.sinks import each_batch, write_batch

_TOKEN, _PARTIAL = re.compile(pii.TOKEN_PATTERN), re.compile(pii.PARTIAL_PATTERN)

SAFE = "request_id STRING, seq BIGINT, safe STRING"
LAST_BATCH = (1 << 62)  # the folder of what is released after the last micro-batch


def split_held(text: str) -> tuple[str, str]:
    """The text that can go out, and the end that may still become a token."""
    opened = text.rfind("[")
    if opened < 0 or _TOKEN.search(text, opened) or not _PARTIAL.match(text[opened:]):
        return text, ""
    return text[:opened], text[opened:]


def _feed(tail: str, delta, finish_reason) -> tuple[str, str]:
    """``(safe text, new tail)``; the last chunk flushes, even when its delta is null."""
    text = tail + (delta if isinstance(delta, str) else "")
    if isinstance(finish_reason, str) and finish_reason:
        return text, ""
    return split_held(text)


class _ChunkFold(Fold):
    key, output_schema = "request_id", SAFE

    def initial(self, rows):
        return ""

    def advance(self, state, rows, emit):
        safe = []
        for delta, finish in zip(rows["delta"], rows["finish_reason"]):
            out, state = _feed(state, delta, finish)
            safe.append(out)
        if not emit:
            return state, None
        return state, pd.DataFrame({"request_id": rows["request_id"].to_numpy(),
                                    "seq": rows["seq"].to_numpy(), "safe": safe})


def release(chunks: DataFrame, slices: int | None = None) -> DataFrame:
    """Batch form: the safe text of every chunk, over slices that may cut a response."""
    return run_fold(sorted_slices(chunks, "request_id", ["seq"], slices), _ChunkFold())


def restore_chunks(chunks: DataFrame, store: DataFrame, as_of,
                   slices: int | None = None) -> DataFrame:
    return restore(release(chunks, slices), "safe", ["request_id", "seq"], store, as_of,
                   into="delta").select("request_id", "seq", "delta")


FINISHED = -1  # the next chunk of a response whose last chunk was there


def flush(tail: str, upcoming: int, early: list[tuple]) -> list[tuple[int, str, int]]:
    """``(seq, safe text, chunks missing before it)`` of all that is held of a response that will
    not go on: the held end, then what came too early, in order."""
    out, expected = [], upcoming
    for seq, delta, finish in sorted(early, key=lambda c: c[0]):
        if seq > expected and tail:  # nothing can complete the held end any more
            out.append((expected, tail, 0))
            tail = ""
        safe, tail = _feed(tail, delta, finish)
        out.append((seq, safe, seq - expected))
        expected = seq + 1
    if tail:
        out.append((expected, tail, 0))
    return out


BLOCK = 1024  # so many places of chunks that came too early are one value of the state
_EARLY = pa.schema([("seq", pa.int64()), ("delta", pa.string()), ("finish", pa.string())])


def _text(value):
    return value if isinstance(value, str) else None


def _packed(early: dict) -> bytes:
    columns = [list(early), [_text(d) for d, _ in early.values()],
               [_text(f) for _, f in early.values()]]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _EARLY) as out:
        out.write_table(pa.table(columns, schema=_EARLY))
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(blob).read_all()
    return list(zip(*(column.to_pylist() for column in table.columns)))


class _Early:
    """The early chunks of one response during one call: a block is read when it is first needed,
    and written once, at the end, if it has changed."""

    def __init__(self, state):
        self.state, self.blocks, self.stored, self.changed = state, {}, set(), set()

    def _block(self, seq: int) -> dict:
        number = seq // BLOCK
        if number not in self.blocks:
            found = self.state.containsKey((number,))
            self.blocks[number] = {s: (d, f) for s, d, f in _unpacked(
                self.state.getValue((number,))[0])} if found else {}
            if found:
                self.stored.add(number)
        return self.blocks[number]

    def put(self, seq: int, delta, finish) -> None:
        self._block(seq)[seq] = (delta, finish)
        self.changed.add(seq // BLOCK)

    def pop(self, seq: int) -> tuple | None:
        chunk = self._block(seq).pop(seq, None)
        if chunk is not None:
            self.changed.add(seq // BLOCK)
        return chunk

    def write(self) -> None:
        for number in sorted(self.changed):
            if self.blocks[number]:
                self.state.updateValue((number,), (_packed(self.blocks[number]),))
            elif number in self.stored:
                self.state.removeKey((number,))


class _ChunkProcessor(StatefulProcessor):
    """Holds per request the tail, the next expected chunk, and chunks that came too early, packed
    by blocks of their numbers: a call to the state store costs more than many chunks.

    A finished response leaves a mark, so that repeated chunks are not sent again; with a limit
    on idle time the mark goes after it, and unfinished responses are flushed after it.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "tail STRING, next BIGINT")
        self.early = handle.getMapState("early", "block BIGINT", "rows BINARY")

    def _rows(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"request_id": [key[0]] * len(out), "seq": [r[0] for r in out],
                             "safe": [r[1] for r in out], "missing": [r[2] for r in out]})

    def _clear_timers(self) -> None:
        for moment in list(self.handle.listTimers()):
            self.handle.deleteTimer(moment)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        stored = self.progress.get()
        tail, upcoming = stored if stored is not None else ("", 0)
        early = _Early(self.early)
        for batch in rows:
            out = []
            ordered = batch.sort_values("seq")
            for seq, delta, finish in zip(ordered["seq"].tolist(), ordered["delta"],
                                          ordered["finish_reason"]):
                if upcoming == FINISHED or seq < upcoming:
                    continue  # a repeated chunk
                if seq > upcoming:
                    early.put(seq, delta, finish)
                    continue
                while True:
                    safe, tail = _feed(tail, delta, finish)
                    out.append((upcoming, safe, 0))
                    if isinstance(finish, str) and finish:
                        tail, upcoming = "", FINISHED
                        break
                    upcoming += 1
                    chunk = early.pop(upcoming)
                    if chunk is None:
                        break
                    delta, finish = chunk
            if out:
                yield self._rows(key, out)
        if upcoming == FINISHED:
            self.early.clear()
        else:
            early.write()
        self.progress.update((tail, upcoming))
        if self.idle_ms is not None:
            self._clear_timers()
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """A response that never finished: what was held goes out, then its state ends."""
        stored = self.progress.get()
        if stored is not None and stored[1] != FINISHED:
            early = [chunk for value in self.early.values() for chunk in _unpacked(value[0])]
            out = flush(stored[0], stored[1], early)
            if out:
                yield self._rows(key, out)
        self.progress.clear()
        self.early.clear()

    def close(self) -> None:
        pass


RELEASED = StructType([StructField("request_id", StringType()), StructField("seq", LongType()),
                       StructField("safe", StringType()), StructField("missing", LongType())])


def release_stream(chunks: DataFrame, idle_minutes: float | None = None) -> DataFrame:
    """Streaming form of ``release``; needs the RocksDB state store.

    ``missing`` counts the chunks that were given up before a row. With ``idle_minutes`` a
    response that stops without its last chunk is flushed. That needs timers on the wall clock,
    which keep a query running, so a draining job leaves them out and flushes with ``left_over``.
    """
    idle_ms = None if idle_minutes is None else int(idle_minutes * 60_000)
    return (chunks.select("request_id", "seq", "delta", "finish_reason").groupBy("request_id")
            .transformWithStateInPandas(
                statefulProcessor=_ChunkProcessor(idle_ms), outputStructType=RELEASED,
                outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime"))


def left_over(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the state of a drained query still holds of unfinished responses, released.

    Only for the end of the input: a later run on the same checkpoint would release it again.
    A response was one value of one row, so gathering its early chunks restores no more.
    """
    def part(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    held = part("progress").select(F.col("key.request_id").alias("request_id"), "value.*").filter(
        F.col("next") != FINISHED)
    early = part("early").select(F.col("key.request_id").alias("request_id"),
                                 F.col("user_map_value.rows").alias("block"))
    both = held.join(early.groupBy("request_id").agg(F.collect_list("block").alias("early")),
                     "request_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(request, *row) for request, tail, upcoming, early_ in zip(
                rows["request_id"], rows["tail"], rows["next"], rows["early"])
                for row in flush(tail or "", int(upcoming), [
                    chunk for block in (early_ if early_ is not None else [])
                    for chunk in _unpacked(block)])]
            yield pd.DataFrame(out, columns=RELEASED.fieldNames())

    return both.select("request_id", "tail", "next", "early").mapInPandas(run, RELEASED)


def restore_stream(chunks: DataFrame, store, as_of, out: str, checkpoint: str,
                   idle_minutes: float = 30, every: str | None = None):
    """Each micro-batch of released text is restored against the token store.

    ``store`` is a frame, or a function that each batch calls to read the store as it is by
    then; ``as_of`` is a time, or a function of the batch that tells it.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            write_batch(_restored(batch, store, as_of), out, epoch)
        finally:
            batch.unpersist()

    released = release_stream(chunks, idle_minutes if every else None)
    return each_batch(released, checkpoint, handle, every=every)


def _restored(batch: DataFrame, store, as_of) -> DataFrame:
    known = store() if callable(store) else store
    moment = as_of(batch) if callable(as_of) else as_of
    return restore(batch, "safe", ["request_id", "seq"], known, moment, into="delta").select(
        "request_id", "seq", "delta", "missing")


def restore_left_over(spark: SparkSession, store, as_of, out: str, checkpoint: str) -> None:
    """Writes what a drained query still held as its last batch; see ``left_over``."""
    left = left_over(spark, checkpoint).persist()
    try:
        write_batch(_restored(left, store, as_of), out, LAST_BATCH)
    finally:
        left.unpersist()
