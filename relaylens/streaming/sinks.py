"""Sinks whose retries leave the same result."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

logger = logging.getLogger(__name__)


def write_batch(df: DataFrame, path: str, epoch: int) -> None:
    """One folder per micro-batch: a retried batch replaces its own output."""
    df.write.mode("overwrite").parquet(f"{path}/batch={epoch}")


def each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None],
               mode: str = "append", every: str | None = None) -> DataStreamWriter:
    """A writer that hands micro-batches to ``handle``; without ``every`` it drains the source."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (stream.writeStream.foreachBatch(handle).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(**trigger))


def fan_out(stream: DataFrame, checkpoint: str,
            sinks: dict[str, Callable[[DataFrame, int], None]], errors_path: str,
            enabled: dict[str, bool] | None = None, every: str | None = None,
            dead_letters: str | None = None) -> DataStreamWriter:
    """Every batch to every enabled sink; a failing sink is recorded and stops no other.

    With ``dead_letters`` the rows of a failed batch are kept there, a folder for each sink and
    batch, for ``feed_again``.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        failures = []
        try:
            for name, sink in sinks.items():
                if not (enabled or {}).get(name, True):
                    continue
                try:
                    sink(batch, epoch)
                except Exception as error:
                    logger.error("sink %s failed in batch %d: %s", name, epoch, error)
                    failures.append((name, epoch, type(error).__name__))
                    if dead_letters is not None:
                        write_batch(batch, f"{dead_letters}/sink={name}", epoch)
            rows = batch.sparkSession.createDataFrame(
                failures, "sink STRING, epoch BIGINT, error STRING")
            write_batch(rows, errors_path, epoch)
        finally:
            batch.unpersist()

    return each_batch(stream, checkpoint, handle, every=every)


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The batches that were written below a path, by one listing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    root = folder(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(folder(f"{path}/batch=*/_SUCCESS")) if fs.exists(root) else None
    names = [status.getPath().getParent().getName() for status in done or []]
    return sorted(int(name.split("=")[1]) for name in names)


def waiting(spark: SparkSession, dead_letters: str, name: str) -> list[int]:
    """The batches that a sink has missed and not been fed again, oldest first."""
    fed = set(_epochs(spark, f"{dead_letters}-fed/sink={name}"))
    return [e for e in _epochs(spark, f"{dead_letters}/sink={name}") if e not in fed]


def feed_again(spark: SparkSession, dead_letters: str, name: str,
               sink: Callable[[DataFrame, int], None]) -> tuple[list[int], list[int]]:
    """Feeds a sink the batches that it missed, each under its own number; returns those that it
    took and those that still wait.

    A batch is marked once the sink has taken it, and not fed again. If the job ends between the
    two, the sink gets the batch under the same number again, which a sink that replaces its own
    output by number (``write_batch``) takes without repeating a row. A sink that fails keeps its
    batches; later batches are tried all the same.
    """
    taken, left = [], []
    for epoch in waiting(spark, dead_letters, name):
        rows = spark.read.parquet(f"{dead_letters}/sink={name}/batch={epoch}")
        try:
            sink(rows, epoch)
        except Exception as error:
            logger.error("sink %s failed again in batch %d: %s", name, epoch, error)
            left.append(epoch)
            continue
        mark = spark.createDataFrame([(name, epoch)], "sink STRING, epoch BIGINT")
        write_batch(mark, f"{dead_letters}-fed/sink={name}", epoch)
        taken.append(epoch)
    return taken, left


def drain(writer: DataStreamWriter, seconds: float | None = None) -> StreamingQuery:
    """Start a draining query and wait for its end, at most ``seconds``."""
    query = writer.start()
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream still running after {seconds} s")
    return query


def read_output(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the batches wrote; an empty frame if nothing was written yet."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")


class DroppedRows(StreamingQueryListener):
    """Counts, per query, every row that came after a watermark and was dropped.

    Add it with ``spark.streams.addListener`` before the query starts: progress reports that a
    query itself keeps are only the latest ones.
    """

    def __init__(self):
        self.by_query: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.by_query.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        dropped = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        key = str(event.progress.id)
        self.by_query[key] = self.by_query.get(key, 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
