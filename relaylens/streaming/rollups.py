"""Summaries over windows of several sizes from one stateful aggregate.

The stream keeps panes of one minute. A pane that the watermark has passed is final; it joins the
table of the panes that open windows still need, and all windows that end up to the newest final
pane are merged from there and written once. However many sizes there are, a log row is put into
one pane.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from relaylens.sources.state_table import StateTable
from relaylens.streaming.jobs import event_time
from relaylens.streaming.sinks import each_batch, write_batch

# width and slide in minutes, both whole panes
WINDOWS = ((10, 1), (60, 10), (1440, 60))
PANES = ("pane TIMESTAMP, module_name STRING, total BIGINT, good BIGINT, timed BIGINT, ms DOUBLE, "
         "low DOUBLE, high DOUBLE")
OUT = ("minutes INT, window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, module_name STRING, "
       "total_requests BIGINT, successful_requests BIGINT, avg_response_time_ms DOUBLE, "
       "min_response_time_ms DOUBLE, max_response_time_ms DOUBLE")


def panes(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Mergeable sums per minute and module, for streams and tables alike."""
    timed = event_time(log, delay=delay) if log.isStreaming else log.withColumn(
        "ts", F.col("ts").cast("timestamp"))
    return timed.groupBy(F.window("ts", "1 minute"), "module_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("good"),
        F.count("response_time_ms").alias("timed"), F.sum("response_time_ms").alias("ms"),
        F.min("response_time_ms").alias("low"), F.max("response_time_ms").alias("high"),
    ).select(F.col("window.start").alias("pane"), "module_name", "total", "good", "timed", "ms",
             "low", "high")


def windows(of: DataFrame, after, until, sizes=WINDOWS) -> DataFrame:
    """All windows of all sizes that end after ``after`` (None: at any time), up to ``until``.

    ``of`` holds every pane from the start of these windows on. Windows without a row are left out.
    """
    parts = []
    for width, slide in sizes:
        cut = F.window("pane", f"{width} minutes", f"{slide} minutes")
        merged = of.withColumn("_window", cut).filter(F.col("_window.end") <= F.lit(until))
        if after is not None:
            merged = merged.filter(F.col("_window.end") > F.lit(after))
        parts.append(merged.groupBy("_window", "module_name").agg(
            F.sum("total").alias("total_requests"), F.sum("good").alias("successful_requests"),
            F.try_divide(F.sum("ms"), F.sum("timed")).alias("avg_response_time_ms"),
            F.min("low").alias("min_response_time_ms"), F.max("high").alias("max_response_time_ms"),
        ).select(F.lit(width).alias("minutes"),
                 F.col("_window.start").cast("timestamp_ntz").alias("window_start"),
                 F.col("_window.end").cast("timestamp_ntz").alias("window_end"), "module_name",
                 "total_requests", "successful_requests", "avg_response_time_ms",
                 "min_response_time_ms", "max_response_time_ms"))
    return reduce(DataFrame.unionByName, parts)


def rollup_stream(log: DataFrame, kept: StateTable, out: str, checkpoint: str, sizes=WINDOWS,
                  delay: str = "10 minutes", every: str | None = None) -> DataStreamWriter:
    """Closed windows of all sizes, written once (``sinks.read_output`` with ``OUT``).

    ``kept`` holds the panes of the longest window; its size does not follow the log's length. A
    repeated batch replaces its own windows and version.
    """
    longest = max(width for width, _ in sizes)

    def handle(batch: DataFrame, epoch: int) -> None:
        version = kept.version_of(batch, epoch)
        before = kept.read(before=version)
        batch.persist()
        try:
            ends = [df.agg((F.max("pane") + F.make_dt_interval(mins=F.lit(1))).alias("end")).first()["end"]
                    for df in (before, batch)]
            if ends[1] is None:  # no pane became final
                return
            known = before.unionByName(batch.select(*before.columns))
            write_batch(windows(known, *ends, sizes), out, epoch)
            needed = F.lit(ends[1]) - F.make_dt_interval(mins=F.lit(longest))
            kept.commit(known.filter(F.col("pane") >= needed), version=version)
        finally:
            batch.unpersist()

    return each_batch(panes(log, delay), checkpoint, handle, every=every)
