"""Models assessed again whenever log rows arrive, at a cost that does not follow the log's length.

The last hours are kept as panes: mergeable sums of each candidate over ten minutes. A batch is added
to the panes of its rows, and panes slide out once the whole of them is older than the window. Only
the oldest pane is cut by the window's edge; it alone is measured again from its rows, which lie in
a folder for each pane. Folders of batches with nothing left in the window are deleted.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from relaylens.functions import clock
from relaylens.operators import quality
from relaylens.session import remove
from relaylens.sources.state_table import StateTable
from relaylens.streaming.sinks import each_batch

PANE_SECONDS = 600
PANES = ("target_model STRING, pane BIGINT, total BIGINT, good BIGINT, timed BIGINT, ms DOUBLE, "
         "newest TIMESTAMP_NTZ")


def _pane(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (PANE_SECONDS * 1_000_000)).cast("bigint")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("target_model", *keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("good"),
        F.count("response_time_ms").alias("timed"), F.sum("response_time_ms").alias("ms"),
        F.max("ts").alias("newest"))


def _added(*sums: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    rows = sums[0]
    for more in sums[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("target_model", *keys).agg(
        *[F.sum(c).alias(c) for c in ("total", "good", "timed", "ms")],
        F.max("newest").alias("newest"))


class RecentLog:
    """The rows of the last hours and their panes, as of the newest row that was ever seen."""

    def __init__(self, spark: SparkSession, path: str, schema: str, hours: float = 24):
        self.spark, self.schema, self.hours = spark, f"{schema}, pane BIGINT", hours
        self.panes = StateTable(spark, f"{path}/panes", PANES)
        self._path = f"{path}/rows"

    def add(self, batch: DataFrame, version: int) -> datetime | None:
        """Takes a batch in and tells the clock: the newest time so far, None before any row. A
        repeated version replaces its own rows and panes. The clock never goes back."""
        before = self.panes.read(before=version)
        timed = batch.filter(F.col("ts").isNotNull()).withColumns(
            {"ts": F.col("ts").cast("timestamp_ntz"), "pane": _pane(F.col("ts"))})
        seen = timed.agg(F.max("ts").alias("t")).unionByName(before.agg(F.max("newest").alias("t")))
        now = seen.agg(F.max("t")).first()[0]
        if now is None:
            return None
        oldest = _pane(self._edge(now))
        live = timed.filter(F.col("pane") >= oldest)
        live.write.mode("overwrite").partitionBy("pane").parquet(f"{self._path}/batch={version}")
        self.panes.commit(_added(
            before.filter(F.col("pane") >= oldest), _sums(live, "pane").select(*before.columns),
            keys=("pane",)).select(*before.columns), version=version)
        return now

    def _edge(self, now: datetime) -> Column:
        return clock.instant(now - timedelta(hours=self.hours))

    def rows(self, now: datetime) -> DataFrame:
        """The log of the window; only folders of its panes are read."""
        kept = self.spark.read.schema(self.schema).parquet(self._path)
        return kept.filter((F.col("pane") >= _pane(self._edge(now)))
                           & (F.col("ts") > self._edge(now))).drop("pane", "batch")

    def measured(self, now: datetime) -> DataFrame:
        """What ``quality.measured`` gives for the window, from the panes and the oldest one's rows."""
        edge = self._edge(now)
        cut = self.spark.read.schema(self.schema).parquet(self._path).filter(
            (F.col("pane") == _pane(edge)) & (F.col("ts") > edge))
        whole = self.panes.read().filter(F.col("pane") > _pane(edge)).drop("pane")
        return _added(whole, _sums(cut).select(*whole.columns)).select(
            F.col("target_model").alias("candidate_model"), F.col("total").alias("_total"),
            F.col("good").alias("_good"), F.try_divide("ms", "timed").alias("_ms"))

    def forget(self, now: datetime) -> int:
        """Deletes the folders of batches that have no row in the window any more."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self._path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        micros = int((now - timedelta(hours=self.hours) - datetime(1970, 1, 1))
                     / timedelta(microseconds=1))
        oldest = micros // (PANE_SECONDS * 1_000_000)
        newest: dict[str, int] = {}
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self._path}/batch=*/pane=*")):
            folder = status.getPath()
            batch, pane = folder.getParent().toString(), int(folder.getName().split("=")[1])
            newest[batch] = max(pane, newest.get(batch, pane))
        over = [batch for batch, pane in newest.items() if pane < oldest]
        for batch in over:
            remove(self.spark, batch)
        return len(over)


def assess_schedule(log: DataFrame, recent: RecentLog, rules, weights: StateTable,
                    checkpoint: str, module: str = "quality",
                    every: str | None = "60 seconds") -> DataStreamWriter:
    """An assessment cycle whenever new log rows arrive, as of the newest row so far.

    A cycle reads its batch, the panes, and the rows of one pane. ``rules`` is a frame, or a function
    that every cycle calls to read the table as it is by then; a frame would keep the files it was
    listed with. Judges that were registered besides the bundled one get the rows of the window.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            now = recent.add(batch, recent.panes.version_of(batch, epoch))
        finally:
            batch.unpersist()
        if now is None:
            return
        version = weights.version_of(batch, epoch)
        weights.commit(quality.assessment_cycle(
            rules() if callable(rules) else rules, recent.rows(now), weights.read(before=version),
            now, module, recent.measured(now)), version=version)
        recent.forget(now)

    return each_batch(log, checkpoint, handle, every=every)
