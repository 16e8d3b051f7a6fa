"""A keyed state table as numbered, immutable Parquet versions.

Spark cannot overwrite a path it is reading, so each commit writes the next version and readers
take the newest one whose write finished. A retried commit with the same version number
replaces its own half-written folder, which keeps streaming batches idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relaylens.session import remove

KEPT_VERSIONS = 3  # the newest ones; a batch reads the one before its own


class StateTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _location(self, version: int) -> str:
        return f"{self.path}/version={version:020d}"

    def versions(self) -> list[int]:
        """Committed versions, oldest first; one directory listing, no data is read."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        names = [status.getPath().getParent().getName() for status in fs.globStatus(done)]
        return sorted(int(name.split("=")[1]) for name in names)

    def version_of(self, batch: DataFrame, epoch: int) -> int:
        """The version that a micro-batch commits.

        Epochs start again with every new checkpoint, so each streaming query is bound, at its
        first batch, to the versions after those that it found.
        """
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_queries/{query}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            known = self.versions()
            first = (known[-1] + 1 if known else 0) - epoch
            fs.mkdirs(jvm.org.apache.hadoop.fs.Path(root, f"first={first}"))
        return int(fs.listStatus(root)[0].getPath().getName().split("=")[1]) + epoch

    def read(self, before: int | None = None) -> DataFrame:
        """The newest committed state, or the newest one older than ``before``."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._location(known[-1]))

    def commit(self, state: DataFrame, version: int | None = None) -> int:
        known = self.versions()
        version = version if version is not None else (known[-1] + 1 if known else 0)
        state.write.mode("overwrite").parquet(self._location(version))
        for old in [v for v in known if v < version][:-(KEPT_VERSIONS - 1)]:
            remove(self.spark, self._location(old))
        return version
