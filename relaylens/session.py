"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Every job assumes UTC; the rest are settings an operator of a cluster may override.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """The settings that results depend on, for a session that was built elsewhere."""
    for key in ("spark.sql.session.timeZone", "spark.sql.streaming.stateStore.providerClass"):
        if spark.conf.get(key, None) != SESSION_CONF[key]:
            spark.conf.set(key, SESSION_CONF[key])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach; a temporary one only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="relaylens-")
    context.setCheckpointDir(local)
    return local


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for a written intermediate table."""
    path = f"{shared_dir(spark).rstrip('/')}/relaylens/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_tables(spark: SparkSession, files: list[str]) -> None:
    """Deletes the intermediate tables of this process that the files are part of."""
    folders = {name.rsplit("/", 2)[-2] for name in files}
    for path in [p for p in _scratch if p.rsplit("/", 1)[-1] in folders]:
        remove(spark, path)
        _scratch.remove(path)


def remove_scratch(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this process has made; call it once no frame that
    was built from them is needed any more. They hold copies of texts."""
    count = len(_scratch)
    while _scratch:
        remove(spark, _scratch.pop())
    return count
