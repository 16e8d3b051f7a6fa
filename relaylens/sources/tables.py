"""Reading log and state tables, appending metric rows, and dropping what has expired."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from relaylens.functions import clock
from relaylens.session import remove, scratch_path


def read_table(spark: SparkSession, path: str, schema: str | None = None,
               fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, partitions: int = 64,
              **options: str) -> DataFrame:
    """A relational source; with a partition column the scan is split over executors."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", partitions))
    return reader.options(**options).load()


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a scan whose files cannot be split that far.

    Meant for costly work per row, such as matching patterns in texts, right after a scan. A
    scan with at least as many splits as there are cores, i.e. any large one, stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()  # planned, not run: a scan has no shuffle
    return scan if splits >= cores else scan.repartition(cores, *keys)


def persist_metrics(log: DataFrame, path: str, mode: str = "append") -> None:
    """Write metric rows partitioned by day.

    ``rebalance`` gives each day few large files and lets AQE split a hot day, so the writer
    neither scatters small files nor sends one day to one task. With ``mode="overwrite"`` only
    the days present in ``log`` are replaced, which makes a re-run of a day idempotent.
    """
    dated = log.withColumn("date", F.to_date("ts")).hint("rebalance", "date")
    (dated.write.partitionBy("date").mode(mode)
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def persist_by_day(rows: DataFrame, path: str, ts: str, day: str) -> None:
    """A table in folders by the day of a timestamp, for ``drop_before``."""
    rows.withColumn(day, F.to_date(ts)).hint("rebalance", day).write.partitionBy(day).mode(
        "append").parquet(path)


def days_of(spark: SparkSession, path: str, day: str) -> list[date]:
    """The days that have a folder; one listing, no data is read."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = [f.getPath().getName() for f in found]
    return sorted(date.fromisoformat(n.split("=")[1]) for n in names
                  if n.startswith(f"{day}=") and "__HIVE" not in n)


def drop_before(spark: SparkSession, path: str, moment: datetime, ts: str, day: str) -> None:
    """Deletes the rows of a table in folders by day whose ``ts`` lies before ``moment``.

    Whole days go with their folder; only the day of ``moment`` is rewritten, and the files of all
    later days stay as they are. Running it again changes nothing more.
    """
    for one in days_of(spark, path, day):
        folder = f"{path}/{day}={one.isoformat()}"
        if one < moment.date():
            remove(spark, folder)
        elif one == moment.date():
            rows = spark.read.parquet(folder)
            aside = scratch_path(spark, "kept-rows")
            rows.filter(F.col(ts) >= clock.instant(moment)).write.parquet(aside)
            spark.read.schema(rows.schema).parquet(aside).write.mode("overwrite").parquet(folder)
