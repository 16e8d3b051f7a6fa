"""Latency reports from stored sketches, with an exact second pass over a bracket of raw rows.

A sketch is a histogram on a logarithmic scale: 64 bins an octave, each with its count, successes,
sum, minimum and maximum, per day, hour and module. Sketches merge by adding counts. As a bin
grows with the value, the counts tell without error in which bin a rank lies, so that a report
reads raw rows of that bin alone, and none where the bin holds one value or the rank is its first
or last. At most two hours at the window's ends, which it cuts, are read as raw rows.

The log's copy lies in folders by day and octave, its files sorted by bin: folders and statistics
of the files keep a report from what lies outside its brackets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from relaylens.functions import clock
from relaylens.sources import tables

PER_OCTAVE = 64
_ZERO = 1200 * PER_OCTAVE  # above the distance of the smallest double from 1 on the scale
_INFINITE, _NO_NUMBER = 2 * _ZERO, 2 * _ZERO + PER_OCTAVE
FINE = 4096  # parts of a bin in the second pass

RAW = ("module_name STRING, pane TIMESTAMP_NTZ, ts TIMESTAMP_NTZ, response_time_ms DOUBLE, "
       "success BOOLEAN, bin INT, date DATE, octave INT")
SKETCHES = ("module_name STRING, pane TIMESTAMP_NTZ, bin INT, copies BIGINT, good BIGINT, "
            "total DOUBLE, least DOUBLE, most DOUBLE, date DATE")


def bin_of(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises; null for null."""
    size = F.abs(value)
    away = (F.when(size == float("inf"), _INFINITE)
            .otherwise(F.floor(F.log2(size) * PER_OCTAVE).cast("int") + _ZERO))
    return (F.when(F.isnan(value), _NO_NUMBER).when(value == 0, 0)
            .when(value < 0, -away).when(value > 0, away))


def sketched(raw: DataFrame, *keys: str) -> DataFrame:
    value = F.col("response_time_ms")
    return raw.groupBy(*keys, "module_name", "bin").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if("success").alias("good"),
        F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def store_days(log: DataFrame, path: str) -> None:
    """Writes whole days of the log and their sketches.

    A repeated run of the same days replaces its folders. A day of a log that only grows keeps
    all its octaves; a day that lost rows has to be removed before it is written anew.
    Ranges of day, octave, bin and moment share out the rows, so a hot module or hour is cut.
    """
    value = F.col("response_time_ms").cast("double")
    placed = (log.select(
        "module_name", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("pane"), "ts",
        value.alias("response_time_ms"), "success", bin_of(value).alias("bin"),
        F.to_date("ts").alias("date"))
        .withColumn("octave", F.floor(F.col("bin") / PER_OCTAVE).cast("int")))
    order = ["date", "octave", "bin", "pane", "ts"]
    _replace(placed.repartitionByRange(*order).sortWithinPartitions(*order),
             f"{path}/raw", "date", "octave")
    days = placed.select("date").distinct()
    raw = tables.read_table(log.sparkSession, f"{path}/raw", RAW).join(days, "date", "left_semi")
    _replace(sketched(raw, "date", "pane").hint("rebalance", "date"), f"{path}/sketches", "date")


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    (rows.write.partitionBy(*by).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def _within(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    return rows.filter(F.col("date").between(F.to_date(start), F.to_date(end)))


def merged_window(spark: SparkSession, path: str, as_of, minutes: float) -> DataFrame:
    """One sketch per module of ``as_of - minutes < ts <= as_of``: stored ones of whole hours,
    raw rows of the hours that the window cuts."""
    start, end = clock.shifted(as_of, mins=-minutes), clock.instant(as_of)
    first, last = (F.date_trunc("hour", edge).cast("timestamp_ntz") for edge in (start, end))
    pane, ts = F.col("pane"), F.col("ts")
    whole = _within(tables.read_table(spark, f"{path}/sketches", SKETCHES), start, end).filter(
        (pane > first) & (pane < last))
    cut = _within(tables.read_table(spark, f"{path}/raw", RAW), start, end).filter(
        ((pane == first) | (pane == last)) & (ts > start) & (ts <= end))
    both = whole.drop("date", "pane").unionByName(sketched(cut))
    return both.groupBy("module_name", "bin").agg(
        *[F.sum(c).alias(c) for c in ("copies", "good", "total")],
        F.min("least").alias("least"), F.max("most").alias("most"))


def _located(bins: DataFrame, wanted: DataFrame, keys: list[str], part: str) -> DataFrame:
    """The part in which each wanted rank lies, its rank there, and its value if that is certain.

    ``bins`` has few rows per key: at most one for each part of the scale.
    """
    through = F.sum("copies").over(W.partitionBy(*keys).orderBy(part))
    placed = bins.select(*keys, part, "copies", "least", "most",
                         (through - F.col("copies")).alias("before"))
    asked = wanted.select([F.col(c).alias(f"_{c}") for c in (*keys, "at", "rank")])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rank = F.col("_rank") - F.col("before")
    known = (F.when((rank == 0) | (F.col("least") == F.col("most")), F.col("least"))
             .when(rank == F.col("copies") - 1, F.col("most")))
    return placed.join(asked, reduce(lambda x, y: x & y, same)).filter(
        (rank >= 0) & (rank < F.col("copies"))).select(
        *keys, F.col("_at").alias("at"), part, rank.alias("rank"), "least", "most",
        known.alias("value"))


def bracket_rows(spark: SparkSession, path: str, open_ranks: DataFrame, as_of,
                 minutes: float) -> DataFrame:
    """The raw rows of the window in the bins of ``open_ranks``, with module and bin.

    The driver reads the distinct bins: a part of the scale, whatever the number of modules.
    """
    start, end = clock.shifted(as_of, mins=-minutes), clock.instant(as_of)
    bins = sorted(r["bin"] for r in open_ranks.select("bin").distinct().collect())
    octaves = sorted({b // PER_OCTAVE for b in bins})
    raw = _within(tables.read_table(spark, f"{path}/raw", RAW), start, end).filter(
        F.col("octave").isin(octaves) & F.col("bin").isin(bins)
        & (F.col("ts") > start) & (F.col("ts") <= end))
    keys = open_ranks.select(F.col("module_name").alias("_module"), F.col("bin").alias("_bin"),
                             "least", "most").distinct()
    return raw.join(keys, F.col("module_name").eqNullSafe(F.col("_module"))
                    & (F.col("bin") == F.col("_bin"))).select(
        "module_name", "bin", "response_time_ms", "least", "most")


def stored_latency_table(spark: SparkSession, path: str, as_of, minutes: float = 60,
                         quantile: float = 0.95) -> DataFrame:
    """``metrics.latency_table`` of a log kept by ``store_days``.

    Null times count as calls and not for the quantile; a module of null times alone has none.
    """
    bins = merged_window(spark, path, as_of, minutes).persist()
    totals = bins.groupBy("module_name").agg(
        F.sum("copies").alias("total_requests"), F.sum("good").alias("successful_requests"),
        F.coalesce(F.try_divide(F.sum("total"), F.sum("copies")), F.lit(0.0)).alias(
            "avg_latency_ms"),
        F.coalesce(F.max("most"), F.lit(0.0)).alias("max_latency_ms"),
        F.sum(F.when(F.col("bin").isNotNull(), F.col("copies"))).alias("timed"))
    position = (F.col("timed").cast("double") - 1) * quantile
    wanted = totals.filter("timed > 0").select(
        "module_name", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position))))
        .alias("at")).withColumn("rank", F.col("at"))
    coarse = _located(bins.filter("bin IS NOT NULL"), wanted, ["module_name"], "bin").persist()
    undecided = coarse.filter("value IS NULL")

    part = F.least(F.floor((F.col("response_time_ms") - F.col("least"))
                           / (F.col("most") - F.col("least")) * FINE), F.lit(FINE - 1))
    rows = bracket_rows(spark, path, undecided, as_of, minutes).withColumn("part", part)
    key = ["module_name", "bin"]
    parts = rows.groupBy(*key, "part").agg(
        F.count(F.lit(1)).alias("copies"), F.min("response_time_ms").alias("least"),
        F.max("response_time_ms").alias("most"))
    fine = _located(parts, undecided.select(*key, "at", "rank"), key, "part")
    last = fine.filter("value IS NULL").select(
        F.col("module_name").alias("_m"), F.col("bin").alias("_b"), F.col("part").alias("_p"),
        "at", "rank")
    single = (rows.groupBy(*key, "part", "response_time_ms").agg(F.count(F.lit(1)).alias("copies"))
              .join(last, F.col("module_name").eqNullSafe(F.col("_m"))
                    & (F.col("bin") == F.col("_b")) & (F.col("part") == F.col("_p")))
              .withColumn("through", F.sum("copies").over(
                  W.partitionBy(*key, "part", "at").orderBy("response_time_ms")))
              .filter("rank < through AND rank >= through - copies")
              .select("module_name", "at", F.col("response_time_ms").alias("value")))
    found = (coarse.filter("value IS NOT NULL").select("module_name", "at", "value")
             .unionByName(fine.filter("value IS NOT NULL").select("module_name", "at", "value"))
             .unionByName(single))
    ends = found.groupBy(F.col("module_name").alias("_module")).agg(
        F.min_by("value", "at").alias("low"), F.max_by("value", "at").alias("high"))
    return totals.join(ends, F.col("module_name").eqNullSafe(F.col("_module")), "left").select(
        "module_name", "total_requests", "successful_requests",
        (F.col("total_requests") - F.col("successful_requests")).alias("failed_requests"),
        "avg_latency_ms",
        F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
            F.col("low") + (F.col("high") - F.col("low")) * (position - F.floor(position)))
        .alias("p95_latency_ms"), "max_latency_ms")
