"""Latency reports from stored sketches."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from pyspark.sql import functions as F

from relaylens.operators import latency, metrics
from relaylens.session import scratch_path

LOG = "ts TIMESTAMP_NTZ, module_name STRING, response_time_ms DOUBLE, success BOOLEAN"
NOW = datetime(2024, 1, 3, 12, 30)


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(11)
    values = {"hot": np.concatenate([np.full(900, 7.0), rng.exponential(50, 3000)]),
              "narrow": rng.uniform(100.0, 100.5, 2000), "one": [3.0], "flat": np.full(50, 9.0),
              None: rng.normal(0, 1, 300), "mixed": [0.0, -5.0, 1e-320, 1e300, None, None],
              "null": [None]}
    rows = [(NOW - timedelta(minutes=float(m)), name, None if v is None else float(v), i % 3 > 0)
            for name, vs in values.items()
            for i, (v, m) in enumerate(zip(vs, rng.integers(0, 2000, len(vs)) if len(vs) > 1
                                           else [0]))]
    return spark.createDataFrame(rows, LOG).persist()


@pytest.fixture(scope="module")
def path(spark, log):
    path = scratch_path(spark, "latency")
    for _ in range(2):  # a repeated run replaces its days
        latency.store_days(log, path)
    return path


@pytest.mark.parametrize("quantile, as_of, minutes", [
    (0.95, NOW, 2000), (0.5, NOW, 1440), (0.0, NOW, 2000), (1.0, NOW, 2000),
    (0.95, NOW.replace(minute=0), 600), (0.9, NOW, 20), (0.95, NOW, 61)])
def test_equals_numpy_over_the_window(spark, log, path, quantile, as_of, minutes):
    window = {}
    for r in log.collect():
        if as_of - timedelta(minutes=minutes) < r.ts <= as_of:
            window.setdefault(r.module_name, []).append(r)
    got = {r.module_name: r for r in latency.stored_latency_table(
        spark, path, as_of, minutes, quantile).collect()}
    assert set(got) == set(window)
    for name, rows in window.items():
        timed = [r.response_time_ms for r in rows if r.response_time_ms is not None]
        assert got[name].total_requests == len(rows)
        assert got[name].successful_requests == sum(r.success for r in rows)
        if timed:
            assert got[name].p95_latency_ms == pytest.approx(np.quantile(timed, quantile))
            assert got[name].max_latency_ms == max(timed)
        else:
            assert got[name].p95_latency_ms is None


def test_bins_never_fall(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1e3, 3000), 2.0 ** rng.integers(-1070, 1020, 3000),
                             [0.0, -0.0, float("inf"), float("-inf"), 5e-324, 1.7e308]])
    near = np.nextafter(values, np.inf)
    rows = [(float(v),) for v in np.concatenate([values, near])]
    bins = [r.bin for r in spark.createDataFrame(rows, "v DOUBLE").select(
        "v", latency.bin_of(F.col("v")).alias("bin")).orderBy("v").collect()]
    assert bins == sorted(bins)


def test_reads_raw_rows_of_the_brackets_only(spark, path):
    ranks = spark.createDataFrame([("narrow", latency._ZERO + 425, 100.0, 100.5)],
                                  "module_name STRING, bin INT, least DOUBLE, most DOUBLE")
    rows = latency.bracket_rows(spark, path, ranks, NOW, 2000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "octave" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "(bin," in scan.split("PushedFilters: [")[1].split("]")[0]
    stored = spark.read.parquet(f"{path}/raw").filter("module_name = 'narrow'").select(
        "response_time_ms", "bin").collect()
    assert rows.count() == sum(r.bin == latency._ZERO + 425 for r in stored) > 1000


def test_empty_log(spark, log):
    path = scratch_path(spark, "latency")
    latency.store_days(log.limit(0), path)
    assert latency.stored_latency_table(spark, path, NOW, 60).count() == 0
    assert metrics.latency_table(log.limit(0), NOW, 60).count() == 0
