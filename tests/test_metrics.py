"""Edges of the metric operators."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest

from relaylens import session
from relaylens.operators import metrics
from relaylens.session import scratch_path
from relaylens.sources import tables

SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, model_name STRING, module_name STRING, "
          "target_model STRING, response_time_ms DOUBLE, success BOOLEAN, error_message STRING")
NOW = datetime(2024, 1, 1, 12)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_window_excludes_its_start_and_includes_its_end(spark):
    rows = [(i, NOW - timedelta(minutes=m), "m", "a", "t", 1.0, True, None)
            for i, m in enumerate((0, 59, 60, 61, -1))]
    assert metrics.overall(frame(spark, rows), NOW, 60).first().total_requests == 2


def test_empty_window_raises_only_the_overall_success_alert(spark):
    raised = metrics.alerts(frame(spark, []), NOW).collect()
    assert [(r.type, r.value, r.module) for r in raised] == [("low_success_rate", 0.0, None)]
    assert raised[0].message == "Overall success rate (0.00%) below threshold"


def test_two_calls(spark):
    rows = [(1, NOW, "m", "a", "t", 150.5, True, None), (2, NOW, "m", "a", "t", 300.0, False, "x")]
    r = metrics.by_module(frame(spark, rows), NOW).first()
    assert (r.total_requests, r.failed_requests, r.success_rate) == (2, 1, 0.5)
    assert (r.avg_response_time_ms, r.min_response_time_ms, r.max_response_time_ms) == (
        225.25, 150.5, 300.0)


@pytest.mark.parametrize("quantile", [0.0, 0.5, 0.95, 1.0])
def test_quantile_is_exact_on_ties_and_hot_modules(spark, quantile):
    rng = np.random.default_rng(4)
    values = {"hot": np.concatenate([np.full(4000, 7.0), rng.exponential(50, 5000)]),
              "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "flat": np.full(50, 9.0)}
    rows = [(i, NOW, "m", name, "t", float(v), True, None)
            for name, vs in values.items() for i, v in enumerate(vs)]
    got = {r.module_name: r.p95_latency_ms
           for r in metrics.latency_table(frame(spark, rows), NOW, 60, quantile).collect()}
    for name, vs in values.items():
        assert got[name] == pytest.approx(np.quantile(vs, quantile))


def test_dropping_old_rows_leaves_other_days_alone(spark):
    rows = spark.sql("""SELECT id, TIMESTAMP_NTZ '2024-01-01 06:00:00'
                               + make_dt_interval(0, CAST(id AS INT) * 6) AS ts FROM range(40)""")
    path = scratch_path(spark, "days")
    tables.persist_by_day(rows, path, "ts", "day")
    cut = datetime(2024, 1, 4, 12)
    later = lambda: {f for f in spark.read.parquet(path).inputFiles()
                     if f.split("day=")[1] > "2024-01-05"}
    before = later()
    for _ in range(2):
        tables.drop_before(spark, path, cut, "ts", "day")
        left = spark.read.parquet(path)
        assert sorted(r.id for r in left.collect()) == [
            r.id for r in rows.orderBy("id").collect() if r.ts >= cut]
    assert tables.days_of(spark, path, "day")[0] == cut.date()
    assert later() == before and len(before) >= 5


def test_scratch_tables_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_scratch", [])
    path = scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert session.remove_scratch(spark) == 1 and session.remove_scratch(spark) == 0
    assert not os.path.exists(path.removeprefix("file:"))


@pytest.mark.parametrize("slices", [1, 7])
def test_running_counters_over_slices_that_cut_a_module(spark, slices):
    rng = np.random.default_rng(4)
    rows = [(i, NOW + timedelta(seconds=int(rng.integers(0, 90))), "m",
             [None, "hot", "hot", "hot", "b"][int(rng.integers(0, 5))], "t", 1.0,
             bool(rng.integers(0, 2)), None) for i in range(400)]
    want, counts = [], {}
    for i, ts, _, module, _, _, success, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        total, good = counts.get(module, (0, 0))
        counts[module] = total, good = total + 1, good + success
        want.append((i, module, ts, total, good, total - good))
    got = metrics.running_counters(frame(spark, rows), slices).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert metrics.running_counters(frame(spark, []), slices).count() == 0
