"""The breaker against a row-by-row model, with slices that cut hot modules."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from relaylens.operators import breaker, slices as slices_module

SCHEMA = ("event_id BIGINT, module_name STRING, ts TIMESTAMP_NTZ, ok BOOLEAN, reset BOOLEAN, "
          "failure_threshold INT, recovery_timeout INT, success_threshold INT")
START = datetime(2024, 1, 1)


def model(rows):
    """Plain state machine over rows sorted by (ts, id, call)."""
    machines, out = {}, {}
    for event_id, module, ts, ok, reset, n, recovery, m in rows:
        s = machines.setdefault(module, dict(state="closed", f=0, s=0, last=None))
        before, admitted = s["state"], None
        if reset:
            s.update(state="closed", f=0, s=0, last=None)
        else:
            admitted = True
            if s["state"] == "open":
                if (ts - s["last"]).total_seconds() < recovery:
                    admitted = False
                else:
                    s.update(state="half_open", s=0)
            if admitted and ok:
                if s["state"] == "half_open":
                    s["s"] += 1
                    if s["s"] >= m:
                        s.update(state="closed", f=0)
                else:
                    s["f"] = 0
            elif admitted:
                s["f"] += 1
                s["last"] = ts
                if s["state"] == "half_open" or s["f"] >= n:
                    s["state"] = "open"
        out[(event_id, reset)] = (before, admitted, s["state"], s["f"])
    return out, machines


def log(seed, n, failing, resets=0.0, modules=("hot", "hot", "hot", "b", "c")):
    rng = random.Random(seed)
    limits = {m: (rng.randint(1, 4), rng.choice([0, 5, 60, 600]), rng.randint(1, 3))
              for m in sorted(set(modules))}
    rows, ts = [], START
    for i in range(n):
        ts += timedelta(seconds=rng.choice([0, 1, 1, 3, 20]))
        module = rng.choice(modules)
        rate = failing if (i // 200) % 2 else min(1.0, failing * 2.2)
        rows.append((i, module, ts, rng.random() > rate, rng.random() < resets, *limits[module]))
    return rows


@pytest.mark.parametrize("seed,failing,resets,slices", [
    (1, 0.2, 0.0, 16), (2, 0.5, 0.01, 16), (3, 1.0, 0.0, 12), (4, 0.05, 0.05, 3), (5, 0.7, 0.0, 1)])
def test_replay_equals_the_model(spark, seed, failing, resets, slices):
    rows = log(seed, 2000, failing, resets)
    expected, machines = model(rows)
    replayed = breaker.replay(spark.createDataFrame(rows, SCHEMA).repartition(7), slices)
    got = {(r.event_id, r.reset): (r.state_before, r.admitted, r.state_after, r.failure_count)
           for r in replayed.collect()}
    assert got == expected
    for r in breaker.status(replayed).collect():
        m = machines[r.module_name]
        assert (r.state, r.failure_count, r.success_count, r.last_failure_at) == (
            m["state"], m["f"], m["s"], m["last"])


def test_replay_continues_from_a_stored_state(spark):
    rows = log(9, 1200, 0.5)
    expected, _ = model(rows)
    first = spark.createDataFrame(rows[:700], SCHEMA)
    status = breaker.status(breaker.replay(first, 5))
    initial = status.select("module_name", breaker.as_initial(
        F.col("state"), F.col("failure_count"), F.col("success_count"),
        F.col("last_failure_at")).alias("initial"))
    second = spark.createDataFrame(rows[700:], SCHEMA).join(initial, "module_name", "left")
    got = {(r.event_id, r.reset): (r.state_before, r.admitted, r.state_after, r.failure_count)
           for r in breaker.replay(second, 5).collect()}
    assert got == {k: v for k, v in expected.items() if k[0] >= 700}


def test_manual_resets(spark):
    rows = [(i, m, START + timedelta(seconds=i), False, False, 1, 600, 1)
            for i, m in enumerate("abab")]
    calls = spark.createDataFrame(rows, SCHEMA)
    states = lambda df: {r.module_name: r.state for r in
                         breaker.status(breaker.replay(df, 2)).collect()}
    assert states(breaker.with_resets(calls, all_at=[(4, "2024-01-01 00:00:09")])) == {
        "a": "closed", "b": "closed"}
    one = spark.createDataFrame([(4, "a", START + timedelta(seconds=9))],
                                "event_id BIGINT, module_name STRING, ts TIMESTAMP_NTZ")
    assert states(breaker.with_resets(calls, one)) == {"a": "closed", "b": "open"}


def test_slow_success_is_a_failure(spark):
    df = spark.createDataFrame([(True, 29000.0), (True, 30000.0), (True, 30000.1), (False, 1.0)],
                               "success BOOLEAN, ms DOUBLE")
    got = [r.ok for r in df.select(breaker.in_time(
        F.col("success"), F.col("ms"), F.lit(30.0)).alias("ok")).collect()]
    assert got == [True, True, False, False]


def test_a_null_module_is_a_module(spark, monkeypatch):
    """Its breaker opens, whatever the size of the batches that Python workers get."""
    rows = [(i, None, START + timedelta(seconds=i), False, False, 5, 600, 1) for i in range(12)]
    expected, _ = model(rows)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for batch in ("3", "10000"):
        spark.conf.set(size, batch)
        try:
            for slices in (1, 4):
                got = {(r.event_id, r.reset): (r.state_before, r.admitted, r.state_after,
                                               r.failure_count) for r in breaker.replay(
                    spark.createDataFrame(rows, SCHEMA), slices).collect()}
                assert got == expected
        finally:
            spark.conf.unset(size)


@pytest.mark.parametrize("seed", range(60))
def test_a_passage_maps_every_entry_state_as_the_fold_does(seed):
    rng = random.Random(seed)
    threshold, recovery, needed = rng.randint(1, 6), rng.choice([0, 3, 17, 90]), rng.randint(1, 4)
    n, rate = rng.randint(1, 70), rng.choice([0.0, 0.2, 0.6, 0.95, 1.0])
    ts, now = [], 1_000_000_000
    for _ in range(n):
        now += rng.choice([0, 1, 1, 2, 9]) * 1_000_000
        ts.append(now)
    rows = pd.DataFrame({
        "event_id": range(n), "module_name": "m", "ts_us": ts,
        "ok": [rng.random() > rate for _ in ts],
        "reset": [rng.random() < rng.choice([0, 0.04]) for _ in ts],
        "failure_threshold": threshold, "recovery_timeout": recovery,
        "success_threshold": needed})
    fold = breaker.BreakerFold()
    passage, at = fold.passage(), 0
    while at < n:
        size = rng.choice([1, 2, 7, 40])
        fold.extend(passage, rows.iloc[at:at + size])
        at += size
    pieces = passage.pieces()
    states = ([["closed", c] for c in range(threshold)]
              + [["half_open", f, g] for f in (1, 9) for g in range(needed)]
              + [["open", 4, ts[0] - back * 500_000] for back in range(2 * recovery + 3)])
    for state in states:
        kind, number = fold.address(state)
        piece = pieces[(pieces["kind"] == kind) & (pieces["upto"] >= number)].nsmallest(
            1, "upto").iloc[0]
        got = fold.landed(state, *[piece[c].item() for c in ("code", "val", "fixed", "off")])
        assert got == fold.advance(state, rows, False)[0], state


def test_a_threshold_lowered_below_the_stored_failures():
    rows = pd.DataFrame({"event_id": [0, 1], "module_name": "m", "ts_us": [0, 1],
                         "ok": [True, False], "reset": False, "failure_threshold": 3,
                         "recovery_timeout": 60, "success_threshold": 1})
    fold = breaker.BreakerFold()
    assert fold.advance(["closed", 7], rows, False)[0] == ["closed", 1]
    assert fold.advance(["closed", 7], rows.iloc[1:], False)[0] == ["open", 8, 1]


@pytest.mark.parametrize("few", [1_000, 0])
@pytest.mark.parametrize("step,recovery,failing", [(1, 10, 1.0), (1, 37, 1.0), (2, 7, 0.8)])
def test_two_scans_whatever_the_data(spark, monkeypatch, step, recovery, failing, few):
    """Slices of a module that never recovers enter in states that no slice can guess."""
    rng = random.Random(5)
    rows = [(i, "dead", START + timedelta(seconds=step * i), rng.random() > failing, False, 3,
             recovery, 2) for i in range(1210)]
    expected, _ = model(rows)
    scans = []
    for name in ("_mapper", "_reporter"):
        plain = getattr(slices_module, name)
        monkeypatch.setattr(slices_module, name, lambda *a, f=plain: scans.append(a) or f(*a))
    monkeypatch.setattr(slices_module, "FEW_PIECES", few)
    for n in (4, 13):
        scans.clear()
        replayed = breaker.replay(spark.createDataFrame(rows, SCHEMA), n)
        got = {(r.event_id, r.reset): (r.state_before, r.admitted, r.state_after, r.failure_count)
               for r in replayed.collect()}
        assert got == expected and len(scans) == 2


def test_blocked_periods_against_the_model(spark):
    rows = log(11, 1500, 0.6, 0.02)
    calls = spark.createDataFrame(rows, SCHEMA)
    limits = {(r[1], r[6]) for r in rows}
    configs = spark.createDataFrame([(m, 1, t, 1, 30.0, True) for m, t in limits],
                                    "module_name STRING, failure_threshold INT, recovery_timeout INT, "
                                    "success_threshold INT, timeout_seconds DOUBLE, enabled BOOLEAN")
    replayed = breaker.replay(calls, 6)
    periods = [tuple(r) for r in breaker.blocked_periods(replayed, configs).collect()]
    refused = 0
    for r in replayed.filter("not reset").collect():
        inside = any(m == r.module_name and a <= r.ts < b for m, a, b in periods)
        if not r.admitted:
            refused += 1
            assert inside
    assert refused > 100
    by = {}
    for m, a, b in sorted(periods):
        assert by.get(m, START) <= a < b
        by[m] = b
