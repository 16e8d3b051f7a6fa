"""Circuit breakers replayed over a log of outcomes."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from relaylens.functions import clock
from relaylens.operators import passages
from relaylens.operators.slices import Fold, run_fold, sorted_slices

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"
_NAMES = np.array([CLOSED, OPEN, HALF_OPEN], dtype=object)

# Defaults of a breaker without a configuration row.
DEFAULTS = {"failure_threshold": 5, "recovery_timeout": 60, "success_threshold": 3,
            "timeout_seconds": 30.0}

STATUS = ("module_name STRING, state STRING, failure_count BIGINT, success_count BIGINT, "
          "last_failure_at TIMESTAMP_NTZ, last_seen_at TIMESTAMP_NTZ")
STATUS_COLUMNS = ["state", "failure_count", "success_count", "last_failure_at", "last_seen_at"]


def breaker_config(modules: DataFrame, configs: DataFrame) -> DataFrame:
    """Every module with its enabled configuration or the defaults."""
    own = configs.filter("enabled").select("module_name", *DEFAULTS)
    return modules.select("module_name").distinct().join(own, "module_name", "left").select(
        "module_name", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()])


def in_time(success: Column, response_time_ms: Column, timeout_seconds: Column) -> Column:
    """A finished call counts as a failure when it took longer than the limit."""
    return success & ~F.coalesce(response_time_ms > timeout_seconds * 1000, F.lit(False))


def outcomes(log: DataFrame, configs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Log rows as breaker input; modules without an enabled row get the defaults."""
    own = configs.filter("enabled").select("module_name", *DEFAULTS)
    joined = log.join(own, "module_name", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})
    return joined.select(
        "event_id", "module_name", "ts",
        in_time(F.col("success"), F.col("response_time_ms"), F.col("timeout_seconds")).alias("ok"),
        F.lit(False).alias("reset"), "failure_threshold", "recovery_timeout", "success_threshold",
        *keep)


def with_resets(calls: DataFrame, resets: DataFrame | None = None,
                all_at: list[tuple[int, str]] = ()) -> DataFrame:
    """Manual resets as further events of the same log.

    ``resets(event_id, ts, module_name)`` names modules; ``all_at`` lists (id, time) of the
    resets of all breakers. A reset comes before a call with the same time and id.
    """
    limits = ["failure_threshold", "recovery_timeout", "success_threshold"]
    modules = calls.groupBy("module_name").agg(*[F.max(c).alias(c) for c in limits])
    flags = [F.lit(False).alias("ok"), F.lit(True).alias("reset")]
    columns = ["event_id", "module_name", "ts", *flags, *limits]
    events = []
    if resets is not None:
        events.append(resets.join(modules, "module_name").select(*columns))
    if all_at:
        times = F.array(*[F.struct(F.lit(i).cast("bigint").alias("event_id"),
                                   clock.instant(ts).alias("ts")) for i, ts in all_at])
        events.append(modules.withColumn("_at", F.explode(times)).select(
            "*", "_at.event_id", "_at.ts").select(*columns))
    for more in events:
        calls = calls.unionByName(more)
    return calls


class BreakerFold(Fold):
    """closed --N consecutive failures--> open --recovery time--> half-open --M successes-->
    closed, or --a failure--> open again. Calls while open are not admitted and change nothing.

    A state is ``[closed, failures]``, ``[open, failures, last failure]`` or
    ``[half_open, failures, successes]``. Only state changes are visited one by one; the rows
    between two changes are filled as arrays.
    """

    key = "module_name"
    output_schema = (
        "event_id BIGINT, module_name STRING, ts_us BIGINT, reset BOOLEAN, ok BOOLEAN, "
        "state_before STRING, admitted BOOLEAN, state_after STRING, failure_count BIGINT, "
        "success_count BIGINT, last_failure_us BIGINT")

    def initial(self, rows: pd.DataFrame):
        stored = rows["initial"].iloc[0] if "initial" in rows.columns else None
        return json.loads(stored) if isinstance(stored, str) else [CLOSED, 0]

    def split(self, state):
        """The failures of a breaker that is not closed decide nothing, so they are the offset."""
        if state[0] == CLOSED:
            return state, 0
        return [state[0], *state[2:]], state[1]

    def joined(self, core, offset: int):
        return core if core[0] == CLOSED else [core[0], offset, *core[1:]]

    def passage(self):
        return passages.Passage()

    def extend(self, passage, rows: pd.DataFrame) -> None:
        passage.extend(passages.Batch(*self._inputs(rows)))

    def address(self, state) -> tuple[int, int]:
        number = state[2] if state[0] == OPEN else -state[-1]
        return int(np.flatnonzero(_NAMES == state[0])[0]), number

    def landed(self, state, code: int, val: int, fixed: bool, off: int):
        offset = off + (0 if fixed else self.split(state)[1])
        if code == passages.AS_ENTERED:
            return state if state[0] == OPEN else [*state[:-1], state[-1] + val]
        return [CLOSED, val] if code == passages.CLOSED else [str(_NAMES[code]), offset, val]

    @staticmethod
    def _inputs(rows: pd.DataFrame) -> tuple:
        reset = rows["reset"].to_numpy(dtype=bool)
        return (rows["ts_us"].to_numpy(), rows["ok"].to_numpy(dtype=bool) & ~reset, reset,
                max(int(rows["failure_threshold"].iloc[0]), 1),
                int(rows["recovery_timeout"].iloc[0]) * 1_000_000,
                max(int(rows["success_threshold"].iloc[0]), 1))

    def advance(self, state, rows: pd.DataFrame, emit: bool):
        ts, ok, reset, threshold, recovery, needed = self._inputs(rows)
        n = len(ts)
        place = np.arange(n)
        breaks = np.flatnonzero(ok | reset)                  # rows that end a failure run
        run = place - np.maximum.accumulate(np.where(ok | reset, place, -1))
        trips = np.flatnonzero(run >= threshold)
        resets = np.flatnonzero(reset)
        before = np.zeros(n, dtype=np.int8)
        after = np.zeros(n, dtype=np.int8)
        admitted = ~reset
        failures = np.zeros(n, dtype=np.int64)
        successes = np.full(n, -1, dtype=np.int64)           # -1: unchanged by this row
        successes[resets] = 0

        def upcoming(positions, at):
            found = np.searchsorted(positions, at)
            return int(positions[found]) if found < len(positions) else n

        i, arrived = 0, None
        while i < n:
            kind = state[0]
            if kind == CLOSED:
                count = state[1]
                pause, more = upcoming(breaks, i), max(threshold - count, 1)
                if pause - i >= more:                        # the run at hand suffices
                    trip = i + more - 1
                else:
                    trip = upcoming(trips, pause)
                stop = min(trip + 1, n)
                middle = min(pause, stop)
                failures[i:middle] = count + place[: middle - i] + 1
                failures[middle:stop] = run[middle:stop]
                if trip < n:
                    after[trip] = 1
                    state = [OPEN, int(failures[trip]), int(ts[trip])]
                else:
                    state = [CLOSED, int(failures[n - 1])]
                i = stop
            elif kind == OPEN:
                _, count, failed_at = state
                resume = max(int(np.searchsorted(ts, failed_at + recovery)), i)
                stop = min(resume, upcoming(resets, i), n)
                before[i:stop] = after[i:stop] = 1
                admitted[i:stop] = False
                failures[i:stop] = count
                i = stop
                if i < n and reset[i]:
                    before[i] = 1
                    state = [CLOSED, 0]
                    i += 1
                elif i < n:
                    state, arrived = [HALF_OPEN, count, 0], 1
            else:
                _, count, good = state
                before[i] = 2 if arrived is None else arrived
                arrived = None
                if reset[i]:
                    state = [CLOSED, 0]
                elif ok[i]:
                    successes[i] = good + 1
                    done = good + 1 >= needed
                    state = [CLOSED, 0] if done else [HALF_OPEN, count, good + 1]
                    after[i] = 0 if done else 2
                    failures[i] = 0 if done else count
                else:
                    successes[i] = good
                    state = [OPEN, count + 1, int(ts[i])]
                    after[i], failures[i] = 1, count + 1
                i += 1
        if not emit:
            return state, None
        failed = admitted & ~ok
        return state, pd.DataFrame({
            "event_id": rows["event_id"].to_numpy(), "module_name": rows["module_name"].to_numpy(),
            "ts_us": ts, "reset": reset, "ok": ok, "state_before": _NAMES[before],
            "admitted": admitted, "state_after": _NAMES[after], "failure_count": failures,
            "success_count": pd.Series(successes, dtype="Int64").where(successes >= 0),
            "last_failure_us": pd.Series(ts, dtype="Int64").where(failed)})


def replay(calls: DataFrame, slices: int | None = None) -> DataFrame:
    """State before and after every event, and whether the call was admitted.

    ``success_count`` and ``last_failure_at`` are null on rows that do not change them.
    ``calls`` may carry ``initial``, the JSON state of its module before the first row.
    """
    events = calls.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    ordered = sorted_slices(events.withColumn("rank", (~F.col("reset")).cast("int")),
                            "module_name", ["ts_us", "event_id", "rank"], slices)

    def moment(column):
        return F.timestamp_micros(column).cast("timestamp_ntz")

    return run_fold(ordered, BreakerFold()).select(
        "event_id", "module_name", moment("ts_us").alias("ts"), "reset", "ok", "state_before",
        F.when(~F.col("reset"), F.col("admitted")).alias("admitted"), "state_after",
        "failure_count", "success_count", moment("last_failure_us").alias("last_failure_at"))


def status(replayed: DataFrame, config: DataFrame | None = None,
           previous: DataFrame | None = None) -> DataFrame:
    """Latest state per module; ``previous`` fills in what these rows left unchanged.

    A reset clears the last failure.
    """
    at = F.struct("ts", "event_id", (~F.col("reset")).alias("call"))

    def latest(column, changed):
        return F.max_by(F.when(changed, F.col(column)), F.when(changed, at))

    counted = F.col("success_count").isNotNull()
    failed = F.col("last_failure_at").isNotNull() | F.col("reset")
    now = replayed.groupBy("module_name").agg(
        F.max_by("state_after", at).alias("state"),
        F.max_by("failure_count", at).alias("failure_count"),
        latest("success_count", counted).alias("success_count"),
        latest("last_failure_at", failed).alias("last_failure_at"),
        F.bool_or(failed).alias("_failed"), F.max("ts").alias("last_seen_at"))
    if previous is not None:
        before = previous.select("module_name", *[
            F.col(c).alias(f"_{c}") for c in STATUS_COLUMNS])
        now = now.join(before, "module_name", "full_outer").select(
            "module_name", F.coalesce("state", "_state").alias("state"),
            F.coalesce("failure_count", "_failure_count").alias("failure_count"),
            F.coalesce("success_count", "_success_count").alias("success_count"),
            F.when(F.col("_failed"), F.col("last_failure_at")).otherwise(
                F.col("_last_failure_at")).alias("last_failure_at"),
            F.greatest("last_seen_at", "_last_seen_at").alias("last_seen_at"))
    now = now.select("module_name", "state", "failure_count",
                     F.coalesce("success_count", F.lit(0)).alias("success_count"),
                     "last_failure_at", "last_seen_at")
    return now if config is None else now.join(config, "module_name", "left")


def blocked_periods(replayed: DataFrame, configs: DataFrame) -> DataFrame:
    """(module_name, blocked_from, blocked_until): when calls of a module are not admitted.

    Every failure that opens a breaker starts such a period; it ends after the recovery time, or
    at a manual reset before that. Periods of a module do not overlap. The reset that ends a
    period is the first event of its module that changes an open state to a closed one within it.
    """
    own = breaker_config(replayed, configs).select("module_name", "recovery_timeout")
    opened = replayed.filter(F.col("admitted") & (F.col("state_after") == OPEN)).join(
        own, "module_name").select(
        "module_name", F.col("ts").alias("blocked_from"), "recovery_timeout",
        (F.col("ts") + F.make_dt_interval(secs=F.col("recovery_timeout"))).alias("_until"))
    slot = lambda ts: F.floor(  # noqa: E731  a period touches two slots of its length at most
        F.unix_micros(ts.cast("timestamp"))
        / (F.greatest(F.col("recovery_timeout"), F.lit(1)).cast("bigint") * 1_000_000)).cast("bigint")
    resets = replayed.filter(F.col("reset") & (F.col("state_before") == OPEN)).join(
        own, "module_name").select(
        F.col("module_name").alias("_module"), F.col("ts").alias("_reset"),
        slot(F.col("ts")).alias("_reset_slot"))
    slots = opened.withColumn("_slot", F.explode(F.array_distinct(F.array(
        slot(F.col("blocked_from")), slot(F.col("_until"))))))
    met = slots.join(resets, (F.col("module_name") == F.col("_module"))
                     & (F.col("_slot") == F.col("_reset_slot"))
                     & (F.col("_reset") >= F.col("blocked_from"))
                     & (F.col("_reset") < F.col("_until")), "left")
    return met.groupBy("module_name", "blocked_from", "_until").agg(
        F.min("_reset").alias("_reset")).select(
        "module_name", "blocked_from",
        F.least("_until", "_reset").alias("blocked_until")).filter(
        "blocked_until > blocked_from")


def as_initial(state: Column, failures: Column, successes: Column, last_failure: Column) -> Column:
    """A module's status as the JSON state a later replay starts from."""
    last = F.unix_micros(last_failure.cast("timestamp"))
    return (F.when(state == OPEN, F.format_string('["open", %d, %d]', failures, last))
            .when(state == HALF_OPEN,
                  F.format_string('["half_open", %d, %d]', failures, successes))
            .otherwise(F.format_string('["closed", %d]', failures)))
