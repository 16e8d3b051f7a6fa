"""Metric rows, rollups, alerts, reports and retention over the routing log.

The log has one row per routed call: ``ts, model_name, module_name, target_model,
response_time_ms, success, error_message`` and, when it was written by ``persist_metrics``,
the partition column ``date``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from relaylens.functions import clock
from relaylens.operators.slices import sorted_slices

# The thresholds of the alerts; so are the texts in ``alerts``.
ALERT_THRESHOLDS = {"max_response_time_ms": 5000.0, "min_success_rate": 0.95}


def metric_rows(outcomes: DataFrame, *keep: str) -> DataFrame:
    """Raw outcomes ``(started_at, finished_at, target_model, ...)`` to metric rows.

    ``keep`` names further columns, such as an id, that pass through.
    """
    elapsed = clock.seconds_between(F.col("started_at"), F.col("finished_at"))
    return outcomes.select(
        *keep, F.col("finished_at").alias("ts"), "model_name", "module_name",
        F.coalesce("target_model", F.lit("default")).alias("target_model"),
        (elapsed * 1000).alias("response_time_ms"),
        F.coalesce("success", F.lit(True)).alias("success"), "error_message")


def recent(log: DataFrame, as_of, minutes: float) -> DataFrame:
    """Rows with ``as_of - minutes < ts <= as_of``; prunes day partitions where they exist."""
    start, end = clock.shifted(as_of, mins=-minutes), clock.instant(as_of)
    rows = log.filter((F.col("ts") > start) & (F.col("ts") <= end))
    if "date" in log.columns:
        rows = rows.filter(F.col("date").between(F.to_date(start), F.to_date(end)))
    return rows


def newest(log: DataFrame, limit: int = 10_000) -> DataFrame:
    """The most recent rows, newest first (a top-k: no full sort)."""
    return log.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit)


def _rate(successes: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(successes, total), F.lit(0.0))


def _tallies(rows, *more: Column) -> DataFrame:
    """Counts and latency sums per group, all of them mergeable map-side."""
    return rows.agg(*more,
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("success").alias("successful_requests"),
        F.sum("response_time_ms").alias("latency_sum"),
        F.min("response_time_ms").alias("min_response_time_ms"),
        F.max("response_time_ms").alias("max_response_time_ms"))


def _summary(tallies: DataFrame, *keys: str) -> DataFrame:
    total, good = F.col("total_requests"), F.col("successful_requests")
    return tallies.select(
        *keys, total, good, (total - good).alias("failed_requests"),
        _rate(good, total).alias("success_rate"),
        _rate(F.col("latency_sum"), total).alias("avg_response_time_ms"),
        F.coalesce("min_response_time_ms", F.lit(0.0)).alias("min_response_time_ms"),
        F.coalesce("max_response_time_ms", F.lit(0.0)).alias("max_response_time_ms"))


def overall(log: DataFrame, as_of, minutes: float = 60) -> DataFrame:
    """One row; zeros when the window is empty."""
    return (_summary(_tallies(recent(log, as_of, minutes).groupBy()))
            .drop("min_response_time_ms", "max_response_time_ms")
            .withColumn("period_minutes", F.lit(int(minutes))))


def by_module(log: DataFrame, as_of, minutes: float = 60) -> DataFrame:
    return _summary(_tallies(recent(log, as_of, minutes).groupBy("module_name")), "module_name")


def by_model(log: DataFrame, as_of, minutes: float = 60) -> DataFrame:
    """Requests per model and the modules used; the set is bounded by the module registry."""
    pairs = recent(log, as_of, minutes).groupBy("model_name", "module_name").count()
    return pairs.groupBy("model_name").agg(
        F.sum("count").alias("total_requests"),
        F.array_sort(F.collect_set("module_name")).alias("modules_used"))


def recent_errors(log: DataFrame, limit: int = 50) -> DataFrame:
    failed = log.filter(~F.col("success"))
    return newest(failed, limit).select(
        "ts", "event_id", "model_name", "module_name", "error_message", "response_time_ms")


def module_counters(log: DataFrame) -> DataFrame:
    """Counters named ``routing.<module>.<total|success|error>``."""
    counts = log.groupBy("module_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("success"))
    named = counts.withColumn("error", F.col("total") - F.col("success")).unpivot(
        "module_name", ["total", "success", "error"], "kind", "value")
    # a module that never succeeded (or failed) has no such counter
    return named.filter("value > 0").select(
        F.concat_ws(".", F.lit("routing"), "module_name", "kind").alias("counter"), "value")


def running_counters(log: DataFrame, slices: int | None = None) -> DataFrame:
    """(event_id, module_name, ts, total, success, error): the counters as of each call.

    A module's calls are cut into slices of time. The calls of all slices before a slice are a sum
    over one row for each slice; the rest is counted inside the slice, so that a hot module is
    counted by many tasks. Calls of one time go by id.
    """
    ordered = sorted_slices(log.select("event_id", "module_name", "ts", "success"),
                            "module_name", ["ts", "event_id"], slices)
    sums = ordered.groupBy("module_name", "slice_id").agg(
        F.count(F.lit(1)).alias("_total"), F.count_if("success").alias("_success"))
    earlier = W.partitionBy("module_name").orderBy("slice_id").rowsBetween(
        W.unboundedPreceding, -1)
    before = sums.select(
        F.col("module_name").alias("_module"), F.col("slice_id").alias("_slice"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_total", "_success")])
    inside = W.partitionBy("slice_id", "module_name").orderBy("ts", "event_id").rowsBetween(
        W.unboundedPreceding, 0)
    counted = ordered.withColumns({"total": F.count(F.lit(1)).over(inside),
                                   "success": F.count_if("success").over(inside)})
    same = (F.col("slice_id") == F.col("_slice")) & F.col("module_name").eqNullSafe(F.col("_module"))
    return counted.join(before, same).select(
        "event_id", "module_name", "ts", (F.col("total") + F.col("_total")).alias("total"),
        (F.col("success") + F.col("_success")).alias("success")).withColumn(
        "error", F.col("total") - F.col("success"))


def rolling_latency(log: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` response times per module.

    The rank filter becomes a group limit that Spark applies before the shuffle too, so a hot
    module ships at most ``n`` rows per input task.
    """
    newest_first = W.partitionBy("module_name").orderBy(F.desc("ts"), F.desc("event_id"))
    return (log.select("module_name", "ts", "event_id", "response_time_ms")
            .withColumn("recency", F.row_number().over(newest_first))
            .filter(F.col("recency") <= n))


def alerts(log: DataFrame, as_of, minutes: float = 10,
           thresholds: dict[str, float] = ALERT_THRESHOLDS) -> DataFrame:
    """Low success rate and high mean latency, overall and per module.

    The overall row is summed from the module rows, so the log is shuffled once. An empty
    window has rate 0 and therefore raises the overall success alert.
    """
    modules = _tallies(recent(log, as_of, minutes).groupBy("module_name"))
    total = modules.groupBy().agg(*[F.sum(c).alias(c) for c in (
        "total_requests", "successful_requests", "latency_sum")],
        F.min("min_response_time_ms").alias("min_response_time_ms"),
        F.max("max_response_time_ms").alias("max_response_time_ms"))
    scopes = (_summary(total).withColumn("module", F.lit(None).cast("string"))
              .unionByName(_summary(modules, F.col("module_name").alias("module"))))
    rate, latency = F.col("success_rate"), F.col("avg_response_time_ms")
    whole = F.col("module").isNull()

    def alert(kind, message, value, threshold):
        return F.struct(
            F.when(whole, F.lit(kind)).otherwise(F.lit(f"module_{kind}")).alias("type"),
            F.lit("warning").alias("severity"), message.alias("message"),
            value.alias("value"), F.lit(threshold).alias("threshold"))

    subject = F.concat(F.lit("Module "), "module")
    low = alert("low_success_rate", F.concat(
        F.when(whole, F.lit("Overall")).otherwise(subject),
        F.format_string(" success rate (%.2f%%) below threshold", rate * 100)),
        rate, thresholds["min_success_rate"])
    slow = alert("high_response_time", F.concat(
        F.when(whole, F.lit("Average")).otherwise(subject),
        F.format_string(" response time (%.1fms) above threshold", latency)),
        latency, thresholds["max_response_time_ms"])
    raised = F.array(
        F.when(rate < thresholds["min_success_rate"], low),
        F.when(latency > thresholds["max_response_time_ms"], slow))
    return (scopes.select("module", F.explode(F.array_compact(raised)).alias("alert"))
            .select("alert.*", "module"))


def report(log: DataFrame, as_of, errors: int = 20) -> dict[str, DataFrame]:
    """Last hour and last 24 hours per module and overall, newest errors, active alerts.

    Both periods come from one scan of the longer one: a row inside the last hour adds to two
    tallies, and the overall rows are the grand totals of the same grouping.
    """
    day = recent(log, as_of, 1440)
    in_hour = F.col("ts") > clock.shifted(as_of, mins=-60)
    labelled = day.select(
        "module_name", "success", "response_time_ms", F.explode(F.when(
            in_hour, F.array(F.lit("last_hour"), F.lit("last_24_hours")))
            .otherwise(F.array(F.lit("last_24_hours")))).alias("period"))
    modules = _tallies(labelled.groupBy("period", "module_name"))
    periods = log.sparkSession.createDataFrame(
        [("last_hour",), ("last_24_hours",)], "period STRING")
    totals = modules.groupBy("period").agg(
        F.sum("total_requests").alias("total_requests"),
        F.sum("successful_requests").alias("successful_requests"),
        F.sum("latency_sum").alias("latency_sum"),
        F.min("min_response_time_ms").alias("min_response_time_ms"),
        F.max("max_response_time_ms").alias("max_response_time_ms"))
    overall_rows = periods.join(totals, "period", "left").fillna(
        0, ["total_requests", "successful_requests"])
    return {
        "summary": _summary(overall_rows, "period")
        .withColumn("module_name", F.lit(None).cast("string"))
        .unionByName(_summary(modules, "period", "module_name")),
        "recent_errors": recent_errors(log.filter(F.col("ts") <= clock.instant(as_of)), errors),
        "active_alerts": alerts(log, as_of),
    }


def retained(log: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Rows that a retention run keeps (older than ``days`` go; exactly ``days`` old stays)."""
    cutoff = clock.shifted(as_of, days=-days)
    rows = log.filter(F.col("ts") >= cutoff)
    return rows.filter(F.col("date") >= F.to_date(cutoff)) if "date" in log.columns else rows


def retention_counts(log: DataFrame, as_of, days: int = 30) -> DataFrame:
    old = F.col("ts") < clock.shifted(as_of, days=-days)
    return log.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))


def latency_table(log: DataFrame, as_of, minutes: float = 60, quantile: float = 0.95) -> DataFrame:
    """Per module: counts, mean, exact interpolated quantile and maximum.

    The quantile is exact without sorting whole modules. A mergeable sketch first brackets it;
    a second pass counts the rows below the bracket and ranks only the distinct values inside,
    about one row in ten thousand of a large module.
    """
    rows = recent(log, as_of, minutes).select("module_name", "success", "response_time_ms")
    value = F.col("response_time_ms")
    margin = 5e-5
    edges = F.percentile_approx(
        "response_time_ms",
        [max(quantile - margin, 0.0), min(quantile + margin, 1.0)], 100_000)
    tallies = _tallies(rows.groupBy("module_name"), edges.alias("edges"),
                       F.count("response_time_ms").alias("n"))
    counted = _summary(tallies, "module_name", "edges", "n")
    # two neighbours in rank order may straddle the bracket: widen it by one distinct value
    target = F.col("n").cast("double") - 1
    summary = ["total_requests", "successful_requests", "failed_requests",
               "avg_response_time_ms", "max_response_time_ms"]
    brackets = counted.select(
        F.col("module_name").alias("_module"), F.col("edges")[0].alias("low"),
        F.col("edges")[1].alias("high"), (target * quantile).alias("position"), *summary)
    placed = rows.join(brackets, F.col("module_name").eqNullSafe(F.col("_module")))
    inside = placed.filter(value.between(F.col("low"), F.col("high")))
    outside = placed.groupBy("module_name").agg(
        F.count_if(value < F.col("low")).alias("below"),
        F.max(F.when(value < F.col("low"), value)).alias("before"),
        F.min(F.when(value > F.col("high"), value)).alias("after"),
        F.first("position").alias("position"), *[F.first(c).alias(c) for c in summary])
    in_order = W.partitionBy("module_name").orderBy("response_time_ms")
    ranked = (inside.groupBy("module_name", "response_time_ms").agg(F.count(F.lit(1)).alias("copies"))
              .withColumn("through", F.sum("copies").over(in_order))
              .join(outside.withColumnRenamed("module_name", "_module"),
                    F.col("module_name").eqNullSafe(F.col("_module")))
              .withColumn("last", F.col("below") + F.col("through") - 1)
              .withColumn("first", F.col("last") - F.col("copies") + 1))
    lower, upper = F.floor("position"), F.ceil("position")

    def at(rank):
        return F.max(F.when(rank.between(F.col("first"), F.col("last")), value))

    picked = ranked.groupBy("module_name").agg(
        F.coalesce(at(lower), F.max("before")).alias("lo"),
        F.coalesce(at(upper), F.min("after")).alias("hi"), F.first("position").alias("position"))
    weight = F.col("position") - F.floor("position")
    quantiles = picked.select(
        F.col("module_name").alias("_module"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * weight).alias("p95_latency_ms"))
    same = F.col("module_name").eqNullSafe(F.col("_module"))
    return outside.join(quantiles, same, "left").select(
        "module_name", "total_requests", "successful_requests", "failed_requests",
        F.col("avg_response_time_ms").alias("avg_latency_ms"), "p95_latency_ms",
        F.col("max_response_time_ms").alias("max_latency_ms"))


def ops_tiles(log: DataFrame, cooldowns: DataFrame, as_of) -> DataFrame:
    """One row for a dashboard; the two aggregates meet by union, not by a cross join."""
    calls = overall(log, as_of, 60).select(
        F.col("total_requests").alias("requests_1h"), "success_rate",
        F.col("avg_response_time_ms").alias("avg_latency_ms"))
    cooling = cooldowns.agg(F.count_if(F.col("cooldown_until") > clock.instant(as_of))
                            .alias("active_cooldowns"))
    both = calls.unionByName(cooling, allowMissingColumns=True)
    tiles = both.agg(*[F.max(c).alias(c) for c in both.columns])
    rate = F.col("success_rate")
    return tiles.withColumn("success_band", F.when(rate >= 0.95, "success")
                            .when(rate >= 0.8, "warning").otherwise("danger"))


def platform_stats(rules: DataFrame, modules: DataFrame, cooldowns: DataFrame, as_of) -> DataFrame:
    """Active and total counts of three tables, one row each."""
    def counts(name, df, active):
        return df.agg(F.count_if(active).alias("active"), F.count(F.lit(1)).alias("total")).select(
            F.lit(name).alias("entity"), "active", "total")

    return (counts("routing_rules", rules, F.col("enabled"))
            .union(counts("modules", modules, F.col("enabled")))
            .union(counts("cooldowns", cooldowns,
                          F.col("cooldown_until") > clock.instant(as_of))))
