"""Queries over the routing log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from relaylens.operators import latency, metrics
from relaylens.plans.registry import query
from relaylens.session import scratch_path
from relaylens.sources import tables

NOON = "2024-01-15 12:00:00"
WEEK = 7 * 1440


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("src_scan", """
    SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total
    FROM {events} GROUP BY event_type""")
def src_scan(t):
    events = tables.read_table(
        t.spark, f"{t.sf_dir}/events.parquet",
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                            F.round(F.sum("value"), 2).alias("total"))


@query("metrics_persist", """
    SELECT module_name, COUNT(*) AS n, COUNT(DISTINCT CAST(ts AS DATE)) AS days,
           COUNT(*) FILTER (ts > {at}'2024-01-10 00:00:00' AND ts <= {at}'2024-01-17 00:00:00')
             AS of_a_week
    FROM {routing_log} GROUP BY module_name""")
def metrics_persist(t):
    path = scratch_path(t.spark, "metrics")
    tables.persist_metrics(t.routing_log, path)
    stored = tables.read_table(t.spark, path)
    week = metrics.recent(stored, "2024-01-17 00:00:00", WEEK)  # reads the days it needs only
    return stored.groupBy("module_name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("days")).join(
        week.groupBy("module_name").agg(F.count(F.lit(1)).alias("of_a_week")),
        "module_name", "left").fillna(0, ["of_a_week"])


@query("metric_rows", """
    SELECT event_id, model_name, module_name, COALESCE(target_model, 'default') AS target_model,
           ROUND(CAST(FLOOR(response_time_ms) AS BIGINT), 3) AS response_time_ms, success
    FROM (SELECT event_id, model_name, module_name, success, response_time_ms,
                 CASE WHEN success THEN target_model END AS target_model FROM {routing_log}) l""")
def metric_rows(t):
    elapsed = F.make_dt_interval(secs=F.floor("response_time_ms") / 1000)
    outcomes = t.routing_log.select(
        "event_id", "model_name", "module_name", "success", "error_message",
        F.when(F.col("success"), F.col("target_model")).alias("target_model"),
        F.col("ts").alias("started_at"), (F.col("ts") + elapsed).alias("finished_at"))
    return metrics.metric_rows(outcomes, "event_id").select(
        "event_id", "model_name", "module_name", "target_model",
        F.round("response_time_ms", 3).alias("response_time_ms"), "success")


@query("metric_tail", """
    SELECT event_id, ts, model_name, response_time_ms FROM {routing_log}
    ORDER BY ts DESC, event_id DESC LIMIT 500""")
def metric_tail(t):
    return metrics.newest(t.routing_log, 500).select(
        "event_id", "ts", "model_name", "response_time_ms")


_STATS = """COUNT(*) AS total_requests, COUNT(*) FILTER (success) AS successful_requests,
    COUNT(*) FILTER (NOT success) AS failed_requests,
    ROUND(COALESCE(AVG(CASE WHEN success THEN 1.0 ELSE 0.0 END), 0.0), 4) AS success_rate,
    ROUND(COALESCE(AVG(response_time_ms), 0.0), 4) AS avg_response_time_ms"""
_IN_WEEK = """ts > {at}'2024-01-08 12:00:00' AND ts <= {at}'2024-01-15 12:00:00'"""


@query("metrics_overall", f"""
    SELECT {_STATS}, {WEEK} AS period_minutes FROM {{routing_log}} WHERE {_IN_WEEK}
    UNION ALL
    SELECT {_STATS}, 60 FROM {{routing_log}}
    WHERE ts > {{at}}'2025-01-30 23:00:00' AND ts <= {{at}}'2025-01-31 00:00:00'""")
def metrics_overall(t):
    log = t.routing_log
    both = metrics.overall(log, NOON, WEEK).union(metrics.overall(log, "2025-01-31 00:00:00", 60))
    return rounded(both, "success_rate", "avg_response_time_ms")


@query("metrics_by_module", f"""
    SELECT module_name, {_STATS}, MIN(response_time_ms) AS min_response_time_ms,
           MAX(response_time_ms) AS max_response_time_ms
    FROM {{routing_log}} WHERE {_IN_WEEK} GROUP BY module_name""")
def metrics_by_module(t):
    return rounded(metrics.by_module(t.routing_log, NOON, WEEK),
                   "success_rate", "avg_response_time_ms")


@query("metrics_by_model", f"""
    SELECT model_name, COUNT(*) AS total_requests,
           STRING_AGG(DISTINCT module_name, ',' ORDER BY module_name) AS modules_used
    FROM {{routing_log}} WHERE {_IN_WEEK} GROUP BY model_name""")
def metrics_by_model(t):
    return (metrics.by_model(t.routing_log, NOON, WEEK)
            .withColumn("modules_used", F.array_join("modules_used", ",")))


@query("recent_errors", """
    SELECT ts, event_id, model_name, module_name, error_message, response_time_ms
    FROM {routing_log} WHERE NOT success ORDER BY ts DESC, event_id DESC LIMIT 50""")
def recent_errors(t):
    return metrics.recent_errors(t.routing_log)


@query("module_counters", """
    SELECT 'routing.' || module_name || '.' || kind AS counter, COUNT(*) AS value
    FROM (SELECT module_name, UNNEST(['total', CASE WHEN success THEN 'success' ELSE 'error' END])
                 AS kind FROM {routing_log}) x
    GROUP BY 1""")
def module_counters(t):
    return metrics.module_counters(t.routing_log)


@query("module_counters_running", """
    SELECT event_id, module_name, ts, COUNT(*) OVER w AS total,
           COUNT(*) FILTER (success) OVER w AS success,
           COUNT(*) FILTER (NOT success) OVER w AS error
    FROM {routing_log}
    WINDOW w AS (PARTITION BY module_name ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def module_counters_running(t):
    return metrics.running_counters(t.routing_log)


@query("rolling_latency", """
    SELECT module_name, ts, event_id, response_time_ms, recency FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY module_name ORDER BY ts DESC, event_id DESC)
             AS recency FROM {routing_log}) r WHERE recency <= 100""")
def rolling_latency(t):
    return metrics.rolling_latency(t.routing_log)


def _alerts_sql(start, end):
    window = f"ts > {{at}}'{start}' AND ts <= {{at}}'{end}'"
    scopes = f"""
      SELECT CAST(NULL AS VARCHAR) AS module,
             COALESCE(AVG(CASE WHEN success THEN 1.0 ELSE 0.0 END), 0.0) AS rate,
             COALESCE(AVG(response_time_ms), 0.0) AS ms
      FROM {{routing_log}} WHERE {window}
      UNION ALL
      SELECT module_name, AVG(CASE WHEN success THEN 1.0 ELSE 0.0 END), AVG(response_time_ms)
      FROM {{routing_log}} WHERE {window} GROUP BY module_name"""
    return f"""
      SELECT CASE WHEN module IS NULL THEN '' ELSE 'module_' END || 'low_success_rate' AS type,
             'warning' AS severity,
             COALESCE('Module ' || module, 'Overall') || ' success rate ('
               || PRINTF('%.2f', rate * 100) || '%) below threshold' AS message,
             module, ROUND(rate, 4) AS value, CAST(0.95 AS DOUBLE) AS threshold
      FROM ({scopes}) s WHERE rate < 0.95
      UNION ALL
      SELECT CASE WHEN module IS NULL THEN '' ELSE 'module_' END || 'high_response_time',
             'warning', COALESCE('Module ' || module, 'Average') || ' response time ('
               || PRINTF('%.1f', ms) || 'ms) above threshold',
             module, ROUND(ms, 4), CAST(5000 AS DOUBLE)
      FROM ({scopes}) s WHERE ms > 5000"""


@query("perf_alerts", _alerts_sql("2024-01-14 12:00:00", "2024-01-15 12:00:00")
       + " UNION ALL " + _alerts_sql("2025-01-30 23:50:00", "2025-01-31 00:00:00"))
def perf_alerts(t):
    log = t.routing_log
    raised = metrics.alerts(log, NOON, 1440).unionByName(
        metrics.alerts(log, "2025-01-31 00:00:00"))
    return rounded(raised, "value")


def _report_sql():
    def period(label, start):
        window = f"ts > {{at}}'{start}' AND ts <= {{at}}'2024-01-15 12:00:00'"
        return f"""
          SELECT 'summary' AS section, '{label}' AS item, CAST(NULL AS VARCHAR) AS module_name,
                 COUNT(*) AS n, ROUND(COALESCE(AVG(response_time_ms), 0.0), 4) AS value
          FROM {{routing_log}} WHERE {window}
          UNION ALL
          SELECT 'summary', '{label}', module_name, COUNT(*), ROUND(AVG(response_time_ms), 4)
          FROM {{routing_log}} WHERE {window} GROUP BY module_name"""
    return f"""{period('last_hour', '2024-01-15 11:00:00')}
        UNION ALL {period('last_24_hours', '2024-01-14 12:00:00')}
        UNION ALL SELECT 'error', error_message, module_name, event_id, response_time_ms FROM (
          SELECT * FROM {{routing_log}}
          WHERE NOT success AND ts <= {{at}}'2024-01-15 12:00:00'
          ORDER BY ts DESC, event_id DESC LIMIT 20) e
        UNION ALL SELECT 'alert', type, module, 1, value
        FROM ({_alerts_sql('2024-01-15 11:50:00', '2024-01-15 12:00:00')}) a"""


@query("perf_report", _report_sql())
def perf_report(t):
    parts = metrics.report(t.routing_log, NOON)
    summary = parts["summary"].select(
        F.lit("summary").alias("section"), F.col("period").alias("item"), "module_name",
        F.col("total_requests").alias("n"), F.round("avg_response_time_ms", 4).alias("value"))
    errors = parts["recent_errors"].select(
        F.lit("error"), "error_message", "module_name", "event_id", "response_time_ms")
    raised = parts["active_alerts"].select(
        F.lit("alert"), "type", "module", F.lit(1).cast("bigint"), F.round("value", 4))
    return summary.union(errors).union(raised)


@query("metrics_retention", """
    SELECT COUNT(*) FILTER (ts < {at}'2024-01-10 12:00:00') AS removed,
           COUNT(*) FILTER (ts >= {at}'2024-01-10 12:00:00') AS kept,
           (SELECT COUNT(*) FROM {routing_log} WHERE ts >= {at}'2024-01-10 12:00:00') AS rows_left,
           MIN(ts) FILTER (ts >= {at}'2024-01-10 12:00:00') AS oldest
    FROM {routing_log}""")
def metrics_retention(t):
    log, as_of = t.routing_log, "2024-01-31 12:00:00"
    path = scratch_path(t.spark, "metrics")
    tables.persist_metrics(log, path)
    tables.drop_before(t.spark, path, datetime(2024, 1, 10, 12), "ts", "date")
    counts = metrics.retention_counts(log, as_of, 21)
    left = tables.read_table(t.spark, path).agg(F.count(F.lit(1)).alias("rows_left"),
                                                F.min("ts").alias("oldest"))
    both = counts.unionByName(left, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query("latency_p95", f"""
    SELECT module_name, COUNT(*) AS total_requests,
           COUNT(*) FILTER (success) AS successful_requests,
           COUNT(*) FILTER (NOT success) AS failed_requests,
           ROUND(AVG(response_time_ms), 4) AS avg_latency_ms,
           ROUND(QUANTILE_CONT(response_time_ms, 0.95), 4) AS p95_latency_ms,
           MAX(response_time_ms) AS max_latency_ms
    FROM {{routing_log}} WHERE {_IN_WEEK} GROUP BY module_name""")
def latency_p95(t):
    return rounded(metrics.latency_table(t.routing_log, NOON, WEEK),
                   "avg_latency_ms", "p95_latency_ms")


@query("latency_p95_stored", f"""
    SELECT module_name, COUNT(*) AS total_requests,
           COUNT(*) FILTER (success) AS successful_requests,
           COUNT(*) FILTER (NOT success) AS failed_requests,
           ROUND(AVG(response_time_ms), 4) AS avg_latency_ms,
           ROUND(QUANTILE_CONT(response_time_ms, 0.95), 4) AS p95_latency_ms,
           MAX(response_time_ms) AS max_latency_ms
    FROM {{routing_log}} WHERE {_IN_WEEK} GROUP BY module_name""")
def latency_p95_stored(t):
    """``latency_p95`` from the sketches of all days."""
    path = scratch_path(t.spark, "latency")
    latency.store_days(t.routing_log, path)
    return rounded(latency.stored_latency_table(t.spark, path, NOON, WEEK),
                   "avg_latency_ms", "p95_latency_ms")


@query("ops_tiles", """
    SELECT requests_1h, ROUND(success_rate, 4) AS success_rate,
           ROUND(avg_latency_ms, 4) AS avg_latency_ms, active_cooldowns,
           CASE WHEN success_rate >= 0.95 THEN 'success' WHEN success_rate >= 0.8 THEN 'warning'
                ELSE 'danger' END AS success_band
    FROM (SELECT COUNT(*) AS requests_1h,
                 COALESCE(AVG(CASE WHEN success THEN 1.0 ELSE 0.0 END), 0.0) AS success_rate,
                 COALESCE(AVG(response_time_ms), 0.0) AS avg_latency_ms,
                 (SELECT COUNT(*) FROM {cooldowns}
                  WHERE cooldown_until > {at}'2024-01-15 12:00:00') AS active_cooldowns
          FROM {routing_log}
          WHERE ts > {at}'2024-01-15 11:00:00' AND ts <= {at}'2024-01-15 12:00:00') x""")
def ops_tiles(t):
    return rounded(metrics.ops_tiles(t.routing_log, t.cooldowns, NOON),
                   "success_rate", "avg_latency_ms")


@query("platform_stats", """
    SELECT 'routing_rules' AS entity, COUNT(*) FILTER (enabled) AS active, COUNT(*) AS total
    FROM {routing_rules}
    UNION ALL SELECT 'modules', COUNT(*) FILTER (enabled), COUNT(*) FROM {routing_modules}
    UNION ALL SELECT 'cooldowns', COUNT(*) FILTER (cooldown_until > {at}'2024-01-15 12:00:00'),
                     COUNT(*) FROM {cooldowns}""")
def platform_stats(t):
    return metrics.platform_stats(t.routing_rules, t.routing_modules, t.cooldowns, NOON)
