"""Breaker queries, and the streams drained over the shipped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylens.functions.text import extract_texts
from relaylens.operators import breaker, routing, state
from relaylens.operators.pii import message_texts
from relaylens.plans import frames, views
from relaylens.plans.registry import query
from relaylens.plans.routing_queries import METRICS, ROUTE_QUALITY, quality_sql
from relaylens.plans.views import AS_OF, duckdb_mask, duckdb_scan
from relaylens.session import scratch_path
from relaylens.sources import schemas
from relaylens.sources.state_table import StateTable
from relaylens.streaming import (assessments, breakers, chunks, cooldowns, jobs, requests,
                                 rollups, sinks)

_BREAKER = """
    WITH RECURSIVE calls AS (
      SELECT module_name, event_id, ts, call, ok, n, r, m, ROW_NUMBER() OVER (
               PARTITION BY module_name ORDER BY ts, event_id, call) AS rn
      FROM (SELECT l.module_name, l.event_id, l.ts, true AS call,
                   l.success AND l.response_time_ms <= 1000 * COALESCE(c.timeout_seconds, 30) AS ok,
                   COALESCE(c.failure_threshold, 5) AS n, COALESCE(c.recovery_timeout, 60) AS r,
                   COALESCE(c.success_threshold, 3) AS m
            FROM {routing_log} l LEFT JOIN (SELECT * FROM {breaker_configs} WHERE enabled) c
              USING (module_name) RESETS) e),
    steps AS (
      SELECT DISTINCT module_name, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id,
             CAST(NULL AS TIMESTAMP) AS ts, true AS call, 'closed' AS before,
             CAST(NULL AS BOOLEAN) AS admitted, 'closed' AS state, CAST(0 AS BIGINT) AS f,
             CAST(0 AS BIGINT) AS s, CAST(NULL AS TIMESTAMP) AS failed_at FROM calls
      UNION ALL
      SELECT module_name, rn, event_id, ts, call, before, CASE WHEN call THEN NOT blocked END,
             CASE WHEN NOT call THEN 'closed' WHEN blocked THEN 'open'
                  WHEN ok AND now = 'half_open' AND s + 1 < m THEN 'half_open'
                  WHEN ok THEN 'closed'
                  WHEN now = 'half_open' OR f + 1 >= n THEN 'open' ELSE 'closed' END,
             CASE WHEN NOT call THEN 0 WHEN blocked THEN f
                  WHEN ok AND now = 'half_open' AND s + 1 < m THEN f
                  WHEN ok THEN 0 ELSE f + 1 END,
             CASE WHEN NOT call THEN 0 WHEN blocked THEN s
                  WHEN ok AND now = 'half_open' THEN s + 1 ELSE s END,
             CASE WHEN NOT call THEN NULL WHEN NOT blocked AND NOT ok THEN ts ELSE failed_at END
      FROM (SELECT *, CASE WHEN before = 'open' AND NOT blocked THEN 'half_open'
                           ELSE before END AS now,
                   CASE WHEN before = 'open' AND NOT blocked THEN 0 ELSE s_before END AS s
            FROM (SELECT c.*, p.state AS before, p.f, p.s AS s_before, p.failed_at,
                         p.state = 'open' AND epoch_us(c.ts) - epoch_us(p.failed_at)
                           < CAST(c.r AS BIGINT) * 1000000 AS blocked
                  FROM steps p JOIN calls c
                    ON c.module_name = p.module_name AND c.rn = p.rn + 1) a) b)
    """
_LOG = _BREAKER.replace("RESETS", "")
_RESETS = "SELECT event_id, ts, module_name FROM {routing_log} WHERE response_time_ms >= 20000"
_WITH_RESETS = _BREAKER.replace("RESETS", f"""
    UNION ALL SELECT x.module_name, x.event_id, x.ts, false, false, COALESCE(c.failure_threshold, 5),
           COALESCE(c.recovery_timeout, 60), COALESCE(c.success_threshold, 3)
    FROM ({_RESETS} UNION ALL SELECT DISTINCT CAST(-1 AS BIGINT),
            {{at}}'2024-01-10 00:00:00', module_name FROM {{routing_log}}) x
    LEFT JOIN (SELECT * FROM {{breaker_configs}} WHERE enabled) c USING (module_name)""")
_STEP = """event_id, module_name, before AS state_before, admitted, state AS state_after,
           f AS failure_count"""
_STATUS = """SELECT module_name, MAX_BY(state, rn) AS state, MAX_BY(f, rn) AS failure_count,
           MAX_BY(s, rn) AS success_count, ARG_MAX_NULL(failed_at, rn) AS last_failure_at,
           MAX(ts) AS last_seen_at
    FROM steps WHERE rn > 0 GROUP BY module_name"""


def _replay(t):
    return breaker.replay(breaker.outcomes(t.routing_log, t.breaker_configs))


@query("breaker_replay", f"{_LOG} SELECT {_STEP} FROM steps WHERE rn > 0")
def breaker_replay(t):
    return _replay(t).select("event_id", "module_name", "state_before", "admitted",
                             "state_after", "failure_count")


@query("breaker_status", f"""{_LOG} SELECT x.*,
    COALESCE(c.failure_threshold, 5) AS failure_threshold,
    COALESCE(c.recovery_timeout, 60) AS recovery_timeout FROM ({_STATUS}) x
    LEFT JOIN (SELECT * FROM {{breaker_configs}} WHERE enabled) c USING (module_name)""")
def breaker_status(t):
    config = breaker.breaker_config(t.routing_log, t.breaker_configs).select(
        "module_name", "failure_threshold", "recovery_timeout")
    return breaker.status(_replay(t), config)


@query("breaker_reset", f"{_WITH_RESETS} SELECT {_STEP}, NOT call AS reset FROM steps WHERE rn > 0")
def breaker_reset(t):
    resets = t.routing_log.filter("response_time_ms >= 20000").select(
        "event_id", "ts", "module_name")
    calls = breaker.with_resets(breaker.outcomes(t.routing_log, t.breaker_configs), resets,
                                [(-1, "2024-01-10 00:00:00")])
    return breaker.replay(calls).select("event_id", "module_name", "state_before", "admitted",
                                        "state_after", "failure_count", "reset")


@query("breaker_timeout", """
    SELECT event_id, l.success AND l.response_time_ms <= 1000 * COALESCE(c.timeout_seconds, 30) AS ok
    FROM {routing_log} l LEFT JOIN (SELECT * FROM {breaker_configs} WHERE enabled) c
      USING (module_name)""")
def breaker_timeout(t):
    return breaker.outcomes(t.routing_log, t.breaker_configs).select("event_id", "ok")


@query("breaker_config", """
    SELECT module_name, COALESCE(failure_threshold, 5) AS failure_threshold,
           COALESCE(recovery_timeout, 60) AS recovery_timeout,
           COALESCE(success_threshold, 3) AS success_threshold,
           COALESCE(timeout_seconds, 30) AS timeout_seconds
    FROM {routing_modules} LEFT JOIN (SELECT * FROM {breaker_configs} WHERE enabled) c
      USING (module_name)""")
def breaker_config(t):
    return breaker.breaker_config(t.routing_modules, t.breaker_configs)


_GATED = """CASE module_name WHEN 'module-0' THEN 'free_tier' WHEN 'module-1' THEN 'prompt_length'
           WHEN 'module-2' THEN 'quality' END"""


@query("route_switchboard", f"""{_LOG}
    SELECT request_id, module_name, state_open AS blocked, CASE WHEN NOT state_open THEN target END
             AS target_model,
           CASE WHEN module_name IS NULL THEN NULL WHEN state_open THEN 'circuit_breaker_open'
                ELSE COALESCE(target, 'default') END AS metric_target,
           CASE WHEN module_name IS NULL THEN NULL ELSE NOT state_open END AS metric_success
    FROM (
      SELECT t.request_id, r.module_name, b.request_id IS NOT NULL AS state_open,
             CASE r.module_name
               WHEN 'free_tier' THEN CASE
                 WHEN NOT EXISTS (SELECT 1 FROM {{rate_limit_events}} e
                   WHERE e.model_key = t.model_name || '-free' AND (e.ts, e.event_id) < (t.ts, t.request_id)
                     AND CAST(e.ts - INTERVAL 6 HOUR AS DATE) = CAST(t.ts - INTERVAL 6 HOUR AS DATE))
                   THEN t.model_name || '-free'
                 WHEN r.instance_config LIKE '%"false"%' THEN NULL
                 ELSE t.model_name || '-paid' END
               WHEN 'prompt_length' THEN CASE WHEN r.instance_config LIKE '%model_over%'
                 THEN CASE WHEN t.n <= 1500 THEN 'small' ELSE 'large' END END
               WHEN 'quality' THEN q.target_model END AS target
      FROM (SELECT x.request_id, x.ts, x.model_name, LENGTH(e.props) * 100 * (1 + x.request_id % 3) AS n
            FROM {{traffic}} x JOIN {{events}} e ON e.event_id = x.request_id) t
      LEFT JOIN {{routing_rules}} r ON r.model_name = t.model_name AND r.enabled
      LEFT JOIN ({ROUTE_QUALITY}) q ON q.request_id = t.request_id
      LEFT JOIN (SELECT DISTINCT t.request_id FROM {{traffic}} t
                 JOIN {{routing_rules}} r ON r.model_name = t.model_name AND r.enabled
                 JOIN (SELECT {_GATED} AS module, failed_at AS opened, failed_at + INTERVAL 1 SECOND
                         * CASE WHEN module_name = 'module-1' THEN 60 ELSE 3600 END AS over
                       FROM steps WHERE admitted AND state = 'open') s
                   ON s.module = r.module_name AND t.ts >= s.opened AND t.ts < s.over) b
        ON b.request_id = t.request_id) w""")
def route_switchboard(t):
    """All traffic through the chain; the breakers are those of the first three log modules."""
    def gated(df):
        return df.withColumn("module_name", F.when(
            F.col("module_name") == "module-0", routing.FREE_TIER).when(
            F.col("module_name") == "module-1", routing.PROMPT_LENGTH).when(
            F.col("module_name") == "module-2", routing.QUALITY)).filter("module_name is not null")

    blocked = breaker.blocked_periods(frames.written(t, _replay(t), "replayed"), t.breaker_configs)
    recovery = breaker.breaker_config(t.routing_log, t.breaker_configs)
    requests = t.traffic.join(t.events.select(
        F.col("event_id").alias("request_id"),
        (F.length("props") * 100 * (1 + F.col("event_id") % 3)).alias("prompt_length")),
        "request_id")
    decisions = routing.switchboard(requests, t.routing_rules, t.module_configs, t.weights,
                                    t.rate_limit_events, gated(recovery), gated(blocked))
    ruled = F.col("module_name").isNotNull()
    return decisions.select(
        "request_id", "module_name", "blocked", "target_model",
        F.when(ruled, routing.metric_target()).alias("metric_target"),
        F.when(ruled, ~F.col("blocked")).alias("metric_success"))


@query("module_overview", f"""{_LOG}
    SELECT m.module_name, COALESCE(display_name, m.module_name) AS display_name,
           COALESCE(description, '') AS description, COALESCE(version, '1.0.0') AS version, enabled,
           COALESCE(r.n, 0) AS rule_count, COALESCE(b.state, 'closed') AS cb_state,
           CASE WHEN m.module_name = 'module-1' THEN (SELECT COUNT(*) FROM {{token_store}}
             WHERE expires_at > {{at}}'{AS_OF}') END AS active_tokens,
           CASE WHEN m.module_name = 'module-1' THEN (SELECT COUNT(*) FROM {{token_store}}) END
             AS total_tokens
    FROM {{routing_modules}} m
    LEFT JOIN (SELECT module_name, COUNT(*) AS n FROM {{routing_rules}} GROUP BY 1) r
      ON r.module_name = m.module_name
    LEFT JOIN ({_STATUS}) b ON b.module_name = m.module_name""")
def module_overview(t):
    return state.module_overview(t.routing_modules, t.routing_rules, breaker.status(_replay(t)),
                                 frames.token_store(t), AS_OF, token_module="module-1")


def _paths(t, label):
    return scratch_path(t.spark, label), scratch_path(t.spark, f"{label}-progress")


@query("fan_out_stream", """
    SELECT 'success' AS sink, module_name, COUNT(*) AS n FROM {routing_log} WHERE success
    GROUP BY module_name
    UNION ALL SELECT 'failure', module_name, COUNT(*) FROM {routing_log} WHERE NOT success
    GROUP BY module_name
    UNION ALL SELECT 'error', 'broken', 1""")
def fan_out_stream(t):
    good, progress = _paths(t, "fan-out")
    bad, errors = f"{good}-failures", f"{good}-errors"

    def broken(batch, epoch):
        raise RuntimeError("this consumer always fails")

    sinks.drain(sinks.fan_out(t.live.routing_log, progress, {
        "broken": broken,
        "success": lambda b, e: sinks.write_batch(b.filter("success"), good, e),
        "failure": lambda b, e: sinks.write_batch(b.filter("not success"), bad, e),
        "switched_off": lambda b, e: sinks.write_batch(b, good, e + 10_000),
    }, errors, enabled={"switched_off": False}))

    def counted(name, path):
        return sinks.read_output(t.spark, path, schemas.ROUTING_LOG).groupBy("module_name").agg(
            F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sink"), "module_name", "n")

    failed = sinks.read_output(t.spark, errors, "sink STRING, epoch BIGINT, error STRING")
    return (counted("success", good).union(counted("failure", bad))
            .union(failed.groupBy("sink").agg(F.count(F.lit(1)).alias("n")).select(
                F.lit("error"), "sink", "n")))


@query("fan_out_fed_again", "SELECT event_id, module_name, success FROM {routing_log}")
def fan_out_fed_again(t):
    """A sink that fails at its first two attempts ends with every row, and with none twice."""
    out, progress = _paths(t, "fed-again")
    dead, attempts = f"{out}-dead", []

    def flaky(batch, epoch):
        attempts.append(epoch)
        if len(attempts) <= 2:
            sinks.write_batch(batch.limit(1), out, epoch)  # it had begun
            raise RuntimeError("this consumer fails twice")
        sinks.write_batch(batch, out, epoch)

    _late_parts(t, t.routing_log, lambda live: sinks.drain(sinks.fan_out(
        live, progress, {"flaky": flaky}, f"{out}-errors", dead_letters=dead)))
    sinks.feed_again(t.spark, dead, "flaky", flaky)
    return sinks.read_output(t.spark, out, schemas.ROUTING_LOG).select(
        "event_id", "module_name", "success")


@query("stream_mask", f"""
    SELECT request_id, turn, part, {duckdb_mask('text')} AS text, CAST(NULL AS VARCHAR) AS token,
           CAST(NULL AS VARCHAR) AS original_value
    FROM {{message_texts}}
    UNION ALL
    SELECT NULL, NULL, NULL, NULL, {views.duckdb_token('v')}, v FROM (SELECT DISTINCT v FROM (
      SELECT UNNEST(regexp_extract_all(text, '{{pii_pattern}}')) AS v FROM {{message_texts}}) a) b""")
def stream_mask(t):
    out, progress = _paths(t, "mask")
    store = jobs.token_table(t.spark, scratch_path(t.spark, "tokens"))
    live = frames.messages(t.live)
    sinks.drain(jobs.mask_stream(live, store, out, progress, lambda batch: AS_OF))
    masked = sinks.read_output(t.spark, out, live.schema)
    return message_texts(masked, "request_id", "turn").unionByName(
        store.read().select("token", "original_value"), allowMissingColumns=True)


@query("stream_screen", f"""
    SELECT request_id, turn, part, {duckdb_scan('text')} AS pattern, 'block' AS outcome, text
    FROM {{message_texts}} WHERE role = 'user' AND {duckdb_scan('text')} IS NOT NULL
    UNION ALL
    SELECT request_id, turn, NULL, NULL, 'passed', (SELECT STRING_AGG(x.text, '|' ORDER BY x.part)
      FROM {{message_texts}} x WHERE x.request_id = m.request_id AND x.turn = m.turn)
    FROM {{messages}} m
    WHERE request_id NOT IN (SELECT request_id FROM {{message_texts}}
           WHERE role = 'user' AND {duckdb_scan('text')} IS NOT NULL)""")
def stream_screen(t):
    passed, progress = _paths(t, "screen")
    log = f"{passed}-log"
    live = frames.messages(t.live)
    sinks.drain(jobs.screen_stream(live, passed, log, progress, action="block"))
    hits = sinks.read_output(t.spark, log, "request_id BIGINT, turn BIGINT, part INT, "
                             "pattern STRING, action STRING, text STRING")
    went_on = sinks.read_output(t.spark, passed, live.schema)
    texts = extract_texts(F.col("content"), F.col("parts"))
    return hits.select("request_id", "turn", "part", "pattern", F.col("action").alias("outcome"),
                       "text").unionByName(
        went_on.select("request_id", "turn", F.lit("passed").alias("outcome"), F.when(
            F.size(texts) > 0, F.array_join(texts, "|")).alias("text")), allowMissingColumns=True)


@query("stream_screen_held", f"""
    SELECT request_id, turn FROM {{messages}}
    WHERE request_id NOT IN (SELECT request_id FROM {{message_texts}}
           WHERE role = 'user' AND {duckdb_scan('text')} IS NOT NULL)""")
def stream_screen_held(t):
    """The messages of every request dealt over three batches; every fifth request does not say
    how many it has and is judged by what is there at the end."""
    whole = frames.messages(t)
    counts = whole.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    asked = whole.join(counts, "request_id").withColumns({
        "n_messages": F.when(F.col("request_id") % 5 != 0, F.col("n")),
        "ts": F.timestamp_seconds(1_706_572_800 + F.col("request_id") % 60).cast("timestamp_ntz")
    }).drop("n")
    asked = frames.written(t, asked, "asked")
    passed, progress = _paths(t, "held")
    log, source = f"{passed}-log", scratch_path(t.spark, "held-messages")
    for part in range(3):
        asked.filter(F.pmod(F.xxhash64("request_id", "turn"), F.lit(3)) == part).write.mode(
            "append").parquet(source)
        live = t.spark.readStream.schema(asked.schema).parquet(source)
        sinks.drain(jobs.screen_stream(requests.held_requests(live, "n_messages"), passed, log,
                                       progress, action="block"))
    jobs.screen_batch(requests.left_over(t.spark, progress, asked.schema), chunks.LAST_BATCH,
                      passed, log, action="block")
    return sinks.read_output(t.spark, passed, asked.schema).select("request_id", "turn")


@query("stream_metrics", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, module_name,
           COUNT(*) AS total_requests, COUNT(*) FILTER (success) AS successful_requests,
           ROUND(AVG(response_time_ms), 4) AS avg_response_time_ms,
           MAX(response_time_ms) AS max_response_time_ms
    FROM {routing_log}
    WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR
       <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM {routing_log}) GROUP BY 1, 2""")
def stream_metrics(t):
    out, progress = _paths(t, "windows")
    sinks.drain(jobs.metrics_stream(t.live.routing_log, out, progress,
                                    width="1 hour", slide=None))
    return t.spark.read.parquet(out).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "module_name",
        "total_requests", "successful_requests",
        F.round("avg_response_time_ms", 4).alias("avg_response_time_ms"), "max_response_time_ms")


LATE_PARTS = 3


def _late_parts(t, rows, drain):
    """Rows in parts by arrival, each up to ten minutes late, in shuffled files; ``drain`` runs
    once for each part, over a stream of all files so far."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    arrives = seconds + F.pmod(F.xxhash64("event_id"), F.lit(590))
    bounds = rows.agg(F.min(seconds).alias("a"), F.max(seconds).alias("b")).first()
    first, last = bounds["a"] or 0, bounds["b"] or 0
    part = F.floor((arrives - first) / ((last - first + 600) // LATE_PARTS + 1))
    source = scratch_path(t.spark, "late-rows")
    for k in range(LATE_PARTS):
        rows.filter(part == k).repartition(4).write.mode("append").parquet(source)
        drain(t.spark.readStream.schema(rows.schema).parquet(source))


def _late_breakers(t):
    out, progress = _paths(t, "breaker")
    _late_parts(t, t.routing_log, lambda live: sinks.drain(breakers.breaker_event_stream(
        live, t.breaker_configs, out, progress, span_seconds=3600)))
    breakers.write_left_over(t.spark, out, progress)
    return sinks.read_output(t.spark, out, breakers.OUT).drop("batch")


@query("stream_breaker", f"{_LOG} SELECT {_STEP} FROM steps WHERE rn > 0")
def stream_breaker(t):
    return _late_breakers(t).filter(F.col("kind") == breakers.CALL).select(
        "event_id", "module_name", "state_before", "admitted", "state_after", "failure_count")


@query("stream_breaker_recovered", f"""{_LOG}
    SELECT s.module_name, s.ts + INTERVAL 1 SECOND * COALESCE(c.recovery_timeout, 60) AS ts
    FROM steps s LEFT JOIN (SELECT * FROM {{breaker_configs}} WHERE enabled) c USING (module_name)
    WHERE s.rn > 0 AND s.admitted AND s.state = 'open'""")
def stream_breaker_recovered(t):
    return _late_breakers(t).filter(F.col("kind") == breakers.RECOVERED).select(
        "module_name", "ts")


@query("stream_metrics_sizes", f"""
    SELECT CAST(w AS INTEGER) AS minutes, start AS window_start, module_name,
           COUNT(*) AS total_requests, COUNT(*) FILTER (success) AS successful_requests,
           ROUND(AVG(response_time_ms), 4) AS avg_response_time_ms,
           MIN(response_time_ms) AS min_response_time_ms,
           MAX(response_time_ms) AS max_response_time_ms
    FROM ({' UNION ALL '.join(f"""
      SELECT {width} AS w, time_bucket(INTERVAL {slide} MINUTE, ts)
               - INTERVAL {slide} MINUTE * UNNEST(range({width // slide})) AS start, *
      FROM {{routing_log}}""" for width, slide in rollups.WINDOWS)}) x
    WHERE start + INTERVAL 1 MINUTE * w <= (
      SELECT MAX(time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE) FROM {{routing_log}}
      WHERE time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE
         <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM {{routing_log}}))
    GROUP BY 1, 2, 3""")
def stream_metrics_sizes(t):
    """Windows of all sizes over the log in three parts, up to ten minutes late."""
    out, progress = _paths(t, "sizes")
    kept = StateTable(t.spark, scratch_path(t.spark, "panes"), rollups.PANES)
    _late_parts(t, t.routing_log, lambda live: sinks.drain(rollups.rollup_stream(
        live, kept, out, progress)))
    return sinks.read_output(t.spark, out, rollups.OUT).select(
        "minutes", "window_start", "module_name", "total_requests", "successful_requests",
        F.round("avg_response_time_ms", 4).alias("avg_response_time_ms"), "min_response_time_ms",
        "max_response_time_ms")


@query("stream_cooldown", """
    SELECT model_key, MAX(CASE WHEN EXTRACT(HOUR FROM ts) < 6
             THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR
             ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 30 HOUR END) AS cooldown_until
    FROM {rate_limit_events} GROUP BY model_key""")
def stream_cooldown(t):
    table = StateTable(t.spark, scratch_path(t.spark, "cooldowns"), schemas.COOLDOWNS)
    sinks.drain(jobs.cooldown_stream(t.live.rate_limit_events, table,
                                     scratch_path(t.spark, "cooldown-progress"), hour=6))
    return table.read()


@query("stream_cooldown_zones", """
    SELECT model_key, MAX(CAST(CAST(shifted - INTERVAL 3 HOUR AS DATE) AS TIMESTAMP)
             + INTERVAL 27 HOUR - away) AS cooldown_until
    FROM (SELECT model_key, ts + away AS shifted, away FROM (
      SELECT *, CASE WHEN CAST(regexp_extract(model_key, 'model-(\\d+)-free', 1) AS BIGINT) % 2 = 0
                     THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END AS away
      FROM {rate_limit_events}) a) b GROUP BY model_key""")
def stream_cooldown_zones(t):
    """Even models reset at three o'clock in Kolkata, odd ones at three in UTC."""
    even = F.regexp_extract("model_key", r"model-(\d+)-free", 1).cast("bigint") % 2 == 0
    settings = t.rate_limit_events.select("model_key").distinct().withColumns(
        {"hour": F.lit(3), "zone": F.when(even, F.lit("Asia/Kolkata"))})
    out, progress = _paths(t, "cooldown-changes")
    table = cooldowns.cooldown_table(t.spark, scratch_path(t.spark, "cooldown-deltas"))
    _late_parts(t, t.rate_limit_events, lambda live: sinks.drain(cooldowns.cooldown_event_stream(
        live, settings, table, out, progress)))
    return table.read()


_NEWEST = "(SELECT MAX(ts) FROM {routing_log})"


@query("stream_assess", f"""
    SELECT p.rule_model_name, p.candidate_model, q.score, {_NEWEST} AS last_assessed_at,
           1 AS assessment_count
    FROM {{rule_pools}} p JOIN ({' UNION ALL '.join(
        quality_sql(m, f"{_NEWEST} - INTERVAL 1 DAY", _NEWEST) for m in METRICS)}) q
      USING (candidate_model, scoring_metric)""")
def stream_assess(t):
    recent, weights = _assessed(t)
    sinks.drain(assessments.assess_schedule(
        t.live.routing_log, recent, lambda: t.routing_rules, weights,
        scratch_path(t.spark, "assess-progress"), every=None))
    return weights.read().withColumn("score", F.round("score", 6))


def _assessed(t):
    return (assessments.RecentLog(t.spark, scratch_path(t.spark, "recent"), schemas.ROUTING_LOG),
            StateTable(t.spark, scratch_path(t.spark, "weights"), schemas.QUALITY_WEIGHTS))


@query("stream_assess_late", f"""
    SELECT p.rule_model_name, p.candidate_model, q.score, {_NEWEST} AS last_assessed_at,
           {LATE_PARTS} AS assessment_count
    FROM {{rule_pools}} p JOIN ({' UNION ALL '.join(
        quality_sql(m, f"{_NEWEST} - INTERVAL 1 DAY", _NEWEST) for m in METRICS)}) q
      USING (candidate_model, scoring_metric)""")
def stream_assess_late(t):
    """A cycle for each of three parts of the log, whose last day comes partly late; the last
    part holds the newest row."""
    recent, weights = _assessed(t)
    progress = scratch_path(t.spark, "assess-progress")
    _late_parts(t, t.routing_log, lambda live: sinks.drain(assessments.assess_schedule(
        live, recent, lambda: t.routing_rules, weights, progress, every=None)))
    return weights.read().withColumn("score", F.round("score", 6))


@query("stream_restore", f"""
    SELECT request_id, MD5(text) AS digest, LENGTH(text) AS n_chars FROM (
      SELECT s.request_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i]
             || CASE WHEN i > len(f) THEN ''
                     WHEN list_contains(live, {views.duckdb_token('f[i]')}) THEN f[i]
                     ELSE {views.duckdb_token('f[i]')} END), '') AS text
      FROM (SELECT *, regexp_extract_all(text, '{{pii_pattern}}') AS f,
                   string_split_regex(text, '{{pii_pattern}}') AS g,
                   (SELECT list(token) FROM {{token_store}}
                    WHERE expires_at > {{at}}'{AS_OF}') AS live
            FROM {{sources}} WHERE request_id IN (SELECT request_id FROM {{found}})) s) q""")
def stream_restore(t):
    """Chunks in three shuffled parts, one a run: a fifth of the responses never finish, another
    fifth arrive twice. Whatever came in goes out once."""
    whole = frames.written(t, frames.chunks(t), "all-chunks")
    lot = F.pmod(F.xxhash64("request_id"), F.lit(5))
    sent = whole.withColumn("finish_reason", F.when(lot != 0, F.col("finish_reason")))
    deal = F.pmod(F.xxhash64("request_id", "seq"), F.lit(2))
    folder = scratch_path(t.spark, "chunks")
    out, progress = _paths(t, "restored")
    store = frames.token_store(t)
    for part in (sent.filter(deal == 0), sent.filter(deal == 1), sent.filter(lot == 1)):
        part.write.mode("append").parquet(folder)
        live = t.spark.readStream.schema(
            "request_id STRING, seq BIGINT, delta STRING, finish_reason STRING").parquet(folder)
        sinks.drain(chunks.restore_stream(live, lambda: store, lambda _: AS_OF, out, progress))
    chunks.restore_left_over(t.spark, store, AS_OF, out, progress)
    pieces = sinks.read_output(t.spark, out, "request_id STRING, seq BIGINT, delta STRING")
    return _joined(pieces)


def _joined(pieces):
    """A response is one value of the source table, so gathering its pieces restores a row."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    texts = pieces.groupBy("request_id").agg(F.array_join(
        F.transform(ordered, lambda p: p["delta"]), "").alias("text"))
    return texts.select("request_id", F.md5("text").alias("digest"),
                        F.length("text").cast("bigint").alias("n_chars"))
