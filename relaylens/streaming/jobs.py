"""Live forms of the batch operators.

Stateless work is a projection. Where order or keyed state matters, a micro-batch runs the
batch operator from the last committed state and commits the next version under its own epoch
number, so that a retried batch starts from the same state and replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from relaylens.operators import breaker, injection, pii, state
from relaylens.functions.text import extract_texts, role_list
from relaylens.sources import schemas
from relaylens.sources.keyed_table import BUCKETS, KeyedTable
from relaylens.sources.state_table import StateTable
from relaylens.streaming.sinks import each_batch, write_batch


def event_time(stream: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A watermark needs a zoned timestamp; the session zone is UTC."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def newest(column: str = "ts"):
    """The clock of a batch: its newest event time (the wall clock for a batch without rows)."""
    def read(batch: DataFrame):
        last = batch.agg(F.max(F.col(column).cast("timestamp_ntz")).alias("t")).first()["t"]
        return last if last is not None else F.localtimestamp()
    return read


def token_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    """A token store that takes the tokens of a batch without reading or rewriting others."""
    return KeyedTable(spark, path, schemas.PII_TOKENS, ["token"], pii.STORE_POLICIES,
                      ["request_id", "original_value"], buckets)


def mask_stream(messages: DataFrame, store: KeyedTable, out: str, checkpoint: str, as_of,
                ttl_hours: float = 24, every: str | None = None,
                compact_every: int = 16) -> DataStreamWriter:
    """Messages masked in flight and their tokens stored; upserts by token are idempotent.

    A batch writes its own tokens alone; each ``compact_every`` versions the buckets with many
    deltas are compacted.

    ``as_of`` is a time, or a function of the batch such as ``newest()``, so that a running job
    does not go on giving out tokens that expire by the time of its start.
    """
    moment = as_of if callable(as_of) else lambda _: as_of

    def handle(batch: DataFrame, epoch: int) -> None:
        seen = pii.with_spans(batch).persist()  # every text is matched once
        try:
            write_batch(pii.masked_at_spans(seen), out, epoch)
            found = pii.entities_at_spans(seen, "request_id").withColumn(
                "request_id", F.col("request_id").cast("string"))
            version = store.version_of(batch, epoch)
            store.merge(pii.entering(found, moment(batch), ttl_hours), version=version)
            if version % compact_every == compact_every - 1:
                store.compact()
        finally:
            seen.unpersist()

    return each_batch(messages, checkpoint, handle, every=every)


def screen_batch(batch: DataFrame, epoch: int, passed: str, log: str,
                 action: str = injection.LOG_ONLY, roles: str = "user",
                 extra: list[tuple[str, str]] = ()) -> None:
    """Screens the messages of whole requests and writes both outputs of a batch."""
    batch.persist()
    scanned = F.col("role").isin(*role_list(roles))
    texts = batch.select("*", F.posexplode(F.when(scanned, extract_texts(
        F.col("content"), F.col("parts")))).alias("part", "text"))
    hits = injection.scan(texts.filter(F.col("text") != ""), "text", extra).filter(
        F.col("pattern").isNotNull()).persist()
    try:
        write_batch(hits.select("request_id", "turn", "part", "pattern",
                                F.lit(action).alias("action"), "text"), log, epoch)
        first = hits.groupBy("request_id").agg(
            F.min_by("pattern", F.struct("turn", "part")).alias("pattern"))
        marked = batch.join(first, "request_id", "left")
        if action == injection.BLOCK:
            marked = marked.filter(F.col("pattern").isNull())
        detected = F.when(F.lit(action == injection.FLAG), F.col("pattern"))
        write_batch(marked.withColumn("injection_detected", detected).drop("pattern"),
                    passed, epoch)
    finally:
        hits.unpersist()
        batch.unpersist()


def screen_stream(messages: DataFrame, passed: str, log: str, checkpoint: str,
                  action: str = injection.LOG_ONLY, roles: str = "user",
                  extra: list[tuple[str, str]] = (), every: str | None = None) -> DataStreamWriter:
    """Messages screened in flight: the ones that go on, and one log row per detection.

    A request is one call, whose messages arrive together: one hit blocks all of them, or flags
    all of them with the pattern of the first hit. Only the hits are grouped and joined back, by
    request; Spark broadcasts them while they are few.
    """
    return each_batch(messages, checkpoint, lambda batch, epoch: screen_batch(
        batch, epoch, passed, log, action, roles, extra), every=every)


def metric_windows(log: DataFrame, width: str = "10 minutes", slide: str | None = "1 minute",
                   delay: str = "10 minutes") -> DataFrame:
    """Sliding summaries per module, for streams and tables alike."""
    timed = event_time(log, delay=delay) if log.isStreaming else log
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(window, "module_name").agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if("success").alias("successful_requests"),
        F.avg("response_time_ms").alias("avg_response_time_ms"),
        F.min("response_time_ms").alias("min_response_time_ms"),
        F.max("response_time_ms").alias("max_response_time_ms"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
             "module_name", "total_requests", "successful_requests", "avg_response_time_ms",
             "min_response_time_ms", "max_response_time_ms")


def metrics_stream(log: DataFrame, out: str, checkpoint: str, every: str | None = None,
                   **windows) -> DataStreamWriter:
    """Closed windows, appended once."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (metric_windows(log, **windows).writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(**trigger))


def breaker_stream(log: DataFrame, configs: DataFrame, states: StateTable, out: str,
                   checkpoint: str, every: str | None = None) -> DataStreamWriter:
    """Breakers over a stream: each micro-batch is replayed from the stored module states.

    The replay cuts a hot module into slices, which one state-store key could not. Rows that are
    older than what their module has already replayed would turn the machine back; they change
    nothing and are written to ``<out>-late``, so that none is lost unseen.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        version = states.version_of(batch, epoch)
        before = states.read(before=version)
        initial = before.select("module_name", breaker.as_initial(
            F.col("state"), F.col("failure_count"), F.col("success_count"),
            F.col("last_failure_at")).alias("initial"), F.col("last_seen_at").alias("_seen"))
        joined = batch.join(initial, batch["module_name"].eqNullSafe(initial["module_name"]),
                            "left").drop(initial["module_name"])
        is_late = F.coalesce(F.col("ts") < F.col("_seen"), F.lit(False))
        write_batch(joined.filter(is_late).select(*batch.columns), f"{out}-late", epoch)
        calls = breaker.outcomes(joined.filter(~is_late), configs, keep=["initial"])
        replayed = breaker.replay(calls).persist()
        try:
            write_batch(replayed, out, epoch)
            states.commit(breaker.status(replayed, previous=before), version=version)
        finally:
            replayed.unpersist()

    return each_batch(log, checkpoint, handle, every=every)


def cooldown_stream(errors: DataFrame, cooldowns: StateTable, checkpoint: str, hour: int = 0,
                    delay: str = "10 minutes", every: str | None = None) -> DataStreamWriter:
    """Cooldowns from live errors.

    A cooldown ends at the next reset, so it is a daily window that starts at the reset hour:
    a plain windowed aggregate, combined before the shuffle, whose state the watermark drops
    once the cooldown is over.
    """
    daily = F.window("ts", "1 day", "1 day", f"{hour} hours")
    live = event_time(errors, delay=delay).groupBy("model_key", daily).agg(
        F.max("ts").alias("last_error_at"))

    def handle(batch: DataFrame, epoch: int) -> None:
        changed = batch.select("model_key", F.col("window.end").cast("timestamp_ntz")
                               .alias("cooldown_until"))
        version = cooldowns.version_of(batch, epoch)
        cooldowns.commit(state.keyed_upsert(
            cooldowns.read(before=version), changed, ["model_key"],
            {"cooldown_until": state.GREATEST}, ["cooldown_until"]), version=version)

    return each_batch(live, checkpoint, handle, mode="update", every=every)
