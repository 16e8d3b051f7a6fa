"""Cooldowns of free-tier models: set by rate-limit errors, lifted at a daily reset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaylens.functions import clock

FREE, PAID = "-free", "-paid"


def with_settings(errors: DataFrame, settings: DataFrame) -> DataFrame:
    """Errors with the reset ``hour`` and ``zone`` of their key; 0:00 UTC without a setting."""
    own = settings.select("model_key", F.col("hour").alias("_hour"), F.col("zone").alias("_zone"))
    return errors.join(own, "model_key", "left").withColumns(
        {"hour": F.coalesce("_hour", F.lit(0)), "zone": F.coalesce("_zone", F.lit("UTC"))}
    ).drop("_hour", "_zone")


def from_errors(errors: DataFrame, hour: Column | int = 0,
                zone: Column | str = "UTC") -> DataFrame:
    """The cooldown table after a log of errors ``(model_key, ts, event_id)``; last write wins.

    Hour and zone may be columns of the errors; see ``with_settings``.
    """
    until = clock.next_reset(F.col("ts"), hour, zone)
    return errors.groupBy("model_key").agg(
        F.max_by(until, F.struct("ts", "event_id")).alias("cooldown_until"))


def periods(errors: DataFrame, hour: int = 0, zone: str = "UTC") -> DataFrame:
    """History: per key and reset period the first error, i.e. the start of the cooldown."""
    return (errors.withColumn("cooldown_until", clock.next_reset(F.col("ts"), hour, zone))
            .groupBy("model_key", "cooldown_until")
            .agg(F.min(F.struct("ts", "event_id")).alias("first_error")))


def is_active(as_of) -> Column:
    return F.coalesce(F.col("cooldown_until") > clock.instant(as_of), F.lit(False))


def status(cooldowns: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Active cooldowns by expiry, and one row with the active and total counts."""
    active = cooldowns.filter(F.col("cooldown_until") > clock.instant(as_of))
    counts = cooldowns.agg(F.count_if(is_active(as_of)).alias("active_count"),
                           F.count(F.lit(1)).alias("total_cooldown_records"))
    return active.orderBy("cooldown_until", "model_key"), counts


def listing(cooldowns: DataFrame, as_of) -> DataFrame:
    return cooldowns.withColumn("is_active", is_active(as_of)).orderBy("model_key")


def clear(cooldowns: DataFrame, as_of=None, mode: str = "expired",
          key: str | None = None) -> DataFrame:
    """Rows left after deleting the expired ones, the active ones, or one key."""
    if mode == "expired":
        doomed = F.col("cooldown_until") <= clock.instant(as_of)
    elif mode == "active":
        doomed = F.col("cooldown_until") > clock.instant(as_of)
    elif mode == "key":
        doomed = F.col("model_key") == F.lit(key)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return cooldowns.filter(~F.coalesce(doomed, F.lit(False)))


def free_tier_target(model: Column, cooling: Column, fallback: Column) -> Column:
    """``m-free`` unless it cools down; then ``m-paid``, or nothing without fallback."""
    return (F.when(~cooling, F.concat(model, F.lit(FREE)))
            .when(fallback, F.concat(model, F.lit(PAID))))


def route_free_tier(requests: DataFrame, cooldowns: DataFrame, as_of,
                    fallback: bool = True) -> DataFrame:
    """Decide all requests against one cooldown snapshot.

    Only active keys are joined. Spark broadcasts them when they are below its threshold and
    otherwise joins by shuffle, where AQE splits a hot model.
    """
    active = (cooldowns.filter(F.col("cooldown_until") > clock.instant(as_of))
              .select(F.regexp_replace("model_key", f"{FREE}$", "").alias("model_name"),
                      F.lit(True).alias("_cooling"))
              .filter(F.col("model_name") != F.lit("")))
    cooling = F.coalesce(F.col("_cooling"), F.lit(False))
    return requests.join(active, "model_name", "left").withColumn(
        "target_model", free_tier_target(F.col("model_name"), cooling, F.lit(fallback))
    ).drop("_cooling")


def route_free_tier_replay(requests: DataFrame, errors: DataFrame, fallback: bool = True,
                           hour: int = 0, zone: str = "UTC") -> DataFrame:
    """Decide every request against the cooldown state at its own time.

    A cooldown always lasts until the next reset, so a request is affected exactly when an
    earlier error of the same key falls into the same reset period. The as-of search is thus
    an equi-join on (key, reset time) with the first error of each period: no window over a
    whole key and at most one right row per left row. Ties on ``ts`` are ordered by id, and a
    request's own error comes after its decision.
    """
    started = periods(errors, hour, zone).select(
        "model_key", F.col("cooldown_until").alias("_reset"), "first_error")
    keyed = (requests.withColumn("model_key", F.concat("model_name", F.lit(FREE)))
             .withColumn("_reset", clock.next_reset(F.col("ts"), hour, zone)))
    joined = keyed.join(started, ["model_key", "_reset"], "left")
    this = F.struct(F.col("ts"), F.col("request_id").alias("event_id"))
    cooling = F.coalesce(F.col("first_error") < this, F.lit(False))
    return joined.withColumn(
        "target_model", free_tier_target(F.col("model_name"), cooling, F.lit(fallback))
    ).drop("model_key", "_reset", "first_error")
