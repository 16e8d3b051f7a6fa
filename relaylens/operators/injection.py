"""Screening messages for prompt injection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relaylens.functions import text

LOG_ONLY, FLAG, BLOCK = "log_only", "flag", "block"


def scan(df: DataFrame, column: str, extra: list[tuple[str, str]] = (),
         into: str = "pattern") -> DataFrame:
    """Name of the first pattern each text matches, null when clean.

    The normalised text and its lower-case form are columns, so the patterns share them.
    """
    patterns = [*text.INJECTION_PATTERNS, *extra]
    return (df.withColumn("_normalised", text.normalise(F.col(column)))
            .withColumn("_lowered", text.folded(F.col("_normalised")))
            .withColumn(into, text.first_match("_normalised", "_lowered", patterns))
            .drop("_normalised", "_lowered"))


def detections(messages: DataFrame, roles: str = "user",
               extra: list[tuple[str, str]] = ()) -> DataFrame:
    """Every matching text of ``messages(request_id, turn, role, content, parts)``."""
    texts = messages.filter(F.col("role").isin(*text.role_list(roles))).select(
        "request_id", "turn", F.posexplode(
            text.extract_texts(F.col("content"), F.col("parts"))).alias("part", "text"))
    found = scan(texts.filter(F.col("text") != ""), "text", extra)
    return found.filter(F.col("pattern").isNotNull())


def verdicts(messages: DataFrame, roles: str = "user",
             extra: list[tuple[str, str]] = ()) -> DataFrame:
    """The first hit of each request in message and part order."""
    first = detections(messages, roles, extra).groupBy("request_id").agg(F.min_by(
        F.struct("pattern", "text", "turn", "part"), F.struct("turn", "part")).alias("hit"))
    return first.select("request_id", "hit.*")


def apply_action(requests: DataFrame, found: DataFrame, action: str = LOG_ONLY) -> DataFrame:
    """Requests with ``injection_detected`` and what happens to them.

    Verdicts have at most one row per request. Filter on ``disposition`` to split the frame.
    """
    if action not in (LOG_ONLY, FLAG, BLOCK):
        raise ValueError(f"unknown action {action!r}")
    joined = requests.join(found.select("request_id", "pattern"), "request_id", "left")
    hit = F.col("pattern").isNotNull()
    flagged = F.when(hit & F.lit(action == FLAG), F.col("pattern"))
    return joined.select(
        *requests.columns, flagged.alias("injection_detected"),
        F.when(hit & F.lit(action == BLOCK), F.lit("blocked"))
        .when(hit & F.lit(action == FLAG), F.lit("flagged"))
        .otherwise(F.lit("passed")).alias("disposition"))


def detection_log(found: DataFrame, action: str = LOG_ONLY) -> DataFrame:
    """One row per verdict, ready to append."""
    return found.select("pattern", "request_id", F.lit(action).alias("action"),
                        text.snippet(F.col("text")).alias("snippet"))
