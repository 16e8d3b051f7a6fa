"""Personal data in tables of texts and messages: masking, the token store, restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relaylens.functions import clock, pii
from relaylens.functions.text import extract_texts
from relaylens.operators import state

STORE_POLICIES = {"original_value": state.AGREE, "entity_type": state.KEEP,
                  "request_id": state.KEEP, "expires_at": state.GREATEST}
MASKED_CALLS = ("completion", "text_completion")


def entities(df: DataFrame, text: str, *ids: str) -> DataFrame:
    """One row per found entity, with its place and its token.

    The outer form of explode keeps Spark from testing the array's size in a filter below,
    which would compute the spans a second time.
    """
    hits = df.filter(pii.may_contain(text))
    found = pii.spans(text, guarded=False)
    return (hits.select(*ids, F.posexplode_outer(found).alias("ordinal", "span"))
            .filter(F.col("ordinal").isNotNull())
            .select(*ids, "ordinal", F.col("span.start").alias("start"),
                    F.col("span.stop").alias("stop"),
                    pii.token(F.col("span.entity_type"), F.col("span.value")).alias("token"),
                    F.col("span.value").alias("original_value"),
                    F.col("span.entity_type").alias("entity_type")))


CONTENT_SPANS, PART_SPANS = "_content_spans", "_part_spans"


def with_spans(messages: DataFrame) -> DataFrame:
    """Messages with what their texts hold, matched once. Persist or write the result when both
    ``masked_at_spans`` and ``entities_at_spans`` read it."""
    return messages.withColumns({
        CONTENT_SPANS: F.coalesce(pii.spans("content"), F.expr(pii.NO_SPANS)),
        PART_SPANS: pii.part_spans("parts")})


def masked_at_spans(found: DataFrame) -> DataFrame:
    """The messages of ``with_spans`` masked, with a ``changed`` flag."""
    hit = (F.size(CONTENT_SPANS) > 0) | F.coalesce(
        F.exists(PART_SPANS, lambda s: F.size(s) > 0), F.lit(False))
    return found.withColumns({
        "changed": hit, "content": pii.mask_at("content", CONTENT_SPANS),
        "parts": pii.mask_parts_at("parts", PART_SPANS)}).drop(CONTENT_SPANS, PART_SPANS)


def entities_at_spans(found: DataFrame, *ids: str) -> DataFrame:
    """One row per entity of the messages of ``with_spans``, with its token."""
    every = F.concat(F.array(F.col(CONTENT_SPANS)), F.coalesce(F.col(PART_SPANS), F.array(
        F.expr(pii.NO_SPANS))))
    return found.select(*ids, F.explode(F.flatten(every)).alias("span")).select(
        *ids, pii.token(F.col("span.entity_type"), F.col("span.value")).alias("token"),
        F.col("span.value").alias("original_value"),
        F.col("span.entity_type").alias("entity_type"))


def mask_messages(messages: DataFrame) -> DataFrame:
    """String contents and text parts masked, with a ``changed`` flag per message.

    A text that holds something is changed, for no token equals what it stands for.
    """
    return masked_at_spans(with_spans(messages))


def message_texts(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per text of a message, in part order."""
    return messages.select(*keep, F.posexplode(
        extract_texts(F.col("content"), F.col("parts"))).alias("part", "text"))


def gate_messages(messages: DataFrame, calls=MASKED_CALLS) -> DataFrame:
    """Messages, strings or lists of parts, masked only for the listed call types."""
    listed = F.col("call_type").isin(*calls)
    return messages.withColumns({
        "content": F.when(listed, pii.mask("content")).otherwise(F.col("content")),
        "parts": F.when(listed, pii.mask_parts("parts")).otherwise(F.col("parts"))})


def gate_by_call_type(df: DataFrame, text: str, calls=MASKED_CALLS) -> DataFrame:
    """Only the listed call types are masked."""
    return df.withColumn(text, F.when(F.col("call_type").isin(*calls), pii.mask(text))
                         .otherwise(F.col(text)))


def store_upsert(store: DataFrame, found: DataFrame, as_of, ttl_hours: float = 24,
                 order: list[str] | None = None, small_updates: bool = False) -> DataFrame:
    """New tokens in; known ones get the later expiry.

    A token that turns out to stand for two values loses its original for good: giving either
    back could show a person's data to another.
    """
    return state.keyed_upsert(store, entering(found, as_of, ttl_hours), ["token"], STORE_POLICIES,
                              order or ["request_id", "original_value"], small_updates)


def entering(found: DataFrame, as_of, ttl_hours: float = 24) -> DataFrame:
    """Entities as updates of a token store that takes deltas; see ``STORE_POLICIES``."""
    return found.withColumn("expires_at", clock.shifted(as_of, hours=ttl_hours))


def collisions(store: DataFrame, found: DataFrame) -> DataFrame:
    """Tokens that stand for more than one value, known as such to the store or not."""
    pairs = store.select("token", "original_value").unionByName(
        found.select("token", "original_value"))
    return pairs.groupBy("token").agg(
        F.min("original_value").alias("first_value"),
        F.max("original_value").alias("last_value"),
        F.bool_or(F.col("original_value").isNull()).alias("_known"),
    ).filter(F.col("_known") | (F.col("first_value") != F.col("last_value"))).drop("_known")


def restore(df: DataFrame, text: str, ids: list[str], store: DataFrame, as_of,
            into: str | None = None, unsafe: DataFrame | None = None) -> DataFrame:
    """Tokens replaced by their originals where the store has a live entry.

    Rows without the token mark skip every shuffle. For the others, only (row id, token) pairs
    travel to the store and only the pairs that were found travel back; a row collects no more
    than its own tokens. Tokens of several values have no original in the store and stay as they
    are; ``unsafe`` lists further tokens to leave alone.
    """
    into = into or text
    marked = F.coalesce(F.contains(F.col(text), F.lit(pii.TOKEN_MARK)), F.lit(False))
    live = store.filter((F.col("expires_at") > clock.instant(as_of))
                        & F.col("original_value").isNotNull()).select("token", "original_value")
    if unsafe is not None:
        live = live.join(unsafe.select("token"), "token", "left_anti")
    with_tokens = df.filter(marked)
    pairs = (with_tokens.select(*ids, F.explode(pii.tokens_in(F.col(text))).alias("token"))
             .join(live, "token")
             .groupBy(*ids).agg(F.collect_list(F.struct("token", "original_value")).alias("_map")))
    nothing = F.array().cast("ARRAY<STRUCT<token: STRING, original_value: STRING>>")
    put_back = F.aggregate(F.coalesce("_map", nothing), F.col(text), lambda acc, e: F.replace(
        acc, e["token"], e["original_value"]))
    restored = (with_tokens.join(pairs, ids, "left").withColumn(into, put_back).drop("_map"))
    return restored.unionByName(df.filter(~marked).withColumn(into, F.col(text)))


def scrub_log(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a log masked, and the entities to store.

    ``requests(request_id, turn, content, parts, ...)``, ``responses(request_id, choice_idx,
    content)``. Masking a masked text changes nothing, so the job can run again.
    """
    asked = with_spans(requests)
    answered = with_spans(responses.withColumn(
        "parts", F.lit(None).cast("ARRAY<STRUCT<type: STRING, text: STRING>>")))
    masked = masked_at_spans(asked).select(
        "request_id", F.lit("request").alias("side"), F.col("turn").alias("idx"),
        "content", "parts", "changed").unionByName(masked_at_spans(answered).select(
            "request_id", F.lit("response").alias("side"), F.col("choice_idx").alias("idx"),
            "content", "parts", "changed"))
    return masked, entities_at_spans(asked, "request_id").unionByName(
        entities_at_spans(answered, "request_id"))


def stats(store: DataFrame, as_of) -> DataFrame:
    """Active and total tokens, overall (null type) and per type, in one grouping pass."""
    per_type = store.groupBy("entity_type").agg(
        F.count_if(F.col("expires_at") > clock.instant(as_of)).alias("active"),
        F.count(F.lit(1)).alias("total"))
    overall = per_type.agg(F.coalesce(F.sum("active"), F.lit(0)).alias("active"),
                           F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return (overall.select(F.lit(None).cast("string").alias("entity_type"), "active", "total")
            .unionByName(per_type.filter("active > 0")))


def purge(store: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """The store without rows that expired before ``as_of``, and the number removed."""
    expired = F.col("expires_at") < clock.instant(as_of)
    return store.filter(~expired), store.agg(F.count_if(expired).alias("purged"))
