"""Queries over messages and texts: projections, personal data, prompt injection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from relaylens.functions import pii, text
from relaylens.operators import injection, pii as pii_ops
from relaylens.plans import frames
from relaylens.plans.registry import query
from relaylens.session import scratch_path
from relaylens.sources import schemas, tables
from relaylens.sources.tables import spread
from relaylens.streaming import jobs
from relaylens.plans.views import (AS_OF, LOOKALIKE_SQL, duckdb_mask, duckdb_scan, duckdb_token)

# DuckDB's \b knows ASCII letters only, so the reference SQL spells out the second pattern's.
CUSTOM = "\\bprompt\\s+zero\\b\n\n([unclosed\n\\bles?\\b\\s+\\bqueque\\b\n\\bof\\s+the\\b"


@query("msg_extract_text", "SELECT request_id, turn, part, text FROM {message_texts}")
def msg_extract_text(t):
    return pii_ops.message_texts(frames.messages(t), "request_id", "turn")


@query("prompt_length", """
    SELECT r.request_id, CAST(COALESCE(SUM(LENGTH(m.text)), 0) AS BIGINT) AS prompt_length
    FROM {requests} r LEFT JOIN {message_texts} m USING (request_id) GROUP BY r.request_id""")
def prompt_length(t):
    return frames.prompts(t).select("request_id", "prompt_length")


@query("role_filter", """
    SELECT request_id, COUNT(*) AS kept, MIN(turn) AS first_turn FROM {messages}
    WHERE role IN ('user', 'system') GROUP BY request_id""")
def role_filter(t):
    kept = frames.messages(t).filter(F.col("role").isin(*text.role_list("user, system")))
    return kept.groupBy("request_id").agg(F.count(F.lit(1)).alias("kept"),
                                          F.min("turn").alias("first_turn"))


@query("inj_snippet", """
    SELECT doc_id, REPLACE(SUBSTR(text, 1, 120), CHR(10), ' ') AS snippet FROM {documents}""")
def inj_snippet(t):
    return t.documents.select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("pii_call_gate", f"""
    SELECT m.request_id, m.turn, m.part, MD5(CASE WHEN r.call_type = 'embedding' THEN m.text
           ELSE {duckdb_mask('m.text')} END) AS digest
    FROM {{message_texts}} m JOIN {{requests}} r USING (request_id)""")
def pii_call_gate(t):
    rows = frames.messages(t).join(t.requests.select("request_id", "call_type"), "request_id")
    return pii_ops.message_texts(pii_ops.gate_messages(rows), "request_id", "turn").select(
        "request_id", "turn", "part", F.md5("text").alias("digest"))


@query("pii_token", f"""
    SELECT c_custkey, {duckdb_token("(c_name || '@example.com')")} AS token FROM {{customer}}""")
def pii_token(t):
    address = F.concat("c_name", F.lit("@example.com"))
    return t.customer.select("c_custkey", pii.token(F.lit("EMAIL"), address).alias("token"))


@query("pii_detect", "SELECT request_id, ordinal, value, entity_type FROM {found}")
def pii_detect(t):
    return pii_ops.entities(frames.sources(t), "text", "request_id").select(
        "request_id", "ordinal", F.col("original_value").alias("value"), "entity_type")


@query("pii_mask", """
    SELECT request_id, MD5(text) AS digest, LENGTH(text) AS n_chars FROM {masked_sources}""")
def pii_mask(t):
    return frames.masked_sources(t).select(
        "request_id", F.md5("text").alias("digest"),
        F.length("text").cast("bigint").alias("n_chars"))


@query("pii_entities", """
    SELECT token, entity_type, COUNT(*) AS n, COUNT(DISTINCT request_id) AS texts,
           MIN(value) AS original_value FROM {found} GROUP BY token, entity_type""")
def pii_entities(t):
    return (pii_ops.entities(frames.sources(t), "text", "request_id")
            .groupBy("token", "entity_type")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("request_id").alias("texts"),
                 F.min("original_value").alias("original_value")))


@query("pii_mask_messages", f"""
    SELECT request_id, turn, part, {duckdb_mask('text')} AS text,
           BOOL_OR({duckdb_mask('text')} <> text) OVER (PARTITION BY request_id, turn) AS changed
    FROM {{message_texts}}""")
def pii_mask_messages(t):
    masked = pii_ops.mask_messages(frames.messages(t))
    return pii_ops.message_texts(masked, "request_id", "turn", "changed")


@query("pii_store_upsert", "SELECT * FROM {token_store}")
def pii_store_upsert(t):
    return frames.token_store(t)


@query("pii_store_merge", "SELECT * FROM {token_store}")
def pii_store_merge(t):
    """Tokens of documents and pages merged as deltas; the second merge rewrites nothing."""
    store = jobs.token_table(t.spark, scratch_path(t.spark, "token-deltas"))
    found = frames.written(t, pii_ops.entities(frames.sources(t), "text", "request_id"),
                           "merged-entities")
    from_docs = F.col("request_id").startswith("doc-")
    store.merge(pii_ops.entering(found.filter(from_docs), frames.DOC_CLOCK))
    store.compact()
    store.merge(pii_ops.entering(found.filter(~from_docs), frames.PAGE_CLOCK))
    return store.read()


_SHORT = r"_([0-9a-f])[0-9a-f]{{7}}\]$"


@query("pii_collisions", f"""
    SELECT token, CASE WHEN COUNT(DISTINCT value) = 1 THEN MIN(value) END AS original_value,
           CASE WHEN COUNT(DISTINCT value) = 1 THEN MIN(value) ELSE token END AS restored,
           COUNT(DISTINCT value) > 1 AS collided
    FROM (SELECT regexp_replace(token, '{_SHORT}', '_\\10000000]') AS token, value FROM {{found}}) f
    GROUP BY token""")
def pii_collisions(t):
    """Tokens of a single digit, so that many stand for several values; none of these comes back."""
    found = frames.written(t, pii_ops.entities(frames.sources(t), "text", "request_id").withColumn(
        "token", F.regexp_replace("token", _SHORT.format(), "_$10000000]")), "collisions")
    empty = t.spark.createDataFrame([], schemas.PII_TOKENS)
    store = pii_ops.store_upsert(empty, found, AS_OF)
    clashes = pii_ops.collisions(store, found).select("token", F.lit(True).alias("collided"))
    rows = store.select(F.col("token").alias("id"), F.col("original_value").alias("original"),
                        F.col("token").alias("text"))
    back = pii_ops.restore(rows, "text", ["id"], store, AS_OF, into="restored")
    return back.withColumnRenamed("id", "token").join(clashes, "token", "left").select(
        "token", F.col("original").alias("original_value"), "restored",
        F.coalesce("collided", F.lit(False)).alias("collided"))


@query("pii_restore", f"""
    SELECT s.request_id, CASE WHEN s.request_id LIKE 'doc-%' THEN MD5(s.text) ELSE MD5(
        array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE
          WHEN i > len(f) THEN ''
          WHEN list_contains(live, {duckdb_token('f[i]')}) THEN f[i]
          ELSE {duckdb_token('f[i]')} END), '')) END AS digest
    FROM (SELECT *, regexp_extract_all(text, '{{pii_pattern}}') AS f,
                 string_split_regex(text, '{{pii_pattern}}') AS g,
                 (SELECT list(token) FROM {{token_store}}
                  WHERE expires_at > {{at}}'{AS_OF}') AS live
          FROM {{sources}}) s""")
def pii_restore(t):
    masked = frames.written(t, frames.masked_sources(t), "masked")
    restored = pii_ops.restore(masked, "text", ["request_id"], frames.token_store(t), AS_OF)
    return restored.select("request_id", F.md5("text").alias("digest"))


@query("pii_scrub_log", f"""
    SELECT request_id, 'request' AS side, turn AS idx,
           STRING_AGG({duckdb_mask('text')}, '|' ORDER BY part) AS text
    FROM {{message_texts}} WHERE role <> 'assistant' GROUP BY request_id, turn
    UNION ALL
    SELECT request_id, 'response', turn, {duckdb_mask('body')} FROM {{messages}}
    WHERE role = 'assistant'
    UNION ALL
    SELECT request_id, 'entity', NULL, UNNEST(list_transform(
             regexp_extract_all(text, '{{pii_pattern}}'), lambda v: {duckdb_token('v')} || v))
    FROM (SELECT request_id, text FROM {{message_texts}} WHERE role <> 'assistant'
          UNION ALL SELECT request_id, body FROM {{messages}} WHERE role = 'assistant') e""")
def pii_scrub_log(t):
    asked = frames.messages(t).filter("role <> 'assistant'")
    answers = t.messages.filter("role = 'assistant'").select(
        "request_id", F.col("turn").alias("choice_idx"), F.col("body").alias("content"))
    scrubbed, found = pii_ops.scrub_log(asked, answers)
    texts = text.extract_texts(F.col("content"), F.col("parts"))
    entities = found.select("request_id", F.lit("entity").alias("side"),
                            F.concat("token", "original_value").alias("text"))
    return scrubbed.filter(F.size(texts) > 0).select(
        "request_id", "side", "idx", F.array_join(texts, "|").alias("text")).unionByName(
        entities, allowMissingColumns=True)


@query("pii_stats", f"""
    SELECT CAST(NULL AS VARCHAR) AS entity_type,
           COUNT(*) FILTER (expires_at > {{at}}'{AS_OF}') AS active, COUNT(*) AS total
    FROM {{token_store}}
    UNION ALL
    SELECT entity_type, COUNT(*) FILTER (expires_at > {{at}}'{AS_OF}'), COUNT(*)
    FROM {{token_store}} GROUP BY entity_type
    HAVING COUNT(*) FILTER (expires_at > {{at}}'{AS_OF}') > 0""")
def pii_stats(t):
    return pii_ops.stats(frames.token_store(t), AS_OF)


@query("pii_purge", f"""
    SELECT token, CAST(NULL AS BIGINT) AS purged FROM {{token_store}}
    WHERE expires_at >= {{at}}'{AS_OF}'
    UNION ALL SELECT NULL, COUNT(*) FROM {{token_store}} WHERE expires_at < {{at}}'{AS_OF}'""")
def pii_purge(t):
    """The store in folders by expiry day; purging deletes the days that are over."""
    store, path = frames.token_store(t), scratch_path(t.spark, "token-days")
    tables.persist_by_day(store, path, "expires_at", "expiry_day")
    tables.drop_before(t.spark, path, datetime.fromisoformat(AS_OF), "expires_at", "expiry_day")
    _, purged = pii_ops.purge(store, AS_OF)
    left = t.spark.read.schema(schemas.PII_TOKENS + ", expiry_day DATE").parquet(path)
    return left.select("token").unionByName(purged, allowMissingColumns=True)


@query("inj_normalise", f"""
    SELECT doc_id, MD5({LOOKALIKE_SQL.format(text='text')}) AS digest FROM {{documents}}""")
def inj_normalise(t):
    docs = spread(t.documents.select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.md5(text.normalise(F.col("text"))).alias("digest"))


@query("inj_scan", f"""
    SELECT 'doc-' || doc_id AS id, {duckdb_scan('text')} AS pattern FROM {{documents}}
    UNION ALL
    SELECT 'msg-' || request_id || '-' || turn || '-' || part, {duckdb_scan('text')}
    FROM {{message_texts}}""")
def inj_scan(t):
    docs = t.documents.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
                              "text")
    messages = pii_ops.message_texts(frames.messages(t), "request_id", "turn").select(
        F.concat_ws("-", F.lit("msg"), "request_id", "turn", "part").alias("id"), "text")
    return injection.scan(spread(docs.union(messages), "id"), "text").select("id", "pattern")


@query("inj_scan_custom", f"""
    SELECT doc_id, COALESCE({duckdb_scan('text')},
      CASE WHEN regexp_matches(text, '\\bprompt\\s+zero\\b', 'i') THEN 'custom_0'
           WHEN regexp_matches(text, '(^|[^\\p{{{{L}}}}\\p{{{{N}}}}_])les?\\s+queque([^\\p{{{{L}}}}\\p{{{{N}}}}_]|$)',
                               'i') THEN 'custom_1'
           WHEN regexp_matches(text, '\\bof\\s+the\\b', 'i') THEN 'custom_2' END) AS pattern
    FROM {{documents}}""")
def inj_scan_custom(t):
    extra = text.custom_patterns(t.spark, CUSTOM)
    docs = spread(t.documents.select("doc_id", "text"), "doc_id")
    return injection.scan(docs, "text", extra).select("doc_id", "pattern")


_VERDICTS = f"""
    SELECT request_id, turn, part, pattern, text FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY turn, part) AS rn FROM (
        SELECT *, {duckdb_scan('text')} AS pattern FROM {{message_texts}}
        WHERE role = 'user' AND text <> '') s WHERE pattern IS NOT NULL) v WHERE rn = 1"""


@query("inj_verdict", f"SELECT request_id, pattern, turn, part FROM ({_VERDICTS}) x")
def inj_verdict(t):
    return injection.verdicts(frames.messages(t)).select("request_id", "pattern", "turn", "part")


@query("inj_action", " UNION ALL ".join(f"""
    SELECT '{action}' AS action, r.request_id,
           CASE WHEN '{action}' = 'flag' THEN v.pattern END AS injection_detected,
           CASE WHEN v.pattern IS NULL OR '{action}' = 'log_only' THEN 'passed'
                WHEN '{action}' = 'flag' THEN 'flagged' ELSE 'blocked' END AS disposition
    FROM {{requests}} r LEFT JOIN ({_VERDICTS}) v USING (request_id)"""
                                        for action in ("log_only", "flag", "block")))
def inj_action(t):
    found = frames.written(t, injection.verdicts(frames.messages(t)), "verdicts")
    parts = [injection.apply_action(t.requests.select("request_id"), found, action).select(
        F.lit(action).alias("action"), "request_id", "injection_detected", "disposition")
        for action in ("log_only", "flag", "block")]
    return parts[0].union(parts[1]).union(parts[2])


@query("inj_log", f"""
    SELECT pattern, request_id, 'flag' AS action,
           REPLACE(SUBSTR(text, 1, 120), CHR(10), ' ') AS snippet FROM ({_VERDICTS}) x""")
def inj_log(t):
    return injection.detection_log(injection.verdicts(frames.messages(t)), injection.FLAG)


@query("split_safe_held", r"""
    SELECT request_id, seq, substr(delta, 1, length(delta) - length(held)) AS safe, held
    FROM (SELECT *, CASE WHEN regexp_matches(tail, '\[PII_[A-Z_]+_[0-9a-f]{{8}}\]') THEN ''
        WHEN regexp_full_match(tail, '\[(P(I(I(_([A-Z_]*(_[0-9a-f]{{0,8}}\]?)?)?)?)?)?)?')
        THEN tail ELSE '' END AS held
      FROM (SELECT *, regexp_extract(delta, '\[[^\[]*$') AS tail FROM (
        SELECT request_id, seq, SUBSTR(text, seq * 60 + 1, 60) AS delta
        FROM (SELECT request_id, text, UNNEST(range(0, (LENGTH(text) - 1) // 60 + 1)) AS seq
              FROM {masked_sources} WHERE contains(text, '[PII_')) p) c) a) b""")
def split_safe_held(t):
    """Pieces of 60 characters: some hold whole tokens, some cut one."""
    pieces = frames.chunks(t, size=60)
    return pieces.select("request_id", "seq", pii.safe_head(F.col("delta")).alias("safe"),
                         pii.held_tail(F.col("delta")).alias("held"))
