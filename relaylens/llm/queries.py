"""The queries over the operators of this folder, and their reference SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from relaylens.llm import (
    archives, collocations, decontaminate, licences, pieces, pseudo, quality, rules, simhash,
    substrings, tokenids, toxicity, wordruns)
from relaylens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def piece_model() -> str:
    """Where the public vocabulary file lies; another path may be given to the operator."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def word_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *[F.col(f"counts.{c}").alias(c) for c in rules.STATS[:5]],
                        "base_failed", "kept", "stratum",
                        F.array_join("rejected_by", ",").alias("rejected_by"))


@query
def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.through_archives(table(spark, sf_dir, "pages"))
    return found.select(F.col("number").alias("page_id"), "payload_bytes", "payload_digest",
                        F.col("type").alias("record_type"),
                        F.col("refers_to_number").alias("refers_to"))


ORACLES["op2_arc_to_warc"] = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                      sha256(coalesce(html, '')) AS payload_digest FROM pages),
         f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
         r AS (SELECT *, payload_bytes >= 100 AND first <> page_id AS again FROM f)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN again THEN first END AS refers_to FROM r"""


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.with_pieces(docs, piece_model()).select(
        "doc_id", *pieces.digests(F.col("pieces")))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(table(spark, sf_dir, "documents"),
                                 table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256)
                        .alias("items_sha256"), "contaminated")


ORACLES["op5_decontamination"] = r"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
         b AS (SELECT item_id, list_filter(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
         s AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
         bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p
                FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
         dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
                FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
                      FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
         h AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, p)),
         c AS (SELECT r, count(DISTINCT k) AS n_hit
               FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
         t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
               FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""


@query
def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.scored(table(spark, sf_dir, "documents"))


@query
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passage_table(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "labels"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.with_groups(docs).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned_documents(table(spark, sf_dir, "documents"))


def _licence_sql() -> str:
    """Phrases and templates against all words and lines, without any filter."""
    cut = """list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),
             lambda x: x <> '')"""
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licences.PHRASES.items())
    sets = [(label, sorted(set(t.split()))) for label, t in licences.TEMPLATES]
    templates = ", ".join(
        f"('{label}', {w!r}, {math.ceil(licences.CONTAINMENT * len(w))})" for label, w in sets)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                      {cut.format("coalesce(text, '')")} AS w FROM documents),
         p AS (SELECT * FROM (VALUES {phrases}) AS v(ws, label)),
         h AS (SELECT r, i, label FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d), p
               WHERE w[i + 1] = ws[1] AND w[i + 1:i + len(ws)] = ws),
         b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
                      list_sort(list(DISTINCT label)) AS labels FROM h GROUP BY r),
         l AS (SELECT r, list_distinct({cut.format("line")}) AS w
               FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
         m AS (SELECT r, label, len(list_intersect(w, ws)) / len(ws) AS share
               FROM l, (VALUES {templates}) AS v(label, ws, need)
               WHERE len(list_intersect(w, ws)) >= need),
         g AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS best FROM m GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(array_to_string(b.labels, ','), '') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(
             coalesce(b.labels, []), coalesce(g.labels, [])))), ',') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
    FROM d LEFT JOIN b USING (r) LEFT JOIN g USING (r)"""


ORACLES["op10_licence_scan"] = _licence_sql()


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    looped = docs.withColumn("text", wordruns.looped(F.col("text"), F.col("doc_id")))
    return wordruns.with_runs(looped).select("doc_id", *wordruns.digests(F.col("periodic")))


@query
def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.through_files(table(spark, sf_dir, "documents"), word_vocabulary())


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _collocation_sql() -> str:
    """All occurrences of all phrases, with every cut of every candidate."""
    lengths = "\n UNION ALL ".join(
        f"SELECT lang, {k} AS m, array_to_string(w[i:i + {k - 1}], ' ') AS phrase "
        f"FROM o WHERE i + {k - 1} <= len(w)" for k in range(1, collocations.LONGEST + 1))
    return f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(
                 coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
         s AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w
               FROM p),
         o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM s),
         g AS ({lengths}),
         f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL
               HAVING count(*) >= {collocations.SUPPORT}),
         t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM s GROUP BY lang),
         c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
         d AS (SELECT DISTINCT lang, array_to_string(w[x:y], ' ') AS phrase, a
               FROM (SELECT *, unnest(range(1, m + 1)) AS x FROM c)
                    JOIN (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS y) ON y BETWEEN x AND m
               WHERE y - x + 1 < m),
         k AS (SELECT c.lang, c.phrase, c.a, w, unnest(range(1, m)) AS k, n
               FROM c JOIN t USING (lang)
               WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = c.lang AND d.phrase = c.phrase
                                 AND 100 * d.a >= 100 * c.a)),
         v AS (SELECT k.*, l.a AS l, r.a AS r,
                      ((1000::HUGEINT * k.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
               FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ')
                      JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
         b AS (SELECT * FROM v QUALIFY row_number() OVER (
                 PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM b
    WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
    QUALIFY rank <= {collocations.BEST}"""


ORACLES["op13_collocations"] = _collocation_sql()
