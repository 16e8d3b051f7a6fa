"""Frames that need nested types or masking, built from the shipped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relaylens.functions import pii, text
from relaylens.operators import pii as pii_ops
from relaylens.session import scratch_path
from relaylens.sources import schemas
from relaylens.sources.tables import spread

DOC_CLOCK, PAGE_CLOCK = "2024-01-30 12:00:00", "2024-01-29 00:00:00"
CHUNK = 16  # shorter than any token, so that every token is cut


def messages(t) -> DataFrame:
    """Messages whose content is a string, a list of parts, or missing."""
    body, shape = F.col("body"), F.col("shape")
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    parts = F.array(part("text", F.substring(body, 1, 40)),
                    part("image_url", F.lit(None).cast("string")),
                    part("text", F.substring(body, F.lit(41), F.length(body))))
    return t.messages.select(
        "request_id", "turn", "role", "model_name",
        F.when(shape == "string", body).alias("content"),
        F.when(shape == "parts", parts).cast(schemas.MESSAGE_PARTS).alias("parts"))


def prompts(t) -> DataFrame:
    """Requests with the summed length of their messages."""
    lengths = messages(t).groupBy("request_id").agg(F.sum(
        text.text_length(F.col("content"), F.col("parts"))).alias("prompt_length"))
    return t.requests.join(lengths, "request_id", "left").fillna(0, ["prompt_length"])


def sources(t) -> DataFrame:
    """Whole documents and whole pages as one table of texts."""
    docs = t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("request_id"), "text")
    pages = t.pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("request_id"),
        F.col("html").alias("text"))
    return spread(docs.union(pages), "request_id")


def masked_sources(t) -> DataFrame:
    return sources(t).withColumn("text", pii.mask("text"))


def written(t, frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder, for work that several steps read."""
    path = scratch_path(t.spark, label)
    frame.write.parquet(path)
    return t.spark.read.parquet(path)


def token_store(t) -> DataFrame:
    """Tokens of the documents, then those of the pages with an earlier expiry."""
    empty = t.spark.createDataFrame([], schemas.PII_TOKENS)
    found = written(t, pii_ops.entities(sources(t), "text", "request_id"), "entities")
    from_docs = F.col("request_id").startswith("doc-")
    store = pii_ops.store_upsert(empty, found.filter(from_docs), DOC_CLOCK)
    return pii_ops.store_upsert(store, found.filter(~from_docs), PAGE_CLOCK)


def chunks(t, size: int = CHUNK) -> DataFrame:
    """Masked texts that hold a token, cut into pieces as a streamed response would be."""
    marked = masked_sources(t).filter(F.contains(F.col("text"), F.lit(pii.TOKEN_MARK)))
    last = F.floor((F.length("text") - 1) / size)
    return (marked.select("request_id", "text", last.alias("last"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("seq"))
            .select("request_id", "seq",
                    F.substring(F.col("text"), (F.col("seq") * size + 1).cast("int"),
                                F.lit(size)).alias("delta"),
                    F.when(F.col("seq") == F.col("last"), F.lit("stop")).alias("finish_reason")))
