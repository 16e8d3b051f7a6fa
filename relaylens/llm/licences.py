"""License scans: base phrases, and an exact set-similarity join of text blocks with templates.

A block is a line of a text. A template is a set of words of a known licence sentence; a block
matches where it holds at least ``CONTAINMENT`` of the template's words. Words are ordered by
their frequency in all documents, rarest first. If a block holds enough words of a template of
size s (o = ceil(CONTAINMENT x s)), it holds one of the template's first s - o + 1 words
(prefix filter); it has at least o distinct words (length filter); and if the first word that both
share is the template's p-th, at least o words of the template must be left from there on
(positional filter). Blocks that pass are counted exactly. Only words of templates can matter, so a
block travels as the numbers of those of its words that some template has, and only if one of them
lies in a prefix.

Null and empty texts have no words and no labels. Phrases may span lines and may overlap. Repeated
rows get the same result; extra columns stay out of the way; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from relaylens.llm.common import PLAIN, raw_texts, written

CONTAINMENT = 0.8
#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences by which common licences are named or open, with their labels.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the "
            "terms of the gnu general public license"),
    ("cc-by", "licensed under creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by nc 4 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this work has been dedicated to the public domain"),
]
SCAN = ("struct<n_words: long, n_base: long, first_word: long, last_word: long, "
        "base_labels: array<string>, digest: binary, "
        "blocks: array<struct<size: int, words: array<int>>>>")


class Ordered:
    """Templates as sets of word numbers, numbered from the rarest word on."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int]):
        sets = [(label, set(text.split())) for label, text in templates]
        words = sorted({w for _, s in sets for w in s}, key=lambda w: (counts.get(w, 0), w))
        self.number = {w.encode(): k for k, w in enumerate(words)}
        #: label, numbers in order, words needed
        self.sets = [(label, sorted(self.number[w.encode()] for w in s),
                      math.ceil(CONTAINMENT * len(s))) for label, s in sets]
        self.prefix = {k for _, own, need in self.sets for k in own[:len(own) - need + 1]}
        self.least = min(need for _, _, need in self.sets)

    def frame(self, spark) -> DataFrame:
        """A row for each word of each template's prefix: the index side of the join."""
        rows = [(t, label, own, need, place, own[place])
                for t, (label, own, need) in enumerate(self.sets)
                for place in range(len(own) - need + 1)]
        return spark.createDataFrame(
            rows, "template int, label string, own array<int>, need int, place int, word int")


def word_counts(texts: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How often the wanted words stand in all texts; the driver gets one sum for each."""
    def run(batches):
        known, total = {w.encode() for w in wanted}, Counter()
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                if raw:
                    total.update(filter(known.__contains__, raw.translate(PLAIN).split()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in total], pa.string()),
             pa.array(list(total.values()), pa.int64())], ["word", "n"])

    got = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in got.collect()}


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Starts, in words, of a phrase in words that are joined and enclosed by blanks."""
    out, key, at, words, seen = [], b" " + phrase + b" ", -1, 0, 0
    while (at := joined.find(key, at + 1)) >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        out.append(words)
    return out


def scanned(raw: bytes | None, order: Ordered) -> dict:
    plain = raw.translate(PLAIN) if raw else b""
    words = plain.split()
    joined = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        if found := places(joined, phrase.encode()):
            starts += found
            labels.add(label)
    blocks, at = [], 0
    if words and not order.prefix_words.isdisjoint(words):
        # Line ends are blanks in ``plain``, which has the same length as ``raw``.
        for line in raw.split(b"\n"):
            own = set(plain[at:at + len(line)].split())
            at += len(line) + 1
            if len(own) >= order.least and not order.prefix_words.isdisjoint(own):
                numbers = sorted(order.number[w] for w in own if w in order.number)
                blocks.append({"size": len(own), "words": numbers})
    return {"n_words": len(words), "n_base": len(starts),
            "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": sorted(labels), "digest": xxhash.xxh3_128_digest(raw or b""),
            "blocks": blocks}


def scan(texts: Column, order: Ordered) -> Column:
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()),
                      ("first_word", pa.int64()), ("last_word", pa.int64()),
                      ("base_labels", pa.list_(pa.string())), ("digest", pa.binary()),
                      ("blocks", pa.list_(pa.struct([("size", pa.int32()),
                                                     ("words", pa.list_(pa.int32()))])))])
    order.prefix_words = {w for w, k in order.number.items() if k in order.prefix}

    @F.arrow_udf(SCAN)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([scanned(raw, order) for raw in raw_texts(batch)], kind)

    return run(texts)


def matches(blocks: DataFrame, order: Ordered) -> DataFrame:
    """(doc_id, digest, label, containment) of the blocks that meet the threshold.

    ``blocks`` has doc_id, digest, block, size and words (template words, rarest first). The
    templates' prefixes are a constant of this module, so they are broadcast.
    """
    index = F.broadcast(order.frame(blocks.sparkSession))
    probes = blocks.withColumn("word", F.explode("words"))
    first = F.array_min(F.array_intersect("words", "own"))
    met = probes.join(index, "word").filter(
        (F.col("size") >= F.col("need"))  # length filter
        & (F.col("word") == first)  # one candidate a block and template: their first shared word
        & (F.size("own") - F.col("place") >= F.col("need")))  # positional filter
    shared = F.size(F.array_intersect("words", "own"))
    return met.filter(shared >= F.col("need")).select(
        "doc_id", "digest", "label", (shared / F.size("own")).alias("containment"))


def scanned_documents(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row.

    ``score`` is 1 with a base phrase, else the best containment of a matching template, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    rows = docs.select("doc_id", "text")
    wanted = sorted({w for _, text in templates for w in text.split()})
    order = Ordered(templates, word_counts(rows.select("text"), wanted))
    found = written(rows.select("doc_id", scan(F.col("text"), order).alias("s")).select(
        "doc_id", "s.*"), "licences")
    blocks = found.filter(F.size("blocks") > 0).select(
        "doc_id", "digest", F.explode("blocks").alias("b")).select("doc_id", "digest", "b.*")
    named = matches(blocks, order).groupBy("doc_id", "digest").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    # Rows with the same id and text get the same answer, so they may share one.
    both = found.alias("f").join(
        named.alias("m"), F.col("f.doc_id").eqNullSafe(F.col("m.doc_id"))
        & (F.col("f.digest") == F.col("m.digest")), "left")
    labels = F.array_sort(F.array_union(
        "base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        F.col("f.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
        .alias("score"))
