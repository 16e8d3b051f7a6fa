"""Phrase collocations by set-oriented mining (SETM) over sorted occurrence relations.

Texts are cut into pieces at punctuation and line ends, pieces into words. The relation of length k has a row
for each document: the places, in order, at which a frequent phrase of k words begins, and
the phrases. A piece ends with an empty place, so places one apart are neighbours in one piece. A relation is
persisted as a table. To extend it, neighbours are merge-joined (a phrase of k + 1 words is its
first and its last k words), counted in groups before the shuffle and summed after it; groups of
at least ``support`` occurrences are the frequent phrases, and a semi-join of the joined relation
with them is the next one. Every part of a frequent phrase is frequent, so nothing is lost.

Phrases are known by numbers given when their table is written. The semi-join sends the table of
frequent phrases to all tasks if it has up to ``SENT`` rows; a longer one meets the occurrences,
a row each, in a shuffled join. Counts of parts travel along with the phrases: those of all beginnings
and endings. Per language only the best phrases are ranked, by a window whose limit applies before the shuffle.

Everything is per ``lang``; a null one is ``und``. Null and empty texts have no words. Words are
bytes of the text and may hold any sign but blanks, tabs and the separators. Repeated rows count
each. Other columns are ignored, whatever their names. An empty table gives an empty result. A text is
held whole by one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from relaylens.llm.common import raw_texts, written

SUPPORT, LONGEST, BEST = 100, 5, 2000
SENT = 1_000_000  # frequent phrases that are sent to all tasks: three numbers each
SENT_WORDS, SENT_BYTES = 500_000, 8 << 20  # and frequent words
HELD = 1_000_000  # groups that a task counts before it passes them on
NO_LANG = "und"
BREAK = b"\xff"  # no byte of a text
#: Lower-case A-Z, tabs as blanks, separators of pieces as ``BREAK``.
SIGNS = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 255 if 10 <= c <= 13 or c in b".,;:!?"
              else c for c in range(256))
RELATION = "row long, gap array<int>, phrase array<long>"
RELATION_ARROW = pa.schema([("row", pa.int64()), ("gap", pa.list_(pa.int32())),
                            ("phrase", pa.list_(pa.int64()))])
PAIRS_ARROW = pa.schema([("first", pa.int64()), ("second", pa.int64()), ("f", pa.int64())])


def tokens(raw: bytes) -> list[bytes]:
    """The words of a text in order, with ``BREAK`` between pieces."""
    return raw.translate(SIGNS).replace(BREAK, b" \xff ").split()


def counted_words(docs: DataFrame) -> DataFrame:
    """(lang, word, f): partial counts of all words of the texts; a null word counts all."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64())])

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            counter.pop(BREAK, None)
            words = [*counter, None]
            sums = [*counter.values(), sum(counter.values())]
            for k in range(0, len(words), 50_000):
                part = words[k:k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part, pa.binary()),
                     pa.array(sums[k:k + 50_000], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                langs = batch.column(0).slice(at, 256).to_pylist()
                for lang, raw in zip(langs, raw_texts(batch.column(1).slice(at, 256))):
                    if raw:
                        counts.setdefault(lang, Counter()).update(tokens(raw))
            if sum(map(len, counts.values())) > HELD:
                yield from rows(counts)
                counts = {}
        yield from rows(counts)

    return docs.select("lang", "text").mapInArrow(run, "lang string, word binary, f long")


def kept(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a written table, each row with a number ``id``."""
    return written(frame.withColumn("id", F.monotonically_increasing_id()), label)


def relation_rows(rows: list[int], gaps: list[np.ndarray], phrases: list[np.ndarray]
                  ) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, gaps)], dtype=np.int32)

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))

    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int64()), lists(gaps, pa.int32()), lists(phrases, pa.int64())],
        schema=RELATION_ARROW)


def gathered(occurrences: DataFrame) -> DataFrame:
    """A relation from (row, at, id), a row each."""
    places = F.sort_array(F.collect_list(F.struct("at", "id")))
    ats = F.col("o.at")
    return occurrences.groupBy("row").agg(places.alias("o")).select(
        "row", F.zip_with(ats, F.concat(F.array(F.lit(0)), F.slice(ats, 1, F.size(ats) - 1)),
                          lambda x, y: x - y).alias("gap"), F.col("o.id").alias("phrase"))


def word_relation(docs: DataFrame, words: DataFrame, sent: int = SENT_WORDS) -> DataFrame:
    """The relation of length 1: the places of frequent words (id, lang, phrase)."""
    spark = docs.sparkSession
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("phrase")).alias("b")).first()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "lang", "text")
    if size["n"] > sent or (size["b"] or 0) > SENT_BYTES:
        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                          raw_texts(batch.column(2))):
                    found = [(k, w) for k, w in enumerate(tokens(raw or b"")) if w != BREAK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(found), pa.int64()),
                         pa.array([k for k, _ in found], pa.int32()),
                         pa.array([lang] * len(found), pa.string()),
                         pa.array([w for _, w in found], pa.binary())],
                        names=["row", "at", "lang", "word"])

        occurrences = texts.mapInArrow(flat, "row long, at int, lang string, word binary")
        return gathered(occurrences.withColumn("phrase", F.col("word").cast("string")).join(
            words.select("lang", "phrase", "id"), ["lang", "phrase"]))
    tables: dict[str, dict[bytes, int]] = {}
    for lang, phrase, number in words.select("lang", "phrase", "id").collect():
        tables.setdefault(lang, {})[phrase.encode()] = number
    known: Broadcast = spark.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, gaps, phrases = [], [], []
            for row, lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                      raw_texts(batch.column(2))):
                own = tokens(raw or b"")
                table = known.value.get(lang)
                if table and own:
                    ids = np.fromiter(map(table.get, own, repeat(-1)), np.int64, len(own))
                    at = np.flatnonzero(ids >= 0)
                    if len(at) > 1:
                        rows.append(row)
                        gaps.append(np.diff(at, prepend=0))
                        phrases.append(ids[at])
            yield relation_rows(rows, gaps, phrases)

    return texts.mapInArrow(run, RELATION)


def neighbours(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(index of the row, place, first phrase, second phrase) of all places one apart."""
    gaps, phrases = batch.column(1), batch.column(2)
    gap, ids = gaps.flatten().to_numpy(), phrases.flatten().to_numpy()
    sizes = np.diff(gaps.offsets.to_numpy())
    index = np.repeat(np.arange(batch.num_rows), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = np.cumsum(gap, dtype=np.int64)
    before = np.concatenate([[0], total])[begin]  # of the rows before: places start anew
    at = np.flatnonzero((gap[1:] == 1) & (index[1:] == index[:-1]))
    return index[at], (total - before)[at], ids[at], ids[at + 1]


def counted_pairs(relation: DataFrame) -> DataFrame:
    """(first, second, f): partial counts of neighbouring phrases."""

    def grouped(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["first", "second"]).aggregate([("f", "sum")])
        return out.rename_columns(["first", "second", "f"]).select(PAIRS_ARROW.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.Table] = []
        for batch in batches:
            _, _, first, second = neighbours(batch)
            tables.append(grouped([pa.table([first, second, np.ones(len(first), np.int64)],
                                            schema=PAIRS_ARROW)]))
            if sum(map(len, tables)) > HELD:
                tables = [grouped(tables)]
                if len(tables[0]) > HELD // 2:
                    yield from tables[0].to_batches()
                    tables = []
        if tables:
            yield from grouped(tables).to_batches()

    return relation.mapInArrow(run, "first long, second long, f long")


def extended(relation: DataFrame, phrases: DataFrame, sent: int = SENT) -> DataFrame:
    """The next relation: the neighbours whose (first, second) is a frequent phrase (id)."""
    if phrases.count() > sent:
        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                index, at, first, second = neighbours(batch)
                rows = batch.column(0).to_numpy()[index]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(at, pa.int32()), pa.array(first),
                     pa.array(second)], names=["row", "at", "first", "second"])

        occurrences = relation.mapInArrow(flat, "row long, at int, first long, second long")
        return gathered(occurrences.join(phrases.select("first", "second", "id"),
                                         ["first", "second"]))
    sent_phrases = phrases.select("first", "second", "id").toPandas().to_numpy(np.int64)
    parts = np.unique(sent_phrases[:, :2])
    keys = np.searchsorted(parts, sent_phrases[:, 0]) * (len(parts) + 1) + \
        np.searchsorted(parts, sent_phrases[:, 1])
    order = np.argsort(keys)
    known = relation.sparkSession.sparkContext.broadcast(
        (parts, keys[order], sent_phrases[order, 2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys, ids = known.value
        for batch in batches:
            index, at, first, second = neighbours(batch)
            a, b = np.searchsorted(parts, first), np.searchsorted(parts, second)
            inside = (a < len(parts)) & (b < len(parts))
            a, b = np.where(inside, a, 0), np.where(inside, b, 0)
            if len(keys):
                inside &= (parts[a] == first) & (parts[b] == second)
                key = a * (len(parts) + 1) + b
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                inside &= keys[k] == key
                index, at, found = index[inside], at[inside], ids[k[inside]]
            else:
                index, at, found = index[:0], at[:0], first[:0]
            cuts = np.flatnonzero(np.diff(index)) + 1
            rows = batch.column(0).to_numpy()[index[np.concatenate([[0], cuts])]] \
                if len(index) else []
            yield relation_rows(list(rows), [np.diff(x, prepend=0) for x in np.split(at, cuts)]
                                if len(index) else [], np.split(found, cuts) if len(index) else [])

    return relation.mapInArrow(run, RELATION).filter(F.size("gap") > 1)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST,
                     sent: int = SENT, sent_words: int = SENT_WORDS) -> list[DataFrame]:
    """For each length from 1 a table of (id, lang, phrase, last, n, f, pre, suf): n counts all
    words of the language, f the phrase, pre and suf its beginnings and endings by length; from
    2 words on also (first, second, first_f, second_f), its two parts but for one word."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                        F.col("text").cast("string").alias("text"))
    counts = written(counted_words(texts).groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(
        (F.col("f") >= support) | F.col("word").isNull()), "words")
    totals = counts.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    words = kept(counts.filter("word IS NOT NULL").join(totals, "lang").select(
        "lang", F.col("word").cast("string").alias("phrase"),
        F.col("word").cast("string").alias("last"), "n", "f",
        F.array().cast("array<bigint>").alias("pre"), F.array().cast("array<bigint>").alias("suf")),
        "phrases-1")
    levels = [words]
    relation = written(word_relation(texts, words, sent_words), "relation-1")
    for k in range(2, longest + 1):
        pairs = counted_pairs(relation).groupBy("first", "second").agg(
            F.sum("f").alias("f")).filter(F.col("f") >= support)
        first = levels[-1].select(F.col("id").alias("first"), "lang", "n", "pre",
                                  F.col("phrase").alias("start"), F.col("f").alias("first_f"))
        second = levels[-1].select(F.col("id").alias("second"), "last", "suf",
                                   F.col("f").alias("second_f"))
        levels.append(kept(pairs.join(first, "first").join(second, "second").select(
            "first", "second", "first_f", "second_f", "lang",
            F.concat_ws(" ", "start", "last").alias("phrase"), "last", "n", "f",
            F.concat("pre", F.array("first_f")).alias("pre"),
            F.concat("suf", F.array("second_f")).alias("suf")), f"phrases-{k}"))
        if k < longest:
            relation = written(extended(relation, levels[-1], sent), f"relation-{k}")
    return levels


def scored(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all frequent phrases of two words or more that no longer
    one with as many occurrences holds. A longer one that holds a phrase and is as frequent has a
    part of one word more than the phrase that is as frequent, too; so one word more decides."""
    def whole(column, cast: str = "decimal(19,0)"):
        return column.cast(cast)

    def cut(k):
        left, right = F.get("pre", k - 1), F.get("suf", F.size("pre") - k)
        score = F.call_function("div", whole(1000 * F.col("f")) * whole(F.col("n")),
                                whole(left) * whole(right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    out = None
    for k in range(1, len(levels)):
        rows = levels[k]
        if k + 1 < len(levels):
            longer = levels[k + 1]
            inside = longer.filter("f >= first_f").select(F.col("first").alias("id")).unionByName(
                longer.filter("f >= second_f").select(F.col("second").alias("id")))
            rows = rows.join(inside.distinct(), "id", "left_anti")
        rows = rows.withColumn("best", F.array_min(F.transform(
            F.sequence(F.lit(1), F.size("pre")), cut)))
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), F.col("best.l").alias("l"),
                           F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST,
                 best: int = BEST, sent: int = SENT, sent_words: int = SENT_WORDS) -> DataFrame:
    """The best phrases of each language: rank, phrase and counts."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored(frequent_phrases(docs, support, longest, sent, sent_words)).withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                         "n", "score")
