"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of the letters of words, one of toxic and one of ordinary
documents: runs of up to ``ORDER`` letters have a model for each class. Both back off to the same
letter pairs, whose counts of different letters before them are shared, and by the same shares,
from the counts of both classes. So a rare expression gets the same probability from both, while
a stem that toxic documents share does not, whatever it ends in.

The logarithms of both probabilities of a word are subtracted and held within ``CAP``; divided by
the length of the text this gives its evidence: the mean of all its words, the share of words beyond
``STRONG``, the strongest word and the mean of its ``TOP`` strongest different ones. A logistic curve
fitted on other labelled documents turns them into a score. Counts are of documents a word stands
in, so a word that one text repeats counts once.

Labels are learned from at most ``ROWS`` documents a class for the counts and as many others for
the curve, taken by a hash of the id; so every table of counts is bounded, and is broadcast. Labels
of the held-out part are never read. Null texts are empty ones; texts without words have no evidence
and get the curve's value at zero. A document labelled twice counts by its largest label. Without
both classes every score is 0. Repeated rows get the same score; an empty table an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from relaylens.llm.common import plain_words, raw_texts, remainder, written

FOLDS, HELD_OUT = 4, 2
ROWS = 3000  # documents a class, for the counts (three quarters) and again for the curve (one)
ORDER, SHARED = 8, 2  # letters of the longest model, and of the one that both classes share
TOP, CAP, STRONG = 3, 5.0, 3.5
RARE = 4  # counts up to this are left to shorter runs
LIMIT = 0.3
KEPT_WORDS = 300_000  # evidence of words that a worker keeps
SALT = np.uint64(0x9E3779B97F4A7C15)
KINDS = ["whole", "share", "strongest", "top"]
START, END = 1, 2  # letters before and after each word
GRAMS = "k int, gram long, context long, suffix long, ordinary long, toxic long"


def mixed(before: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The 64-bit name of what stands before with one more letter."""
    x = (before ^ (letter + np.uint64(0x51))) * SALT
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(32))


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words with their marks, and each one's place in its word."""
    text = "".join(f"{chr(START)}{w.decode('utf-8', 'replace')}{chr(END)}" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.arange(len(codes))
    first = np.maximum.accumulate(np.where(codes == START, at, 0))
    return codes, at - first


def names(codes: np.ndarray) -> list[np.ndarray]:
    """[k]: names of the k letters that end at each place; right where the word is long enough."""
    out = [np.zeros(len(codes), np.uint64)]
    for _ in range(ORDER):
        before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
        out.append(mixed(before if len(out) > 1 else out[0], codes))
    return out


class Table:
    """A sorted table from 64-bit names to numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where there is none, and which names are known."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.values[at], 0), known


class Evidence:
    """Differences of log-likelihoods, from what ``kept_grams`` gives for each number of letters.

    ``of_order`` is asked for one number after the other, so only one such table is held at once.
    """

    def __init__(self, of_order):
        self.grams: dict[int, Table] = {}
        self.words: dict[bytes, float] = {}
        lower = None  # names and [class, name] probabilities of one order less
        for k in range(1, ORDER + 1):
            own = of_order(k)
            gram, suffix = (own[c].to_numpy(np.int64).view(np.uint64) for c in ("gram", "suffix"))
            if lower is None or not len(lower[0]):
                below = np.full((2, len(gram)), 1 / (len(gram) + 1))
            else:
                at = np.minimum(np.searchsorted(lower[0], suffix), len(lower[0]) - 1)
                below = lower[1][:, at]
            free, p = own["free"].to_numpy(float), []
            for kind, base in zip(("ordinary", "toxic"), below):
                seen, total = (own[c].to_numpy(float) for c in (kind, f"all_{kind}"))
                share = np.where(total > 0, seen / np.maximum(total, 1e-9), base)
                p.append((1 - free) * share + free * base)
            order = np.argsort(gram)
            lower = gram[order], np.stack(p)[:, order]
            if k > SHARED:
                self.grams[k] = Table(gram, np.log(p[1]) - np.log(p[0]))

    def measure(self, words: list[bytes]) -> np.ndarray:
        """Per word: the difference of its log-likelihoods, within CAP."""
        codes, place = letters(words)
        runs = names(codes)
        out, left = np.zeros(len(codes)), place > 0
        for k in range(ORDER, SHARED, -1):
            at = (left & (place >= k - 1)).nonzero()[0]
            value, known = self.grams[k].get(runs[k][at])
            out[at] += value
            left[at[known]] = False
        starts = (place == 0).nonzero()[0]
        return np.clip(np.add.reduceat(out, starts), -CAP, CAP)

    def of(self, raw: bytes | None) -> tuple[float, ...]:
        """The numbers named in ``KINDS``."""
        words = plain_words(raw) if raw else []
        if not words:
            return (0.0,) * len(KINDS)
        known, kinds = self.words, set(words)
        if new := [w for w in kinds if w not in known]:
            known.update(zip(new, self.measure(new).tolist()))
        each = np.fromiter(map(known.__getitem__, kinds), float, len(kinds))
        every = np.fromiter(map(known.__getitem__, words), float, len(words))
        k = min(TOP, len(each))
        top = np.partition(each, len(each) - k)[len(each) - k:]
        if len(known) > KEPT_WORDS:
            known.clear()
        return (float(every.mean()), min(float((every > STRONG).mean()), 0.05) * 100,
                float(top.max()), float(top.sum() / TOP))


def chosen(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, part): at most ROWS documents a class and part, 12,000 in all."""
    marks = labels.groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).withColumn(
        "h", F.xxhash64("doc_id")).withColumn("part", (F.pmod("h", F.lit(4)) == 3).cast("int"))
    out = None
    for toxic in (0, 1):
        for part in (0, 1):
            some = marks.filter((F.col("toxic") == toxic) & (F.col("part") == part)).orderBy(
                "h", "doc_id").limit(ROWS).select("doc_id", "toxic", "part")
            out = some if out is None else out.unionByName(some)
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ordinary, toxic) from text and toxic; summed in the tasks before the shuffle."""
    def run(batches):
        counts = Counter(), Counter()
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for raw, c in zip(raw_texts(batch.column(0)), toxic):
                if raw:
                    counts[c].update(set(plain_words(raw)))
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()),
             *[pa.array([c[w] for w in words], pa.int64()) for c in counts]],
            ["word", "ordinary", "toxic"])

    return texts.mapInArrow(run, "word binary, ordinary long, toxic long").groupBy("word").agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def gram_counts(words: DataFrame) -> DataFrame:
    """The runs of up to ORDER letters of all words, with the counts of the words they are in."""
    def run(batches):
        for batch in batches:
            codes, place = letters(batch.column(0).to_pylist())
            if not len(codes):
                continue
            word = (place == 0).cumsum() - 1
            runs = names(codes)
            n = [c.to_numpy(zero_copy_only=False)[word] for c in batch.columns[1:]]
            for k in range(1, ORDER + 1):
                at = ((place >= k - 1) & (place > 0)).nonzero()[0]
                zero = np.zeros(len(at), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k, np.int32)),
                     *[pa.array(x.view(np.int64)) for x in
                       (runs[k][at], runs[k - 1][at - 1] if k > 1 else zero,
                        runs[k - 1][at] if k > 1 else zero)],
                     pa.array(n[0][at]), pa.array(n[1][at])],
                    ["k", "gram", "context", "suffix", "ordinary", "toxic"])

    return words.mapInArrow(run, GRAMS).groupBy("k", "gram").agg(
        F.first("context").alias("context"), F.first("suffix").alias("suffix"),
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def kept_grams(grams: DataFrame) -> DataFrame:
    """What the models need: k, gram, suffix, the counts of both classes beyond ``RARE``, their
    sums over the gram's context, and the share of the context that goes to shorter runs.

    Runs that are rare in both classes are left out: shorter ones speak for them. Up to
    ``SHARED`` letters both classes count how many different letters stand before a run.
    """
    before = grams.filter(F.col("k") <= SHARED + 1).groupBy(
        (F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(
        (F.count(F.lit(1)) + 1).alias("kinds"))
    every = grams.join(before, ["k", "gram"], "left")
    shared = F.col("k") <= SHARED
    over = lambda n: F.col(n) - F.least(F.col(n), F.lit(RARE))
    counted = every.select(
        "k", "gram", "context", "suffix",
        F.when(shared, F.coalesce("kinds", F.lit(1))).otherwise(F.col("ordinary") + F.col("toxic"))
        .alias("n"),
        *[F.when(shared, F.coalesce("kinds", F.lit(1))).otherwise(over(c)).alias(c)
          for c in ("ordinary", "toxic")])
    contexts = counted.groupBy("k", "context").agg(
        F.greatest(F.sum(F.least(F.col("n"), F.lit(RARE))) / F.sum("n"), F.lit(1e-3))
        .alias("free"),
        F.sum("ordinary").alias("all_ordinary"), F.sum("toxic").alias("all_toxic"))
    return counted.filter(shared | (F.greatest("ordinary", "toxic") > 0)).join(
        contexts, ["k", "context"]).drop("context", "n")


def evidence(texts: Column, model: Broadcast) -> Column:
    @F.arrow_udf("struct<" + ", ".join(f"{k}: double" for k in KINDS) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rules = model.value
        for batch in batches:
            rows = np.array([rules.of(raw) for raw in raw_texts(batch)], float).reshape(
                -1, len(KINDS))
            yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(KINDS))],
                                             KINDS)

    return run(texts)


def curve(x: np.ndarray, y: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve (the last is the constant), slightly held back, by Newton's
    method; every class weighs as much as its share among all labelled documents."""
    full = np.column_stack([x, np.ones(len(x))])
    sizes = np.array([max((y == k).sum(), 1) for k in (0, 1)])
    weight = (shares / sizes * len(x))[y]
    held = np.diag([0.1] * x.shape[1] + [1e-6])
    w = np.zeros(full.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (weight * (y - p)) - held @ w
        bend = (full * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + held
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence: a row for every row of ``docs``."""
    rows = docs.select("doc_id", "text")
    held_out = (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    marks = labels.filter("toxic in (0, 1) and doc_id is not null").filter(
        remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    # At most 4 x ROWS rows of an id and two numbers: small whatever the size of the tables.
    sample = F.broadcast(written(chosen(marks), "toxicity-sample"))
    taught = rows.join(sample, "doc_id")
    words = written(word_counts(taught.filter("part = 0").select("text", "toxic")), "words")
    seen = words.agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t")).first()
    if not seen["o"] or not seen["t"]:
        return rows.select("doc_id", held_out, F.lit(0.0).alias("score"),
                           F.lit(0).alias("predicted"),
                           *[F.lit(0.0).alias(k) for k in KINDS])
    grams = written(kept_grams(written(gram_counts(words), "grams")), "kept-grams")
    model = rows.sparkSession.sparkContext.broadcast(Evidence(
        lambda k: grams.filter(F.col("k") == k).drop("k").toPandas()))
    other = taught.filter("part = 1").select(
        "toxic", evidence(F.col("text"), model).alias("e")).select("toxic", "e.*").toPandas()
    y = other["toxic"].to_numpy(np.int64)
    if len(set(y)) < 2:
        w = np.array([0.0, 1.0, 0.0, 0.0, -2.0])
    else:
        shares = np.array([totals[0], totals[1]], float)
        w = curve(other[KINDS].to_numpy(float), y, shares / shares.sum())
    found = rows.select("doc_id", evidence(F.col("text"), model).alias("e")).select(
        "doc_id", "e.*")
    log_odds = F.lit(float(w[-1]))
    for k, kind in enumerate(KINDS):
        log_odds = log_odds + F.lit(float(w[k])) * F.col(kind)
    return found.select("doc_id", held_out, (1 / (1 + F.exp(-log_odds))).alias("score"), *KINDS
                        ).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
