"""Quality rules whose cutoffs carry a guarantee on false rejections.

Every text gets counts (words, symbols, repeated lines and word windows, capitals, exclamation
marks) and from them a few rates in thousandths. A rule rejects a text whose rate lies above a
cutoff. For each stratum (language) and rule, the labelled documents of good quality are the
holdout: a cutoff is certified if its number of false rejections is so small that a rate of
``RISK / rules`` or more would give it with probability at most ``FAILURE / (strata x rules)``
(exact binomial tail). Going from loose to tight and stopping at the first that fails needs no
further correction within a rule; the division corrects over rules and strata, so with
probability 1 - FAILURE no stratum loses over RISK of its good documents. Of the certified
cutoffs the one that best separates bad from good documents is used; without one the rule is off.

Null texts have no words. A document labelled twice counts by its smallest label, null labels do
not count. Strata are languages of two letters, everything else (nulls too) is ``other``, so there
are at most 677 of them. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relaylens.llm.common import blank_words, fresh, raw_texts, written

RISK, FAILURE = 0.02, 0.1
SYMBOLS, CAPITALS = b"#*$%&|<>", bytes(range(65, 91))
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
         "n_capitals", "n_bangs"]
#: A rule's rate: numerator, denominator.
RULES = {"symbols": ("n_symbols", "n_words"), "repeats": ("n_repeat_words", "n_words"),
         "lines": ("n_dup_lines", "n_lines"), "capitals": ("n_capitals", "word_chars"),
         "bangs": ("n_bangs", "n_words")}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words (five) that stand twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    names: dict[bytes, int] = {}
    one = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (n + 1) + right, return_inverse=True)[1]

    two = joined(one[:-1], one[1:])
    four = joined(two[:-2], two[2:])
    _, at, counts = np.unique(four[:-1] * (n + 1) + one[4:], return_inverse=True,
                              return_counts=True)
    starts = (counts[at] > 1).nonzero()[0]
    if not len(starts):
        return 0
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((covered.cumsum() > 0).sum())


def measured(raw: bytes | None) -> tuple[int, ...]:
    """The counts named in ``STATS``."""
    if not raw:
        return (0,) * len(STATS)
    words = blank_words(raw)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(b"".join(words).decode("utf-8", "replace")),
            len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(raw) - len(raw.translate(None, CAPITALS)),
            raw.count(b"!"))


def stats(texts: Column) -> Column:
    """A struct of the counts of a text."""
    kinds = ", ".join(f"{name}: long" for name in STATS)

    @F.arrow_udf(f"struct<{kinds}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([measured(raw) for raw in raw_texts(batch)],
                            np.int64).reshape(-1, len(STATS))
            yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATS))],
                                             STATS)

    return run(texts)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def stratum(lang: Column) -> Column:
    known = F.regexp_like(lang, F.lit("^[a-z][a-z]$"))
    return F.when(known, lang).otherwise("other")


def rate(rule: str, counts: Column) -> Column:
    """The rate of a rule in thousandths, at most 1,000; 0 where there is nothing to divide by."""
    part, whole = (counts[name] for name in RULES[rule])
    return F.when(whole > 0, F.least(F.lit(1000), F.floor(1000 * part / whole))).otherwise(
        0).cast("int")


def tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) for independent events of probability p, exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
            + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def allowed(n: int, risk: float, level: float) -> int:
    """The most false rejections among n good documents that still certify a cutoff; or -1."""
    low, high = -1, n  # tail(low) <= level < tail(high)
    while high - low > 1:
        mid = (low + high) // 2
        if tail(mid, n, risk) <= level:
            low = mid
        else:
            high = mid
    return low


def choose(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int | None:
    """The certified cutoff that separates best, from the counts of each rate 0..1000."""
    n, n_bad = int(good.sum()), int(bad.sum())
    if not n or not n_bad:
        return None
    most = allowed(n, risk, level)
    above = lambda counts: counts[::-1].cumsum()[::-1][1:]  # noqa: E731  at cutoffs 0..999
    lost, caught = above(good), above(bad)
    certified = lost <= most  # tighter cutoffs lose more, so this is a run up to the loosest
    if not certified.any():
        return None
    gain = np.where(certified, caught / n_bad - lost / n, -1.0)
    best = len(gain) - 1 - int(gain[::-1].argmax())  # the loosest of equals
    return best if gain[best] > 0 else None


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK,
            failure: float = FAILURE) -> dict[str, dict[str, int]]:
    """rule -> stratum -> cutoff. ``counted`` has doc_id, stratum and counts.

    What reaches the driver is one histogram per stratum, rule and label: 677 x 5 x 2 x 1,001
    counts at most.
    """
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), rate(r, F.col("counts"))
                                         .alias("rate")) for r in RULES]))
    found = counted.join(marks, "doc_id").select("stratum", "quality", rates.alias("r")).groupBy(
        "stratum", "quality", "r.rule", "r.rate").count().toPandas()
    out: dict[str, dict[str, int]] = {rule: {} for rule in RULES}
    strata = sorted(found["stratum"].unique())
    for (name, rule), rows in found.groupby(["stratum", "rule"]):
        kinds = []
        for want in (True, False):
            one = rows[(rows["quality"] == 1) == want]
            kinds.append(np.bincount(one["rate"].to_numpy(np.int64),
                                     one["count"].to_numpy(np.int64), 1001).astype(np.int64))
        best = choose(*kinds, risk / len(RULES), failure / (len(strata) * len(RULES)))
        if best is not None:
            out[rule][name] = best
    return out


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK,
           failure: float = FAILURE) -> DataFrame:
    """doc_id, stratum, counts, base_failed, rejected_by (names of rules), kept."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    counted = written(docs.select("doc_id", stratum(lang).alias("stratum"),
                                  stats(F.col("text")).alias("counts")), "rules")
    limits = cutoffs(counted, labels, risk, failure)
    hits = []
    for rule, by in limits.items():
        if by:
            limit = F.element_at(F.create_map(*[F.lit(x) for kv in by.items() for x in kv]),
                                 F.col("stratum"))
            hits.append(F.when(rate(rule, F.col("counts")) > limit, F.lit(rule)))
    named = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    failed = base_failed(F.col("counts.n_words"), F.col("counts.n_repeat_words"))
    return counted.withColumn("base_failed", failed).withColumn("rejected_by", named).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document passes, with all their columns."""
    name = fresh(docs, "kept")
    good = judged(docs, labels).groupBy("doc_id").agg(F.min("kept").alias(name))
    good = good.withColumnRenamed("doc_id", name + "_id")
    return docs.join(good, docs["doc_id"].eqNullSafe(F.col(name + "_id"))).filter(name).drop(
        name, name + "_id")
