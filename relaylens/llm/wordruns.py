"""Periodic runs of words: the maximal pairs of a text whose distance is at most their length.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and twice its period
long, that no neighbouring word extends. A maximal pair is two equal stretches with different
words before and behind them; if they lie no farther apart than they are long, they and what is
between them are a run whose ends need no extension, and every run gives such a pair.

Pairs are enumerated bottom-up over the tree of intervals of the sorted suffixes (LCP intervals). Every
interval holds its places in order, each with its left word as its class; the smaller list of
places is merged into the larger, and each of its places is compared with the places on both sides of it. Only
neighbours count: a third place between the two of a run's pair would be a smaller period of the
run (Fine and Wilf). Pairs of one class are no maximal pairs. Multiples of a period give the same stretch; the smallest
distance stays. So the work is O(n log² n) for any text, a single word repeated included.

Suffixes are sorted by doubling in numpy, all texts of a batch together, over the texts in which some ``HALF`` words
stand twice; a place enters the tree only if the same words stand within the distance that its longest
common prefix allows. Both conditions hold for every place of a run's pair.

Null texts have no words. Empty and blank texts have no runs and collapse to an empty text. Rows are
treated alone, so repeated ones get equal results; any other columns stay as they are. A text is
held whole by one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relaylens.llm.common import blank_words, raw_texts

LEAST = 12  # words of the shortest run
HALF = LEAST // 2  # words that stand twice in every run
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RESULT = pa.struct([
    ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
    ("collapsed", pa.binary())])

Run = tuple[int, int, int]


def sorted_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and where in it each key differs from the one before."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return order, first


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, the length of the prefix that each shares with the
    one before, and a name of the first ``HALF`` words of each place of the text.

    Only places whose first four words stand twice are listed. ``ids`` ends with a value that
    occurs once, and so does every text in it.
    """
    n = len(ids)
    order, first = sorted_groups(ids)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, width = [rank], 1
    size = np.diff(np.append(np.flatnonzero(first), n))
    tied = order[np.repeat(size > 1, size)]
    listed = tied
    while len(tied):
        # places of one rank come together; within it, by the rank of what follows
        key = levels[-1][tied] * (n + 1) + levels[-1][tied + width]
        order, first = sorted_groups(key)
        tied, at = tied[order], np.arange(len(tied))
        old = levels[-1][tied]
        head = np.ones(len(tied), bool)
        head[1:] = old[1:] != old[:-1]
        begin = np.maximum.accumulate(np.where(head, at, 0))
        rank = levels[-1].copy()
        rank[tied] = old + np.maximum.accumulate(np.where(first, at, 0)) - begin
        levels.append(rank)
        width *= 2
        size = np.diff(np.append(np.flatnonzero(first), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        if width <= 4:
            listed = tied
    places = listed[np.argsort(levels[-1][listed], kind="stable")]
    shared = np.zeros(len(places), np.int64)
    left, right = places[:-1].copy(), places[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][left] == levels[k][right]
        step = same * (1 << k)
        left, right = left + step, right + step
        shared[1:] += step
    four, names = levels[min(2, len(levels) - 1)], np.full(n, -1)
    if len(levels) > 2:
        key = four[places] * (n + 1) + four[np.minimum(places + 2, n - 1)]
        order, first = sorted_groups(key)
        names[places[order]] = np.cumsum(first)
    return places, shared, names


def near_enough(places: np.ndarray, shared: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which listed places have the same ``HALF`` words no farther away than their longest
    common prefix with any other place."""
    reach = np.maximum(shared, np.append(shared[1:], 0))
    near = np.full(len(names), len(names), np.int64)
    own = np.sort(places)
    own = own[np.argsort(names[own], kind="stable")]  # by name, then by place
    gap = np.diff(own)
    same = names[own[1:]] == names[own[:-1]]
    near[own[1:][same]] = gap[same]
    near[own[:-1][same]] = np.minimum(near[own[:-1][same]], gap[same])
    return (reach >= HALF) & (near[places] <= reach)


def joined(a: list[int], b: list[int], common: int, left: list[int],
           found: dict[tuple[int, int], int]) -> list[int]:
    """The places of two parts of an interval in order; notes the runs of their maximal pairs."""
    if len(a) < len(b):
        a, b = b, a
    last = len(a)
    for place in b:
        k, word = bisect_left(a, place), left[place]
        if k < last:
            distance = a[k] - place
            if distance <= common and distance + common >= LEAST and left[a[k]] != word:
                key = (place, distance + common)
                if distance < found.get(key, common + 1):
                    found[key] = distance
        if k:
            other = a[k - 1]
            distance = place - other
            if distance <= common and distance + common >= LEAST and left[other] != word:
                key = (other, distance + common)
                if distance < found.get(key, common + 1):
                    found[key] = distance
    if len(b) < 8:
        for place in b:
            insort(a, place)
    else:
        a += b
        a.sort()
    return a


def maximal_pairs(places: list[int], shared: list[int], left: list[int]) -> dict:
    """The smallest distance of the pairs of each (start, length), bottom-up over the intervals."""
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, list[int]]] = []  # open intervals: length of their prefix, places
    shared = [*shared[1:], 0]
    for place, common in zip(places, shared):
        own = [place]
        while stack and stack[-1][0] > common:
            width, before = stack.pop()
            own = joined(before, own, width, left, found)
        if common < HALF:
            stack.clear()
        elif stack and stack[-1][0] == common:
            stack[-1] = common, joined(stack[-1][1], own, common, left, found)
        else:
            stack.append((common, own))
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(w) for w in texts], np.int64)
    table: dict[bytes, int] = {}
    flat = np.fromiter((table.setdefault(w, len(table)) for words in texts for w in words),
                       np.int64, int(sizes.sum()))
    # Texts in which HALF words stand twice, by a mixed number of the words: equal words have
    # equal numbers, so none is missed.
    text = np.repeat(np.arange(len(texts)), sizes)
    mixed = text.astype(np.uint64)
    with np.errstate(over="ignore"):
        many = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(HALF):
            mixed = (mixed[:len(flat) - k] ^ many[k:]) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
    inside = np.flatnonzero(text[:len(mixed)] == text[HALF - 1:]) if len(mixed) else \
        np.zeros(0, np.int64)
    order, first = sorted_groups(mixed[inside]) if len(inside) else (inside, inside)
    twice = np.unique(text[inside[order[~first]]]) if len(inside) else inside
    if not len(twice):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes)])
    pieces, begins, total, v = [], [], 0, len(table)
    for k, which in enumerate(twice.tolist()):
        words = flat[starts[which]:starts[which + 1]]
        # words of different texts differ, and a value of its own ends each text
        pieces += [words + k * (v + 1), np.array([k * (v + 1) + v])]
        begins.append(total)
        total += len(words) + 1
    ids = np.concatenate(pieces)
    places, shared, names = suffixes(ids)
    kept = near_enough(places, shared, names)
    # the prefix shared over places left out is the shortest in between
    index = np.flatnonzero(kept)
    if not len(index):
        return out
    least = np.minimum.reduceat(shared[:index[-1] + 1], np.concatenate([[0], index[:-1] + 1]))
    left = np.concatenate([[-1], ids[:-1]])
    found = maximal_pairs(places[index].tolist(), least.tolist(), left.tolist())
    for (start, length), period in found.items():
        k = int(np.searchsorted(begins, start, "right")) - 1
        out[twice[k]].append((start - begins[k], length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words but those that a run repeats, joined by single blanks."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [w for w, inside in zip(words, np.cumsum(edge).tolist()) if not inside]
    return b" ".join(words)


def with_runs(docs: DataFrame, text: str = "text", into: str = "periodic") -> DataFrame:
    """Adds a struct column ``into``: the ``runs`` (start, length, period; words from 0) of every
    whole text by start and period, and the text ``collapsed`` to the first period of each run."""

    @F.arrow_udf(f"struct<runs: {RUNS}, collapsed: binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for at in range(0, len(batch), 256):  # whole texts, a few at a time
                words = [blank_words(t or b"") for t in raw_texts(batch.slice(at, 256))]
                found = runs_of(words)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                items = pa.StructArray.from_arrays(
                    [pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                collapsed = pa.array(map(collapse, words, found), pa.binary())
                parts.append(pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(ends), items), collapsed],
                    ["runs", "collapsed"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], RESULT)

    return docs.withColumn(into, run(F.col(text)))


def looped(text: Column, doc_id: Column) -> Column:
    """The contract's texts: in those whose number (CRC-32 of the id) is divisible by ten, the
    words from one place on repeat; other texts stay as they are."""
    number = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))

    @F.arrow_udf("string")
    def run(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = raw_texts(texts)
        for k, h in enumerate(numbers.to_pylist()):
            words = blank_words(out[k] or b"") if h % 10 == 0 else None
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                times = -(-(n - a) // p)
                out[k] = b" ".join(words[:a] + (words[a:a + p] * times)[:n - a])
        return pa.array(out, pa.binary()).cast(pa.string())

    return run(text, number)


def digests(periodic: Column) -> list[Column]:
    """Number, longest run and digests of what ``with_runs`` added."""
    runs = periodic["runs"]
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    return [F.size(runs).cast("long").alias("n_runs"), (-best["start"]).alias("start"),
            best["length"].alias("length"), (-best["period"]).alias("period"),
            F.call_function("div", 1000 * best["length"], -best["period"]).alias("exponent_milli"),
            F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
            F.sha2(periodic["collapsed"], 256).alias("collapsed_sha256")]
