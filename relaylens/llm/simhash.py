"""SimHash fingerprints of word shingles, and near duplicates by a generalised pigeonhole.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Two fingerprints
are linked at a Hamming distance of at most ``distance``; a group is a connected component.

Linking works on distinct fingerprints. Correlated bits are put into the same of ``PARTS``
partitions. If thresholds t_i over the partitions sum to distance - PARTS + 1, two linked
fingerprints agree up to t_i bits in some partition i, so a fingerprint may probe each partition
with its own threshold (-1: not at all). A dynamic program picks the thresholds whose estimated
candidates, taken from the counts of all values of each partition, are fewest. A bucket with more
than ``BUCKET`` members is dealt out again over blocks of the remaining bits, which loses no pair,
so no task ever holds a large bucket. Inside a bucket every member is compared and only the
edges of a spanning forest leave it.

A null text is an empty one; texts without words have fingerprint zero and link like any other.
Repeated rows and ties change nothing; a null id takes part, but names a group only if no other
id does (then null). Extra columns stay out of the way. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from relaylens.llm.common import blank_words, fresh, raw_texts, written
from relaylens.llm.components import connected

PARTS, WIDTH, DISTANCE = 4, 16, 3
BUCKET = 4096  # members of a bucket compared in one place
SMALL = 48  # buckets up to this size are compared in one sweep over many buckets
PROBE_COST = 40.0  # a row sent to a bucket, in candidates looked at
EDGE = "a long, b long"


def fingerprint(raw: bytes | None) -> int:
    words = blank_words(raw.lower()) if raw else []  # bytes.lower() changes A-Z only
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at:at + (1 << 16)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(shingles)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.int64)[0])


def fingerprints(texts: Column) -> Column:
    """The 64-bit fingerprint of a text, as a signed long."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(raw) for raw in raw_texts(batch)], pa.int64())

    return run(texts)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bit_groups(together: np.ndarray, n: int) -> list[int]:
    """Masks of PARTS groups of WIDTH bits each: every group grows by its most correlated bit."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(phi, 0)
    left, masks = list(range(64)), []
    for _ in range(PARTS):
        group = [max(left, key=lambda b: (phi[b][left].sum(), -b))]
        left.remove(group[0])
        while len(group) < WIDTH:
            group.append(max(left, key=lambda b: (phi[b][group].sum(), -b)))
            left.remove(group[-1])
        masks.append(sum(1 << b for b in group))
    return masks


def _bits(mask: int) -> list[int]:
    return [b for b in range(64) if mask >> b & 1]


def packed(fps: np.ndarray, mask: int) -> np.ndarray:
    """The bits under the mask as one small number."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(_bits(mask)):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def patterns(mask: int, t: int) -> list[int]:
    """All ways to flip exactly t bits under the mask."""
    from itertools import combinations
    return [sum(1 << b for b in chosen) for chosen in combinations(_bits(mask), t)]


def costs(histogram: np.ndarray) -> np.ndarray:
    """[part, threshold + 1, value]: estimated candidates plus the cost of the probes."""
    values = np.arange(1 << WIDTH)
    table = np.zeros((PARTS, DISTANCE + 2, 1 << WIDTH))
    for i in range(PARTS):
        total, probes = np.zeros(1 << WIDTH), 0
        for t in range(DISTANCE + 1):
            flips = patterns((1 << WIDTH) - 1, t)
            for flip in flips:
                total = total + histogram[i][values ^ flip]
            probes += len(flips)
            table[i][t + 1] = total + PROBE_COST * (probes - 1)
    return table


def allocate(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Thresholds [row, part] of least total cost with sum DISTANCE - PARTS + 1."""
    n, target = len(values), DISTANCE + 1  # thresholds are counted from -1, so shifted by one
    best = np.full((n, target + 1), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((PARTS, n, target + 1), np.int8)
    for i in range(PARTS):
        step = np.full((n, target + 1), np.inf)
        cost = table[i][:, values[:, i]]
        for total in range(target + 1):
            for t in range(total + 1):
                now = best[:, total - t] + cost[t]
                better = now < step[:, total]
                step[better, total] = now[better]
                chosen[i, better, total] = t
        best = step
    out = np.zeros((n, PARTS), np.int64)
    left, rows = np.full(n, target), np.arange(n)
    for i in reversed(range(PARTS)):
        out[:, i] = chosen[i, rows, left]
        left = left - out[:, i]
    return out - 1


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names)


def bit_counts(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """How often two bits are set together over all fingerprints; 4,096 sums reach the driver."""
    def run(batches):
        sums, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            fps = _unsigned(batch.column(0))
            for at in range(0, len(fps), 1 << 14):
                bits = np.unpackbits(fps[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8),
                                     axis=1, bitorder="little").astype(np.float32)
                sums += (bits.T @ bits).astype(np.int64)
                n += len(bits)
        cells = np.append(sums.ravel(), n)
        yield _rows(["cell", "n"], np.arange(len(cells)), cells)

    got = nodes.mapInArrow(run, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n")).toPandas().sort_values("cell")["n"].to_numpy(np.int64)
    if not len(got):
        return np.zeros((64, 64)), 0
    return got[:-1].reshape(64, 64).astype(float), int(got[-1])


def value_counts(nodes: DataFrame, masks: list[int]) -> np.ndarray:
    """How many fingerprints have each value of each partition: 4 x 65,536 sums at most."""
    def run(batches):
        counts = np.zeros(PARTS << WIDTH, np.int64)
        for batch in batches:
            fps = _unsigned(batch.column(0))
            for i, mask in enumerate(masks):
                counts += np.bincount(packed(fps, mask) + (i << WIDTH), minlength=len(counts))
        cells = counts.nonzero()[0]
        yield _rows(["cell", "n"], cells.astype(np.int64), counts[cells])

    got = nodes.mapInArrow(run, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n")).toPandas()
    out = np.zeros(PARTS << WIDTH)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out.reshape(PARTS, -1)


def dealt(nodes: DataFrame, masks: list[int], table: np.ndarray) -> DataFrame:
    """(mask, value, fp): every fingerprint in its own bucket of each partition and in those
    that its thresholds let it probe."""
    shared = nodes.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def run(batches):
        flips = {(i, t): patterns(m, t) for i, m in enumerate(masks)
                 for t in range(1, DISTANCE + 1)}
        for batch in batches:
            all_fps = _unsigned(batch.column(0))
            for at in range(0, len(all_fps), 1 << 14):
                fps = all_fps[at:at + (1 << 14)]
                values = np.stack([packed(fps, m) for m in masks], axis=1)
                limits = allocate(values, shared.value)
                for i, mask in enumerate(masks):
                    m = np.uint64(mask)
                    yield _rows(["mask", "value", "fp"], np.full(len(fps), m), fps & m, fps)
                    for t in range(1, DISTANCE + 1):
                        own = fps[limits[:, i] >= t]
                        for flip in flips[i, t] if len(own) else ():
                            yield _rows(["mask", "value", "fp"], np.full(len(own), m),
                                        (own ^ np.uint64(flip)) & m, own)

    return nodes.mapInArrow(run, "mask long, value long, fp long")


def dealt_again(rows: DataFrame) -> DataFrame:
    """Members of large buckets over DISTANCE + 1 blocks of the bits that the bucket leaves
    open: two of them within the distance agree in at least one block."""
    def run(batches):
        for batch in batches:
            mask, value, fp = (_unsigned(c) for c in batch.columns)
            for own in np.unique(mask):
                at = mask == own
                open_bits = _bits(~int(own) & (1 << 64) - 1)
                for k in range(DISTANCE + 1):
                    block = np.uint64(sum(1 << b for b in open_bits[k::DISTANCE + 1]))
                    yield _rows(["mask", "value", "fp"],
                                np.full(at.sum(), own | block),
                                (value[at] & own) | (fp[at] & block), fp[at])

    return rows.mapInArrow(run, rows.schema)


def small_buckets(rows: DataFrame) -> DataFrame:
    """Deals large buckets out again until every one is small; each round is a table."""
    key = ["mask", "value"]
    while True:
        large = written(rows.groupBy(key).count().filter(F.col("count") > BUCKET).select(key),
                        "simhash-large")
        if large.isEmpty():
            return rows
        rows = written(rows.join(large, key, "left_anti").unionByName(
            dealt_again(rows.join(large, key, "left_semi").select("mask", "value", "fp"))),
            "simhash-buckets")


def forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what lies within the distance: each member reached once."""
    left = np.unique(members)
    ends: tuple[list, list] = ([], [])
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= DISTANCE
            if near.any():
                found = left[near]
                ends[0].append(np.full(len(found), at))
                ends[1].append(found)
                front.extend(found)
                left = left[~near]
    if not ends[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(ends[0]), np.concatenate(ends[1])


def bucket_edges(mask: np.ndarray, value: np.ndarray, fp: np.ndarray):
    """Verified edges of whole buckets that lie one after the other."""
    new = np.ones(len(fp), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
    starts = np.append(new.nonzero()[0], len(fp))
    sizes = np.diff(starts)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    small = (sizes <= SMALL)[bucket]
    fps, own = fp[small], bucket[small]
    for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        same = own[d:] == own[:-d]
        if not same.any():
            break
        near = same & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= DISTANCE) & (fps[d:] != fps[:-d])
        if near.any():
            yield fps[:-d][near], fps[d:][near]
    for k in (sizes > SMALL).nonzero()[0]:
        yield forest(fp[starts[k]:starts[k + 1]])


def links(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints that share a bucket and lie within the distance."""
    def run(batches):
        kept: list[np.ndarray] = [np.zeros(0, np.uint64)] * 3
        for batch in batches:
            now = [np.concatenate([k, _unsigned(c)]) for k, c in zip(kept, batch.columns)]
            if not len(now[0]):
                continue
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = len(last) if not last.any() else int(last.argmax())
            for a, b in bucket_edges(*(c[:cut] for c in now)) if cut else ():
                yield _rows(["a", "b"], a, b)
            kept = [c[cut:] for c in now]
        if len(kept[0]):
            for a, b in bucket_edges(*kept):
                yield _rows(["a", "b"], a, b)

    key = ["mask", "value"]
    return (rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, EDGE)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .filter("a <> b").distinct())


def groups(prints: DataFrame, doc_id: str, fp: str) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint: the smallest fingerprint of its
    group, and the smallest id."""
    nodes = written(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first")),
                    "simhash-nodes")
    only = nodes.select("fp")
    masks = bit_groups(*bit_counts(only))
    table = costs(value_counts(only, masks))
    rows = small_buckets(written(dealt(only, masks, table), "simhash-buckets"))
    root = connected(links(rows))
    rooted = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def with_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id), a row for every row of ``docs``."""
    prints = written(docs.select(F.col(doc_id).alias("doc_id"),
                                 fingerprints(F.col(text)).alias("fp")), "simhash-prints")
    return prints.join(groups(prints, "doc_id", "fp"), "fp").select(
        "doc_id", "fp", "root", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that of its smallest id, and of its repeated rows one.

    Of rows that share the id that names their group, the smallest (of all columns, as text)
    stays; so does the smallest row of a group whose ids are all null.
    """
    found = written(with_groups(docs, doc_id, text), "simhash-groups")
    group, rank, fp = (fresh(docs, n) for n in ("group", "rank", "fp"))
    order = [F.col(f"`{c}`").cast("string").asc_nulls_first() for c in docs.columns]

    def first_of(rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn(rank, F.row_number().over(
            Window.partitionBy(key).orderBy(*order))).filter(F.col(rank) == 1).select(
            *[f"`{c}`" for c in docs.columns])

    ids = found.select(F.col("component_id").alias(group)).distinct()
    named = first_of(docs.join(ids, F.col(doc_id) == F.col(group), "left_semi"), doc_id)
    lone = found.filter("component_id is null").select(
        F.col("fp").alias(fp), F.col("root").alias(group)).distinct()
    nameless = docs.filter(F.col(doc_id).isNull()).withColumn(fp + "_own",
                                                              fingerprints(F.col(text)))
    return named.unionByName(first_of(nameless.join(lone, F.col(fp + "_own") == F.col(fp)), group))
