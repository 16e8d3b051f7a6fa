import random
from itertools import combinations

import numpy as np
import xxhash

import llm_rows
from relaylens.llm import simhash
from relaylens.llm.components import connected


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    runs = [words] if len(words) < 3 else [words[i:i + 3] for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_groups(prints):
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= 3:
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in prints}


def test_fingerprints_and_groups_of_awkward_rows(spark):
    docs = llm_rows.awkward(spark)
    got = simhash.with_groups(docs).select(
        "doc_id", simhash.hex_digits(simhash.F.col("fp")).alias("h"), "component_id").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["h"]) for r in got) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, f"{slow_print(r['text']):016x}")
        for r in docs.collect())
    tops = brute_groups([slow_print(t) for t in texts.values()])
    for r in got:
        mine = tops[slow_print(texts[r["doc_id"]])]
        assert r["component_id"] == min(
            (i for i, t in texts.items() if i is not None and tops[slow_print(t)] == mine),
            default=None)
    assert simhash.with_groups(docs.limit(0)).count() == 0


def test_groups_against_brute_force(spark, monkeypatch):
    """Random prints, dense balls and chains; small buckets force the splitting of large ones."""
    random.seed(2)
    prints = {random.getrandbits(64) for _ in range(500)}
    for centre in list(prints)[:4]:
        for _ in range(150):
            p = centre
            for b in random.sample(range(64), random.randint(1, 4)):
                p ^= 1 << b
            prints.add(p)
    p = random.getrandbits(64)
    for _ in range(60):
        for b in random.sample(range(64), 3):
            p ^= 1 << b
        prints.add(p)
    rows = [(i, signed(p)) for i, p in enumerate(sorted(prints))]
    frame = spark.createDataFrame(rows, "doc_id long, fp long").repartition(5)
    tops = brute_groups(prints)
    first = {}
    for i, p in enumerate(sorted(prints)):
        first.setdefault(tops[p], i)
    want = sorted((signed(p), first[tops[p]]) for p in prints)
    for bucket in (4096, 20):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = simhash.groups(frame, "doc_id", "fp")
        assert llm_rows.rows_of(got, "fp", "component_id") == sorted(want, key=repr)


def test_thresholds_sum_up_and_are_cheapest():
    rng = np.random.default_rng(3)
    table = simhash.costs(rng.integers(0, 50, (4, 1 << 16)).astype(float))
    values = rng.integers(0, 1 << 16, (200, 4))
    limits = simhash.allocate(values, table)
    assert (limits.sum(axis=1) == simhash.DISTANCE - simhash.PARTS + 1).all()
    options = [t for t in np.ndindex(5, 5, 5, 5) if sum(t) == 4]
    for v, limit in zip(values, limits):
        cost = lambda t: sum(table[i][t[i]][v[i]] for i in range(4))
        assert np.isclose(cost(limit + 1), min(map(cost, options)))


def test_one_row_of_each_group_stays(spark):
    docs = llm_rows.awkward(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in llm_rows.rows_of(kept, "doc_id")]
    assert sorted(i for i in ids if i) == [1, 3, 4, 7, 8, 9, 10] and ids.count(None) == 1
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 240)] + [(300, 400)]
    got = dict(llm_rows.rows_of(connected(spark.createDataFrame(edges, "a long, b long")),
                                "node", "root"))
    want = {i: 0 for i in range(101)} | {i: 200 for i in range(200, 240)} | {300: 300, 400: 300}
    assert got == want
