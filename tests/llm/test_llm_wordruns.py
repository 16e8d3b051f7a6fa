import hashlib
import random
import time
import zlib

from pyspark.sql import functions as F

import llm_rows
from relaylens.llm import wordruns


def brute_runs(words):
    """Every period of every stretch, the smallest of each."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_text(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_of_random_texts_equal_brute_force():
    random.seed(3)
    for _ in range(250):
        texts = []
        for _ in range(random.randint(1, 8)):
            k = random.choice([1, 2, 2, 3, 6, 40])
            words = [b"%d" % random.randrange(k) for _ in range(random.randrange(0, 110))]
            if random.random() < .5 and len(words) > 3:
                a = random.randrange(len(words))
                p = 1 + (len(words) - a) // random.randint(3, 10)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
            texts.append(words)
        assert wordruns.runs_of(texts) == [brute_runs(w) for w in texts]


def test_long_repetitive_texts_end_soon():
    random.seed(4)
    fibonacci = [[b"a"], [b"a", b"b"]]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [[b"a"] * 40_000, [b"a", b"b"] * 20_000, fibonacci[-1],
             [b"%d" % random.randrange(2) for _ in range(40_000)],
             sum(([b"u%d" % i] + [b"ha"] * 12 for i in range(3000)), []),
             [b"x%d" % (i % 9) for i in range(40_000)],
             [b"w%d" % random.randrange(50) for _ in range(200)] * 200]
    begin = time.time()
    found = wordruns.runs_of(texts)
    assert time.time() - begin < 20
    assert found[0] == [(0, 40_000, 1)] and found[1] == [(0, 40_000, 2)]
    assert len(found[4]) == 3000 and found[5] == [(0, 40_000, 9)]
    assert (0, 40_000, 200) in found[6]


def test_a_run_is_kept_once():
    words = b"x a b c a b c a b c a b c a b c y".split()
    runs, = wordruns.runs_of([words])
    assert runs == [(1, 15, 3)]
    assert wordruns.collapse(words, runs) == b"x a b c y"
    assert wordruns.runs_of([[], [b"one"]]) == [[], []]


def test_awkward_rows(spark):
    docs = llm_rows.awkward(spark)
    looped = docs.withColumn("text", wordruns.looped(F.col("text"), F.col("doc_id")))
    got = wordruns.with_runs(looped, into="out").select(
        "doc_id", "rank", F.col("out.runs").alias("r"), *wordruns.digests(F.col("out"))).collect()
    want = [(r["doc_id"], brute_text(r["doc_id"], r["text"])) for r in
            docs.filter("doc_id IS NULL OR doc_id <> 7").collect()]
    assert len(got) == docs.count() and all(r["rank"] == "x" for r in got)
    found = sorted((repr(r["doc_id"]), r["collapsed_sha256"], r["runs_sha256"], r["n_runs"],
                    r["start"], r["length"], r["period"], r["exponent_milli"])
                   for r in got if r["doc_id"] != 7)
    rows = []
    for doc_id, words in want:
        runs = brute_runs(words)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        rows.append((repr(doc_id), hashlib.sha256(wordruns.collapse(words, runs)).hexdigest(),
                     hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode())
                     .hexdigest(), len(runs), s, n, q, None if s is None else 1000 * n // q))
    assert found == sorted(rows)
    assert wordruns.with_runs(docs.limit(0)).count() == 0


def test_documents_whose_words_are_looped(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = llm_rows.documents(spark, [(i, llm_rows.prose(i, 40 + i)) for i in ids])
    looped = docs.withColumn("text", wordruns.looped(F.col("text"), F.col("doc_id")))
    got = {r["doc_id"]: [tuple(x) for x in r["p"]["runs"]] for r in
           wordruns.with_runs(looped, into="p").select("doc_id", "p").collect()}
    assert got == {i: brute_runs(brute_text(i, llm_rows.prose(i, 40 + i))) for i in ids}
    assert sum(map(len, got.values())) > 10
