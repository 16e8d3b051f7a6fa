import random
import re
from collections import Counter

import pytest

import llm_rows
from relaylens.llm import collocations


def brute(rows, support, longest=5, best=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    candidates = {k: a for k, a in f.items() if a >= support and len(k[1]) > 1}
    out = []
    for lang in n:
        rows = []
        for (own, w), a in candidates.items():
            if own != lang or any(
                    own == o and len(v) > len(w) and 100 * b >= 100 * a and
                    any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
                    for (o, v), b in candidates.items()):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k)
                    for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(k, lang, text, "x", 5) for k, (lang, text) in enumerate(rows)],
                                 "doc_id long, lang string, text string, rank string, f int"
                                 ).repartition(4)


def mined(docs, **more):
    return sorted(map(tuple, collocations.collocations(docs, **more).collect()))


@pytest.fixture(scope="module")
def rows():
    random.seed(8)
    words = ["a", "b", "C", "dé", "\U0001f600", "", "x'y", "B", "\x00q", "und"]
    out = []
    for k in range(300):
        text = "".join(random.choice(words) + random.choice([" ", " ", "  ", "\t", " ", ", ", ".\n"])
                       for _ in range(random.randrange(0, 60)))
        out.append((random.choice(["en", "en", "en", "de", None, "und"]), text))
    out += [("en", "hot words here " * 40)] * 9 + [("fr", None), ("fr", ""), (None, " .\r\x0b")]
    out += [("en", "one two three four five six. ")] * 25
    return out


@pytest.mark.parametrize("more", [{}, {"sent": 0, "sent_words": 0}])
def test_equal_to_brute_force(spark, rows, more):
    got = mined(table(spark, rows), support=20, best=60, **more)
    assert got == brute(rows, 20, best=60) and len(got) > 100


def test_counts_passed_on_in_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 10)
    assert mined(table(spark, rows), support=20, best=60) == brute(rows, 20, best=60)


def test_scores_beyond_64_bits(spark):
    frame = spark.createDataFrame(
        [(7, "en", "p q", "q", 9 * 10**15, 4 * 10**15, [8 * 10**15], [9 * 10**15])],
        "id long, lang string, phrase string, last string, n long, f long, "
        "pre array<long>, suf array<long>")
    row = collocations.scored([frame, frame]).first()
    assert row["score"] == 1000 * 4 * 10**15 * 9 * 10**15 // (8 * 10**15 * 9 * 10**15)


def test_ties_take_the_smallest_cut_and_phrases_in_byte_order(spark):
    rows = [("en", "k l m. z z2. é e2. ￿ f2. \U0001f600 g2. ")] * 12
    got = mined(table(spark, rows), support=10)
    assert got == brute(rows, 10)
    assert [r[2] for r in got][0] == "k l m"


def test_awkward_rows(spark):
    docs = llm_rows.awkward(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert mined(docs, support=2, longest=3) == brute(rows, 2, longest=3)
    assert mined(docs.limit(0)) == []
