import math

import numpy as np
import pytest

import llm_rows
from relaylens.llm import rules


def slow_counts(text):
    text = text or ""
    blanks = " \t\n\v\f\r"
    words = text.translate({ord(c): " " for c in blanks}).split(" ")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if x.strip(blanks)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


@pytest.mark.parametrize("text", [
    None, "", "a b c", "a b c d e a b c d e", "x\nx\n \n\nx\ny", "a " * 30, "#* <é> b|\x0bc\fd",
    "a a a a a a", "a b c d e f g\na b c d e f g h", "der die das " * 7 + "und so"])
def test_counts_against_the_definition(text):
    raw = None if text is None else text.encode()
    assert rules.measured(raw)[:5] == slow_counts(text)


def test_exact_tail():
    for n, p in ((10, 0.3), (40, 0.02)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))
            assert rules.tail(k, n, p) == pytest.approx(want, rel=1e-9)
    for n in (5, 100, 3000):
        k = rules.allowed(n, 0.01, 0.05)
        assert k == -1 or rules.tail(k, n, 0.01) <= 0.05
        assert rules.tail(k + 1, n, 0.01) > 0.05


def test_certified_cutoffs_hold_their_promise():
    """Over many holdouts from one distribution, the true loss rarely exceeds the risk."""
    rng, bad = np.random.default_rng(4), np.bincount([500] * 100, minlength=1001)
    over = 0
    for _ in range(300):
        good = np.bincount(np.minimum(rng.geometric(0.02, 4000), 1000), minlength=1001)
        cut = rules.choose(good, bad, 0.01, 0.05)
        over += cut is not None and 0.98**cut > 0.01
    assert over <= 30


def test_few_labels_certify_nothing():
    good, bad = np.zeros(1001, np.int64), np.zeros(1001, np.int64)
    good[0], bad[900] = 20, 20
    assert rules.choose(good, bad, 0.01, 0.05) is None
    good[0] = 2000
    assert 0 <= rules.choose(good, bad, 0.01, 0.05) < 900


def test_awkward_rows(spark):
    docs = llm_rows.awkward(spark)
    got = rules.judged(docs, llm_rows.labels(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0),
                                                     (2, None, None)])).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        text = texts[r["doc_id"]]
        if r["doc_id"] != 7:
            assert tuple(r["counts"])[:5] == slow_counts(text)
        n, _, _, _, again = tuple(r["counts"])[:5]
        assert r["base_failed"] == (n < 10 or 100 * again > 20 * n) and r["kept"] != r["base_failed"]
    assert rules.judged(docs.limit(0), llm_rows.labels(spark, [])).count() == 0


def test_junk_goes_and_prose_stays(spark):
    texts = [(i, llm_rows.prose(i, 60)) for i in range(4000)]
    texts += [(i, " ".join(w + "###" for w in llm_rows.prose(i, 60).split()))
              for i in range(4000, 4300)]
    docs = llm_rows.documents(spark, texts)
    found = rules.judged(docs, llm_rows.labels(spark, [(i, int(i < 4000), 0) for i, _ in texts]))
    kept = {r["doc_id"] for r in found.filter("kept").collect()}
    assert kept == set(range(4000))
    assert rules.kept_documents(docs, llm_rows.labels(spark, [])).columns == docs.columns
