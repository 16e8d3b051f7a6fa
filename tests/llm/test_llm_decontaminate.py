import re
import sys

import pytest

import llm_rows
from relaylens.llm import decontaminate as D


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def slow(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        n = min(13, len(own))
        runs = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in runs:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def tables(spark):
    one, two = llm_rows.prose(50, 40), llm_rows.prose(51, 20)
    items = [(0, one), (10, two), (9, "É short; ITEM"), (3, None), (4, "?!"), (None, "lone words"),
             (11, two)]
    w = one.split()
    texts = [(20, "intro " + one.upper() + " outro"), (21, " ".join(w[:12])),
             (22, " ".join(w[3:16])), (23, "; ".join(w[:13]) + " x " + " - ".join(w[5:30])),
             (24, llm_rows.prose(60, 900) + " " + " ".join(w[:20])), (25, "a É  short--item b"),
             (26, "é short item"), (27, "lone words"), (28, "A" * 50_000), (27, "lone words"),
             (29, two + " " + two)]
    docs = llm_rows.awkward(spark).unionByName(llm_rows.documents(spark, texts))
    return docs, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("set_limit", [20_000, 3])
def test_against_the_definition(tables, set_limit):
    docs, frame, items = tables
    got = D.judged(docs, frame, set_limit=set_limit).collect()
    source = docs.collect()
    assert len(got) == len(source)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, *slow(r["text"], items)) for r in source)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"],
                   r["contaminated"]) for r in got) == want
    assert {r["doc_id"] for r in got if r["contaminated"]} >= {20, 22, 23, 25, 27, 29}


def test_empty_tables(tables):
    docs, frame, _ = tables
    assert {r["n_hit"] for r in D.judged(docs, frame.limit(0)).collect()} == {0}
    assert D.judged(docs.limit(0), frame).count() == 0


def test_documents_or_spans_go(tables):
    docs, frame, items = tables
    bad = sorted(r["doc_id"] for r in docs.collect() if slow(r["text"], items)[3])
    kept = D.cleaned(docs, frame)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(bad)
    cut = D.cleaned(docs, frame, remove="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    by = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert by[20] == "intro outro" and by[4] is None and by[26] == "é short item"
    for r in cut.collect():
        assert slow(r["text"], items)[1] == 0 or r["doc_id"] in (24,)


def test_main_path_is_native(tables):
    docs, frame, _ = tables
    plan = D.judged(docs, frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_whole_texts_are_not_shuffled(spark, tables):
    """Whatever Spark's own threshold says, and with the same rows where the list is too long."""
    docs, items = tables[:2]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = D.cleaned(docs, items)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        common = sys.modules[D.sent.__module__]
        limit, common.SENT = common.SENT, 0
        try:
            assert llm_rows.rows_of(D.cleaned(docs, items), "doc_id", "text") == llm_rows.rows_of(
                kept, "doc_id", "text")
        finally:
            common.SENT = limit
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
