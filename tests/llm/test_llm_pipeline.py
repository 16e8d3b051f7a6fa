"""The stages on a planted corpus and the queries against their SQL and brute force."""

import importlib

import duckdb
import pytest

import llm_rows
from check_oracle import canonical

pipeline = importlib.import_module("corpus_pipeline")
queries = importlib.import_module("relaylens.llm.queries")
SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF_DIR)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(
        names, want.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Prose, junk, copies, a shared passage, a benchmark item; and awkward rows."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    item = llm_rows.prose(900, 40)
    shared = llm_rows.prose(901, 70)
    junk = lambda i: " ".join(w + "###" for w in llm_rows.prose(i, 60).split())
    texts = [(i, llm_rows.prose(i, 60 + i % 20)) for i in range(200)]
    texts += [(i, junk(i)) for i in range(200, 260)]
    texts += [(300, texts[5][1]), (301, texts[6][1]), (302, texts[7][1] + " " + shared),
              (303, texts[8][1] + " ending " + shared + " here"), (304, item),
              (305, llm_rows.prose(305, 30) + " " + item), (306, None), (307, "")]
    llm_rows.documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    llm_rows.labels(spark, [(i, int(i < 200), 0) for i in range(260)]).write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs, seen = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    good = set(seen["quality_classifier"])
    assert not good & set(range(200, 260)) and len(good & set(range(200))) > 190
    single = set(seen["simhash_near_dedup"])
    assert single <= good and not {300, 301} & single and {302, 303} <= single
    whole = seen["substring_dedup"]
    assert set(whole) == single
    assert llm_rows.prose(901, 70) in whole[302]["text"]
    assert llm_rows.prose(901, 70) not in whole[303]["text"]
    assert whole[303]["n_chars"] == len(whole[303]["text"])
    clean = set(seen["benchmark_decontamination"])
    assert single - clean == {304, 305} & single
    assert set(seen["sentencepiece"]) == clean
    again = pipeline.run(spark, corpus)
    assert {r["doc_id"]: r["ids_sha256"] for r in again.collect()} == {
        i: r["ids_sha256"] for i, r in seen["sentencepiece"].items()}
