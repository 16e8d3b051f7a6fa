import numpy as np

import llm_rows
from relaylens.llm import toxicity

DATA = "/root/testdata/sf0.01"


def model_of(spark, counts):
    """An Evidence model of {word: (ordinary, toxic)}, by the definition of runs of letters."""
    rows = {}
    for word, n in counts.items():
        codes, place = toxicity.letters([word.encode()])
        runs = toxicity.names(codes)
        for k in range(1, toxicity.ORDER + 1):
            for i in range(max(k - 1, 1), len(codes)):
                key = (k, int(runs[k][i].view(np.int64)))
                row = rows.setdefault(key, [
                    int(runs[k - 1][i - 1].view(np.int64)) if k > 1 else 0,
                    int(runs[k - 1][i].view(np.int64)) if k > 1 else 0, 0, 0])
                row[2] += n[0]
                row[3] += n[1]
    grams = spark.createDataFrame([(*key, *row) for key, row in rows.items()], toxicity.GRAMS)
    words = spark.createDataFrame([(w.encode(), *n) for w, n in counts.items()],
                                  "word binary, ordinary long, toxic long")
    assert llm_rows.rows_of(toxicity.gram_counts(words), "k", "gram", "ordinary", "toxic") == \
        llm_rows.rows_of(grams, "k", "gram", "ordinary", "toxic")
    kept = toxicity.kept_grams(grams).toPandas()
    return toxicity.Evidence(lambda k: kept[kept["k"] == k])


def test_stems_of_one_class_stand_out(spark):
    counts = {f"stem{i}end": (0, 9) for i in range(20)} | {f"calm{i}word": (90, 9)
                                                          for i in range(20)}
    model = model_of(spark, counts)
    toxic, calm, new, rare = model.measure([b"stem7other", b"calm3word", b"zzzz", b"calm77"])
    assert toxic > 1.5 and toxic > calm + 1 and toxic > rare + 1 and new == 0


def test_a_word_seen_as_often_in_both_is_no_evidence(spark):
    model = model_of(spark, {"alpha": (50, 50), "beta": (50, 50), "gamma": (50, 50)})
    assert np.allclose(model.measure([b"alpha", b"beta", b"delta"]), 0, atol=1e-6)


def test_names_tell_runs_apart():
    codes, place = toxicity.letters([b"abab", b"ab"])
    runs = toxicity.names(codes)
    # ^ a b a b $ ^ a b $ : the run "ab" has one name wherever it stands
    assert runs[2][2] == runs[2][4] == runs[2][8] and runs[2][2] != runs[2][3]
    assert runs[3][2] == runs[3][8] and runs[3][4] != runs[3][2]


def test_planted_words_are_found(spark):
    calm = [(i, llm_rows.prose(i, 60), 0) for i in range(400)]
    words = ["vexgrim", "vexlorn", "vextide", "vexmoor"]
    toxic = []
    for i in range(400, 560):
        w = llm_rows.prose(i, 60).split()
        w[10], w[30] = words[i % 4], words[(i + 1) % 4]
        toxic.append((i, " ".join(w), 1))
    rows = calm + toxic
    docs = llm_rows.documents(spark, [(i, t) for i, t, _ in rows])
    marks = llm_rows.labels(spark, [(i, 1, x) for i, _, x in rows])
    got = {r["doc_id"]: r for r in toxicity.classified(docs, marks).collect()}
    held = [(got[i]["predicted"], x) for i, _, x in rows if got[i]["held_out"]]
    assert len(held) > 80 and np.mean([p == x for p, x in held]) > 0.97


def test_held_out_accuracy_and_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.remainder(toxicity.F.col("doc_id"), 4) == 2
    turned = labels.withColumn("toxic", toxicity.F.when(held, 1 - toxicity.F.col("toxic"))
                               .otherwise(toxicity.F.col("toxic")))
    one, two = (dict(llm_rows.rows_of(toxicity.classified(docs, x), "doc_id", "score"))
                for x in (labels, turned))
    assert np.allclose([one[i] for i in sorted(one)], [two[i] for i in sorted(two)])


def test_awkward_rows(spark):
    docs = llm_rows.awkward(spark)
    marks = llm_rows.labels(spark, [(i, 1, i % 2) for i in range(11)] + [(1, 0, None)])
    rows = toxicity.classified(docs, marks).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.classified(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.classified(docs.limit(0), marks).count() == 0
