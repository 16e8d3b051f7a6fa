import numpy as np

import llm_rows
from relaylens.llm import quality

DATA = "/root/testdata/sf0.01"


def test_score_is_the_difference_of_normal_densities():
    rng = np.random.default_rng(1)
    sums, data = {}, {}
    for k in (0, 1):
        x = rng.normal(k, 1 + k, (300, quality.FEATURES))
        full = np.column_stack([x, np.ones(300)])
        sums[k], data[k] = full.T @ full, x
    model = quality.Discriminant(sums)
    pooled = np.cov(np.vstack([data[0], data[1]]).T, bias=True)
    scale = np.sqrt(np.diag(pooled))
    x, logs = rng.normal(0, 1, (5, quality.FEATURES)), []
    for k in (0, 1):
        own = np.cov(data[k].T, bias=True)
        s = (1 - quality.TO_POOLED) * own + quality.TO_POOLED * pooled
        z = s / np.outer(scale, scale)
        d = len(z)
        z = (1 - quality.TO_SPHERE) * z + quality.TO_SPHERE * np.trace(z) / d * np.eye(d)
        s = z * np.outer(scale, scale)
        gap = x - data[k].mean(axis=0)
        logs.append(-0.5 * (gap @ np.linalg.inv(s) * gap).sum(axis=1)
                    - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classified(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.remainder(quality.F.col("doc_id"), 3) == 1
    turned = labels.withColumn("quality", quality.F.when(held, 1 - quality.F.col("quality"))
                               .otherwise(quality.F.col("quality")))
    one, two = (dict(llm_rows.rows_of(quality.classified(docs, x), "doc_id", "score"))
                for x in (labels, turned))
    assert np.allclose([one[i] for i in sorted(one)], [two[i] for i in sorted(two)])


def test_awkward_rows(spark):
    docs = llm_rows.awkward(spark)
    marks = llm_rows.labels(spark, [(i, i % 2, 0) for i in range(11)] + [(1, 0, 0), (None, 1, 0)])
    rows = quality.classified(docs, marks).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    for one in (marks.filter("quality = 1"), marks.limit(0)):
        got = quality.classified(docs, one).collect()
        assert {r["score"] for r in got} == {0.5}
        assert quality.keep_good(docs, one).count() == docs.count()
    assert quality.keep_good(docs, marks).columns == docs.columns
    assert quality.classified(docs.limit(0), marks).count() == 0
