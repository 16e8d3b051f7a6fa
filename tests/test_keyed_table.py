"""The bucketed state table against the plain upsert, file by file."""

import os
import random

from pyspark.sql import functions as F

from relaylens.operators import state
from relaylens.session import scratch_path
from relaylens.sources.keyed_table import KeyedTable

SCHEMA = "k STRING, last INT, first INT, most INT, n BIGINT, same STRING"
POLICIES = {"last": state.OVERWRITE, "first": state.KEEP, "most": state.GREATEST,
            "n": state.INCREMENT, "same": state.AGREE}


def updates(spark, seed, n=60, keys=40):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(keys)}", rng.choice([None, *range(9)]), rng.choice([None, 1, 2]),
             rng.choice([None, *range(50)]), rng.choice("aaaab"), i) for i in range(n)]
    return spark.createDataFrame(rows, "k STRING, last INT, first INT, most INT, same STRING, at INT")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names
            if f.endswith(".parquet")}


def table(spark, path, buckets=8):
    return KeyedTable(spark, path, SCHEMA, ["k"], POLICIES, ["at"], buckets)


def test_merges_and_compactions_equal_upserts(spark):
    own = table(spark, scratch_path(spark, "keyed"))
    plain = spark.createDataFrame([], SCHEMA)
    assert own.read().count() == 0 and own.compact() == []
    for version in range(7):
        batch = updates(spark, version)
        plain = spark.createDataFrame(
            state.keyed_upsert(plain, batch, ["k"], POLICIES, ["at"]).collect(), SCHEMA)
        assert own.merge(batch) == version
        assert rows(own.read()) == rows(plain)
        if version in (2, 5):
            assert own.compact(deltas=2)
            assert rows(own.read()) == rows(plain)
        if version == 4:
            before = rows(plain)
    assert rows(own.read(before=5)) == before
    wanted = spark.createDataFrame([("k3",), ("k7",), ("none",)], "k STRING")
    assert rows(own.lookup(wanted)) == rows(plain.filter("k IN ('k3', 'k7')"))


def test_untouched_files_keep_their_names_and_retries_change_nothing(spark):
    path = scratch_path(spark, "keyed")
    own = table(spark, path, buckets=16)
    own.merge(updates(spark, 1, 400, 200))
    assert len(own.compact()) == 16
    held = files(f"{path}/base")
    one = spark.createDataFrame([("k5", 1, 1, 99, "z", 0)], updates(spark, 1).schema)
    own.merge(one, version=1)
    first = rows(own.read())
    own.merge(one, version=1)  # a retried batch
    assert rows(own.read()) == first
    written = files(path) - held - files(f"{path}/version={0:020d}")
    assert len(written) == 1  # one bucket of one delta
    assert own.compact(share=0.0, deltas=1) and own.compact(share=0.0, deltas=1) == []
    assert held <= files(f"{path}/base") and len(files(f"{path}/base") - held) == 1
    assert rows(own.read()) == first
    # clean buckets are read as they are: only the ones with deltas are shuffled
    own.merge(one, version=2)
    layout = own.layout()
    assert sum(1 for base, since in layout.values() if since) == 1
    assert len(own.versions()) == 3


def test_old_folders_go(spark):
    path = scratch_path(spark, "keyed")
    own = table(spark, path, buckets=2)
    for version in range(9):
        own.merge(updates(spark, version, 20, 10))
        own.compact(share=0.0, deltas=1)
    assert own.versions() == [6, 7, 8]
    assert len(files(f"{path}/base")) == 6
    assert rows(own.read(before=8)) == rows(own.read(before=8))


def test_rows_can_be_dropped(spark):
    own = table(spark, scratch_path(spark, "keyed"), buckets=4)
    own.merge(updates(spark, 3))
    want = rows(own.read().filter("most >= 30"))
    own.compact(keep=F.col("most") >= 30)
    assert rows(own.read()) == want and own.compact(keep=F.col("most") >= 30) == []
    own.compact(keep=F.lit(False))
    assert own.read().count() == 0
    own.merge(updates(spark, 4))
    assert rows(own.read()) == rows(state.keyed_upsert(
        spark.createDataFrame([], SCHEMA), updates(spark, 4), ["k"], POLICIES, ["at"]))
