"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

from pyspark.sql import types as T

CLASHES = ["fp", "score", "kept", "spans", "digest", "group", "rank", "pieces", "words"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHES]])
WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch".split()


def prose(seed: int, n: int) -> str:
    """Words that depend on the seed and hardly repeat."""
    return " ".join(f"{WORDS[(seed * 7 + i * i) % 12]}{(seed * 31 + i * 17) % 997}" for i in range(n))


def documents(spark, texts):
    rows = [(i, t, "en", "src0", None if t is None else len(t), *["x"] * len(CLASHES))
            for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def awkward(spark):
    """Ids 1 and 2 are copies, 3 is repeated, 4 null, 5 empty, 6 blank, 7 long, one id is null."""
    same = prose(1, 80)
    return documents(spark, [(1, same), (2, same), (3, prose(3, 70)), (3, prose(3, 70)), (4, None),
                             (5, ""), (6, " \n\t "), (7, prose(7, 30_000)), (None, prose(9, 60)),
                             (8, "É 日本 ▁ 😀  x\u0000y"), (9, "one"), (10, "cc by CC  By.")])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.select(*names).collect()), key=repr)
