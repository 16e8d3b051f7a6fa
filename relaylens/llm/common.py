"""Words, row keys and scratch tables shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relaylens.session import prepare, remove_tables, scratch_path

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z; all others become blanks.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def plain_words(raw: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and everything outside ASCII."""
    return raw.translate(PLAIN).split()


def blank_words(raw: bytes) -> list[bytes]:
    """Runs of bytes other than blank, tab, line feed, vertical tab, form feed, return."""
    return raw.split()


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


#: Rows that a Python worker holds at a time: whole texts are large.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    if int(spark.conf.get(BATCH_ROWS[0])) > int(BATCH_ROWS[1]):
        spark.conf.set(*BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, safe from lost executors."""
    path = scratch_path(frame.sparkSession, f"llm-{label}")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: With it, Spark deletes the shuffle files of a query that has ended at once, not at a later collection.
ENDED_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def ended_files_deleted(spark: SparkSession) -> Iterator[None]:
    """For queries that are made and run inside and not run again."""
    before = spark.conf.get(ENDED_FILES, None)
    spark.conf.set(ENDED_FILES, "true")
    try:
        yield
    finally:
        spark.conf.unset(ENDED_FILES) if before is None else spark.conf.set(ENDED_FILES, before)


def written_in_turn(frames: Iterable[DataFrame], label: str) -> DataFrame:
    """The frames as one table in the shared folder, written one after the other. Only the shuffle
    files of the one being written are on disk; there must be one frame at least."""
    path = schema = spark = None
    for frame in frames:
        if path is None:
            spark, schema = frame.sparkSession, frame.schema
            path = scratch_path(spark, f"llm-{label}")
        with ended_files_deleted(spark):
            frame.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def totals(frame: DataFrame, *sums: Column) -> tuple:
    """The sums over all rows, 0 where there are none."""
    with ended_files_deleted(frame.sparkSession):
        return tuple(x or 0 for x in frame.agg(*sums).first())


def used_up(*tables: DataFrame) -> None:
    """Deletes written tables that no later frame reads."""
    for one in tables:
        remove_tables(one.sparkSession, one.inputFiles())


#: Rows that are sent to the tasks; more of them meet the texts in a shuffle.
SENT = 1_000_000


def sent(rows: DataFrame) -> DataFrame:
    """Short rows to join with texts: sent to the tasks while there are at most ``SENT``."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame is called so."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
