"""Sequential folds over ordered keys, in parallel even when one key owns most rows.

A fold (state machine) needs the rows of a key in order. Hashing by key would send a hot key to
one task. Here the rows are range-partitioned by (key, order) instead, so a hot key spans many
slices, and the state at the start of each slice is found in one of two ways.

*Composition*, for folds that can tell what a stretch of rows makes of every state it may be entered
with (``passage``). One pass over the slices writes this as a table of pieces; the entry states follow
by looking up one piece for each slice, in order. With the pass that emits the output that makes two
scans, whatever the data.

*Repair*, for the others:

1. every slice folds its rows, starting a continued key from the initial state, and reports one
   row: first and last key, the state it started with and the state it ended with;
2. where a key continues from one slice into the next, the next one should have started with
   what the previous one ended with; slices that did not are folded again from there;
3. when all agree, the states are exact (the first slice is right, hence the second, ...).

A state machine that forgets its start within a slice needs one or two repairs. A part of
a state that only grows is kept out of this comparison as an *offset*: slices are folded from an
unknown offset, and once all states agree the true offsets are running sums over the slices' reports.

What the driver sees is one row per slice, and the pieces of a slice where they are few; of a slice
with more of them it reads the one that it needs.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from relaylens.session import scratch_path, shared_dir

_SUMMARY = ("slice_id INT, first_key STRING, last_key STRING, entered STRING, left_as STRING, "
            "left_offset BIGINT")
_REPORT = ("slice_id INT, first_key STRING, last_key STRING, left_as STRING, n_pieces INT, "
           "kind INT, upto BIGINT, code INT, val BIGINT, fixed BOOLEAN, off BIGINT")
UNKNOWN = 1 << 50  # stands for an offset that is not known yet; counts stay far below it
FEW_PIECES = 1_000  # of a slice: up to here the driver takes them all at once


class Fold(ABC):
    """The state of a key must be JSON-serialisable and hold all that later rows depend on."""

    key: str                # column that names the key
    output_schema: str      # schema of the rows that ``advance`` returns

    @abstractmethod
    def initial(self, rows: pd.DataFrame):
        """State before the first row of a key; ``rows`` starts with that row."""

    @abstractmethod
    def advance(self, state, rows: pd.DataFrame, emit: bool):
        """``(state after rows, output rows or None)`` for consecutive rows of one key."""

    def split(self, state) -> tuple[object, int]:
        """The state without its offset, and the offset: a number that no transition looks at and
        that the rows only raise, or drop together with what they leave it in."""
        return state, 0

    def joined(self, core, offset: int):
        return core

    def passage(self):
        """An empty stretch, for folds that are composed: an object with ``pieces()``, one row for
        each piece (kind, upto, code, val, fixed, off)."""
        return None

    def extend(self, passage, rows: pd.DataFrame) -> None:
        """Adds consecutive rows to a stretch."""
        raise NotImplementedError

    def address(self, state) -> tuple[int, int]:
        """Kind and number of a state: it meets the first piece of its kind with ``upto`` from
        its number on."""
        raise NotImplementedError

    def landed(self, state, code: int, val: int, fixed: bool, off: int):
        """The state after a stretch that was entered with ``state`` and met this piece."""
        raise NotImplementedError


def sorted_slices(df: DataFrame, key: str, order: list[str], slices: int | None = None) -> DataFrame:
    """Rows in (key, order), cut into slices of similar size; ``order`` must break all ties.

    The result is checkpointed to the shared folder: later passes must see the same slices.
    Without ``slices`` their number is that of shuffle partitions, as for any other sort; rows
    of a slice are streamed, so its size is bounded by disk, not by memory.
    """
    spark = df.sparkSession
    shared_dir(spark)
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(slices, key, *order).sortWithinPartitions(key, *order)
            .withColumn("slice_id", F.spark_partition_id()).checkpoint())


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys; a null equals a null."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    edges = [0, *cuts.tolist(), len(keys)]
    return zip(edges[:-1], edges[1:])


def _mapper(fold: Fold, entries: dict[int, str], emit: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = summary = None
        for rows in batches:
            if not len(rows):
                continue
            names = rows[fold.key].astype(object).where(rows[fold.key].notna(), None).to_numpy()
            for start, stop in _runs(names):
                part = rows.iloc[start:stop]
                if summary is None:
                    slice_id = int(part["slice_id"].iloc[0])
                    known = entries.get(slice_id)
                    state = fold.initial(part) if known is None else json.loads(known)
                    key, core = names[start], json.dumps(fold.split(state)[0])
                    summary = [slice_id, json.dumps(key), None, core, None, None]
                elif names[start] != key:
                    key, state = names[start], fold.initial(part)
                state, out = fold.advance(state, part, emit)
                if emit:
                    yield out
        if summary is not None and not emit:
            core, offset = fold.split(state)
            summary[2], summary[4], summary[5] = json.dumps(key), json.dumps(core), int(offset)
            yield pd.DataFrame([summary], columns=["slice_id", "first_key", "last_key", "entered",
                                                   "left_as", "left_offset"])
    return run


def _reporter(fold: Fold):
    """One row for each slice, and the pieces of slices that hold one key alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, key, state, passage = None, None, None, fold.passage()
        for rows in batches:
            if not len(rows):
                continue
            names = rows[fold.key].astype(object).where(rows[fold.key].notna(), None).to_numpy()
            for start, stop in _runs(names):
                part = rows.iloc[start:stop]
                if head is None:
                    head = int(part["slice_id"].iloc[0]), json.dumps(names[start])
                    key, state = names[start], fold.initial(part)
                elif names[start] != key:
                    key, state, passage = names[start], fold.initial(part), None
                state, _ = fold.advance(state, part, False)
                if passage is not None:
                    fold.extend(passage, part)
        if head is None:
            return
        pieces = pd.DataFrame() if passage is None else passage.pieces()
        summary = pd.DataFrame([[*head, json.dumps(key), json.dumps(state), len(pieces)]], columns=[
            "slice_id", "first_key", "last_key", "left_as", "n_pieces"])
        names = [column.split()[0] for column in _REPORT.split(", ")]
        yield summary.reindex(columns=names).astype(object).where(lambda df: df.notna(), None)
        if len(pieces):
            yield pieces.assign(slice_id=head[0], n_pieces=len(pieces), first_key=None,
                                last_key=None, left_as=None)[names]
    return run


def _composed(slices: DataFrame, fold: Fold) -> dict[int, str]:
    """Entry states by one pass: each slice's end is looked up in its pieces."""
    spark = slices.sparkSession
    path = scratch_path(spark, "passages")
    slices.mapInPandas(_reporter(fold), _REPORT).write.parquet(path)
    table = spark.read.schema(_REPORT).parquet(path)
    reports = {row.slice_id: row for row in table.filter("kind IS NULL").select(
        "slice_id", "first_key", "last_key", "left_as", "n_pieces").collect()}
    follows = {after.slice_id for _, after in _continued(reports)}
    few: dict[tuple[int, int], list] = {}
    if any(0 < reports[i].n_pieces <= FEW_PIECES for i in follows):
        small = table.filter(F.col("kind").isNotNull() & (F.col("n_pieces") <= FEW_PIECES)
                             & F.col("slice_id").isin(*follows))
        for row in small.collect():
            few.setdefault((row.slice_id, row.kind), []).append(row)

    def met(report, kind: int, number: int):
        if report.n_pieces <= FEW_PIECES:
            found = [p for p in few[(report.slice_id, kind)] if p.upto >= number]
            return min(found, key=lambda p: p.upto)
        here = (F.col("slice_id") == report.slice_id) & (F.col("kind") == kind)
        return table.filter(here & (F.col("upto") >= number)).orderBy("upto").first()

    entries: dict[int, str] = {}
    left = None
    for i in sorted(reports):
        report = reports[i]
        entered, left = left, json.loads(report.left_as)
        if i in follows:
            entries[i] = json.dumps(entered)
            if report.n_pieces:
                piece = met(report, *fold.address(entered))
                left = fold.landed(entered, piece.code, piece.val, piece.fixed, piece.off)
    return entries


def entry_states(slices: DataFrame, fold: Fold) -> dict[int, str]:
    """State at the start of every slice whose first key continues from the slice before."""
    if fold.passage() is not None:
        return _composed(slices, fold)
    cores: dict[int, str] = {}
    reports: dict[int, object] = {}
    todo = slices
    while True:
        unknown = {i: json.dumps(fold.joined(json.loads(c), UNKNOWN)) for i, c in cores.items()}
        found = todo.mapInPandas(_mapper(fold, unknown, False), _SUMMARY).collect()
        reports.update({row.slice_id: row for row in found})
        wrong = {after.slice_id: before.left_as for before, after in _continued(reports)
                 if after.slice_id not in cores or after.entered != before.left_as}
        if not wrong:
            break
        cores.update(wrong)
        todo = slices.filter(F.col("slice_id").isin(*wrong))
    entries: dict[int, str] = {}
    offsets = {i: row.left_offset for i, row in reports.items()}
    for before, after in _continued(reports):
        entered = offsets[before.slice_id]
        entries[after.slice_id] = json.dumps(fold.joined(json.loads(before.left_as), entered))
        if offsets[after.slice_id] >= UNKNOWN // 2:  # it still counts from where it entered
            offsets[after.slice_id] += entered - UNKNOWN
    return entries


def _continued(reports: dict[int, object]) -> list[tuple[object, object]]:
    """Neighbouring slices in which a key goes on from the first to the second."""
    rows = [reports[i] for i in sorted(reports)]
    return [(a, b) for a, b in zip(rows, rows[1:]) if a.last_key == b.first_key]


def run_fold(slices: DataFrame, fold: Fold) -> DataFrame:
    """The fold's output rows, in any order."""
    return slices.mapInPandas(_mapper(fold, entry_states(slices, fold), True), fold.output_schema)
