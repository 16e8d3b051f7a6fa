"""A keyed state table that takes small batches without rewriting what they do not touch.

Keys are hashed into buckets. A merge writes the collapsed updates alone, as a new delta with a folder for
each bucket, and reads nothing, so its cost follows the batch. A read merges each bucket's
base file with the deltas since; buckets without deltas are read as they are, without a shuffle. Every
policy of an upsert is a mergeable aggregate over versions, which is what makes this exact.
``compact`` folds the deltas of the buckets that need it into a new base of these buckets; files of all
other buckets keep their names. Folders count once their write has finished, and a retried merge or
compaction replaces its own folder, so repeated batches change nothing::

    <path>/version=<v>/bucket=<b>/...    the updates of a merge
    <path>/base/gen=<g>/bucket=<b>/...   rows of a bucket with all merges up to version g // SERIALS

The newest ``KEPT_VERSIONS`` versions can be read; what only older ones need is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relaylens.operators import state
from relaylens.session import remove
from relaylens.sources.state_table import KEPT_VERSIONS, StateTable

BUCKETS = 64
SHARE = 0.25  # bytes of deltas to bytes of base from which on a bucket is compacted
DELTAS = 8  # and their number
VERSION, BUCKET = "_version", "bucket"
SERIALS = 1_000_000  # compactions between two versions


class KeyedTable(StateTable):
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str],
                 policies: dict[str, str], order: list[str], buckets: int = BUCKETS):
        super().__init__(spark, path, schema)
        self.keys, self.policies, self.order, self.buckets = keys, policies, order, buckets
        self._stored = f"{schema}, {VERSION} BIGINT"

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folders(self, pattern: str) -> dict[int, dict[int, tuple[str, int]]]:
        """Folder and bytes by bucket, then by version, of all writes that have finished."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return {}

        def listed(glob: str) -> list:
            return list(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{glob}")) or [])

        done = {s.getPath().getParent().getName() for s in listed(f"{pattern}/_SUCCESS")}
        found: dict[int, dict[int, tuple[str, int]]] = {}
        for status in listed(f"{pattern}/{BUCKET}=*"):
            folder = status.getPath()
            if folder.getParent().getName() in done:
                bucket = int(folder.getName().split("=")[1])
                version = int(folder.getParent().getName().split("=")[1])
                found.setdefault(bucket, {})[version] = (
                    folder.toString(), fs.getContentSummary(folder).getLength())
        return found

    def layout(self, before: int | None = None) -> dict[int, tuple]:
        """By bucket its base (version, folder, bytes), or None, and its deltas since then."""
        def seen(found: dict) -> list[tuple]:
            return sorted((n, *f) for n, f in found.items() if before is None or n < before)

        bases = {b: [(g // SERIALS, *v[g]) for g in [max(
            (g for g in v if before is None or g // SERIALS < before), default=None)]
            if g is not None] for b, v in self._folders("base/gen=*").items()}
        deltas = {b: seen(v) for b, v in self._folders("version=*").items()}
        out = {}
        for bucket in bases.keys() | deltas.keys():
            base = (bases.get(bucket) or [None])[0]
            since = [d for d in deltas.get(bucket, []) if base is None or d[0] > base[0]]
            if base is not None or since:
                out[bucket] = base, since
        return out

    def merge(self, updates: DataFrame, version: int | None = None) -> int:
        """Writes a batch of updates; nothing that is stored is read or rewritten."""
        known = self.versions()
        version = version if version is not None else (known[-1] + 1 if known else 0)
        delta = state.collapse(updates, self.keys, self.policies, self.order)
        self._write(delta.withColumn(VERSION, F.lit(version).cast("bigint")),
                    self._location(version))
        return version

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET).write.mode(
            "overwrite").partitionBy(BUCKET).parquet(path)

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*folders)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key: the effect of its versions one after the other."""
        at = F.col(VERSION)
        policies = {
            state.OVERWRITE: lambda c: F.max_by(c, at), state.KEEP: lambda c: F.min_by(c, at),
            state.GREATEST: F.max, state.INCREMENT: F.sum,
            state.AGREE: lambda c: F.when((F.count(c) == F.count(F.lit(1)))
                                          & (F.min(c) == F.max(c)), F.min(c))}
        return rows.groupBy(*self.keys).agg(
            *[policies[p](F.col(c)).alias(c) for c, p in self.policies.items()],
            F.max(at).alias(VERSION))

    def _state(self, layout: dict[int, tuple]) -> DataFrame:
        clean = [base[1] for base, since in layout.values() if not since]
        touched = [f[1] for base, since in layout.values() if since
                   for f in ([base] if base else []) + since]
        return self._rows(clean).unionByName(self._merged(self._rows(touched)))

    def _columns(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.keys, *self.policies)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest state, or that before a version."""
        return self._columns(self._state(self.layout(before)))

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of some keys; only the buckets of these keys are read."""
        keyed = wanted.select(*self.keys).distinct()
        numbers = {r[0] for r in keyed.select(self._bucket()).distinct().collect()}
        layout = {b: f for b, f in self.layout(before).items() if b in numbers}
        return self._columns(self._state(layout)).join(keyed, self.keys, "left_semi")

    def compact(self, share: float = SHARE, deltas: int = DELTAS, keep=None) -> list[int]:
        """Folds the deltas of the buckets that have many, and tells which. With ``keep``, a
        condition on the rows, buckets that hold rows without it lose these rows."""
        known = self.versions()
        if not known:
            return []
        layout = self.layout()
        due = {b: f for b, f in layout.items() if f[1] and (
            len(f[1]) >= deltas or sum(d[2] for d in f[1]) >= share * (f[0][2] if f[0] else 0))}
        if keep is not None:
            losing = self._state(layout).filter(~F.coalesce(keep, F.lit(False))).select(
                self._bucket().alias(BUCKET)).distinct().collect()
            due |= {r[0]: layout[r[0]] for r in losing}
        if due:
            rows = self._state(due)
            if keep is not None:
                rows = rows.filter(keep)
            self._compacted(rows, due, known[-1])
        self._forget(known)
        return sorted(due)

    def _compacted(self, rows: DataFrame, due: dict[int, tuple], version: int) -> None:
        serials = [g for own in self._folders("base/gen=*").values() for g in own
                   if g // SERIALS == version]
        path = f"{self.path}/base/gen={max(serials, default=version * SERIALS - 1) + 1:020d}"
        self._write(rows.withColumn(VERSION, F.lit(version).cast("bigint")), path)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = folder(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for bucket in due:  # one that keeps no row needs a base, too, for its deltas to be over
            fs.mkdirs(folder(f"{path}/{BUCKET}={bucket}"))

    def _forget(self, known: list[int]) -> None:
        """Deletes what no version among the newest ones needs."""
        horizon = known[-KEPT_VERSIONS:][0]
        bases, deltas = self._folders("base/gen=*"), self._folders("version=*")
        left = set()
        for bucket in bases.keys() | deltas.keys():
            own = bases.get(bucket, {})
            needed = max((g for g in own if g // SERIALS <= horizon), default=-1)
            for g, (folder, _) in own.items():
                if g < needed:
                    remove(self.spark, folder)
            for v, (folder, _) in deltas.get(bucket, {}).items():
                if v <= needed // SERIALS and needed >= 0:
                    remove(self.spark, folder)
                else:
                    left.add(v)
        for v in known:
            if v < horizon and v not in left:
                remove(self.spark, self._location(v))
