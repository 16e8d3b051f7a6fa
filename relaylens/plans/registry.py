"""The catalogue of named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relaylens.plans import views
from relaylens.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The tables of one scale factor, addressed as attributes; ``live`` reads them as streams."""

    def __init__(self, spark: SparkSession, sf_dir: str, streaming: bool = False):
        self.spark, self.sf_dir, self._streaming = spark, sf_dir, streaming

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return views.view(self.spark, self.sf_dir, name, self._streaming)

    @property
    def live(self) -> Inputs:
        return Inputs(self.spark, self.sf_dir, streaming=True)


def query(key: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``key`` with its DuckDB equivalent."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(Inputs(spark, sf_dir))

        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = views.duckdb_sql(oracle)
        return fn
    return register
