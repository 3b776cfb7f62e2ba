"""The queries of this subpackage, kept apart from those of the library."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

# Rows that go to a Python worker at once.  Texts are long rows: Spark's default of 10,000 would hold tens of MB in both processes.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors; smaller batches, unless the session asks for a size of its own."""
    ship(spark)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))


def query(name: str, sql: str | None = None):
    """Register a query; its Python workers get the package, and its SQL twin is optional."""

    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
