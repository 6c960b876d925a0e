"""Name -> query and name -> oracle SQL of this package, and what queries share."""

from __future__ import annotations

import ctypes
import pickle

import pyarrow as pa
from pyspark import cloudpickle

from ..session import prepare

#: Bytes of a batch that goes to a Python worker: texts vary in length, so a count of rows bounds nothing.
BATCH_BYTES = 4 << 20

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def bounded(spark):
    """A session whose batches for Python workers are bounded in bytes."""
    spark = prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its oracle if SQL can say it."""

    def wrap(fn):
        def run(spark, sf_dir):
            return fn(bounded(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark, value):
    """A broadcast value as a function to call in tasks. Its classes travel along, so executors need no copy of this package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def released(run):
    """A function of a task's batches whose worker gives freed memory back to the system at the end of the task: workers
    outlive tasks, and what one stage has touched would stay with them through all later ones."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task
