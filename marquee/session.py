"""Session settings and materialisation in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
WORK_KEY = "spark.marquee.workdir"
BATCH_BYTES = 4 << 20


def local_session(cpus: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("marquee")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Let AQE split hot keys of many-to-one joins even if that costs an exchange, and bound
    the batches that go to Python workers in bytes."""
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def work_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a single process makes one of its own and
    removes it at its end; executors on other machines would not see it, so elsewhere it is an error."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get(WORK_KEY, None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marquee-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set(WORK_KEY, base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/marquee/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends in files that
    outlive any executor, and later scans prune columns."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Joins one-row aggregates into one row, by a constant key."""
    out = None
    for df in one_row_frames:
        part = df.withColumn("_one", F.lit(1))
        out = part if out is None else out.join(part, "_one")
    return out.drop("_one")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows over all cores, for work that is heavy per row."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
