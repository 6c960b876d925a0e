"""Lookup caches that hold definitive answers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.scores import legal_width
from ..session import fresh_path


def definitive(status: Column) -> Column:
    """A hit or a plain miss. Too many requests, server errors and no answer (0 or null) are
    transient and will be asked again."""
    s = F.coalesce(status, F.lit(0))
    return (s > 0) & (s != 429) & (s < 500)


def merge_cache(cache: DataFrame | None, answers: DataFrame) -> DataFrame:
    """Latest definitive answer per key. Both have key, status, value, seq; the maximum is an
    aggregate, so a key with very many answers costs one row per task."""
    good = answers.filter(definitive(F.col("status")))
    both = good if cache is None else cache.unionByName(good)
    latest = both.groupBy("key").agg(F.max_by(F.struct("status", "value", "seq"), "seq").alias("a"))
    return latest.select("key", "a.*")


class CacheStore:
    """A cache as sorted runs of growing size. A micro-batch adds one run of its own; FAN runs of a level are merged into one of the next
    level, so an answer is written once per level and what a batch writes follows the batch, not the cache.

    `folder` holds `run/<batch>-<level>` and, per batch, a manifest of the runs that count. Batch n reads the manifest of batch n - 1 and
    replaces only what has its own number, so a batch that is retried after a lost executor or a restart finds the same
    input. Runs and manifests that no kept manifest needs are removed by `vacuum`."""

    FAN = 8
    MANIFEST = "name string, level int, n long"

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _runs(self, batch_id: int) -> list[tuple[str, int, int]]:
        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.folder}/manifest/{batch_id}").collect()
        return sorted((r["name"], r["level"], r["n"]) for r in rows)

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/run/{n}" for n in names])

    def _write(self, rows: DataFrame, name: str, level: int) -> tuple[str, int, int]:
        seen = Observation()
        rows.select(*self.schema.names).observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/run/{name}")
        return name, level, seen.get["n"]

    def add(self, answers: DataFrame, batch_id: int) -> None:
        """One micro-batch: its definitive answers become a run, and full levels are merged."""
        runs = self._runs(batch_id - 1) if batch_id else []
        runs.append(self._write(merge_cache(None, answers), f"{batch_id}-0", 0))
        level = 0
        while len(full := [r for r in runs if r[1] == level]) >= self.FAN:
            merged = merge_cache(None, self._read([r[0] for r in full]))
            level += 1
            runs = [r for r in runs if r not in full]
            runs.append(self._write(merged, f"{batch_id}-{level}", level))
        self.spark.createDataFrame(runs, self.MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{batch_id}")

    def _files(self, part: str) -> list:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [(fs, s.getPath()) for s in fs.listStatus(path)] if fs.exists(path) else []

    def version(self) -> int | None:
        """The last batch that is complete."""
        done = [int(p.getName()) for fs, p in self._files("manifest") if fs.exists(p.suffix("/_SUCCESS"))]
        return max(done, default=None)

    def read(self) -> DataFrame:
        """Latest answer per key as of the last complete batch."""
        last = self.version()
        if last is None:
            return self.spark.createDataFrame([], self.schema)
        return merge_cache(None, self._read([r[0] for r in self._runs(last)])).select(*self.schema.names)

    def vacuum(self, keep: int = 2) -> int:
        """Removes the runs and manifests that the last `keep` versions do not need; returns how many runs went."""
        last = self.version()
        if last is None:
            return 0
        kept = range(max(0, last - keep + 1), last + 1)
        needed = {name for n in kept for name, _, _ in self._runs(n)}
        gone = [(fs, p) for fs, p in self._files("run") if p.getName() not in needed and int(p.getName().split("-")[0]) <= last]
        for fs, p in gone + [(fs, p) for fs, p in self._files("manifest") if int(p.getName()) < kept[0]]:
            fs.delete(p, True)
        return len(gone)


def merge_stream(answers: DataFrame, folder: str | None = None) -> CacheStore:
    """Folds a stream of answers into a cache. With the folder of an earlier run it goes on where that one stopped."""
    spark = answers.sparkSession
    store = CacheStore(spark, folder or fresh_path(spark, "cache"), answers.schema)
    query = answers.writeStream.foreachBatch(store.add).option("checkpointLocation", f"{store.folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return store


def migrate_cache(old: DataFrame) -> DataFrame:
    """Entries of an old cache worth keeping: a picture at a width that is still served."""
    return old.filter(F.col("value").isNotNull() & legal_width(F.col("value")))
