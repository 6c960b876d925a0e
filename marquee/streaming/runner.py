"""Sources of streams and a bounded run into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import EVENT
from ..session import fresh_path

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with an event-time column."""
    raw = spark.readStream.schema(EVENT).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


#: State that outlives micro-batches stays on disk beside the heap; its checkpoints go to the query's own folder.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of the row that ends a bounded run: late, but still a number of nanoseconds.
FAR_AHEAD = "2262-01-01"


class Ending:
    """A stream with an end: `stream` reads, beside its rows, a folder that gets one row far ahead in event time
    once all others are read. That moves the watermark past them, so nothing waits any longer."""

    def __init__(self, stream: DataFrame):
        spark, schema = stream.sparkSession, stream.schema
        self.path = fresh_path(spark, "ending")
        self.row = spark.range(1).select(
            *[(F.lit(FAR_AHEAD) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        )
        self.row.limit(0).write.parquet(self.path)
        self.stream = stream.unionByName(spark.readStream.schema(schema).parquet(self.path))

    def close(self) -> None:
        self.row.write.mode("append").parquet(self.path)


def run_available(stream: DataFrame, name: str, mode: str = "append", ending: Ending | None = None) -> DataFrame:
    """Drive a stream over all available input and read what it wrote, with its `batch`. With an ending the query
    is started again from its checkpoint to read that.

    Every micro-batch overwrites its own folder, so a batch that is retried after a lost
    executor or a restart leaves no duplicates."""
    spark = stream.sparkSession
    out, log = fresh_path(spark, name), fresh_path(spark, f"{name}-log")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def run() -> None:
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    if ending is not None:
        ending.close()
        run()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(out)
