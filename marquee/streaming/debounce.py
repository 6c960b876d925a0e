"""Keep the last event of a burst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import micros
from .runner import WATERMARK

SPAN = 64  # length of a time bucket in gaps


def debounce(events: DataFrame, key: str, gap_seconds: float, immediate: Column | None = None) -> DataFrame:
    """An event stays if no later one of its key follows within the gap; immediate ones
    always stay, and still cancel a waiting one.

    A window over a key would put a hot key into one task. Time is cut into buckets of 64
    gaps, and the events of a bucket's first gap are also shown to the bucket before it, so
    every window sees one key and bucket only."""
    gap = int(gap_seconds * 1e6)
    us = micros(F.col("ts"))
    wide = gap * SPAN
    here = F.floor(us / wide)
    shown = F.array_compact(
        F.array(
            F.struct(here.alias("bucket"), F.lit(True).alias("own")),
            F.when(us - here * wide < gap, F.struct((here - 1).alias("bucket"), F.lit(False).alias("own"))),
        )
    )
    now = F.lit(False) if immediate is None else immediate
    rows = events.withColumn("_us", us).withColumn("_now", now).withColumn("_b", F.explode(shown))
    w = Window.partitionBy(key, "_b.bucket").orderBy("_us", "event_id")
    following = F.lead("_us").over(w)
    return (
        rows.withColumn("_next", following)
        .filter(F.col("_b.own"))
        .filter(F.col("_now") | F.col("_next").isNull() | (F.col("_next") - F.col("_us") >= gap))
        .drop("_us", "_now", "_b", "_next")
    )


def debounce_stream(events: DataFrame, key: str, gap: str) -> DataFrame:
    """The same on a stream: the last event of every session, once the watermark has passed
    the session's end."""
    last = F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id"))
    return (
        events.withWatermark("ts", WATERMARK)
        .groupBy(key, F.session_window("ts", gap))
        .agg(last.alias("last"))
        .select(key, F.col("last.event_id").alias("event_id"), F.col("last.ts").alias("ts"))
    )
