"""Inputs several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import item_key
from ..operators.summaries import toggled_on
from ..sources.catalogue import entries, read_table


def events(spark, sf_dir) -> DataFrame:
    """Events with the item number their properties carry."""
    return read_table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    )


def marked_keys(spark, sf_dir, event_type: str) -> DataFrame:
    """Item keys some user has toggled on."""
    ev = events(spark, sf_dir).filter(F.col("event_type") == event_type)
    pos = toggled_on(ev, ["user_id", "k"]).select(F.col("k").alias("pos")).distinct()
    items = entries(spark, sf_dir).select("kind", "pos", "title", "year", "author")
    return items.join(pos, "pos", "left_semi").select(item_key().alias("item_key")).distinct()
