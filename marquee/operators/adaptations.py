"""Works of one franchise in several media."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .sorting import top_per_group

KEEP = 4


def adaptations(vectors: DataFrame) -> DataFrame:
    """gid -> up to four items of other media with the same base title, in item order.

    A base title may cover a third of all items, so its group is never gathered: the first
    four items per (title, medium) are enough to answer for every medium, and Spark keeps
    four per task before the shuffle."""
    named = vectors.filter(F.col("base_key") != "").select("gid", "kind_rank", "base_key")
    heads = top_per_group(named, ["base_key", "kind_rank"], [F.asc("gid")], KEEP, "_r")
    per_title = heads.groupBy("base_key").agg(
        F.array_sort(F.collect_list(F.struct("gid", "kind_rank"))).alias("heads"),  # at most 16
        F.collect_set("kind_rank").alias("kinds"),
    )
    lists = (
        per_title.filter(F.size("kinds") >= 2)
        .withColumn("kind_rank", F.explode("kinds"))
        .select(
            "base_key",
            "kind_rank",
            F.slice(
                F.transform(F.filter("heads", lambda h: h["kind_rank"] != F.col("kind_rank")), lambda h: h["gid"]), 1, KEEP
            ).alias("others"),
        )
    )
    return named.join(lists, ["base_key", "kind_rank"]).select("gid", "others")
