"""Figures from stored sketches, held against exact ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sketches import figures, merged, sketched
from ..session import materialise
from ..sources.catalogue import read_table
from .registry import query

#: What the figures may be off: four standard errors.
DISTINCT, RANK = 0.064, 0.056


@query(
    "sketch_figures",
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_ok, true AS median_ok, true AS q95_ok
    FROM events GROUP BY event_type""",
)
def _(spark, d):
    """Users and values per kind of event, from a sketch per kind and day."""
    events = read_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = materialise(sketched(events, ["event_type", "day"], "user_id", "value"), "sketches")
    found = figures(merged(days, ["event_type"]), [0.5, 0.95])
    share = lambda c: F.sum(c.cast("double")) / F.count("value")
    both = events.join(F.broadcast(found.select("event_type", "q50", "q95")), "event_type")
    exact = both.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"),
        *[share(F.col("value") < F.col(q)).alias(f"{q}_below") for q in ("q50", "q95")],
        *[share(F.col("value") <= F.col(q)).alias(f"{q}_upto") for q in ("q50", "q95")],
    )
    near = lambda q, r: (F.col(f"{q}_below") <= r + RANK) & (F.col(f"{q}_upto") >= r - RANK)
    return found.join(exact, "event_type").select(
        "event_type", "n", "users", (F.abs(F.col("distinct") - F.col("users")) <= DISTINCT * F.col("users") + 1).alias("users_ok"),
        near("q50", 0.5).alias("median_ok"), near("q95", 0.95).alias("q95_ok"),
    )
