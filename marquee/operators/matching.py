"""Matching users' lists to the catalogue by folded title and tolerant year.

A title may be shared by a third of all works, so candidates are never gathered per
title. The catalogue is reduced to counts per (title, year); each count is spread over the
years it agrees with, and a row looks up at most two counts. Exactly one agreeing work is a
match, none or several is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import fold_title

ANY_YEAR = "any"  # all works of a title: what a row without a year agrees with
NO_YEAR = "none"  # works without a year: these agree with every row


def years_agree(a: Column, b: Column, slack: int = fixed.YEAR_SLACK) -> Column:
    """Lenient: an absent year on either side is no conflict."""
    return a.isNull() | b.isNull() | (F.abs(a - b) <= slack)


def years_agree_strict(stored: Column, found: Column, slack: int, oldest: int) -> Column:
    """Strict: nothing to check against is a failure."""
    return F.coalesce((found >= oldest) & (F.abs(stored - found) <= slack), F.lit(False))


def titles_agree(a: Column, b: Column, shortest: int = 8) -> Column:
    """Folded titles are equal, or one is a start of the other and long enough."""
    fa, fb = fold_title(a), fold_title(b)
    short = F.when(F.length(fa) <= F.length(fb), fa).otherwise(fb)
    long_ = F.when(F.length(fa) <= F.length(fb), fb).otherwise(fa)
    starts = (F.length(short) >= shortest) & F.startswith(long_, short)
    return (fa != "") & (fb != "") & ((fa == fb) | starts)


def title_index(entries: DataFrame, slack: int = fixed.YEAR_SLACK) -> DataFrame:
    """(kind, fold_key, probe) -> number of agreeing works and the position of the first.

    One row per distinct title and probe year, hence as large as the distinct titles, not
    as the works."""
    keyed = entries.select("kind", "pos", "year", fold_title(F.col("title")).alias("fold_key"))
    per_year = (
        keyed.filter(F.col("fold_key") != "")
        .groupBy("kind", "fold_key", "year")
        .agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    )
    near = F.transform(
        F.sequence(F.col("year") - slack, F.col("year") + slack), lambda y: y.cast("string")
    )
    probes = F.concat(F.array(F.lit(ANY_YEAR)), F.when(F.col("year").isNull(), F.array(F.lit(NO_YEAR))).otherwise(near))
    return (
        per_year.withColumn("probe", F.explode(probes))
        .groupBy("kind", "fold_key", "probe")
        .agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))
    )


def match_lists(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Adds `matches`, the number of agreeing works, and `match_pos` where it is one.

    `rows` has kind, title and year. Left equi-joins on unique keys: the same code runs on
    a stream against a static index, and AQE splits a hot title."""
    keyed = rows.withColumn("_k", fold_title(F.col("title"))).withColumn(
        "_p", F.coalesce(F.col("year").cast("string"), F.lit(ANY_YEAR))
    )
    dated = index.filter(F.col("probe") != NO_YEAR).select(
        "kind", F.col("fold_key").alias("_k"), F.col("probe").alias("_p"), F.col("n").alias("_n1"), F.col("pos").alias("_pos1")
    )
    undated = index.filter(F.col("probe") == NO_YEAR).select(
        "kind", F.col("fold_key").alias("_k"), F.col("n").alias("_n2"), F.col("pos").alias("_pos2")
    )
    joined = keyed.join(dated, ["kind", "_k", "_p"], "left").join(undated, ["kind", "_k"], "left")
    second = F.when(F.col("year").isNotNull(), F.coalesce("_n2", F.lit(0))).otherwise(F.lit(0))
    n = F.coalesce("_n1", F.lit(0)) + second
    return (
        joined.withColumn("matches", n)
        .withColumn("match_pos", F.when(F.col("matches") == 1, F.coalesce("_pos1", "_pos2")))
        .drop("_k", "_p", "_n1", "_pos1", "_n2", "_pos2")
    )
