"""Catalogue and view aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import js_round


def catalogue_stats(items: DataFrame, approximate: bool = False) -> DataFrame:
    """Per kind: count, year span, distinct genres (a missing one counts), verified, authors."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    games, books = F.col("kind") == "games", F.col("kind") == "books"
    return items.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.min("year").alias("year_from"),
        F.max("year").alias("year_to"),
        distinct(F.coalesce("genre", F.lit("∅"))).alias("genres"),
        F.count_if(games & F.col("verified")).alias("verified"),
        distinct(F.when(books, F.coalesce("author", F.lit("∅")))).alias("authors"),
    )


def page_stats(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.coalesce(js_round(F.avg("metacritic")), F.lit(0)).alias("avg_metacritic"),
        F.count_if("verified").alias("verified"),
        F.min("year").alias("year_from"),
        F.max("year").alias("year_to"),
    )


def genre_counts(items: DataFrame) -> DataFrame:
    """Counts per kind and genre; ties rank by first appearance. Few rows remain after the
    aggregate, so the display order is a sort of those."""
    return (
        items.groupBy("kind", "genre")
        .agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
        .orderBy("kind", F.desc("n"), "first_pos")
    )


def view_summary(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count("*").alias("shown"), F.coalesce(js_round(F.avg("metacritic")), F.lit(0)).alias("avg_metacritic")
    )


def index_coverage(slim: DataFrame) -> DataFrame:
    """Total, scored and timed per kind, and the grand total in the row named `all`."""
    return (
        slim.rollup("kind")
        .agg(F.count("*").alias("total"), F.count("score").alias("scored"), F.count("minutes").alias("timed"))
        .withColumn("kind", F.coalesce("kind", F.lit("all")))
    )


def distinct_labels(items: DataFrame) -> DataFrame:
    """Distinct genres and makers with the kinds they occur in."""
    genre = items.select("kind", F.lit("genre").alias("what"), F.col("genre").alias("label"))
    maker = items.select("kind", F.lit("maker").alias("what"), F.coalesce("author", "creator").alias("label"))
    return genre.unionByName(maker).filter(F.col("label").isNotNull()).distinct()


def toggled_on(events: DataFrame, keys: list[str]) -> DataFrame:
    """Members of a toggled set: keys toggled an odd number of times."""
    return events.groupBy(*keys).agg(F.count("*").alias("toggles")).filter(F.col("toggles") % 2 == 1)
