"""Checking stored scores against an external lookup, and merging what holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import slugify
from .matching import titles_agree, years_agree_strict
from .sorting import top_per_group

GAMES = "games"


def found_year(kind: Column) -> Column:
    """Games: year of the PC date, else of the release date; others: the year as given."""
    date = F.coalesce(F.col("hit.pc_date"), F.col("hit.date"))
    return F.when(kind == GAMES, F.substring(date, 1, 4)).otherwise(F.col("hit.year")).try_cast("int")


def verdict() -> Column:
    """The order of the tests matters: found, title, year, score; screen lookups need a score
    to count as found."""
    hit = F.col("hit")
    games = F.col("kind") == GAMES
    truth = F.when(games, F.coalesce(hit["pc"], hit["headline"])).otherwise(hit["score"])
    absent = hit.isNull() | F.coalesce(hit["missing"], F.lit(False)) | (~games & truth.isNull())
    year_ok = F.when(games, years_agree_strict(F.col("year"), found_year(F.col("kind")), 2, 1950)).otherwise(
        years_agree_strict(F.col("year"), found_year(F.col("kind")), 3, 1880)
    )
    name = (
        F.when(absent, F.lit("not found"))
        .when(~titles_agree(F.col("title"), hit["title"]), F.lit("title mismatch"))
        .when(~year_ok, F.lit("year mismatch"))
        .when(truth.isNull(), F.lit("unscored"))
        .when(F.coalesce(truth == F.col("metacritic"), F.lit(False)), F.lit("agree"))
        .otherwise(F.lit("corrected"))
    )
    return F.struct(name.alias("name"), truth.alias("truth"))


def reconcile(items: DataFrame, lookup: DataFrame) -> DataFrame:
    """Items with verdict, the score found, and whether it is only a headline score.

    All games are checked, of films and series those with a score. The lookup is unique on
    (kind, slug); AQE splits a slug many items share."""
    due = items.filter((F.col("kind") == GAMES) | (F.col("kind").isin("movies", "shows") & F.col("metacritic").isNotNull()))
    hits = lookup.select("kind", "slug", F.struct([c for c in lookup.columns if c not in ("kind", "slug")]).alias("hit"))
    joined = due.withColumn("slug", slugify(F.col("title"))).join(hits, ["kind", "slug"], "left")
    v = verdict()
    ok = F.col("v.name").isin("agree", "corrected")
    return joined.withColumn("v", v).select(
        "kind", "pos", "title", "year", "slug", "metacritic", "verified",
        F.col("v.name").alias("verdict"),
        F.when(ok, F.col("v.truth")).alias("truth"),
        (ok & (F.col("kind") == GAMES) & F.col("hit.pc").isNull()).alias("headline_only"),
        F.col("hit.title").alias("found_title"),
    )


def reconcile_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("kind", "verdict").agg(
        F.count("*").alias("n"), F.count_if("headline_only").alias("headline_only")
    )


def sample_verdicts(verdicts: DataFrame) -> DataFrame:
    """The first few of each verdict that a person should read; films and series have shorter lists than games."""
    most = max(n for sizes in (fixed.SAMPLES_GAMES, fixed.SAMPLES_SCREEN) for n in sizes.values())
    some = top_per_group(verdicts.filter(F.col("verdict").isin(list(fixed.SAMPLES_GAMES))), ["kind", "verdict"], [F.asc("pos")], most)
    keep = F.lit(False)
    for sizes, mine in ((fixed.SAMPLES_GAMES, F.col("kind") == GAMES), (fixed.SAMPLES_SCREEN, F.col("kind") != GAMES)):
        for name, n in sizes.items():
            keep = keep | (mine & (F.col("verdict") == name) & (F.col("rank") <= n))
    return some.filter(keep)


def pending_lookups(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Slugs still to be looked up, once each."""
    slugs = items.select("kind", slugify(F.col("title")).alias("slug")).distinct()
    return slugs.join(cache.select("kind", "slug"), ["kind", "slug"], "left_anti")


def apply_updates(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A new snapshot: found scores are taken over and marked verified; what could not be
    verified loses its mark. Keyed on the item itself, so namesakes never share an update."""
    v = verdicts.select("kind", "pos", "verdict", "truth")
    ok = F.col("truth").isNotNull()
    checked = F.col("verdict").isNotNull()
    return items.join(v, ["kind", "pos"], "left").select(
        "kind", "pos", "title", "year",
        F.when(ok, F.col("truth")).otherwise(F.col("metacritic")).alias("metacritic"),
        F.when(checked, ok).otherwise(F.col("verified")).alias("verified"),
        (ok & ~F.col("metacritic").eqNullSafe(F.col("truth"))).alias("changed"),
        (checked & (F.col("verified") != ok)).alias("badge_changed"),
    )


def update_counts(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("kind").agg(
        F.count_if("changed").alias("changed"), F.count_if("badge_changed").alias("badges")
    )


def batch_keys(numbered: DataFrame, size: int = fixed.BATCH_SIZE) -> DataFrame:
    """Fixed-size batches per kind from the dense numbers."""
    return numbered.withColumn("batch", F.floor(F.col("idx") / size))


def confirmed_results(batches: DataFrame) -> DataFrame:
    """Batches of results (array of key, metacritic, found) flattened; confirmed ones counted.
    A batch without results counts for nothing."""
    flat = batches.select(F.explode("results").alias("r"))
    sure = F.col("r.found") & F.col("r.metacritic").isNotNull()
    return flat.agg(F.count("*").alias("total"), F.count_if(sure).alias("confirmed"))
