"""Ranking users' own lists: quality and length per row, floors and budgets, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.scores import js_round
from .filters import keep_budget, keep_floor, keep_status
from .matching import match_lists, title_index
from .sorting import top_per_group

ENTRY = [
    "title", "year", "genre", "verified", "metacritic", "rating", "runtime", "seasons", "creator", "author",
]


def quality_of() -> Column:
    """Score, what it rests on, and whether it was verified; from `kind`, `entry` and `item`."""
    entry, item = F.col("entry"), F.col("item")
    theirs = item["their_rating"]
    top = F.when(theirs > 5, F.lit(10)).otherwise(F.lit(5))
    no = F.lit(False)
    pick = lambda score, basis, verified: F.struct(
        score.cast("int").alias("score"), F.lit(basis).alias("basis"), verified.alias("verified")
    )
    return (
        F.when(
            (F.col("kind") == "books") & entry["rating"].isNotNull(),
            pick(js_round(entry["rating"] / 5 * 100), "shelf", no),
        )
        .when(entry["metacritic"].isNotNull(), pick(entry["metacritic"], "critics", F.coalesce(entry["verified"], no)))
        .when(theirs.isNotNull(), pick(js_round(theirs / top * 100), "community", no))
        .otherwise(pick(F.lit(None), "none", no))
    )


def minutes_for() -> Column:
    """Books by their pages, films by runtime, series by their whole run; games have none."""
    entry, item = F.col("entry"), F.col("item")
    pages = F.nullif(item["pages"], F.lit(0.0))
    seasons = F.coalesce(F.nullif(entry["seasons"], F.lit(0)), F.lit(1))
    run = js_round(F.nullif(entry["runtime"], F.lit(0)) * fixed.EPISODES_PER_SEASON * seasons)
    return (
        F.when(F.col("kind") == "books", js_round(pages * fixed.MINUTES_PER_PAGE))
        .when(F.col("kind") == "movies", F.nullif(entry["runtime"], F.lit(0)))
        .when(F.col("kind") == "shows", run)
    )


def enrich(rows: DataFrame, entries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """List rows with their catalogue entry, quality and length. `rows` has user_id, row_id,
    kind and the columns of an export row."""
    matched = match_lists(rows, title_index(entries) if index is None else index)
    side = entries.select("kind", F.col("pos").alias("_at"), F.struct(*ENTRY).alias("entry"))
    # Rows without a match get keys of their own: as nulls they would all meet in one task.
    at = F.coalesce("match_pos", -F.col("row_id") - 1)
    item_cols = ["title", "creator", "year", "pages", "isbn", "my_rating", "their_rating", "status", "shelves"]
    joined = matched.withColumn("item", F.struct(*item_cols)).withColumn("_at", at).join(side, ["kind", "_at"], "left")
    q = quality_of()
    return (
        joined.withColumn("_q", q)
        .withColumn("minutes", minutes_for())
        .select(
            "user_id", "row_id", "kind", "status", "matches",
            F.coalesce(F.nullif(F.col("entry.title"), F.lit("")), F.col("item.title")).alias("title"),
            F.coalesce(
                F.nullif(F.col("item.creator"), F.lit("")), F.col("entry.author"), F.col("entry.creator"), F.lit("")
            ).alias("creator"),
            F.coalesce(F.nullif(F.col("item.year"), F.lit(0)), F.nullif(F.col("entry.year"), F.lit(0))).alias("year"),
            F.coalesce("entry.genre", F.lit("")).alias("genre"),
            "minutes",
            F.col("_q.score").alias("score"),
            F.col("_q.basis").alias("basis"),
            F.col("_q.verified").alias("verified"),
            F.col("match_pos").isNotNull().alias("in_catalogue"),
            "match_pos", "entry", "item",
        )
    )


def order() -> list[Column]:
    """Best first, then the shorter, then list order."""
    return [F.desc_nulls_last("score"), F.asc_nulls_last("minutes"), F.asc("row_id")]


def eligible(enriched: DataFrame, status: str = "todo", minutes: float = 0, min_score: float = 0) -> DataFrame:
    return enriched.filter(keep_status(status)).filter(keep_floor(min_score)).filter(keep_budget(minutes))


def rank_backlog(rows: DataFrame, limit: int | None = fixed.LIST_LIMIT) -> DataFrame:
    """Every user's list in order. With a limit (what a reader sees), ranks of the first rows
    per user, found without gathering a user's list; without one, a global sort, whose range
    partitions also split one long list."""
    if limit is None:
        return rows.orderBy("user_id", *order())
    return top_per_group(rows, ["user_id"], order(), limit)


def backlog_stats(rows: DataFrame, status: str = "todo", minutes: float = 0, min_score: float = 0) -> DataFrame:
    """Per user: total, considered, matched, timed, shown."""
    considered = keep_status(status)
    shown = considered & keep_floor(min_score) & keep_budget(minutes)
    return rows.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(considered).alias("considered"),
        F.count_if(considered & F.col("in_catalogue")).alias("matched"),
        F.count_if(considered & F.coalesce(F.col("minutes") > 0, F.lit(False))).alias("timed"),
        F.count_if(shown).alias("shown"),
    )


def budget_options(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """How many rows fit each preset budget of their kind."""
    presets = spark.createDataFrame(
        [(k, m) for k, ms in fixed.BUDGETS.items() for m in ms], "kind string, budget int"
    )
    return (
        rows.join(F.broadcast(presets), "kind")  # nine rows
        .groupBy("user_id", "kind", "budget")
        .agg(F.count_if(F.coalesce(F.col("minutes") <= F.col("budget"), F.lit(False))).alias("fits"))
    )
