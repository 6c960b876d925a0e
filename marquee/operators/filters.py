"""Faceted view: each control is one predicate; Catalyst combines them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import best_score, item_key


def search_haystack() -> Column:
    """Title, creator, genre and blurb, lowered; the double blank of an empty creator stays."""
    return F.lower(
        F.concat_ws(
            " ",
            F.coalesce("title", F.lit("")),
            F.coalesce("creator", F.lit("")),
            F.coalesce("genre", F.lit("")),
            F.coalesce("blurb", F.lit("")),
        )
    )


def text_matches(query: str) -> Column:
    needle = query.strip().lower()
    return F.lit(True) if not needle else F.contains(search_haystack(), F.lit(needle))


def score_at_least(bar: float) -> Column:
    return best_score() >= F.lit(bar)


def year_between(a: int, b: int) -> Column:
    """Bounds in either order; a missing year counts as 0."""
    return F.coalesce("year", F.lit(0)).between(min(a, b), max(a, b))


def genre_in(genres: list[str]) -> Column:
    return F.col("genre").isin(genres) if genres else F.lit(True)


def keep_marked(items: DataFrame, marked: DataFrame) -> DataFrame:
    """Items whose key is in `marked(item_key)`; serves favourites and status alike."""
    return items.withColumn("item_key", item_key()).join(
        marked.select("item_key").distinct(), "item_key", "left_semi"
    )


@dataclass
class View:
    """State of the view's controls."""

    query: str = ""
    min_score: float = 0
    years: tuple[int, int] | None = None
    genres: list[str] = field(default_factory=list)

    def predicates(self) -> dict[str, Column]:
        return {
            "search": text_matches(self.query),
            "min": score_at_least(self.min_score),
            "years": year_between(*self.years) if self.years else F.lit(True),
            "genres": genre_in(self.genres),
        }

    def apply(self, items: DataFrame) -> DataFrame:
        for p in self.predicates().values():
            items = items.filter(p)
        return items


def active_filters(view: View, favourites: bool, year_span: tuple[Column, Column]) -> Column:
    """Descriptions of the controls in force, in display order."""
    n = len(view.genres)
    parts = []
    if n:
        parts.append(F.lit(f"{n} genre{'s' if n > 1 else ''}"))
    if view.min_score > 0:
        parts.append(F.lit(f"{view.min_score:g}+ score"))
    if favourites:
        parts.append(F.lit("favourites"))
    if view.years:
        lo, hi = min(view.years), max(view.years)
        narrowed = (F.lit(lo) > year_span[0]) | (F.lit(hi) < year_span[1])
        parts.append(F.when(narrowed, F.lit(f"{lo}–{hi}")))
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def keep_floor(floor: float) -> Column:
    """Unscored rows survive a floor."""
    return F.col("score").isNull() | (F.col("score") >= F.lit(floor))


def keep_budget(minutes: float) -> Column:
    """With a budget a length must be known; without one everything stays."""
    if not minutes:
        return F.lit(True)
    return F.col("minutes").isNotNull() & (F.col("minutes") <= F.lit(minutes))


def keep_status(want: str) -> Column:
    return F.lit(True) if want == "any" else F.col("status") == want


def eligible_target(min_quality: float, min_ratings: int) -> Column:
    """May be recommended: scored well enough, and findable if its ratings are known."""
    obscure = (F.col("kind") == "books") & (F.coalesce("ratings_count", F.lit(min_ratings)) < min_ratings)
    return F.coalesce(F.col("score") >= min_quality, F.lit(False)) & ~obscure


def inclusion_bar() -> Column:
    """Documented admission rule per kind, over the item's columns and its popularity figures."""
    scored = F.col("metacritic").isNotNull()
    return (
        F.when(F.col("kind") == "games", scored | (F.col("reviews") >= 1000) | F.col("major"))
        .when(F.col("kind") == "movies", scored | (F.col("critics") >= 25) | (F.col("votes") >= 5000))
        .when(
            F.col("kind") == "shows",
            (F.coalesce("seasons", F.lit(0)) >= 1) & (scored | (F.col("votes") >= 5000)),
        )
        .otherwise((F.coalesce("ratings_count", F.lit(0)) >= 1000) | F.col("prize") | F.col("bestseller"))
    )


def required_fields() -> Column:
    named = (F.coalesce("title", F.lit("")) != "") & F.col("year").isNotNull() & F.col("genre").isNotNull()
    return named & F.coalesce(F.col("metacritic"), F.col("imdb"), F.col("rt")).isNotNull()


def scored_only() -> Column:
    return F.col("metacritic").isNotNull()
