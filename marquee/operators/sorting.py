"""Orders of the view, pages, picks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.scores import best_score


def sort_keys(mode: str) -> list[Column]:
    """Every order ends in `pos`, because ties keep catalogue order."""
    keys = {
        "best-desc": [best_score().desc()],
        "mc-desc": [F.desc_nulls_last("metacritic")],
        "imdb-desc": [F.desc_nulls_last("imdb")],
        "rt-desc": [F.desc_nulls_last("rt")],
        "year-desc": [F.coalesce("year", F.lit(0)).desc(), best_score().desc()],
        "year-asc": [F.coalesce("year", F.lit(0)).asc(), best_score().desc()],
        "title-asc": [F.collate("title", "UNICODE").asc()],
    }
    return [*keys[mode], F.asc("pos")]


def sort_view(items: DataFrame, mode: str) -> DataFrame:
    return items.orderBy(*sort_keys(mode))


def page(items: DataFrame, mode: str, number: int, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """Page `number` from 0; runs as a bounded top-n, not as a full sort."""
    return sort_view(items, mode).offset(number * size).limit(size)


def page_after(items: DataFrame, score: int, pos: int, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """Next page of the best-first order after a known last row, at constant cost."""
    best = best_score()
    later = (best < score) | ((best == score) & (F.col("pos") > pos))
    return sort_view(items.filter(later), "best-desc").limit(size)


def ranked_page(items: DataFrame, mode: str, number: int, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """A page with 1-based ranks; the window sees one page only."""
    w = Window.orderBy(*sort_keys(mode))
    return page(items, mode, number, size).withColumn("rank", number * size + F.row_number().over(w))


def surprise(items: DataFrame, seed: str) -> DataFrame:
    """One item, uniformly by a seeded hash, among those at 80 or more if there are any."""
    weak = F.when(best_score() >= 80, F.lit(0)).otherwise(F.lit(1))
    draw = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("kind"), F.lit(":"), F.col("pos").cast("string")))
    return items.orderBy(weak, draw).limit(1)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best k rows of each group. Spark keeps k rows per group before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
