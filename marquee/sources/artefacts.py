"""Slim index, statistics, downloads and reports as tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import entry_minutes, js_round
from ..schema import KINDS


def slim_index(items: DataFrame) -> DataFrame:
    """What matching and ranking read: title, year, one score, one length."""
    score = F.when(F.col("kind") == "books", js_round(F.col("rating") / 5 * 100)).otherwise(F.col("metacritic"))
    return items.select(
        "kind", "pos", "title", "year", score.alias("score"), "genre",
        F.col("verified").cast("int").alias("verified"), entry_minutes().alias("minutes"),
    )


def write_slim_index(items: DataFrame, path: str) -> None:
    slim_index(items).write.partitionBy("kind").parquet(path)


def stats_row(stats: DataFrame) -> DataFrame:
    """The per-kind statistics as one flat row."""
    cols = []
    for k in KINDS:
        hit = F.col("kind") == k
        cols += [
            F.max(F.when(hit, F.col("n"))).alias(k),
            F.max(F.when(hit, F.col("year_from"))).alias(f"{k}_from"),
            F.max(F.when(hit, F.col("year_to"))).alias(f"{k}_to"),
            F.max(F.when(hit, F.col("genres"))).alias(f"{k}_genres"),
        ]
    cols.append(F.max(F.when(F.col("kind") == "games", F.col("verified"))).alias("games_verified"))
    cols.append(F.max(F.when(F.col("kind") == "books", F.col("authors"))).alias("books_authors"))
    return stats.agg(*cols)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CRLF lines, doubled quotes, UTF-8; one file per partition. The byte order mark that
    spreadsheets look for leads the first column's name, and with it every file."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "\ufeff" + first) if mark else df
    out.write.csv(path, header=True, quote='"', escape='"', lineSep="\r\n", encoding="UTF-8", emptyValue="")


def copy_titles(view: DataFrame, block: int = 4096) -> DataFrame:
    """Titles joined by newlines in catalogue order, in blocks of positions, so that no
    aggregate grows beyond a block."""
    return view.groupBy("kind", F.floor(F.col("pos") / block).alias("block")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]), "\n"
        ).alias("titles")
    )
