"""The catalogue, derived from documents and labels, and its dense numbering."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import period_signal
from ..operators.numbering import dense_position
from ..schema import ITEM, KINDS
from ..session import materialise

# Labels each kind uses; one of the film labels has no prior on purpose.
GENRES = {
    "games": [
        "Strategy / 4X / RTS", "Narrative / Adventure", "Simulation / Management", "Shooter (FPS/TPS)",
        "Action RPG", "Indie / Platformer", "Roguelike / Metroidvania", "Horror / Survival", "Racing / Sports",
        "Multiplayer / MOBA / Co-op", "JRPG / Turn-based RPG", "Fighting", "Open-World Action-Adventure",
        "Stealth / Immersive Sim",
    ],
    "books": [
        "Literary Fiction", "Philosophy & Psychology", "Poetry & Essays", "History & Politics",
        "Memoir & Biography", "Travel & Food", "Science & Nature", "Art, Music & Film", "Historical Fiction",
        "Science Fiction", "Manga & Comics", "Classics", "Crime & Detective", "Fantasy", "Business & Self-Help",
        "Children & Middle Grade", "Horror", "Mystery & Thriller", "Health & Wellbeing", "Graphic Novels",
        "Romance", "Young Adult",
    ],
    "movies": [
        "Action & Adventure", "Sci-Fi & Fantasy", "Drama", "Documentary", "Horror", "Comedy", "Crime",
        "Animation", "War & History", "Musical & Music", "Thriller & Mystery", "Romance", "Western",
    ],
    "shows": [
        "Drama", "Comedy", "Crime & Mystery", "Sci-Fi & Fantasy", "Documentary", "Animation", "Anime",
        "Reality & Competition", "Kids & Family", "Limited Series", "Action & Adventure", "Horror",
    ],
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _genre(kind: Column, q: Column) -> Column:
    out = None
    for k in KINDS:
        labels = F.array(*[F.lit(g) for g in GENRES[k]])
        value = F.element_at(labels, (q % len(GENRES[k]) + 1).cast("int"))
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, all columns but `verified`: a projection of one scan, for text
    search and word counts. `pos` is the order key within a kind (the document id)."""
    docs = read_table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    q = F.floor(d / 4)
    kind = F.element_at(
        F.array(*[F.lit(k) for k in KINDS]), (F.substring("source", 4, 9).cast("int") % 4 + 1)
    )
    is_k = {k: F.col("kind") == k for k in KINDS}
    screen = is_k["movies"] | is_k["shows"]
    head = F.regexp_extract("text", r"^[ \t\r\n]*((?:[^ \t\r\n]+[ \t\r\n]+){0,3}[^ \t\r\n]+)", 1)
    person = F.concat(F.col("lang"), F.lit(" "), (q % 50).cast("string"))
    return docs.withColumn("kind", kind).select(
        "kind",
        d.alias("pos"),
        F.regexp_replace(head, r"[ \t\r\n]+", " ").alias("title"),
        F.when(is_k["books"] & (q % 61 == 0), -(d % 700) - 1)
        .when(q % 53 != 0, 1920 + d % 105)
        .cast("int")
        .alias("year"),
        _genre(F.col("kind"), q).alias("genre"),
        F.col("text").alias("blurb"),
        F.when(~is_k["books"] & (q % 7 != 0), 40 + (d * 7) % 60).cast("int").alias("metacritic"),
        F.when(is_k["games"] & (q % 6 != 0), (40 + (d * 3) % 57) / 10.0).cast("double").alias("ign"),
        F.when(is_k["games"] & (q % 5 != 0), (30 + (d * 13) % 67) / 10.0).cast("double").alias("user_score"),
        F.when(screen & (q % 5 != 0), (30 + (d * 3) % 65) / 10.0).cast("double").alias("imdb"),
        F.when(screen & (q % 3 != 0), 20 + (d * 11) % 80).cast("int").alias("rt"),
        F.when(screen & (q % 8 != 0), person).alias("creator"),
        F.when(is_k["books"], person).alias("author"),
        F.when(is_k["books"] & (q % 9 != 0), (25 + q % 25) / 10.0).cast("double").alias("rating"),
        F.when(is_k["books"], F.col("n_chars")).alias("ratings_count"),
        F.when(is_k["movies"] & (q % 10 != 0), 60 + q % 120)
        .when(is_k["shows"] & (q % 11 != 0), 20 + q % 45)
        .cast("int")
        .alias("runtime"),
        F.when(is_k["shows"], q % 8).cast("int").alias("seasons"),
        F.when(is_k["books"], F.concat(F.lit("978"), F.lpad(d.cast("string"), 10, "0"))).alias("isbn"),
        F.when(is_k["games"], d + 1000).alias("steam_app_id"),
        F.when(screen & (q % 3 != 0), F.concat(F.lit("/p"), d.cast("string"), F.lit(".jpg"))).alias("poster_path"),
        F.when(screen & (q % 4 != 0), F.concat(F.lit("tt"), F.lpad(d.cast("string"), 7, "0"))).alias("imdb_id"),
        F.when(screen, d.cast("string")).alias("tmdb_id"),
    )


def _with_verified(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """Adds the mark of items whose label says so; books are never marked."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), "quality")
    mark = (F.col("kind") != "books") & (F.coalesce(F.col("quality"), F.lit(0)) == 1)
    rest = [c for c in items.columns if c not in ITEM.names]
    joined = items.join(labels, "pos", "left").withColumn("verified", mark)
    return joined.select(*[c for c in ITEM.names if c in joined.columns], *rest)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalogue, texts and marks included."""
    return _with_verified(spark, sf_dir, texts(spark, sf_dir))


@lru_cache(maxsize=8)
def _entries(app: str, sf_dir: str) -> DataFrame:
    spark = SparkSession.active()
    narrow = texts(spark, sf_dir).withColumn("period", period_signal(F.col("blurb"))).drop("blurb")
    return materialise(_with_verified(spark, sf_dir, narrow), "entries")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue without its texts but with their period signal, written once per
    application: everything but text search and word counts reads this narrow table."""
    return _entries(spark.sparkContext.applicationId, sf_dir)


def kind_spans(items: DataFrame) -> DataFrame:
    """One row per kind with its count and offset, and all counts beside: four counters in
    one pass."""
    one = items.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    rows, before = [], F.lit(0).cast("long")
    for i, k in enumerate(KINDS):
        rows.append(
            F.struct(F.lit(k).alias("kind"), F.lit(i).alias("kind_rank"), before.alias("offset"), F.col(k).alias("n"))
        )
        before = before + F.col(k)
    return one.select(F.inline(F.array(*rows)), F.array(*[F.col(k) for k in KINDS]).alias("all_n"))


def number_items(items: DataFrame) -> DataFrame:
    """Adds kind_rank, dense `idx` within the kind, `gid` = offset + idx, and `turn`, the
    place of the item when the kinds take turns.

    Before item idx of a kind, every kind has given at most idx items, and one more if it
    goes first in a round; so `turn` follows from the four counts, without a sort."""
    numbered = dense_position(items, ["kind"], "pos", "idx")
    spans = F.broadcast(kind_spans(items.select("kind")))  # four rows
    given = F.lit(0).cast("long")
    for i, _ in enumerate(KINDS):
        goes_first = F.when(F.lit(i) < F.col("kind_rank"), F.lit(1)).otherwise(F.lit(0))
        given = given + F.least(F.get("all_n", F.lit(i)), F.col("idx") + goes_first)
    return (
        numbered.join(spans, "kind")
        .withColumn("gid", F.col("offset") + F.col("idx"))
        .withColumn("turn", given)
        .drop("offset", "n", "all_n")
    )


def build_items(sets: dict[str, DataFrame]) -> DataFrame:
    """Union of per-kind frames; columns a kind lacks become null."""
    out = None
    for k in KINDS:
        if k in sets:
            part = sets[k].withColumn("kind", F.lit(k))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
