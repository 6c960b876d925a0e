"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

KINDS = ["games", "books", "movies", "shows"]

ITEM = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("genre", T.StringType()),
        T.StructField("blurb", T.StringType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("metacritic", T.IntegerType()),
        T.StructField("ign", T.DoubleType()),
        T.StructField("user_score", T.DoubleType()),
        T.StructField("imdb", T.DoubleType()),
        T.StructField("rt", T.IntegerType()),
        T.StructField("creator", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("ratings_count", T.LongType()),
        T.StructField("runtime", T.IntegerType()),
        T.StructField("seasons", T.IntegerType()),
        T.StructField("isbn", T.StringType()),
        T.StructField("steam_app_id", T.LongType()),
        T.StructField("poster_path", T.StringType()),
        T.StructField("imdb_id", T.StringType()),
        T.StructField("tmdb_id", T.StringType()),
    ]
)

EXPORT_ROW = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("creator", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("pages", T.DoubleType()),
        T.StructField("isbn", T.StringType()),
        T.StructField("my_rating", T.DoubleType()),
        T.StructField("their_rating", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("shelves", T.ArrayType(T.StringType())),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
