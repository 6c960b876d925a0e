"""Readers and writers: what is written is read back and must be what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import csv_safe
from ..operators import reconcile as rec, reports
from ..operators.adaptations import adaptations
from ..operators.summaries import catalogue_stats
from ..operators.views import export_rows, personal_columns
from ..schema import ITEM, KINDS
from ..session import fresh_path
from ..sources import artefacts, exports, neighbour_files, pages
from ..sources.catalogue import build_items, catalogue, entries
from ..sources.lists import list_rows, lookup_cache
from .common import marked_keys
from .list_queries import LISTS, VERDICTS
from .oracle import CAT, ITEM_KEY, MARKS, NUM
from .recommend_oracle import ASSIGNED, AXES
from .recommend_queries import assigned, features
from .registry import query
from .view_queries import SLIM

_ITEM_COLS = "kind, pos, title, year, genre, md5(blurb) AS blurb_md5, verified, metacritic, ign, user_score, imdb, rt, creator, author, rating, ratings_count, runtime, seasons, isbn, steam_app_id, poster_path, imdb_id, tmdb_id"


def _items(df: DataFrame) -> DataFrame:
    return df.withColumn("blurb_md5", F.md5("blurb")).drop("blurb")


@query("catalogue_items", f"WITH {CAT} SELECT {_ITEM_COLS} FROM cat")
def _(spark, d):
    return _items(catalogue(spark, d))


@query("build_items", f"WITH {NUM} SELECT kind, pos, kind_rank, idx, gid FROM num")
def _(spark, d):
    from ..sources.catalogue import number_items

    items = entries(spark, d).select("kind", "pos", "title")
    sets = {k: items.filter(F.col("kind") == k).drop("kind") for k in KINDS}
    return number_items(build_items(sets)).select("kind", "pos", "kind_rank", "idx", "gid")


@query("load_json", f"WITH {CAT} SELECT {_ITEM_COLS} FROM cat WHERE kind IN ('games', 'movies', 'shows')")
def _(spark, d):
    blocks = pages.item_blocks(catalogue(spark, d))
    part = lambda k: blocks.filter(F.col("kind") == k)
    games = pages.load_json(spark, pages.write_json_files(part("games")))
    movies = pages.load_json(spark, pages.write_json_files(part("movies"), "movies"), "movies")
    shows = pages.load_json(spark, pages.write_json_files(part("shows"), "shows"), "shows")
    return _items(build_items({k: df.drop("kind") for k, df in (("games", games), ("movies", movies), ("shows", shows))}))


@query("extract_embedded_array", f"WITH {CAT} SELECT {_ITEM_COLS} FROM cat WHERE kind IN ('games', 'books')")
def _(spark, d):
    html = pages.embed_in_pages(pages.item_blocks(catalogue(spark, d).filter("kind IN ('games', 'books')")))
    found = {k: pages.extract_embedded_array(html, k.upper()).drop("kind", "block") for k in ("games", "books")}
    return _items(build_items(found)).select(*[c for c in ITEM.names if c != "blurb"], "blurb_md5")


# ---- exports: written as CSV, read back, recognised, normalised ----


def _goodreads(spark, d) -> DataFrame:
    rows = list_rows(spark, d).filter("kind = 'books'")
    e = F.col("row_id")
    blank = F.lit("")
    given = {
        "Book Id": e.cast("string"),
        "Title": F.when(e % 7 == 0, F.concat("title", F.lit(', "annotated"'))).otherwise(F.col("title")),
        "Author": F.col("creator"),
        "ISBN": F.when(e % 4 == 0, F.lit('=""')).otherwise(F.concat(F.lit('="0'), e.cast("string"), F.lit('"'))),
        "ISBN13": F.when(e % 2 == 0, F.lit('=""')).otherwise(F.concat(F.lit('="978'), e.cast("string"), F.lit('"'))),
        "My Rating": F.coalesce(F.col("my_rating").cast("int").cast("string"), F.lit("0")),
        "Average Rating": F.coalesce(F.col("their_rating").cast("string"), blank),
        "Number of Pages": F.coalesce(F.col("pages").cast("int").cast("string"), blank),
        "Year Published": (2000 + e % 20).cast("string"),
        "Original Publication Year": F.coalesce(F.col("year").cast("string"), F.lit("0")),
        "Bookshelves": F.concat(F.lit("list, ,"), F.col("shelves")[0], F.lit(" ")),
        "Exclusive Shelf": F.when(F.col("status") == "done", "read").when(F.col("status") == "doing", "currently-reading").otherwise("to-read"),
        "My Review": F.concat(F.lit('Loved it, "oddly".\nTwice: '), e.cast("string")),
    }
    return rows.select(*[given.get(c, blank).alias(c) for c in exports.BOOK_COLUMNS])


def _letterboxd(spark, d) -> DataFrame:
    rows = list_rows(spark, d).filter("kind = 'movies'")
    e = F.col("row_id")
    given = {
        "Date": F.lit("2024-01-05"), "Name": F.col("title"), "Year": F.coalesce(F.col("year").cast("string"), F.lit("")),
        "Letterboxd URI": F.concat(F.lit("https://boxd.example/"), e.cast("string")),
        "Rating": F.when(F.col("status") == "done", F.coalesce(F.col("my_rating").cast("string"), F.lit(""))).otherwise(""),
        "Watched Date": F.when(e % 9 == 0, "2024-02-01").otherwise(""),
    }
    return rows.select(*[given[c].alias(c) for c in exports.FILM_COLUMNS])


def _imdb(spark, d) -> DataFrame:
    rows = list_rows(spark, d).filter("kind = 'shows'")
    e = F.col("row_id")
    given = {
        "Const": F.concat(F.lit("tt"), e.cast("string")), "Title Type": F.lit("tvSeries"),
        "Title": F.when(e % 6 == 0, "").otherwise(F.col("title")), "Original Title": F.concat("title", F.lit(" (orig)")),
        "Directors": F.col("creator"), "Year": F.coalesce(F.col("year").cast("string"), F.lit("")),
        "Your Rating": F.when(F.col("status") == "done", F.coalesce(F.col("my_rating").cast("string"), F.lit(""))).otherwise(""),
        "IMDb Rating": F.coalesce(F.col("their_rating").cast("string"), F.lit("")),
    }
    return rows.select(*[given[c].alias(c) for c in exports.RATING_COLUMNS])


def _round_trip(spark, df: DataFrame) -> DataFrame:
    path = fresh_path(spark, "csv")
    artefacts.write_csv(df, path)
    return exports.read_export_csv(spark, path, df.columns)


_T = lambda t: f"trim({t}, ' ')"


@query(
    "read_export_csv",
    f"""WITH {LISTS} SELECT CAST(row_id AS VARCHAR) AS book_id, {_T("CASE WHEN row_id % 7 = 0 THEN title || ', \"annotated\"' ELSE title END")} AS title,
    CASE WHEN row_id % 4 = 0 THEN '=""' ELSE '="0' || row_id || '"' END AS isbn, 'Loved it, "oddly".' || chr(10) || 'Twice: ' || row_id AS review,
    '' AS publisher FROM lists WHERE kind = 'books'""",
)
def _(spark, d):
    back = _round_trip(spark, _goodreads(spark, d))
    return back.select(
        F.col("Book Id").alias("book_id"), F.col("Title").alias("title"), F.col("ISBN").alias("isbn"),
        F.col("My Review").alias("review"), F.col("Publisher").alias("publisher"),
    )


@query(
    "normalise_goodreads",
    f"""WITH {LISTS} SELECT {_T("CASE WHEN row_id % 7 = 0 THEN title || ', \"annotated\"' ELSE title END")} AS title, {_T('creator')} AS creator,
    CAST(coalesce(nullif(year, 0), 2000 + row_id % 20) AS INTEGER) AS year, pages,
    CASE WHEN row_id % 2 <> 0 THEN '978' || row_id WHEN row_id % 4 <> 0 THEN '0' || row_id ELSE '' END AS isbn,
    nullif(my_rating, 0) AS my_rating, their_rating, status, ['list', CASE status WHEN 'done' THEN 'purchase' WHEN 'doing' THEN 'view' ELSE ev.event_type END] AS shelves
    FROM lists JOIN events ev ON ev.event_id = row_id WHERE kind = 'books' AND title <> ''""",
)
def _(spark, d):
    return exports.normalise_goodreads(_round_trip(spark, _goodreads(spark, d)))


@query(
    "normalise_letterboxd",
    f"""WITH {LISTS} SELECT {_T('title')} AS title, '' AS creator, year, CAST(NULL AS DOUBLE) AS pages, '' AS isbn,
    CASE WHEN status = 'done' THEN my_rating END AS my_rating, CAST(NULL AS DOUBLE) AS their_rating,
    CASE WHEN (status = 'done' AND my_rating IS NOT NULL) OR row_id % 9 = 0 THEN 'done' ELSE 'todo' END AS status, [] AS shelves
    FROM lists WHERE kind = 'movies' AND title <> ''""",
)
def _(spark, d):
    return exports.normalise_letterboxd(_round_trip(spark, _letterboxd(spark, d)))


@query(
    "normalise_imdb",
    f"""WITH {LISTS} SELECT {_T("CASE WHEN row_id % 6 = 0 THEN title || ' (orig)' ELSE title END")} AS title, {_T('creator')} AS creator, year,
    CAST(NULL AS DOUBLE) AS pages, '' AS isbn, CASE WHEN status = 'done' THEN my_rating END AS my_rating, their_rating,
    CASE WHEN status = 'done' AND my_rating IS NOT NULL THEN 'done' ELSE 'todo' END AS status, [] AS shelves FROM lists WHERE kind = 'shows' AND title <> ''""",
)
def _(spark, d):
    return exports.normalise_imdb(_round_trip(spark, _imdb(spark, d)))


_GOODREADS_ROWS = f"""SELECT 'goodreads' AS source, 'books' AS kind, {_T("CASE WHEN row_id % 7 = 0 THEN title || ', \"annotated\"' ELSE title END")} AS title,
    {_T('creator')} AS creator, CAST(coalesce(nullif(year, 0), 2000 + row_id % 20) AS INTEGER) AS year, pages,
    CASE WHEN row_id % 2 <> 0 THEN '978' || row_id WHEN row_id % 4 <> 0 THEN '0' || row_id ELSE '' END AS isbn,
    nullif(my_rating, 0) AS my_rating, their_rating, status, ['list', CASE status WHEN 'done' THEN 'purchase' WHEN 'doing' THEN 'view' ELSE ev.event_type END] AS shelves
    FROM lists JOIN events ev ON ev.event_id = row_id WHERE kind = 'books' AND title <> ''"""
_FILM_ROWS = f"""SELECT 'letterboxd', 'movies', {_T('title')}, '', year, CAST(NULL AS DOUBLE), '', CASE WHEN row_id % 2 = 0 AND status = 'done' THEN my_rating END,
    CAST(NULL AS DOUBLE), CASE WHEN row_id % 2 = 0 AND ((status = 'done' AND my_rating IS NOT NULL) OR row_id % 9 = 0) THEN 'done' ELSE 'todo' END, []
    FROM lists WHERE kind = 'movies' AND title <> ''"""
_RATING_ROWS = f"""SELECT 'imdb', 'movies', {_T("CASE WHEN row_id % 6 = 0 THEN title || ' (orig)' ELSE title END")}, {_T('creator')}, year, CAST(NULL AS DOUBLE), '',
    CASE WHEN status = 'done' THEN my_rating END, their_rating, CASE WHEN status = 'done' AND my_rating IS NOT NULL THEN 'done' ELSE 'todo' END, []
    FROM lists WHERE kind = 'shows' AND title <> ''"""


@query("read_export", f"WITH {LISTS} {_GOODREADS_ROWS} UNION ALL {_FILM_ROWS} UNION ALL {_RATING_ROWS}")
def _(spark, d):
    """One folder: a book list with its columns the other way round and one more, a film diary, a
    watchlist without ratings, a ratings list, and a file of no known service."""
    base = fresh_path(spark, "mixed")
    books = _goodreads(spark, d)
    artefacts.write_csv(books.select(F.lit("yes").alias("Surplus"), *reversed(books.columns)), f"{base}/books")
    films = _letterboxd(spark, d).withColumn("even", F.regexp_extract("Letterboxd URI", "([0-9]+)$", 1).cast("long") % 2 == 0)
    diary = films.filter("even").withColumns({"Rewatch": F.lit("Yes"), "Tags": F.lit("a, b")})
    artefacts.write_csv(diary.select("Date", "Name", "Year", "Letterboxd URI", "Rating", "Rewatch", "Tags", "Watched Date"), f"{base}/diary")
    artefacts.write_csv(films.filter("not even").select("Date", "Name", "Year", "Letterboxd URI"), f"{base}/watchlist")
    artefacts.write_csv(_imdb(spark, d), f"{base}/ratings")
    artefacts.write_csv(list_rows(spark, d).select("row_id", "title"), f"{base}/other")
    return exports.read_export(spark, f"{base}/*").drop("file")


@query(
    "detect_source",
    """SELECT 'books' AS folder, 'goodreads' AS source UNION ALL SELECT 'films', 'letterboxd' UNION ALL SELECT 'ratings', 'imdb'
    UNION ALL SELECT 'other', NULL""",
)
def _(spark, d):
    base = fresh_path(spark, "uploads")
    for name, df in (("books", _goodreads(spark, d)), ("films", _letterboxd(spark, d)), ("ratings", _imdb(spark, d))):
        artefacts.write_csv(df, f"{base}/{name}")
    artefacts.write_csv(list_rows(spark, d).select("row_id", "title"), f"{base}/other")
    found = exports.file_headers(spark, f"{base}/*")
    return found.select(F.regexp_extract("file", "([a-z]+)/[^/]*$", 1).alias("folder"), "source").distinct()


_LINE = """CASE WHEN row_id % 5 = 0 THEN title || ' (' || year || ')' WHEN row_id % 5 = 1 THEN title || '  ' || year
  WHEN row_id % 5 = 2 THEN '  ' || title || ' - ' WHEN row_id % 5 = 3 THEN '   ' ELSE title END"""


@query(
    "read_pasted",
    rf"""WITH {LISTS}, l AS (SELECT row_id, trim({_LINE}, ' ') AS s FROM lists),
    m AS (SELECT row_id, s, regexp_matches(s, '^(.*?)[\s(]*((?:19|20)\d{{2}})\)?$') AS dated FROM l WHERE s IS NOT NULL),
    r AS (SELECT row_id, trim(regexp_replace(CASE WHEN dated THEN regexp_extract(s, '^(.*?)[\s(]*((?:19|20)\d{{2}})\)?$', 1) ELSE s END, '[\s\-–—:,]+$', ''), ' ') AS title,
      CASE WHEN dated THEN CAST(regexp_extract(s, '^(.*?)[\s(]*((?:19|20)\d{{2}})\)?$', 2) AS INTEGER) END AS year FROM m)
    SELECT row_id, title, year, 'todo' AS status FROM r WHERE title <> ''""",
)
def _(spark, d):
    e, y = F.col("row_id"), F.col("year").cast("string")
    line = (
        F.when(e % 5 == 0, F.concat("title", F.lit(" ("), y, F.lit(")")))
        .when(e % 5 == 1, F.concat("title", F.lit("  "), y))
        .when(e % 5 == 2, F.concat(F.lit("  "), "title", F.lit(" - ")))
        .when(e % 5 == 3, F.lit("   "))
        .otherwise(F.col("title"))
    )
    lines = list_rows(spark, d).select("row_id", line.alias("value"))
    return exports.read_pasted(lines, keep=["row_id"]).select("row_id", "title", "year", "status")


# ---- artefacts ----


@query("write_slim_index", f"WITH {SLIM} SELECT * FROM slim")
def _(spark, d):
    path = fresh_path(spark, "slim")
    items = entries(spark, d)
    artefacts.write_slim_index(items, path)
    schema = artefacts.slim_index(items).schema
    return spark.read.schema(schema).parquet(path)


_AXES = "[" + ", ".join(f"'{a}'" for a in AXES) + "]"


@query(
    "neighbour_artifact_meta",
    f"WITH {NUM} SELECT kind, min(gid) AS \"offset\", count(*) AS n, 9 AS stride, 3 AS digits, {_AXES} AS axes FROM num GROUP BY kind",
)
def _(spark, d):
    f = features(spark, d)
    path = fresh_path(spark, "artifact")
    packed = reports.pack_neighbours(f.ids, assigned(spark, d), reports.slot_digits(f.ids))
    neighbour_files.write_artifact(path, f.ids, packed, adaptations(f.vectors))
    return spark.read.parquet(f"{path}/meta").drop("built", "phrases")


@query("neighbour_artifact_slots", f"WITH {ASSIGNED} SELECT gid, slot, neighbour, axis FROM aslots")
def _(spark, d):
    f = features(spark, d)
    path = fresh_path(spark, "artifact")
    packed = reports.pack_neighbours(f.ids, assigned(spark, d), reports.slot_digits(f.ids))
    neighbour_files.write_artifact(path, f.ids, packed, adaptations(f.vectors))
    digits = spark.read.parquet(f"{path}/meta").first()["digits"]
    return reports.unpack_neighbours(spark.read.schema(packed.schema).parquet(f"{path}/neighbours"), digits)


_SAFE = "CASE WHEN regexp_matches({t}, '^[=+\\-@\\t\\r]') THEN '''' || {t} ELSE coalesce({t}, '') END"
_PERS = f"""{CAT}, {MARKS}, fk AS (SELECT DISTINCT {ITEM_KEY} AS item_key FROM cat WHERE pos IN (SELECT pos FROM fav)),
dk AS (SELECT DISTINCT {ITEM_KEY} AS item_key FROM cat WHERE pos IN (SELECT pos FROM done)),
pers AS (SELECT *, CASE WHEN {ITEM_KEY} IN (SELECT item_key FROM dk) THEN 'yes' ELSE 'no' END AS done,
  CASE WHEN {ITEM_KEY} IN (SELECT item_key FROM fk) THEN 'yes' ELSE 'no' END AS favourite FROM cat)"""


def _personal(spark, d) -> DataFrame:
    return personal_columns(catalogue(spark, d), marked_keys(spark, d, "purchase"), marked_keys(spark, d, "click"))


def _s(c: str) -> str:
    return _SAFE.format(t=c)


@query(
    "export_games",
    f"""WITH {_PERS} SELECT {_s('title')} AS "Title", year AS "Year", {_s('genre')} AS "Genre", metacritic AS "Metacritic", ign AS "IGN",
    user_score AS "User score", CASE WHEN verified THEN 'yes' ELSE 'no' END AS "Verified", steam_app_id AS "Steam app id",
    done AS "Played", favourite AS "Favourite", {_s('blurb')} AS "Blurb" FROM pers WHERE kind = 'games'""",
)
def _(spark, d):
    return export_rows(_personal(spark, d), "games")


@query(
    "export_books",
    f"""WITH {_PERS} SELECT {_s('title')} AS "Title", {_s('author')} AS "Author", year AS "Year", {_s('genre')} AS "Genre", rating AS "Rating",
    ratings_count AS "Ratings count", {_s('isbn')} AS "ISBN", done AS "Read", favourite AS "Favourite", {_s('blurb')} AS "Blurb" FROM pers WHERE kind = 'books'""",
)
def _(spark, d):
    return export_rows(_personal(spark, d), "books")


@query(
    "export_screen",
    f"""WITH {_PERS} SELECT {_s('title')} AS "Title", year AS "Year", {_s('genre')} AS "Genre", metacritic AS "Metacritic", imdb AS "IMDb", rt AS "RT",
    CASE WHEN verified THEN 'yes' ELSE 'no' END AS "Verified", done AS "Watched", favourite AS "Favourite", {_s('blurb')} AS "Blurb" FROM pers WHERE kind IN ('movies', 'shows')""",
)
def _(spark, d):
    items = _personal(spark, d)
    return export_rows(items, "movies").unionByName(export_rows(items, "shows"))


@query(
    "export_csv_round_trip",
    f"""WITH {_PERS} SELECT {_s('title')} AS title, coalesce(CAST(year AS VARCHAR), '') AS year, coalesce(CAST(rating AS VARCHAR), '') AS rating,
    done, md5(trim(regexp_replace({_s('blurb')}, '[ \\t\\n\\r]+', ' ', 'g'))) AS blurb FROM pers WHERE kind = 'books'""",
)
def _(spark, d):
    back = _round_trip(spark, export_rows(_personal(spark, d), "books"))
    flat = F.trim(F.regexp_replace("Blurb", "[ \\t\\n\\r]+", " "))
    return back.select(
        F.col("Title").alias("title"), F.col("Year").alias("year"), F.col("Rating").alias("rating"),
        F.col("Read").alias("done"), F.md5(flat).alias("blurb"),
    )


_RISKY = "([ '=', '+', '-', '@', chr(9), ''])[CAST(pos % 6 AS INTEGER) + 1] || title"


@query("csv_safe", f"WITH {CAT}, r AS (SELECT pos, {_RISKY} AS t FROM cat) SELECT pos, {_s('t')} AS cell FROM r")
def _(spark, d):
    marks = F.array(*[F.lit(m) for m in ("=", "+", "-", "@", "\t", "")])
    cell = F.concat(F.element_at(marks, (F.col("pos") % 6 + 1).cast("int")), "title")
    return entries(spark, d).select("pos", csv_safe(cell).alias("cell"))


@query(
    "copy_titles",
    f"WITH {CAT} SELECT kind, pos // 4096 AS block, string_agg(title, chr(10) ORDER BY pos) AS titles FROM cat GROUP BY 1, 2",
)
def _(spark, d):
    return artefacts.copy_titles(entries(spark, d))


_STAT = ", ".join(
    f"count(*) FILTER (kind = '{k}') AS {k}, min(year) FILTER (kind = '{k}') AS {k}_from, max(year) FILTER (kind = '{k}') AS {k}_to, "
    f"count(DISTINCT genre) FILTER (kind = '{k}') AS {k}_genres"
    for k in KINDS
)


@query(
    "write_stats",
    f"""WITH {CAT} SELECT {_STAT}, count(*) FILTER (kind = 'games' AND verified) AS games_verified,
    count(DISTINCT author) FILTER (kind = 'books') AS books_authors FROM cat""",
)
def _(spark, d):
    row = artefacts.stats_row(catalogue_stats(entries(spark, d)))
    path = fresh_path(spark, "stats")
    artefacts.write_json(row.coalesce(1), path)
    return spark.read.schema(row.schema).json(path)


@query("reconcile_report", f"WITH {VERDICTS} SELECT kind, pos, verdict, truth, headline_only FROM verdicts")
def _(spark, d):
    path = fresh_path(spark, "report")
    verdicts = rec.reconcile(entries(spark, d), lookup_cache(spark, d)).select("kind", "pos", "truth", "headline_only", "verdict")
    verdicts.write.partitionBy("verdict").parquet(path)
    return spark.read.schema(verdicts.schema).parquet(path)
