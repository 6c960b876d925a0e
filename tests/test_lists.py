"""Exports, pasted lists, matching and ranking."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import backlog, matching
from marquee.schema import ITEM
from marquee.session import fresh_path
from marquee.sources import exports

BOOKS = (
    "﻿Book Id,Title,Author,Author l-f,Additional Authors,ISBN,ISBN13,My Rating,Average Rating,Publisher,Binding,"
    "Number of Pages,Year Published,Original Publication Year,Date Read,Date Added,Bookshelves,Bookshelves with positions,"
    "Exclusive Shelf,My Review,Spoiler,Private Notes,Read Count,Owned Copies\r\n"
    '1,Sandworld,A. Writer,"Writer, A.",,="0441013597",="9780441013593",0,4.27,Ace,Paperback,544,2005,1965,,2024/01/03,'
    '"sci-fi, to-read",x,to-read,,,,0,0\r\n'
    '2,"The Long Title, Annotated",B. Writer,"Writer, B.",,="1",="",5,3.93,S,P,180,2004,1925,,,classics,x,read,'
    '"Liked it, ""oddly"".\nTwice.",,,1,1\r\n'
    "\r\n"
    '3,Small Book,C. Writer,x,,="",="",0,3.99,G,P,163,2018,0,,,to-read,x,currently-reading\r\n'
)


def write_text(spark, name, text):
    path = fresh_path(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return path


def test_book_export(spark):
    raw = exports.read_export_csv(spark, write_text(spark, "books", BOOKS), exports.BOOK_COLUMNS)
    rows = {r["title"]: r for r in exports.normalise_goodreads(raw).collect()}
    assert set(rows) == {"Sandworld", "The Long Title, Annotated", "Small Book"}
    sand, long_, small = rows["Sandworld"], rows["The Long Title, Annotated"], rows["Small Book"]
    assert (sand["isbn"], sand["year"], sand["pages"], sand["my_rating"]) == ("9780441013593", 1965, 544.0, None)
    assert (sand["shelves"], sand["status"]) == (["sci-fi", "to-read"], "todo")
    assert (long_["isbn"], long_["status"], long_["my_rating"]) == ("1", "done", 5.0)
    assert (small["isbn"], small["year"], small["status"]) == ("", 2018, "doing")
    reviews = [r["My Review"] for r in raw.collect()]
    assert 'Liked it, "oddly".\nTwice.' in reviews


@pytest.mark.parametrize(
    "header,source",
    [
        (["Title", "Exclusive Shelf"], "goodreads"), (["Book Id", "Title"], "goodreads"), (["Name", "Letterboxd URI"], "letterboxd"),
        (["Const", "Title Type"], "imdb"), (["a", "b"], None),
    ],
)
def test_detect_source(spark, header, source):
    df = spark.createDataFrame([(header,)], "h array<string>")
    assert df.select(exports.detect_source(F.col("h"))).first()[0] == source


def test_header_with_mark_and_quotes(spark):
    path = write_text(spark, "hdr", '﻿"Date",Name,Year,Letterboxd URI\r\n2024-01-05,X,2022,u')
    assert exports.file_headers(spark, path).first()["source"] == "letterboxd"


def test_pasted(spark):
    lines = ["Nightfall", "Gold Rush (2019)", "Far Out  2019", "", "   ", "2012", "Edge - "]
    rows = exports.read_pasted(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["title"], r["year"]) for r in rows] == [
        ("Nightfall", None), ("Gold Rush", 2019), ("Far Out", 2019), ("Edge", None),
    ]


def entries(spark, rows):
    full = [{**{f: None for f in ITEM.names}, "kind": "books", "verified": False, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f] for f in ITEM.names) for r in full], ITEM)


def test_remakes_and_namesakes(spark):
    cat = entries(spark, [
        {"pos": 1, "title": "Psycho!", "year": 1960}, {"pos": 2, "title": "The Same & Other", "year": 2000},
        {"pos": 3, "title": "Same and Other", "year": 2002}, {"pos": 4, "title": "Same and Other", "year": 1980},
        {"pos": 5, "title": "Undated", "year": None}, {"pos": 6, "title": "é", "year": 1}, {"pos": 7, "title": "!!", "year": 1},
    ])
    asked = [("psycho", 1961), ("Psycho", 1998), ("Same and other", 2001), ("same AND other", 1983), ("Same and Other", None),
             ("Same and Other", 2005), ("undated", 1900), ("Undated", None), ("E", 2), ("!!", 1)]
    rows = spark.createDataFrame([(i, "books", t, y) for i, (t, y) in enumerate(asked)], "row_id long, kind string, title string, year int")
    got = {r["row_id"]: (r["matches"], r["match_pos"]) for r in matching.match_lists(rows, matching.title_index(cat)).collect()}
    assert [got[i][1] for i in range(len(asked))] == [1, None, None, 4, None, 3, 5, 5, 6, None]
    assert [got[i][0] for i in range(len(asked))] == [1, 0, 2, 1, 3, 1, 1, 1, 1, 0]


def test_matching_against_brute_force_with_a_hot_title(spark):
    rng = random.Random(4)
    year = lambda: None if rng.random() < 0.15 else rng.randint(1990, 2010)
    title = lambda: "hot" if rng.random() < 0.35 else f"t{rng.randint(0, 60)}"
    cat = [(i, title(), year()) for i in range(250)]
    asked = [(i, title(), year()) for i in range(400)]
    df = entries(spark, [{"pos": i, "title": t, "year": y} for i, t, y in cat])
    rows = spark.createDataFrame([(i, "books", t, y) for i, t, y in asked], "row_id long, kind string, title string, year int")
    got = {r["row_id"]: (r["matches"], r["match_pos"]) for r in matching.match_lists(rows, matching.title_index(df)).collect()}
    for i, t, y in asked:
        fit = [p for p, u, z in cat if u == t and (y is None or z is None or abs(y - z) <= 3)]
        assert got[i] == (len(fit), fit[0] if len(fit) == 1 else None)


LIST = "user_id long, row_id long, kind string, title string, creator string, year int, pages double, isbn string, my_rating double, their_rating double, status string, shelves array<string>"


def test_backlog(spark):
    cat = entries(spark, [
        {"pos": 1, "title": "Sandworld", "year": 1965, "rating": 4.3, "author": "A", "genre": "Fantasy"},
        {"pos": 2, "kind": "movies", "title": "Film", "year": 2000, "metacritic": 88, "verified": True, "runtime": 100},
        {"pos": 3, "kind": "shows", "title": "Show", "year": 2000, "metacritic": 70, "runtime": 30, "seasons": 0},
    ])
    def row(i, kind, title, pages=None, theirs=None, status="todo"):
        return (1, i, kind, title, "", 2000 if kind != "books" else 1966, pages, "", None, theirs, status, [])

    rows = spark.createDataFrame([
        row(0, "books", "Sandworld", 544.0, 4.27), row(1, "books", "Unknown", 163.0, 4.6), row(2, "movies", "Film"),
        row(3, "shows", "Show"), row(4, "books", "Nothing known"), row(5, "games", "Nowhere", None, 8.5), row(6, "books", "Read", 10.0, 5.0, "done"),
    ], LIST)
    out = backlog.enrich(rows, cat)
    got = {r["row_id"]: (r["score"], r["basis"], r["minutes"], r["verified"]) for r in out.collect()}
    assert got[0] == (86, "shelf", 598, False)
    assert got[1] == (92, "community", 179, False)
    assert got[2] == (88, "critics", 100, True)
    assert got[3] == (70, "critics", 300, False)
    assert got[4] == (None, "none", None, False)
    assert got[5] == (85, "community", None, False)
    ranked = backlog.rank_backlog(backlog.eligible(out)).orderBy("rank").collect()
    assert [r["row_id"] for r in ranked] == [1, 2, 0, 5, 3, 4]
    short = backlog.eligible(out, minutes=200).collect()
    assert {r["row_id"] for r in short} == {1, 2}
    floor = backlog.eligible(out, min_score=85).collect()
    assert {r["row_id"] for r in floor} == {0, 1, 2, 4, 5}
    stats = backlog.backlog_stats(out, minutes=200).first()
    assert (stats["total"], stats["considered"], stats["matched"], stats["timed"], stats["shown"]) == (7, 6, 3, 4, 2)
    empty = backlog.enrich(rows, cat.limit(0))
    assert empty.count() == 7 and empty.filter("in_catalogue").count() == 0


def test_columns_go_by_name(spark):
    """Reordered, missing and surplus columns; film diary, watchlist and ratings in one folder."""
    from marquee.session import fresh_path

    base = fresh_path(spark, "mixed")
    files = {
        "books": 'Title,Book Id,Author,Exclusive Shelf\n"Dune, again",7,Someone,read\nShort\n',
        "diary": "\ufeffDate,Name,Year,Letterboxd URI,Rating,Rewatch,Tags,Watched Date\n2024-01-03,Seen,1999,u,,,,2024-01-02\n2024-01-04,Unseen,2001,u,,Yes,x,\n",
        "watchlist": "Date,Name,Year,Letterboxd URI\n2024-01-03,Later,2010,u\n",
        "ratings": "Your Rating,Title Type,Const,Title,Surplus\n8,movie,tt1,Rated,x\n,movie,tt2,Unrated,x\n",
        "other": "a,b\n1,2\n",
        "empty": "",
    }
    jvm = spark._jvm
    for name, text in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.csv")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(text.encode()))
        out.close()
    rows = exports.read_export(spark, f"{base}/*.csv").collect()
    got = {r["title"]: (r["source"], r["kind"], r["status"], r["my_rating"], r["creator"]) for r in rows}
    assert got == {
        "Dune, again": ("goodreads", "books", "done", None, "Someone"),
        "Short": ("goodreads", "books", "todo", None, ""),
        "Seen": ("letterboxd", "movies", "done", None, ""),
        "Unseen": ("letterboxd", "movies", "todo", None, ""),
        "Later": ("letterboxd", "movies", "todo", None, ""),
        "Rated": ("imdb", "movies", "done", 8.0, ""),
        "Unrated": ("imdb", "movies", "todo", None, ""),
    }
    headers = {r["file"].rsplit("/", 1)[1]: r["source"] for r in exports.file_headers(spark, f"{base}/*.csv").collect()}
    assert headers == {"books.csv": "goodreads", "diary.csv": "letterboxd", "watchlist.csv": "letterboxd", "ratings.csv": "imdb", "other.csv": None}
