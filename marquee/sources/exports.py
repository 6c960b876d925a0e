"""Users' exported lists: CSV, recognition, normalisation, pasted text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import clean_trailing, to_number, unwrap_excel
from ..session import materialise
from .splits import CsvLines, csv_cells, records

BOOK_COLUMNS = [
    "Book Id", "Title", "Author", "Author l-f", "Additional Authors", "ISBN", "ISBN13", "My Rating",
    "Average Rating", "Publisher", "Binding", "Number of Pages", "Year Published",
    "Original Publication Year", "Date Read", "Date Added", "Bookshelves", "Bookshelves with positions",
    "Exclusive Shelf", "My Review", "Spoiler", "Private Notes", "Read Count", "Owned Copies",
]
FILM_COLUMNS = ["Date", "Name", "Year", "Letterboxd URI", "Rating", "Watched Date"]
RATING_COLUMNS = ["Const", "Title Type", "Title", "Original Title", "Directors", "Year", "Your Rating", "IMDb Rating"]


#: White space that does not count at the ends of a cell.
BLANK = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _cells(batches):
    """file, split, no, text of records -> file, split, no, cells."""
    for batch in batches:
        cells = [csv_cells(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("file", "split", "no")), pa.array(cells, pa.list_(pa.string()))], ["file", "split", "no", "cells"]
        )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, split, no, header, cells of every record but the first of the CSV files in a folder. Real CSV: quotes, doubled quotes,
    embedded commas and line ends, any number of columns; carriage returns outside of quotes and blank lines do not count.
    A file is read by as many tasks as it has splits."""
    found = records(spark, path, CsvLines()).mapInArrow(_cells, "file string, split bigint, no bigint, cells array<string>")
    trimmed = F.transform("cells", lambda c: F.btrim(c, F.lit(BLANK)))
    rows = materialise(found.withColumn("cells", trimmed).filter((F.size("cells") > 1) | (F.col("cells")[0] != "")), "cells")
    # The first record that is not blank, of its split's first ones.
    place = F.struct("split", "no")
    first = rows.groupBy("file").agg(F.min(place).alias("first"))
    heads = rows.join(first, "file").filter(place == F.col("first")).select("file", "first", F.col("cells").alias("header"))
    return rows.join(materialise(heads, "headers"), "file").filter(place != F.col("first")).drop("first")


def read_keyed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """file, header and the named columns of every record of the CSV files in a folder, whatever the
    order of their columns. A name the file lacks gives empty text; of repeated names the last counts."""

    def cell(name):
        back = F.array_position(F.reverse("header"), F.lit(name)).cast("int")
        at = F.size("header") - back + 1
        return F.when((back > 0) & (at <= F.size("cells")), F.get("cells", at - 1)).otherwise(F.lit("")).alias(name)

    return read_cells(spark, path).select("file", "header", *[cell(c) for c in columns])


def read_export_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of the CSV files in a folder, by name; absent ones are empty text."""
    return read_keyed(spark, path, columns).drop("file", "header")


def detect_source(header: Column) -> Column:
    """Which service wrote a file, from its array of column names; first rule wins."""
    has = lambda name: F.array_contains(header, F.lit(name))
    return (
        F.when(has("Exclusive Shelf") | (has("Book Id") & has("Title")), F.lit("goodreads"))
        .when(has("Letterboxd URI"), F.lit("letterboxd"))
        .when(has("Const") & has("Title Type"), F.lit("imdb"))
    )


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file that has records: its column names and which service wrote it."""
    seen = read_cells(spark, path).groupBy("file").agg(F.first("header").alias("header"))
    return seen.withColumn("source", detect_source(F.col("header")))


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def _positive(c: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(c, F.lit(0.0))


def _row(df: DataFrame, keep: list[str], cols: dict[str, Column]) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in cols.items()]).filter(F.col("title") != "")


def _goodreads() -> dict[str, Column]:
    shelf = F.lower(_text("Exclusive Shelf"))
    labels = F.filter(F.transform(F.split(_text("Bookshelves"), ","), lambda s: F.trim(s)), lambda s: s != "")
    return dict(
        title=_text("Title"),
        creator=_text("Author"),
        year=F.coalesce(_positive(to_number(_text("Original Publication Year"))), to_number(_text("Year Published"))).cast("int"),
        pages=to_number(_text("Number of Pages")),
        isbn=F.coalesce(F.nullif(unwrap_excel(_text("ISBN13")), F.lit("")), unwrap_excel(_text("ISBN"))),
        my_rating=_positive(to_number(_text("My Rating"))),
        their_rating=to_number(_text("Average Rating")),
        status=F.when(shelf == "read", "done").when(shelf == "currently-reading", "doing").otherwise("todo"),
        shelves=labels,
    )


def _letterboxd() -> dict[str, Column]:
    rating = to_number(_text("Rating"))
    return dict(
        title=_text("Name"),
        creator=F.lit(""),
        year=to_number(_text("Year")).cast("int"),
        pages=F.lit(None).cast("double"),
        isbn=F.lit(""),
        my_rating=rating,
        their_rating=F.lit(None).cast("double"),
        status=F.when(rating.isNotNull() | (_text("Watched Date") != ""), "done").otherwise("todo"),
        shelves=F.array().cast("array<string>"),
    )


def _imdb() -> dict[str, Column]:
    return dict(
        title=F.coalesce(F.nullif(_text("Title"), F.lit("")), _text("Original Title")),
        creator=_text("Directors"),
        year=to_number(_text("Year")).cast("int"),
        pages=F.lit(None).cast("double"),
        isbn=F.lit(""),
        my_rating=to_number(_text("Your Rating")),
        their_rating=to_number(_text("IMDb Rating")),
        status=F.when(_text("Your Rating") != "", "done").otherwise("todo"),
        shelves=F.array().cast("array<string>"),
    )


#: Service -> the kind of its items and its columns.
SERVICES = {"goodreads": ("books", _goodreads), "letterboxd": ("movies", _letterboxd), "imdb": ("movies", _imdb)}


def normalise_goodreads(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    return _row(df, list(keep), _goodreads())


def normalise_letterboxd(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    return _row(df, list(keep), _letterboxd())


def normalise_imdb(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    return _row(df, list(keep), _imdb())


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Any mix of exports in a folder: file, source, kind and the normalised columns of every item.
    A file is recognised by its column names; files of no known service give no rows."""
    known = list(dict.fromkeys([*BOOK_COLUMNS, *FILM_COLUMNS, *RATING_COLUMNS]))
    rows = read_keyed(spark, path, known).withColumn("source", detect_source(F.col("header"))).filter("source is not null")
    parts = {name: (kind, cols()) for name, (kind, cols) in SERVICES.items()}

    def pick(value):
        out = F.when(F.lit(False), None)
        for name, (kind, cols) in parts.items():
            out = out.when(F.col("source") == name, value(kind, cols))
        return out

    columns = {"kind": pick(lambda kind, _: F.lit(kind))}
    columns |= {c: pick(lambda _, cols, c=c: cols[c]) for c in _imdb()}
    return _row(rows, ["file", "source"], columns)


PASTED = r"^(.*?)[\s(]*((?:19|20)\d{2})\)?$"


def read_pasted(lines: DataFrame, line: str = "value", keep: list[str] = ()) -> DataFrame:
    """One title per line, with an optional trailing year."""
    s = F.trim(F.regexp_replace(F.col(line), "\r", ""))
    dated = s.rlike(PASTED)
    title = F.when(dated, F.regexp_extract(s, PASTED, 1)).otherwise(s)
    return _row(lines, list(keep), dict(
        title=clean_trailing(title),
        creator=F.lit(""),
        year=F.when(dated, F.nullif(F.regexp_extract(s, PASTED, 2), F.lit("")).try_cast("int")),
        pages=F.lit(None).cast("double"),
        isbn=F.lit(""),
        my_rating=F.lit(None).cast("double"),
        their_rating=F.lit(None).cast("double"),
        status=F.lit("todo"),
        shelves=F.array().cast("array<string>"),
    ))
