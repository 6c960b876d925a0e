"""Scores, lengths, labels and formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def js_round(c: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(c + F.lit(0.5)).cast("int")


def best_score(metacritic="metacritic", imdb="imdb", rt="rt") -> Column:
    return F.coalesce(F.col(metacritic), js_round(F.col(imdb) * 10), F.col(rt), F.lit(0))


def item_score() -> Column:
    """The recommender's score: books from readers, the rest from critics."""
    return F.when(F.col("kind") == "books", F.col("rating") / 5 * 100).otherwise(
        F.col("metacritic").cast("double")
    )


def popularity() -> Column:
    raw = (
        F.when(F.col("kind") == "games", F.coalesce(F.col("metacritic"), F.lit(0)) / 100)
        .when(F.col("kind") == "books", F.coalesce(F.col("rating"), F.lit(0.0)) / 5)
        .otherwise(best_score() / 100)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def entry_minutes() -> Column:
    """Length of a catalogue item: a film's runtime, a series' whole run, else unknown."""
    seasons = F.coalesce(F.nullif(F.col("seasons"), F.lit(0)), F.lit(1))
    run = js_round(F.col("runtime") * fixed.EPISODES_PER_SEASON * seasons)
    return F.nullif(
        F.when(F.col("kind") == "movies", F.col("runtime")).when(F.col("kind") == "shows", run),
        F.lit(0),
    )


def fmt_count(c: Column) -> Column:
    n = c.cast("double")
    return (
        F.when(n.isNull(), F.lit("—"))
        .when(n >= 1e7, F.concat(F.format_string("%.0f", n / 1e6), F.lit("M")))
        .when(n >= 1e6, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
        .when(n >= 1e3, F.concat(js_round(n / 1e3).cast("string"), F.lit("K")))
        .otherwise(c.cast("string"))
    )


def fmt_year(c: Column) -> Column:
    return (
        F.when(c.isNull(), F.lit("—"))
        .when(c < 0, F.concat(F.abs(c).cast("string"), F.lit(" BC")))
        .otherwise(c.cast("string"))
    )


def fmt_minutes(c: Column) -> Column:
    h = F.floor(c / 60)
    r = c % 60
    hours = F.concat(h.cast("string"), F.lit("h"))
    return (
        F.when(c.isNull(), F.lit("—"))
        .when(c < 60, F.concat(c.cast("string"), F.lit(" min")))
        .when((h < 24) & (r > 0), F.concat(hours, F.lit(" "), r.cast("string"), F.lit("m")))
        .otherwise(hours)
    )


def score_band(c: Column, good: int = 80, mid: int = 60) -> Column:
    return (
        F.when(c.isNull(), F.lit("none"))
        .when(c >= good, F.lit("good"))
        .when(c >= mid, F.lit("mid"))
        .otherwise(F.lit("bad"))
    )


def basis_label(kind: Column, verified: Column) -> Column:
    return (
        F.when(kind == "books", F.lit("readers"))
        .when(F.coalesce(verified, F.lit(False)), F.lit("critics ✓"))
        .otherwise(F.lit("critics"))
    )


def item_key() -> Column:
    """title|year, and title|author for books."""
    other = F.when(F.col("kind") == "books", F.coalesce(F.col("author"), F.lit(""))).otherwise(
        F.coalesce(F.col("year").cast("string"), F.lit(""))
    )
    return F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit("|"), other)


def char_mask(c: Column) -> Column:
    """27 bits: one per letter, one for any digit."""
    bits = [
        F.when(F.contains(c, F.lit(chr(97 + i))), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(26)
    ]
    bits.append(F.when(c.rlike("[0-9]"), F.lit(1 << 26)).otherwise(F.lit(0)))
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def thumb_step(url: Column, want: Column) -> Column:
    """Replace the width in a thumbnail address by the smallest legal one that suffices."""
    width = F.nullif(F.regexp_extract(url, r"/(\d+)px-", 1), F.lit("")).try_cast("int")
    steps = F.array(*[F.lit(s) for s in fixed.THUMB_STEPS])
    target = F.greatest(width, want)
    fit = F.try_element_at(F.filter(steps, lambda s: s >= target), F.lit(1))
    swapped = F.regexp_replace(url, F.lit(r"/(\d+)px-"), F.concat(F.lit("/"), fit.cast("string"), F.lit("px-")))
    return F.when(fit.isNull(), url).otherwise(swapped)


def legal_width(url: Column) -> Column:
    width = F.regexp_extract(F.coalesce(url, F.lit("")), r"/(\d+)px-", 1)
    return (width == "") | width.isin([str(s) for s in fixed.THUMB_STEPS])


def csv_safe(c: Column) -> Column:
    """Defuse text a spreadsheet would run as a formula; numbers are not passed here."""
    return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(F.coalesce(c, F.lit("")))
