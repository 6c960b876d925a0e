"""Comparison tables, relaxation counts, exports of a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.scores import best_score, csv_safe, fmt_count, fmt_year, item_key
from .filters import View


def _one(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("—")).otherwise(F.format_string("%.1f", F.col(c)))


def _yes(c: Column) -> Column:
    return F.when(c, F.lit("Yes")).otherwise(F.lit("No"))


def attribute_rows(items: DataFrame) -> DataFrame:
    """Long form: one row per item and attribute, with the text shown and the number compared.

    Only attributes of the item's kind appear. `played` and `favourite` are flags."""
    k = F.col("kind")
    screen = k.isin("movies", "shows")
    integer = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    number = lambda c: F.col(c).cast("double")
    none = F.lit(None).cast("double")
    rating = F.col("rating")
    two_digits = F.when(rating.isNull(), F.lit("—")).otherwise(F.format_string("%.2f", rating))
    verified = F.when(F.col("verified"), F.lit(1.0)).otherwise(F.lit(0.0))
    specs = [
        ("Metacritic", k != "books", integer("metacritic"), number("metacritic")),
        ("IGN", k == "games", _one("ign"), number("ign")),
        ("User score", k == "games", _one("user_score"), number("user_score")),
        ("IMDb", screen, _one("imdb"), number("imdb")),
        ("RT", screen, integer("rt"), number("rt")),
        ("Rating", k == "books", two_digits, number("rating")),
        ("Ratings", k == "books", fmt_count(F.col("ratings_count")), number("ratings_count")),
        ("Author", k == "books", F.coalesce("author", F.lit("—")), none),
        ("Year", F.lit(True), fmt_year(F.col("year")), none),
        ("Genre", F.lit(True), F.coalesce("genre", F.lit("—")), none),
        ("Verified", k != "books", _yes(F.col("verified")), verified),
        ("Done", F.lit(True), _yes(F.col("done")), none),
        ("Favourite", F.lit(True), _yes(F.col("favourite")), none),
    ]
    cells = F.array_compact(
        F.array(
            *[
                F.when(
                    cond,
                    F.struct(
                        F.lit(i).alias("attribute_no"), F.lit(a).alias("attribute"),
                        shown.alias("shown"), num.alias("num"),
                    ),
                )
                for i, (a, cond, shown, num) in enumerate(specs)
            ]
        )
    )
    return items.select("tray", "kind", "pos", "title", F.inline(cells))


def compare(items: DataFrame) -> DataFrame:
    """Trays of two to four items side by side; the best value of a row is flagged unless all
    values tie. A tray holds at most four items, so every window is tiny; a fuller one is an error."""
    tray = Window.partitionBy("tray")
    row = Window.partitionBy("tray", "attribute")
    known = F.count("num").over(row)
    top, low = F.max("num").over(row), F.min("num").over(row)
    full = F.raise_error(F.concat(F.lit("a tray holds more than "), F.lit(str(fixed.COMPARE_MAX)), F.lit(" items"))).cast("boolean")
    fits = F.when(F.col("_n") > fixed.COMPARE_MAX, full).otherwise(True)
    wins = (known >= 2) & (top != low) | (known == 1)
    return (
        attribute_rows(items.withColumn("_n", F.count("*").over(tray)).filter((F.col("_n") >= 2) & fits).drop("_n"))
        .withColumn("best", F.coalesce(wins & (F.col("num") == top), F.lit(False)))
        .drop("num")
    )


def compare_table(cells: DataFrame) -> DataFrame:
    """Wide form: one row per attribute, one column per place in the tray."""
    place = F.row_number().over(Window.partitionBy("tray", "attribute").orderBy("kind", "pos"))
    return (
        cells.withColumn("place", place)
        .groupBy("tray", "attribute_no", "attribute")
        .pivot("place", list(range(1, fixed.COMPARE_MAX + 1)))
        .agg(F.first("shown"))
        .withColumnsRenamed({str(i): f"item{i}" for i in range(1, fixed.COMPARE_MAX + 1)})
    )


def score_floor_ladder(view: View, floors: list[float], rest: Column) -> Column:
    """Highest lower floor that lets rows through, as struct(value, n); null if none does."""
    lower = sorted((f for f in floors if f < view.min_score), reverse=True)
    hits = [
        F.struct(F.lit(float(f)).alias("value"), F.count_if(rest & (best_score() >= f)).alias("n")) for f in lower
    ]
    return F.try_element_at(F.filter(F.array(*hits), lambda h: h["n"] > 0), F.lit(1))


def relaxation_counts(items: DataFrame, view: View, floors: list[float], flags: dict[str, Column]) -> DataFrame:
    """How many rows would pass with one control released: one scan, conditional counts.

    `flags` adds the status and favourite controls as boolean columns, and may replace a
    control by a column computed before (the text search, so that texts stay out of joins).
    Suggestions without a
    row are dropped; the first two are what a user sees (`picked`). `floor` is the score that the first
    control would be lowered to."""
    p = {**view.predicates(), **flags}

    def without(name: str) -> Column:
        out = F.lit(True)
        for key, cond in p.items():
            if key != name:
                out = out & cond
        return out

    order = ["min", "years", "genres", "status", "fav", "search"]
    named = [n for n in order if n in p and n != "min"]
    counts = items.agg(
        score_floor_ladder(view, floors, without("min")).alias("_min"),
        *[F.count_if(without(n)).alias(n) for n in named],
    )
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(0).alias("place"), F.lit("min").alias("control"), F.col("_min.n").alias("n"), F.col("_min.value").alias("floor"))]
    rows += [
        F.struct(F.lit(order.index(n)).alias("place"), F.lit(n).alias("control"), F.col(n).alias("n"), none.alias("floor")) for n in named
    ]
    offered = F.filter(F.array(*rows), lambda r: r["n"] > 0)
    picked = F.transform(offered, lambda r, i: F.struct(r["place"].alias("place"), r["control"].alias("control"), r["n"].alias("n"), r["floor"].alias("floor"), (i < 2).alias("picked")))
    return counts.select(F.inline(picked))


def personal_columns(items: DataFrame, done: DataFrame, favourites: DataFrame) -> DataFrame:
    """Adds `done` and `favourite`; both sets are distinct on the item key."""
    return (
        items.withColumn("item_key", item_key())
        .join(done.select("item_key").distinct().withColumn("done", F.lit(True)), "item_key", "left")
        .join(favourites.select("item_key").distinct().withColumn("favourite", F.lit(True)), "item_key", "left")
        .fillna(False, ["done", "favourite"])
    )


def export_rows(items: DataFrame, kind: str) -> DataFrame:
    """Columns of a kind's download, text cells made safe, numbers untouched."""
    yes = lambda c: F.when(F.col(c), F.lit("yes")).otherwise(F.lit("no"))
    txt = lambda c: csv_safe(F.col(c))
    common = {"Title": txt("title"), "Year": F.col("year"), "Genre": txt("genre")}
    tail = {"Favourite": yes("favourite"), "Blurb": txt("blurb")}
    if kind == "games":
        mid = {
            "Metacritic": F.col("metacritic"), "IGN": F.col("ign"), "User score": F.col("user_score"),
            "Verified": yes("verified"), "Steam app id": F.col("steam_app_id"), "Played": yes("done"),
        }
        cols = {**common, **mid, **tail}
    elif kind == "books":
        mid = {
            "Rating": F.col("rating"), "Ratings count": F.col("ratings_count"), "ISBN": txt("isbn"),
            "Read": yes("done"),
        }
        cols = {"Title": common["Title"], "Author": txt("author"), "Year": common["Year"], "Genre": common["Genre"]}
        cols = {**cols, **mid, **tail}
    else:
        mid = {
            "Metacritic": F.col("metacritic"), "IMDb": F.col("imdb"), "RT": F.col("rt"),
            "Verified": yes("verified"), "Watched": yes("done"),
        }
        cols = {**common, **mid, **tail}
    return items.filter(F.col("kind") == kind).select(*[c.alias(n) for n, c in cols.items()])
