"""Finding items by number, title, shared address or recent use; artwork."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.scores import item_key, thumb_step
from ..functions.text import fold_loose
from ..functions.viewstate import open_token
from ..session import materialise
from ..sources.catalogue import kind_spans
from .sorting import top_per_group


def resolve_gid(refs: DataFrame, items: DataFrame, idx: str = "idx") -> DataFrame:
    """Global numbers to items: the span that holds a number gives kind and place (four
    spans, as an array beside each row), then an equi-join."""
    spans = kind_spans(items.select("kind")).agg(F.collect_list(F.struct("kind", "offset", "n")).alias("spans"))
    tagged = refs.withColumn("_one", F.lit(1)).join(F.broadcast(spans.withColumn("_one", F.lit(1))), "_one").drop("_one")
    hit = F.try_element_at(
        F.filter("spans", lambda s: (F.col("gid") >= s["offset"]) & (F.col("gid") < s["offset"] + s["n"])), F.lit(1)
    )
    placed = tagged.withColumn("_s", hit).select(
        *refs.columns, F.col("_s.kind").alias("kind"), (F.col("gid") - F.col("_s.offset")).alias(idx)
    )
    return placed.join(items, ["kind", idx])


def first_by_title(items: DataFrame) -> DataFrame:
    """(kind, lower title) -> first item of that title."""
    return items.groupBy("kind", F.lower("title").alias("title_key")).agg(F.min("pos").alias("pos"))


def lookup_by_title(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """`wanted` has kind and title; the first item of that title, in any case, wins."""
    return wanted.withColumn("title_key", F.lower(F.coalesce("title", F.lit("")))).join(
        first_by_title(items), ["kind", "title_key"], "left"
    )


def open_items(urls: DataFrame, items: DataFrame, url: str = "url") -> DataFrame:
    """What a shared address opens: the item of that key, else of that title, else the first
    item whose title starts so. `urls` has kind, an id `url_id` and the address.

    Three equi-joins against lists that are unique per key. For the last one titles are cut to
    the lengths that occur among the tokens, and the first item per start is kept, so a common
    start costs a row per task, not a row per pair."""
    # Addresses without a token drop out in the explode, which also has each parsed only once;
    # the result feeds two branches and is written.
    token = F.explode(F.array_compact(F.array(open_token(F.col(url)))))
    parsed = urls.select("url_id", "kind", token.alias("token"))
    asked = materialise(parsed.withColumn("_low", F.lower(F.trim("token"))), "tokens")
    by_key = items.groupBy("kind", item_key().alias("token")).agg(F.min("pos").alias("pos_key"))
    titles = first_by_title(items)
    by_title = titles.select("kind", F.col("title_key").alias("_low"), F.col("pos").alias("pos_title"))
    lengths = asked.agg(F.collect_set(F.length("_low")).alias("_n")).withColumn("_one", F.lit(1))
    starts = (
        titles.withColumn("_one", F.lit(1))
        .join(F.broadcast(lengths), "_one")  # one row
        .select("kind", "title_key", "pos", F.explode("_n").alias("_n"))
        .filter((F.col("_n") > 0) & (F.col("_n") <= F.length("title_key")))
        .groupBy("kind", F.substring(F.col("title_key"), F.lit(1), F.col("_n")).alias("_low"))
        .agg(F.min("pos").alias("pos_start"))
    )
    return (
        asked.join(by_key, ["kind", "token"], "left")
        .join(by_title, ["kind", "_low"], "left")
        .join(starts, ["kind", "_low"], "left")
        .select(
            "url_id", "kind", "token",
            F.coalesce("pos_key", "pos_title", "pos_start").alias("pos"),
            F.when(F.col("pos_key").isNotNull(), "key")
            .when(F.col("pos_title").isNotNull(), "title")
            .when(F.col("pos_start").isNotNull(), "start")
            .otherwise("none")
            .alias("how"),
        )
    )


def recent_items(uses: DataFrame, keep: int = fixed.RECENT_KEEP) -> DataFrame:
    """Latest `keep` distinct items per user, newest first, and whether an item is among the few
    that are shown. `uses` has user_id, kind, item_id, ts and event_id; each item counts once, at its last use."""
    last = uses.groupBy("user_id", "kind", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    flat = last.select("user_id", "kind", "item_id", F.col("last.ts").alias("ts"), F.col("last.event_id").alias("event_id"))
    kept = top_per_group(flat, ["user_id"], [F.desc("ts"), F.desc("event_id")], keep)
    return kept.withColumn("shown", F.col("rank") <= fixed.RECENT_SHOW)


def resolve_recents(recents: DataFrame, items: DataFrame) -> DataFrame:
    """Recents to items: same title in any case, and year (games) or author (books) equal
    where both sides have one; the first such item wins.

    `recents` has recent_id, kind, title, year, author. Items are first reduced to one per
    title, year and author."""
    other = F.when(F.col("kind") == "books", F.col("author")).otherwise(F.col("year").cast("string"))
    unique = (
        items.withColumn("_other", F.nullif(other, F.lit("")))
        .groupBy("kind", F.lower("title").alias("_t"), "_other")
        .agg(F.min("pos").alias("pos"))
    )
    any_of = unique.groupBy("kind", "_t").agg(
        F.min("pos").alias("_any"), F.min(F.when(F.col("_other").isNull(), F.col("pos"))).alias("_blank")
    )
    same = unique.filter(F.col("_other").isNotNull()).select("kind", "_t", "_other", F.col("pos").alias("_same"))
    asked = recents.withColumn("_t", F.lower("title")).withColumn("_other", F.nullif(other, F.lit("")))
    return (
        asked.join(any_of, ["kind", "_t"], "left")
        .join(same, ["kind", "_t", "_other"], "left")
        .withColumn(
            "pos", F.when(F.col("_other").isNull(), F.col("_any")).otherwise(F.least(F.col("_same"), F.col("_blank")))
        )
        .select("recent_id", "kind", "title", "pos")
    )


# ------------------------------------------------------------------ artwork


def candidate_titles() -> Column:
    """Article titles to try, likeliest first, per kind."""
    t, y = F.col("title"), F.coalesce(F.col("year").cast("string"), F.lit("null"))
    word = F.when(F.col("kind") == "shows", F.lit("TV series")).otherwise(F.lit("film"))
    with_ = lambda *parts: F.concat(t, F.lit(" ("), *parts, F.lit(")"))
    screen = F.array(
        with_(y, F.lit(" "), word), with_(word), with_(y, F.lit(" American "), word), t
    )
    games = F.array(with_(y, F.lit(" video game")), with_(F.lit("video game")), t)
    return F.when(F.col("kind") == "games", games).when(F.col("kind").isin("movies", "shows"), screen)


def picture_of(article: Column) -> Column:
    """Widest legal thumbnail the original can fill; the original without one; none for a
    page that only lists namesakes."""
    thumb, orig, width = article["thumb"], article["original"], article["original_width"]
    want = F.when(F.coalesce(width, F.lit(0)) >= fixed.THUMB_WANT, F.lit(fixed.THUMB_WANT)).otherwise(F.lit(0))
    found = F.when(thumb.isNull(), orig).otherwise(thumb_step(thumb, want))
    return F.when(article["type"] != "disambiguation", found)


def artwork_candidates(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Picture per item: the first candidate article that has one, else an article whose title
    without its trailing qualifier folds to the item's title. Also returns the first candidate
    that is a real page, for the media fallback.

    `articles` has article_id, article, thumb, original, original_width, type."""
    art = articles.withColumn("picture", picture_of(F.struct(*articles.columns)))
    tried = (
        items.filter("kind <> 'books'")
        .select("kind", "pos", F.posexplode(candidate_titles()).alias("priority", "article"))
        .join(
            art.filter(F.col("type") != "disambiguation").groupBy("article").agg(
                F.min("picture").alias("picture"), F.min("article_id").alias("article_id")
            ),
            "article",
        )
        .groupBy("kind", "pos")
        .agg(
            F.min_by(F.when(F.col("picture").isNotNull(), F.col("picture")), F.when(F.col("picture").isNotNull(), F.col("priority"))).alias("direct"),
            F.min_by("article", "priority").alias("page"),
        )
    )
    searched = (
        art.filter(F.col("picture").isNotNull())
        .groupBy(fold_loose(F.regexp_replace("article", r"\s*\([^)]*\)\s*$", "")).alias("_f"))
        .agg(F.min_by("picture", "article_id").alias("found"))
    )
    return (
        items.filter("kind <> 'books'")
        .select("kind", "pos", "title", fold_loose(F.col("title")).alias("_f"))
        .join(tried, ["kind", "pos"], "left")
        .join(searched, "_f", "left")
        .select(
            "kind", "pos", "title", F.coalesce("direct", "found").alias("picture"), "page",
            F.when(F.col("direct").isNotNull(), "article").when(F.col("found").isNotNull(), "search").otherwise("none").alias("how"),
        )
    )


def media_file_fallback(missing: DataFrame, media: DataFrame) -> DataFrame:
    """For items without a picture whose page is known: the first image of that page whose
    file name says what it is and starts with the title. `media` has page, place, file, src."""
    named = F.regexp_replace("file", "^File:", "")
    fit = media.filter(named.rlike(fixed.MEDIA_NAME)).withColumn("_name", fold_loose(named))
    asked = missing.withColumn("_f", fold_loose(F.col("title")))
    # Items of one page and title share an answer, so files meet distinct pairs only.
    found = (
        asked.select("page", "_f").distinct()
        .join(fit, "page")
        .filter(F.startswith("_name", "_f"))
        .groupBy("page", "_f")
        .agg(F.min_by("src", "place").alias("picture"))
    )
    return asked.join(found, ["page", "_f"]).select("kind", "pos", "picture")


def book_covers(books: DataFrame, editions: DataFrame) -> DataFrame:
    """Cover per book: the first edition with a cover by title and author, else by title
    alone. `editions` has edition_id, title, author, cover_id."""
    with_cover = editions.filter(F.col("cover_id").isNotNull())
    key = lambda c: fold_loose(F.col(c))
    both = with_cover.groupBy(key("title").alias("_t"), key("author").alias("_a")).agg(
        F.min_by("cover_id", "edition_id").alias("exact")
    )
    loose = with_cover.groupBy(key("title").alias("_t")).agg(F.min_by("cover_id", "edition_id").alias("loose"))
    asked = books.withColumn("_t", key("title")).withColumn("_a", key("author"))
    return (
        asked.join(both, ["_t", "_a"], "left")
        .join(loose, "_t", "left")
        .select(
            "kind", "pos", "title",
            F.coalesce("exact", "loose").alias("cover_id"),
            F.when(F.col("exact").isNotNull(), "title and author").when(F.col("loose").isNotNull(), "title").otherwise("none").alias("how"),
        )
    )
