"""Faceted view, orders, summaries and view analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import best_score, item_key, popularity, score_band
from ..operators import filters as flt, sorting, summaries, views
from ..sources.artefacts import slim_index
from ..sources.catalogue import entries, number_items, texts
from .common import events, marked_keys
from .oracle import BEST, CAT, HAY, ITEM_KEY, MARKS, NUM, jsround
from .registry import query

KEY = ["kind", "pos", "title"]
VIEW = flt.View(query=" The ", min_score=70, years=(2010, 1950), genres=["Drama", "Action RPG", "Fantasy", "Comedy", "Horror"])
VIEW_SQL = f"""contains({HAY}, 'the') AND {BEST} >= 70 AND coalesce(year, 0) BETWEEN 1950 AND 2010
  AND genre IN ('Drama', 'Action RPG', 'Fantasy', 'Comedy', 'Horror')"""


@query("search_haystack", f"WITH {CAT} SELECT kind, pos, length({HAY}) AS hay_length, md5({HAY}) AS hay_md5 FROM cat")
def _(spark, d):
    hay = flt.search_haystack()
    return texts(spark, d).select("kind", "pos", F.length(hay).alias("hay_length"), F.md5(hay).alias("hay_md5"))


@query("filter_text", f"WITH {CAT} SELECT kind, pos, title FROM cat WHERE contains({HAY}, 'ation')")
def _(spark, d):
    return texts(spark, d).filter(flt.text_matches("  ATION ")).select(*KEY)


@query("filter_min_score", f"WITH {CAT} SELECT kind, pos, title, {BEST} AS best FROM cat WHERE {BEST} >= 70")
def _(spark, d):
    return entries(spark, d).filter(flt.score_at_least(70)).select(*KEY, best_score().alias("best"))


@query("filter_years", f"WITH {CAT} SELECT kind, pos, title, year FROM cat WHERE coalesce(year, 0) BETWEEN 1950 AND 1999")
def _(spark, d):
    return entries(spark, d).filter(flt.year_between(1999, 1950)).select(*KEY, "year")


@query("filter_genres", f"WITH {CAT} SELECT kind, pos, title, genre FROM cat WHERE genre IN ('Drama', 'Horror')")
def _(spark, d):
    return entries(spark, d).filter(flt.genre_in(["Drama", "Horror"])).select(*KEY, "genre")


@query(
    "filter_favourites",
    f"""WITH {CAT}, {MARKS}, k AS (SELECT {ITEM_KEY} AS item_key FROM cat WHERE pos IN (SELECT pos FROM fav))
    SELECT kind, pos, title FROM cat WHERE {ITEM_KEY} IN (SELECT item_key FROM k)""",
)
def _(spark, d):
    return flt.keep_marked(entries(spark, d), marked_keys(spark, d, "click")).select(*KEY)


@query(
    "filter_status",
    f"""WITH {CAT}, {MARKS}, k AS (SELECT {ITEM_KEY} AS item_key FROM cat WHERE pos IN (SELECT pos FROM done))
    SELECT kind, pos, title FROM cat WHERE {ITEM_KEY} IN (SELECT item_key FROM k) AND {BEST} >= 50""",
)
def _(spark, d):
    view = flt.View(min_score=50).apply(entries(spark, d))
    return flt.keep_marked(view, marked_keys(spark, d, "purchase")).select(*KEY)


@query("passes_view", f"WITH {CAT} SELECT kind, pos, title, {BEST} AS best FROM cat WHERE {VIEW_SQL}")
def _(spark, d):
    return VIEW.apply(texts(spark, d)).select(*KEY, best_score().alias("best"))


@query(
    "films_by_word",
    f"""WITH {CAT} SELECT kind, pos, title, year, {BEST} AS best FROM cat
    WHERE kind = 'movies' AND contains({HAY}, 'tion') AND {BEST} >= 70""",
)
def films_by_word(spark, d):
    films = texts(spark, d).filter(F.col("kind") == "movies")
    view = flt.View(query="tion", min_score=70).apply(films)
    return sorting.sort_view(view, "best-desc").select(*KEY, "year", best_score().alias("best"))


@query(
    "inclusion_bar",
    f"""WITH {CAT}, p AS (SELECT *, (pos * 29) % 2000 AS reviews, pos % 17 = 0 AS major, pos % 40 AS critics,
      (pos * 37) % 9000 AS votes, pos % 19 = 0 AS prize, pos % 23 = 0 AS bestseller FROM cat)
    SELECT kind, pos, CASE WHEN kind = 'games' THEN metacritic IS NOT NULL OR reviews >= 1000 OR major
      WHEN kind = 'movies' THEN metacritic IS NOT NULL OR critics >= 25 OR votes >= 5000
      WHEN kind = 'shows' THEN coalesce(seasons, 0) >= 1 AND (metacritic IS NOT NULL OR votes >= 5000)
      ELSE coalesce(ratings_count, 0) >= 1000 OR prize OR bestseller END AS admitted FROM p""",
)
def _(spark, d):
    p = F.col("pos")
    figures = {
        "reviews": (p * 29) % 2000, "major": p % 17 == 0, "critics": p % 40,
        "votes": (p * 37) % 9000, "prize": p % 19 == 0, "bestseller": p % 23 == 0,
    }
    return entries(spark, d).withColumns(figures).select("kind", "pos", flt.inclusion_bar().alias("admitted"))


@query(
    "required_fields",
    f"""WITH {CAT} SELECT kind, pos FROM cat WHERE coalesce(title, '') <> '' AND year IS NOT NULL AND genre IS NOT NULL
    AND coalesce(metacritic, imdb, rt) IS NOT NULL""",
)
def _(spark, d):
    return entries(spark, d).filter(flt.required_fields()).select("kind", "pos")


@query("scored_only", f"WITH {CAT} SELECT kind, pos, metacritic FROM cat WHERE metacritic IS NOT NULL")
def _(spark, d):
    return entries(spark, d).filter(flt.scored_only()).select("kind", "pos", "metacritic")


@query(
    "eligible_target",
    f"""WITH {CAT}, s AS (SELECT *, CASE WHEN kind = 'books' THEN rating / 5 * 100 ELSE metacritic END AS score FROM cat)
    SELECT kind, pos FROM s WHERE score >= 60 AND NOT (kind = 'books' AND coalesce(ratings_count, 250) < 250)""",
)
def _(spark, d):
    from ..functions.scores import item_score

    items = entries(spark, d).withColumn("score", item_score())
    return items.filter(flt.eligible_target(60, 250)).select("kind", "pos")


# ---- orders, pages, picks ----

ORDER_SQL = {
    "best-desc": f"{BEST} DESC",
    "mc-desc": "metacritic DESC NULLS LAST",
    "imdb-desc": "imdb DESC NULLS LAST",
    "rt-desc": "rt DESC NULLS LAST",
    "year-desc": f"coalesce(year, 0) DESC, {BEST} DESC",
    "year-asc": f"coalesce(year, 0), {BEST} DESC",
}


def _register_orders():
    for mode, order in ORDER_SQL.items():
        name = mode.replace("-", "_")

        @query(f"sort_{name}", f"WITH {CAT} SELECT kind, pos, title, {BEST} AS best FROM cat ORDER BY {order}, pos")
        def _(spark, d, mode=mode):
            return sorting.sort_view(entries(spark, d), mode).select(*KEY, best_score().alias("best"))

        @query(
            f"page_{name}",
            f"""WITH {CAT}, r AS (SELECT kind, pos, title, row_number() OVER (ORDER BY {order}, pos) AS rank FROM cat)
            SELECT * FROM r WHERE rank > 60 AND rank <= 120""",
        )
        def _(spark, d, mode=mode):
            return sorting.ranked_page(entries(spark, d), mode, 1).select(*KEY, "rank")


_register_orders()


@query("sort_title_asc", f"WITH {CAT} SELECT kind, pos, title FROM cat")
def _(spark, d):
    return sorting.sort_view(entries(spark, d), "title-asc").select(*KEY)


@query(
    "page_after_row",
    f"""WITH {CAT} SELECT kind, pos, title, {BEST} AS best FROM cat WHERE {BEST} < 90 OR ({BEST} = 90 AND pos > 100)
    ORDER BY {BEST} DESC, pos LIMIT 60""",
)
def _(spark, d):
    return sorting.page_after(entries(spark, d), 90, 100).select(*KEY, best_score().alias("best"))


@query(
    "surprise_pick",
    f"""WITH {CAT} SELECT kind, pos, title FROM cat WHERE genre IN ('Drama', 'Fantasy')
    ORDER BY CASE WHEN {BEST} >= 80 THEN 0 ELSE 1 END, md5('7:' || kind || ':' || pos) LIMIT 1""",
)
def _(spark, d):
    view = flt.View(genres=["Drama", "Fantasy"]).apply(entries(spark, d))
    return sorting.surprise(view, "7").select(*KEY)


@query(
    "interleaved_order",
    f"WITH {NUM} SELECT kind, pos, gid, row_number() OVER (ORDER BY idx, kind_rank) - 1 AS turn FROM num",
)
def _(spark, d):
    return number_items(entries(spark, d).select("kind", "pos")).select("kind", "pos", "gid", "turn")


@query(
    "first_wins_dedup",
    f"""WITH {CAT} SELECT kind, lower(trim(title)) AS title_key, min(pos) AS pos, arg_min(year, pos) AS year FROM
    (SELECT kind, title, pos, coalesce(year, -9999) AS year FROM cat) GROUP BY 1, 2""",
)
def _(spark, d):
    items = entries(spark, d).select(
        "kind", F.lower(F.trim("title")).alias("title_key"), "pos", F.coalesce("year", F.lit(-9999)).alias("year")
    )
    return items.groupBy("kind", "title_key").agg(F.min("pos").alias("pos"), F.min_by("year", "pos").alias("year"))


# ---- summaries ----


@query(
    "catalogue_stats",
    f"""WITH {CAT} SELECT kind, count(*) AS n, min(year) AS year_from, max(year) AS year_to,
    count(DISTINCT coalesce(genre, '∅')) AS genres, count(*) FILTER (kind = 'games' AND verified) AS verified,
    count(DISTINCT CASE WHEN kind = 'books' THEN coalesce(author, '∅') END) AS authors FROM cat GROUP BY kind""",
)
def _(spark, d):
    return summaries.catalogue_stats(entries(spark, d))


@query(
    "page_stats",
    f"""WITH {CAT} SELECT kind, count(*) AS n, coalesce({jsround('avg(metacritic)')}, 0) AS avg_metacritic,
    count(*) FILTER (verified) AS verified, min(year) AS year_from, max(year) AS year_to FROM cat GROUP BY kind""",
)
def _(spark, d):
    return summaries.page_stats(entries(spark, d))


@query(
    "genre_counts",
    f"WITH {CAT} SELECT kind, genre, count(*) AS n, min(pos) AS first_pos FROM cat GROUP BY kind, genre",
)
def _(spark, d):
    return summaries.genre_counts(entries(spark, d))


@query(
    "view_summary",
    f"WITH {CAT} SELECT count(*) AS shown, coalesce({jsround('avg(metacritic)')}, 0) AS avg_metacritic FROM cat WHERE {VIEW_SQL}",
)
def _(spark, d):
    return summaries.view_summary(VIEW.apply(texts(spark, d)))


SLIM_ONLY = f"""slim AS (SELECT kind, pos, title, year,
  CASE WHEN kind = 'books' THEN {jsround('rating / 5 * 100')} ELSE metacritic END AS score, genre,
  CASE WHEN verified THEN 1 ELSE 0 END AS verified,
  nullif(CASE WHEN kind = 'movies' THEN runtime
    WHEN kind = 'shows' THEN runtime * 10 * coalesce(nullif(seasons, 0), 1) END, 0) AS minutes FROM cat)"""
SLIM = f"{CAT}, {SLIM_ONLY}"


@query(
    "index_coverage",
    f"""WITH {SLIM} SELECT coalesce(kind, 'all') AS kind, count(*) AS total, count(score) AS scored, count(minutes) AS timed
    FROM slim GROUP BY ROLLUP (kind)""",
)
def _(spark, d):
    return summaries.index_coverage(slim_index(entries(spark, d)))


@query(
    "distinct_labels",
    f"""WITH {CAT} SELECT DISTINCT kind, 'genre' AS what, genre AS label FROM cat WHERE genre IS NOT NULL
    UNION ALL SELECT DISTINCT kind, 'maker', coalesce(author, creator) FROM cat WHERE coalesce(author, creator) IS NOT NULL""",
)
def _(spark, d):
    return summaries.distinct_labels(entries(spark, d))


@query(
    "toggle_set",
    f"""WITH {MARKS} SELECT user_id, k, count(*) AS toggles FROM ev WHERE event_type = 'click'
    GROUP BY user_id, k HAVING count(*) % 2 = 1""",
)
def _(spark, d):
    return summaries.toggled_on(events(spark, d).filter("event_type = 'click'"), ["user_id", "k"])


@query(
    "score_bands",
    f"""WITH {CAT} SELECT kind, CASE WHEN metacritic IS NULL THEN 'none' WHEN metacritic >= 75 THEN 'good'
    WHEN metacritic >= 50 THEN 'mid' ELSE 'bad' END AS page_band,
    CASE WHEN metacritic IS NULL THEN 'none' WHEN metacritic >= 80 THEN 'good'
    WHEN metacritic >= 60 THEN 'mid' ELSE 'bad' END AS list_band, count(*) AS n FROM cat GROUP BY ALL""",
)
def _(spark, d):
    mc = F.col("metacritic")
    return (
        entries(spark, d)
        .groupBy("kind", score_band(mc, 75, 50).alias("page_band"), score_band(mc).alias("list_band"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "popularity",
    f"""WITH {CAT} SELECT kind, pos, round(greatest(0, least(1, CASE WHEN kind = 'games' THEN coalesce(metacritic, 0) / 100
    WHEN kind = 'books' THEN coalesce(rating, 0) / 5 ELSE {BEST} / 100 END)), 6) AS popularity FROM cat""",
)
def _(spark, d):
    return entries(spark, d).select("kind", "pos", F.round(popularity(), 6).alias("popularity"))


# ---- view analytics ----


def _trays(spark, d):
    """Trays of up to four items of one kind: four neighbours in the numbering."""
    num = number_items(entries(spark, d))
    done = marked_keys(spark, d, "purchase")
    fav = marked_keys(spark, d, "click")
    tray = F.concat(F.col("kind"), F.lit(":"), F.floor(F.col("idx") / 4).cast("string"))
    return views.personal_columns(num, done, fav).withColumn("tray", tray)


_PERSONAL = f"""{NUM}, {MARKS},
fk AS (SELECT DISTINCT {ITEM_KEY} AS item_key FROM cat WHERE pos IN (SELECT pos FROM fav)),
dk AS (SELECT DISTINCT {ITEM_KEY} AS item_key FROM cat WHERE pos IN (SELECT pos FROM done)),
pers AS (SELECT *, {ITEM_KEY} IN (SELECT item_key FROM dk) AS done, {ITEM_KEY} IN (SELECT item_key FROM fk) AS favourite FROM num)"""

_CELLS = f"""{_PERSONAL},
tr AS (SELECT *, kind || ':' || (idx // 4) AS tray FROM pers),
tn AS (SELECT *, count(*) OVER (PARTITION BY tray) AS n_tray FROM tr),
t AS (SELECT * FROM tn WHERE n_tray >= 2),
cells AS (
  SELECT tray, kind, pos, title, 0 AS attribute_no, 'Metacritic' AS attribute, coalesce(CAST(metacritic AS VARCHAR), '—') AS shown, CAST(metacritic AS DOUBLE) AS num FROM t WHERE kind <> 'books'
  UNION ALL SELECT tray, kind, pos, title, 1, 'IGN', coalesce(printf('%.1f', ign), '—'), ign FROM t WHERE kind = 'games'
  UNION ALL SELECT tray, kind, pos, title, 2, 'User score', coalesce(printf('%.1f', user_score), '—'), user_score FROM t WHERE kind = 'games'
  UNION ALL SELECT tray, kind, pos, title, 3, 'IMDb', coalesce(printf('%.1f', imdb), '—'), imdb FROM t WHERE kind IN ('movies', 'shows')
  UNION ALL SELECT tray, kind, pos, title, 4, 'RT', coalesce(CAST(rt AS VARCHAR), '—'), rt FROM t WHERE kind IN ('movies', 'shows')
  UNION ALL SELECT tray, kind, pos, title, 5, 'Rating', coalesce(printf('%.2f', rating), '—'), rating FROM t WHERE kind = 'books'
  UNION ALL SELECT tray, kind, pos, title, 6, 'Ratings', CASE WHEN ratings_count >= 1000 THEN CAST(floor(ratings_count / 1000 + 0.5) AS INTEGER) || 'K' ELSE CAST(ratings_count AS VARCHAR) END, ratings_count FROM t WHERE kind = 'books'
  UNION ALL SELECT tray, kind, pos, title, 7, 'Author', coalesce(author, '—'), NULL FROM t WHERE kind = 'books'
  UNION ALL SELECT tray, kind, pos, title, 8, 'Year', CASE WHEN year IS NULL THEN '—' WHEN year < 0 THEN abs(year) || ' BC' ELSE CAST(year AS VARCHAR) END, NULL FROM t
  UNION ALL SELECT tray, kind, pos, title, 9, 'Genre', coalesce(genre, '—'), NULL FROM t
  UNION ALL SELECT tray, kind, pos, title, 10, 'Verified', CASE WHEN verified THEN 'Yes' ELSE 'No' END, CASE WHEN verified THEN 1 ELSE 0 END FROM t WHERE kind <> 'books'
  UNION ALL SELECT tray, kind, pos, title, 11, 'Done', CASE WHEN done THEN 'Yes' ELSE 'No' END, NULL FROM t
  UNION ALL SELECT tray, kind, pos, title, 12, 'Favourite', CASE WHEN favourite THEN 'Yes' ELSE 'No' END, NULL FROM t
),
best AS (
  SELECT tray, kind, pos, title, attribute_no, attribute, shown,
    coalesce(((count(num) OVER w >= 2 AND max(num) OVER w <> min(num) OVER w) OR count(num) OVER w = 1) AND num = max(num) OVER w, false) AS best
  FROM cells WINDOW w AS (PARTITION BY tray, attribute)
)"""


@query("compare_best", f"WITH {_CELLS} SELECT * FROM best")
def _(spark, d):
    return views.compare(_trays(spark, d))


@query(
    "compare_table",
    f"""WITH {_CELLS}, pl AS (SELECT *, row_number() OVER (PARTITION BY tray, attribute ORDER BY kind, pos) AS place FROM best)
    SELECT tray, attribute_no, attribute, max(shown) FILTER (place = 1) AS item1, max(shown) FILTER (place = 2) AS item2,
    max(shown) FILTER (place = 3) AS item3, max(shown) FILTER (place = 4) AS item4 FROM pl GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return views.compare_table(views.compare(_trays(spark, d)))


@query("personal_columns", f"WITH {_PERSONAL} SELECT kind, pos, done, favourite FROM pers")
def _(spark, d):
    items = entries(spark, d)
    both = views.personal_columns(items, marked_keys(spark, d, "purchase"), marked_keys(spark, d, "click"))
    return both.select("kind", "pos", "done", "favourite")


@query(
    "status_view",
    f"WITH {_PERSONAL} SELECT kind, count(*) AS marked FROM pers WHERE done GROUP BY kind",
)
def _(spark, d):
    marked = flt.keep_marked(entries(spark, d), marked_keys(spark, d, "purchase"))
    return marked.groupBy("kind").agg(F.count("*").alias("marked"))


_FREE = {
    "search": f"contains({HAY}, 'tion')",
    "min": f"{BEST} >= 98",
    "years": "coalesce(year, 0) BETWEEN 1930 AND 1990",
    "genres": "genre IN ('Drama', 'Fighting', 'Fantasy', 'Comedy', 'Animation', 'Classics')",
    "status": "done OR pos % 2 = 0",
    "fav": "favourite OR pos % 5 < 4",
}
TIGHT = flt.View(
    query="tion", min_score=98, years=(1930, 1990),
    genres=["Drama", "Fighting", "Fantasy", "Comedy", "Animation", "Classics"],
)


def _without(name: str) -> str:
    return " AND ".join(f"({v})" for k, v in _FREE.items() if k != name)


_LADDER = " ".join(
    f"WHEN count(*) FILTER ({_without('min')} AND {BEST} >= {f}) > 0 THEN count(*) FILTER ({_without('min')} AND {BEST} >= {f})"
    for f in (90, 80, 70, 60, 0)
)
_FLOOR = " ".join(f"WHEN count(*) FILTER ({_without('min')} AND {BEST} >= {f}) > 0 THEN {f}" for f in (90, 80, 70, 60, 0))


@query(
    "relaxation_counts",
    f"""WITH {_PERSONAL}, c AS (SELECT CASE {_LADDER} END AS mn, CASE {_FLOOR} END AS fl, count(*) FILTER ({_without('years')}) AS ye,
      count(*) FILTER ({_without('genres')}) AS ge, count(*) FILTER ({_without('status')}) AS st,
      count(*) FILTER ({_without('fav')}) AS fa, count(*) FILTER ({_without('search')}) AS se FROM pers)
    SELECT *, row_number() OVER (ORDER BY place) <= 2 AS picked FROM (SELECT 0 AS place, 'min' AS control, mn AS n, CAST(fl AS DOUBLE) AS floor FROM c
      UNION ALL SELECT 1, 'years', ye, NULL FROM c UNION ALL SELECT 2, 'genres', ge, NULL FROM c UNION ALL SELECT 3, 'status', st, NULL FROM c
      UNION ALL SELECT 4, 'fav', fa, NULL FROM c UNION ALL SELECT 5, 'search', se, NULL FROM c) WHERE n > 0""",
)
def _(spark, d):
    searched = texts(spark, d).withColumn("hit", TIGHT.predicates()["search"]).drop("blurb")  # no text is shuffled
    items = views.personal_columns(searched, marked_keys(spark, d, "purchase"), marked_keys(spark, d, "click"))
    pos = F.col("pos")
    flags = {"search": F.col("hit"), "status": F.col("done") | (pos % 2 == 0), "fav": F.col("favourite") | (pos % 5 < 4)}
    return views.relaxation_counts(items, TIGHT, [0, 60, 70, 80, 90], flags)


_RUNGS = " ".join(
    f"WHEN count(*) FILTER (coalesce(year, 0) BETWEEN 1990 AND 1993 AND {BEST} >= {f}) > 0 THEN {f}" for f in (95, 90, 80, 70, 0)
)


@query(
    "score_floor_ladder",
    f"""WITH {CAT}, c AS (SELECT kind, CAST(CASE {_RUNGS} END AS DOUBLE) AS value FROM cat GROUP BY kind)
    SELECT c.kind, c.value, count(*) FILTER (coalesce(year, 0) BETWEEN 1990 AND 1993 AND {BEST} >= value) AS n
    FROM c JOIN cat ON cat.kind = c.kind GROUP BY ALL""",
)
def _(spark, d):
    view = flt.View(min_score=99, years=(1990, 1993))
    rung = views.score_floor_ladder(view, [0, 70, 80, 90, 95], view.predicates()["years"])
    out = entries(spark, d).groupBy("kind").agg(rung.alias("r"))
    return out.select("kind", "r.value", "r.n")


@query(
    "active_filters",
    f"""WITH {CAT} SELECT kind, concat_ws(', ', '5 genres', '70+ score', 'favourites',
      CASE WHEN 1950 > min(year) OR 2010 < max(year) THEN '1950–2010' END) AS filters FROM cat GROUP BY kind""",
)
def _(spark, d):
    parts = flt.active_filters(VIEW, True, (F.min("year"), F.max("year")))
    return entries(spark, d).groupBy("kind").agg(F.array_join(parts, ", ").alias("filters"))


@query(
    "item_key",
    f"WITH {CAT} SELECT kind, {ITEM_KEY} AS item_key, count(*) AS n FROM cat GROUP BY ALL",
)
def _(spark, d):
    return entries(spark, d).groupBy("kind", item_key().alias("item_key")).agg(F.count("*").alias("n"))
