"""Lookups by number, title and address; recents; artwork."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import encode_component
from ..functions.viewstate import open_token, search_links, state_genres, state_map, state_value
from ..operators import lookups
from ..sources.catalogue import entries, number_items, read_table
from .oracle import CAT, ITEM_KEY, NUM, encode, fold_loose
from .registry import query

# ---- numbers and titles ----


@query(
    "resolve_gid",
    f"""WITH {NUM}, r AS (SELECT event_id, event_id // 10 AS gid FROM events)
    SELECT r.event_id, r.gid, kind, pos, title FROM r JOIN num ON num.gid = r.gid""",
)
def _(spark, d):
    items = number_items(entries(spark, d).select("kind", "pos", "title")).select("kind", "idx", "pos", "title")
    refs = read_table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("gid"))
    return lookups.resolve_gid(refs, items).select("event_id", "gid", "kind", "pos", "title")


@query(
    "lookup_by_title",
    f"""WITH {CAT}, f AS (SELECT kind, lower(title) AS t, min(pos) AS pos FROM cat GROUP BY 1, 2)
    SELECT w.kind, w.pos AS asked_pos, f.pos FROM cat w LEFT JOIN f ON f.kind = w.kind AND f.t = lower(coalesce(w.title, ''))""",
)
def _(spark, d):
    items = entries(spark, d).select("kind", "pos", "title")
    wanted = items.withColumnRenamed("pos", "asked_pos")
    return lookups.lookup_by_title(wanted, items).select("kind", "asked_pos", "pos")


# ---- shared addresses: one per event, over the catalogue's titles ----


def addresses(spark, d) -> DataFrame:
    ev = read_table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("pos"))
    items = entries(spark, d).select("kind", "pos", "title", "year", "author", "genre")
    e = F.col("event_id")
    other = F.when(F.col("kind") == "books", F.coalesce("author", F.lit(""))).otherwise(F.coalesce(F.col("year").cast("string"), F.lit("")))
    token = (
        F.when(e % 4 == 0, F.concat("title", F.lit("|"), other))
        .when(e % 4 == 1, F.upper(F.translate("title", "ß", "s")))
        .when(e % 4 == 2, F.substring("title", 1, 9))
        .otherwise(F.concat("title", F.lit(" zzz")))
    )
    coded = F.when(e % 3 == 0, F.replace(encode_component(token), F.lit("%20"), F.lit("+"))).otherwise(encode_component(token))
    url = F.concat(
        F.lit("https://example.org/"), "kind", F.lit(".html#search="), encode_component(F.col("title")),
        F.lit("&minmc="), (e % 10 * 10).cast("string"),
        F.when(e % 5 != 0, F.concat(F.lit("&g="), encode_component(F.concat("genre", F.lit("~Drama"))))).otherwise(F.lit("")),
        F.when(e % 6 != 0, F.concat(F.lit("&open="), coded)).otherwise(F.lit("")),
    )
    return ev.join(items, "pos").select(e.alias("url_id"), "kind", url.alias("url"))


_TOKEN = """CASE WHEN event_id % 4 = 0 THEN title || '|' || CASE WHEN kind = 'books' THEN coalesce(author, '') ELSE coalesce(CAST(year AS VARCHAR), '') END
  WHEN event_id % 4 = 1 THEN upper(replace(title, 'ß', 's')) WHEN event_id % 4 = 2 THEN left(title, 9) ELSE title || ' zzz' END"""

ADDR = f"""{CAT}, addr AS (SELECT event_id AS url_id, kind, title, genre, event_id, {_TOKEN} AS token FROM events JOIN cat ON cat.pos = event_id // 10)"""


@query(
    "view_addresses",
    f"""WITH {ADDR} SELECT url_id, 'https://example.org/' || kind || '.html#search=' || {encode('title')} || '&minmc=' || (event_id % 10 * 10)
    || CASE WHEN event_id % 5 <> 0 THEN '&g=' || {encode("genre || '~Drama'")} ELSE '' END
    || CASE WHEN event_id % 6 <> 0 THEN '&open=' || CASE WHEN event_id % 3 = 0 THEN replace({encode('token')}, '%20', '+') ELSE {encode('token')} END ELSE '' END AS url
    FROM addr""",
)
def _(spark, d):
    return addresses(spark, d).select("url_id", "url")


@query(
    "view_state_parse",
    f"""WITH {ADDR} SELECT url_id, title AS search, CAST(event_id % 10 * 10 AS VARCHAR) AS minmc,
    CASE WHEN event_id % 5 <> 0 THEN [genre, 'Drama'] ELSE [] END AS genres FROM addr""",
)
def _(spark, d):
    url = F.col("url")
    return addresses(spark, d).select(
        "url_id", state_value(url, "search").alias("search"), state_value(url, "minmc").alias("minmc"),
        state_genres(url).alias("genres"),
    )


@query(
    "view_state_map",
    f"""WITH {ADDR} SELECT url_id, CAST(2 + CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 6 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS n,
    title AS search FROM addr""",
)
def _(spark, d):
    m = state_map(F.col("url"))
    return addresses(spark, d).select("url_id", F.size(m).alias("n"), F.try_element_at(m, F.lit("search")).alias("search"))


@query("open_token", f"WITH {ADDR} SELECT url_id, CASE WHEN event_id % 6 <> 0 THEN token END AS token FROM addr")
def _(spark, d):
    return addresses(spark, d).select("url_id", open_token(F.col("url")).alias("token"))


@query(
    "open_title",
    f"""WITH {ADDR}, a AS (SELECT url_id, kind, token, lower(trim(token)) AS low FROM addr WHERE event_id % 6 <> 0),
    bk AS (SELECT kind, {ITEM_KEY} AS k, min(pos) AS p FROM cat GROUP BY 1, 2),
    bt AS (SELECT kind, lower(title) AS t, min(pos) AS p FROM cat GROUP BY 1, 2),
    lows AS (SELECT DISTINCT kind, low FROM a WHERE low <> ''),
    bs AS (SELECT l.kind, l.low, min(bt.p) AS p FROM lows l JOIN bt ON bt.kind = l.kind AND starts_with(bt.t, l.low) GROUP BY 1, 2)
    SELECT a.url_id, a.kind, a.token, coalesce(bk.p, bt.p, bs.p) AS pos,
      CASE WHEN bk.p IS NOT NULL THEN 'key' WHEN bt.p IS NOT NULL THEN 'title' WHEN bs.p IS NOT NULL THEN 'start' ELSE 'none' END AS how
    FROM a LEFT JOIN bk ON bk.kind = a.kind AND bk.k = a.token LEFT JOIN bt ON bt.kind = a.kind AND bt.t = a.low
    LEFT JOIN bs ON bs.kind = a.kind AND bs.low = a.low""",
)
def _(spark, d):
    items = entries(spark, d).select("kind", "pos", "title", "year", "author")
    return lookups.open_items(addresses(spark, d), items)


@query(
    "outbound_links",
    f"""WITH {CAT}, l AS (SELECT kind, pos, imdb_id, {encode("title || ' ' || coalesce(CAST(year AS VARCHAR), 'null')")} AS e FROM cat)
    SELECT kind, pos, CASE WHEN coalesce(imdb_id, '') <> '' THEN 'https://www.imdb.com/title/' || imdb_id || '/' ELSE 'https://www.imdb.com/find/?q=' || e END AS imdb_url,
    'https://www.rottentomatoes.com/search?search=' || e AS rt_url, 'https://www.metacritic.com/search/' || e || '/' AS mc_url FROM l""",
)
def _(spark, d):
    links = search_links(F.col("title"), F.col("year"), F.col("imdb_id"))
    return entries(spark, d).select("kind", "pos", links.alias("l")).select("kind", "pos", "l.*")


# ---- recents ----


@query(
    "recent_items",
    """WITH u AS (SELECT user_id, event_type AS kind, json_extract_string(props, '$.k') AS item_id, ts, event_id FROM events),
    l AS (SELECT user_id, kind, item_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM u GROUP BY 1, 2, 3)
    SELECT user_id, kind, item_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank, rank <= 5 AS shown
    FROM l QUALIFY rank <= 8""",
)
def _(spark, d):
    uses = read_table(spark, d, "events").select(
        "user_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("item_id"), "ts", "event_id"
    )
    return lookups.recent_items(uses).select("user_id", "kind", "item_id", "event_id", "rank", "shown")


@query(
    "resolve_recents",
    f"""WITH {CAT}, r AS (SELECT event_id AS recent_id, kind, upper(replace(title, 'ß', 's')) AS title,
      CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN year ELSE year + 1 END AS year,
      CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN author ELSE author || '?' END AS author
      FROM events JOIN cat ON cat.pos = event_id // 10 WHERE kind IN ('games', 'books')),
    c AS (SELECT kind, pos, lower(title) AS t, CASE WHEN kind = 'books' THEN author ELSE CAST(year AS VARCHAR) END AS other FROM cat)
    SELECT r.recent_id, r.kind, r.title, min(c.pos) AS pos FROM r LEFT JOIN c ON c.kind = r.kind AND c.t = lower(r.title)
      AND (nullif(CASE WHEN r.kind = 'books' THEN r.author ELSE CAST(r.year AS VARCHAR) END, '') IS NULL OR nullif(c.other, '') IS NULL
        OR c.other = CASE WHEN r.kind = 'books' THEN r.author ELSE CAST(r.year AS VARCHAR) END)
    GROUP BY 1, 2, 3""",
)
def _(spark, d):
    items = entries(spark, d).filter("kind IN ('games', 'books')").select("kind", "pos", "title", "year", "author")
    ev = read_table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("pos"))
    case = F.col("event_id") % 3
    recents = ev.join(items, "pos").select(
        F.col("event_id").alias("recent_id"), "kind", F.upper(F.translate("title", "ß", "s")).alias("title"),
        F.when(case == 1, F.col("year")).when(case == 2, F.col("year") + 1).alias("year"),
        F.when(case == 1, F.col("author")).when(case == 2, F.concat("author", F.lit("?"))).alias("author"),
    )
    return lookups.resolve_recents(recents, items)


# ---- artwork: an article table derived from the documents ----


def articles(spark, d) -> DataFrame:
    p = F.col("pos")
    q = F.floor(p / 4)
    word = F.when(F.col("kind") == "games", "video game").when(F.col("kind") == "shows", "TV series").otherwise("film")
    year = F.coalesce(F.col("year").cast("string"), F.lit("null"))
    name = (
        F.when(q % 6 == 0, F.concat("title", F.lit(" ("), year, F.lit(" "), word, F.lit(")")))
        .when(q % 6 == 1, F.concat("title", F.lit(" ("), word, F.lit(")")))
        .when(q % 6 == 2, F.col("title"))
        .when(q % 6 == 3, F.concat("title", F.lit("!! (1982 "), word, F.lit(")")))
        .when(q % 6 == 4, F.concat(F.lit("On "), "title"))
        .otherwise(F.concat("title", F.lit(" ("), year, F.lit(" American "), word, F.lit(")")))
    )
    src = F.concat(F.lit("https://img.example.org/"), p.cast("string"), F.lit("/"), (q % 7 * 100 + 30).cast("string"), F.lit("px-a.jpg"))
    return entries(spark, d).filter("kind <> 'books'").select(
        p.alias("article_id"),
        name.alias("article"),
        F.when(q % 5 < 3, src).alias("thumb"),
        F.when(q % 5 < 4, F.concat(F.lit("https://img.example.org/"), p.cast("string"), F.lit("/a.jpg"))).alias("original"),
        (q % 10 * 120).cast("int").alias("original_width"),
        F.when(q % 11 == 0, "disambiguation").otherwise("standard").alias("type"),
    )


_STEP = "list_filter([20, 40, 60, 120, 250, 330, 500, 960, 1280, 1920, 3840], lambda s: s >= greatest(w, want))[1]"
ARTICLES = f"""{CAT},
art0 AS (SELECT pos AS article_id, kind, title, pos // 4 AS q, coalesce(CAST(year AS VARCHAR), 'null') AS y,
  CASE kind WHEN 'games' THEN 'video game' WHEN 'shows' THEN 'TV series' ELSE 'film' END AS word FROM cat WHERE kind <> 'books'),
art1 AS (SELECT article_id, q, CASE q % 6 WHEN 0 THEN title || ' (' || y || ' ' || word || ')' WHEN 1 THEN title || ' (' || word || ')'
    WHEN 2 THEN title WHEN 3 THEN title || '!! (1982 ' || word || ')' WHEN 4 THEN 'On ' || title
    ELSE title || ' (' || y || ' American ' || word || ')' END AS article,
  CASE WHEN q % 5 < 3 THEN q % 7 * 100 + 30 END AS w, CASE WHEN q % 5 < 4 THEN 'https://img.example.org/' || article_id || '/a.jpg' END AS original,
  CASE WHEN q % 10 * 120 >= 500 THEN 500 ELSE 0 END AS want, q % 11 = 0 AS disambiguation FROM art0),
art AS (SELECT article_id, article, disambiguation, CASE WHEN disambiguation THEN NULL WHEN w IS NULL THEN original
  ELSE 'https://img.example.org/' || article_id || '/' || coalesce({_STEP}, w) || 'px-a.jpg' END AS picture FROM art1),
it AS (SELECT kind, pos, title, coalesce(CAST(year AS VARCHAR), 'null') AS y, CASE kind WHEN 'shows' THEN 'TV series' ELSE 'film' END AS word FROM cat WHERE kind <> 'books'),
tries AS (
  SELECT kind, pos, 0 AS pr, title || ' (' || y || CASE WHEN kind = 'games' THEN ' video game' ELSE ' ' || word END || ')' AS article FROM it
  UNION ALL SELECT kind, pos, 1, title || ' (' || CASE WHEN kind = 'games' THEN 'video game' ELSE word END || ')' FROM it
  UNION ALL SELECT kind, pos, 2, title || ' (' || y || ' American ' || word || ')' FROM it WHERE kind <> 'games'
  UNION ALL SELECT kind, pos, 3, title FROM it),
one AS (SELECT article, min(picture) AS picture FROM art WHERE NOT disambiguation GROUP BY article),
tr AS (SELECT kind, pos, arg_min(picture, pr) FILTER (picture IS NOT NULL) AS direct, arg_min(article, pr) AS page FROM tries JOIN one USING (article) GROUP BY 1, 2),
se AS (SELECT {fold_loose("regexp_replace(article, '[ ]*[(][^)]*[)][ ]*$', '')")} AS f, arg_min(picture, article_id) AS found FROM art WHERE picture IS NOT NULL GROUP BY 1),
pic AS (SELECT it.kind, it.pos, it.title, coalesce(direct, found) AS picture, page,
  CASE WHEN direct IS NOT NULL THEN 'article' WHEN found IS NOT NULL THEN 'search' ELSE 'none' END AS how
  FROM it LEFT JOIN tr ON tr.kind = it.kind AND tr.pos = it.pos LEFT JOIN se ON se.f = {fold_loose('it.title')})"""


@query("artwork_candidates", f"WITH {ARTICLES} SELECT kind, pos, picture, page, how FROM pic")
def _(spark, d):
    items = entries(spark, d).select("kind", "pos", "title", "year")
    return lookups.artwork_candidates(items, articles(spark, d)).select("kind", "pos", "picture", "page", "how")


@query(
    "thumb_width_step",
    f"WITH {ARTICLES} SELECT article_id, 'https://img.example.org/' || article_id || '/' || coalesce({_STEP}, w) || 'px-a.jpg' AS picture FROM art1 WHERE w IS NOT NULL",
)
def _(spark, d):
    from ..functions.scores import thumb_step

    want = F.when(F.col("original_width") >= 500, F.lit(500)).otherwise(F.lit(0))
    art = articles(spark, d).filter("thumb IS NOT NULL")
    return art.select("article_id", thumb_step(F.col("thumb"), want).alias("picture"))


def media_files(spark, d) -> DataFrame:
    """Files listed on article pages: three per article, of various names."""
    art = articles(spark, d).select("article_id", F.col("article").alias("page"))
    base = F.regexp_replace("page", r"\s*\([^)]*\)\s*$", "")
    names = F.array(
        F.concat(F.lit("File:Photo of "), base, F.lit(".jpg")),
        F.concat(F.lit("File:"), base, F.when(F.col("article_id") % 3 == 0, F.lit(" festival.jpg")).otherwise(F.lit(" Title-card.png"))),
        F.concat(F.lit("File:"), base, F.lit(" logo.svg")),
    )
    return art.select("page", "article_id", F.posexplode(names).alias("n", "file")).select(
        "page", (F.col("article_id") * 3 + F.col("n")).alias("place"), "file",
        F.concat(F.lit("https://img.example.org/m/"), (F.col("article_id") * 3 + F.col("n")).cast("string")).alias("src"),
    )


@query(
    "media_file_fallback",
    f"""WITH {ARTICLES}, b AS (SELECT article_id, article AS page, regexp_replace(article, '[ ]*[(][^)]*[)][ ]*$', '') AS base FROM art1),
    md AS (SELECT page, article_id * 3 AS place, 'Photo of ' || base || '.jpg' AS file FROM b
      UNION ALL SELECT page, article_id * 3 + 1, base || CASE WHEN article_id % 3 = 0 THEN ' festival.jpg' ELSE ' Title-card.png' END FROM b
      UNION ALL SELECT page, article_id * 3 + 2, base || ' logo.svg' FROM b)
    SELECT kind, pos, 'https://img.example.org/m/' || min(place) AS picture FROM pic JOIN md USING (page)
    WHERE picture IS NULL AND regexp_matches(file, '(?i)poster|logo|cover|title.?card|box.?art|intertitle')
      AND starts_with({fold_loose('file')}, {fold_loose('title')}) GROUP BY 1, 2""",
)
def _(spark, d):
    items = entries(spark, d).select("kind", "pos", "title", "year")
    art = lookups.artwork_candidates(items, articles(spark, d))
    missing = art.filter(F.col("picture").isNull()).select("kind", "pos", "title", "page")
    return lookups.media_file_fallback(missing, media_files(spark, d))


@query(
    "book_cover_lookup",
    f"""WITH {CAT}, bk AS (SELECT kind, pos, title, author, pos // 4 AS q FROM cat WHERE kind = 'books'),
    ed AS (SELECT pos AS edition_id, {fold_loose("CASE WHEN q % 5 = 4 THEN title || ' reissue' ELSE title END")} AS t,
      {fold_loose("CASE WHEN q % 3 = 0 THEN author ELSE 'anon' END")} AS a, CASE WHEN q % 4 <> 0 THEN pos + 5000 END AS cover_id FROM bk),
    e AS (SELECT t, a, arg_min(cover_id, edition_id) AS c FROM ed WHERE cover_id IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT t, arg_min(cover_id, edition_id) AS c FROM ed WHERE cover_id IS NOT NULL GROUP BY 1)
    SELECT kind, pos, title, coalesce(e.c, l.c) AS cover_id,
      CASE WHEN e.c IS NOT NULL THEN 'title and author' WHEN l.c IS NOT NULL THEN 'title' ELSE 'none' END AS how
    FROM bk LEFT JOIN e ON e.t = {fold_loose('title')} AND e.a = {fold_loose('author')} LEFT JOIN l ON l.t = {fold_loose('title')}""",
)
def _(spark, d):
    books = entries(spark, d).filter("kind = 'books'").select("kind", "pos", "title", "author")
    q = F.floor(F.col("pos") / 4)
    editions = books.select(
        F.col("pos").alias("edition_id"),
        F.when(q % 5 == 4, F.concat("title", F.lit(" reissue"))).otherwise(F.col("title")).alias("title"),
        F.when(q % 3 == 0, F.col("author")).otherwise("anon").alias("author"),
        F.when(q % 4 != 0, F.col("pos") + 5000).alias("cover_id"),
    )
    return lookups.book_covers(books, editions)
