"""Building blocks of the oracle SQL: the derived catalogue and the text keys in SQL."""

from __future__ import annotations

from ..schema import KINDS
from ..sources.catalogue import GENRES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def _genre_case() -> str:
    arms = " ".join(
        f"WHEN kind = '{k}' THEN ({sql_list(GENRES[k])})[CAST(q % {len(GENRES[k])} AS INTEGER) + 1]" for k in KINDS
    )
    return f"CASE {arms} END"


# The derived catalogue; the same columns as sources.catalogue.catalogue.
CAT = f"""
base AS (
  SELECT d.*, l.quality, d.doc_id // 4 AS q,
         ({sql_list(KINDS)})[CAST(substr(d.source, 4) AS INTEGER) % 4 + 1] AS kind,
         regexp_extract(d.text, '^[ \\t\\r\\n]*((?:[^ \\t\\r\\n]+[ \\t\\r\\n]+){{0,3}}[^ \\t\\r\\n]+)', 1) AS head,
         d.lang || ' ' || ((d.doc_id // 4) % 50) AS person
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
cat AS (
  SELECT kind, doc_id AS pos,
    regexp_replace(head, '[ \\t\\r\\n]+', ' ', 'g') AS title,
    CAST(CASE WHEN kind = 'books' AND q % 61 = 0 THEN -(doc_id % 700) - 1
              WHEN q % 53 <> 0 THEN 1920 + doc_id % 105 END AS INTEGER) AS year,
    {_genre_case()} AS genre,
    text AS blurb,
    (kind <> 'books' AND coalesce(quality, 0) = 1) AS verified,
    CAST(CASE WHEN kind <> 'books' AND q % 7 <> 0 THEN 40 + (doc_id * 7) % 60 END AS INTEGER) AS metacritic,
    CASE WHEN kind = 'games' AND q % 6 <> 0 THEN CAST(40 + (doc_id * 3) % 57 AS DOUBLE) / 10 END AS ign,
    CASE WHEN kind = 'games' AND q % 5 <> 0 THEN CAST(30 + (doc_id * 13) % 67 AS DOUBLE) / 10 END AS user_score,
    CASE WHEN kind IN ('movies', 'shows') AND q % 5 <> 0 THEN CAST(30 + (doc_id * 3) % 65 AS DOUBLE) / 10 END AS imdb,
    CAST(CASE WHEN kind IN ('movies', 'shows') AND q % 3 <> 0 THEN 20 + (doc_id * 11) % 80 END AS INTEGER) AS rt,
    CASE WHEN kind IN ('movies', 'shows') AND q % 8 <> 0 THEN person END AS creator,
    CASE WHEN kind = 'books' THEN person END AS author,
    CASE WHEN kind = 'books' AND q % 9 <> 0 THEN CAST(25 + q % 25 AS DOUBLE) / 10 END AS rating,
    CASE WHEN kind = 'books' THEN n_chars END AS ratings_count,
    CAST(CASE WHEN kind = 'movies' AND q % 10 <> 0 THEN 60 + q % 120
              WHEN kind = 'shows' AND q % 11 <> 0 THEN 20 + q % 45 END AS INTEGER) AS runtime,
    CAST(CASE WHEN kind = 'shows' THEN q % 8 END AS INTEGER) AS seasons,
    CASE WHEN kind = 'books' THEN '978' || lpad(CAST(doc_id AS VARCHAR), 10, '0') END AS isbn,
    CASE WHEN kind = 'games' THEN doc_id + 1000 END AS steam_app_id,
    CASE WHEN kind IN ('movies', 'shows') AND q % 3 <> 0 THEN '/p' || doc_id || '.jpg' END AS poster_path,
    CASE WHEN kind IN ('movies', 'shows') AND q % 4 <> 0
         THEN 'tt' || lpad(CAST(doc_id AS VARCHAR), 7, '0') END AS imdb_id,
    CASE WHEN kind IN ('movies', 'shows') THEN CAST(doc_id AS VARCHAR) END AS tmdb_id
  FROM base
)"""

KIND_RANK = "(list_position(['games', 'books', 'movies', 'shows'], kind) - 1)"

# The catalogue with dense numbers.
NUM = f"""{CAT},
num AS (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY pos) - 1 AS idx,
         CAST({KIND_RANK} AS INTEGER) AS kind_rank,
         row_number() OVER (ORDER BY {KIND_RANK}, pos) - 1 AS gid
  FROM cat
)"""

BEST = "coalesce(metacritic, CAST(floor(imdb * 10 + 0.5) AS INTEGER), rt, 0)"
HAY = "lower(coalesce(title, '') || ' ' || coalesce(creator, '') || ' ' || coalesce(genre, '') || ' ' || coalesce(blurb, ''))"
ITEM_KEY = "(coalesce(title, '') || '|' || CASE WHEN kind = 'books' THEN coalesce(author, '') ELSE coalesce(CAST(year AS VARCHAR), '') END)"

# Toggled favourites and finished items, both from the event stream.
MARKS = """
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
),
fav AS (
  SELECT DISTINCT k AS pos FROM (
    SELECT user_id, k FROM ev WHERE event_type = 'click' GROUP BY user_id, k HAVING count(*) % 2 = 1)
),
done AS (
  SELECT DISTINCT k AS pos FROM (
    SELECT user_id, k FROM ev WHERE event_type = 'purchase' GROUP BY user_id, k HAVING count(*) % 2 = 1)
)"""


def fold(x: str) -> str:
    return (
        r"regexp_replace(regexp_replace(replace(strip_accents(lower(coalesce(" + x + r", ''))), '&', ' and '), "
        r"'\b(the|a|an)\b', ' ', 'g'), '[^a-z0-9]+', '', 'g')"
    )


def fold_loose(x: str) -> str:
    return f"regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^a-z0-9]+', '', 'g')"


def slug(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace(replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '&', ' and '), "
        "'[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
    )


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def base_title(x: str) -> str:
    bare = f"regexp_replace({norm(x)}, '^(the|a|an) ', '')"
    cut = f"regexp_split_to_array({bare}, ' (?:vol|volume|part|book|season|episode) ')[1]"
    return rf"trim(regexp_replace({cut}, '\s+\d+$', ''))"


def jsround(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS INTEGER)"


def encode(x: str) -> str:
    e = f"url_encode({x})"
    for coded, plain in [("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")]:
        e = f"replace({e}, '{coded}', '{plain}')"
    return e
