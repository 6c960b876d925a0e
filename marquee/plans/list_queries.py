"""Users' lists: matching, ranking; score reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold_title
from ..operators import backlog, matching, reconcile as rec
from ..sources.catalogue import entries, number_items
from ..sources.lists import list_rows, lookup_cache
from .oracle import CAT, NUM, fold, jsround, slug
from .registry import query

LISTS = f"""{CAT},
lists AS (
  SELECT user_id, event_id AS row_id, kind,
    CASE WHEN event_id % 13 = 0 THEN title || ' nowhere known' WHEN event_id % 5 = 1 THEN 'The ' || lower(title)
         WHEN event_id % 5 = 2 THEN title || '!' ELSE title END AS title,
    CASE WHEN event_id % 3 = 0 THEN coalesce(author, '') ELSE '' END AS creator,
    CAST(CASE WHEN event_id % 11 <> 0 THEN year + (event_id % 9 - 4) END AS INTEGER) AS year,
    CASE WHEN kind = 'books' AND event_id % 6 <> 0 THEN CAST(60 + event_id % 900 AS DOUBLE) END AS pages,
    CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 5 AS DOUBLE) END AS my_rating,
    CASE WHEN event_id % 4 <> 0 AND value <= 10 THEN value END AS their_rating,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'doing' ELSE 'todo' END AS status
  FROM events JOIN cat ON cat.pos = event_id // 10
)"""

MATCHED = f"""{LISTS},
ck AS (SELECT kind, pos, year, {fold('title')} AS fk FROM cat),
m0 AS (SELECT l.row_id, count(c.pos) AS matches, min(c.pos) AS p
  FROM lists l LEFT JOIN ck c ON c.kind = l.kind AND c.fk = {fold('l.title')} AND c.fk <> ''
    AND (c.year IS NULL OR l.year IS NULL OR abs(c.year - l.year) <= 3) GROUP BY l.row_id),
matched AS (SELECT l.*, m0.matches, CASE WHEN m0.matches = 1 THEN m0.p END AS match_pos FROM lists l JOIN m0 USING (row_id))"""

_RANGE = "CASE WHEN m.their_rating > 5 THEN 10 ELSE 5 END"

ENRICHED = f"""{MATCHED},
enr AS (
  SELECT m.user_id, m.row_id, m.kind, m.status, m.matches, coalesce(nullif(c.title, ''), m.title) AS title,
    coalesce(nullif(m.creator, ''), c.author, c.creator, '') AS creator, coalesce(nullif(m.year, 0), nullif(c.year, 0)) AS year,
    coalesce(c.genre, '') AS genre, m.match_pos IS NOT NULL AS in_catalogue,
    CASE WHEN m.kind = 'books' THEN {jsround('m.pages * 1.1::DOUBLE')} WHEN m.kind = 'movies' THEN nullif(c.runtime, 0)
         WHEN m.kind = 'shows' THEN nullif(c.runtime, 0) * 10 * coalesce(nullif(c.seasons, 0), 1) END AS minutes,
    CASE WHEN m.kind = 'books' AND c.rating IS NOT NULL THEN {jsround('c.rating / 5 * 100')}
         WHEN c.metacritic IS NOT NULL THEN c.metacritic
         WHEN m.their_rating IS NOT NULL THEN {jsround(f'm.their_rating / {_RANGE} * 100')} END AS score,
    CASE WHEN m.kind = 'books' AND c.rating IS NOT NULL THEN 'shelf' WHEN c.metacritic IS NOT NULL THEN 'critics'
         WHEN m.their_rating IS NOT NULL THEN 'community' ELSE 'none' END AS basis,
    coalesce(m.kind <> 'books' AND c.metacritic IS NOT NULL AND c.verified, false) AS verified
  FROM matched m LEFT JOIN cat c ON c.kind = m.kind AND c.pos = m.match_pos
)"""

FIT = "status = 'todo' AND (score IS NULL OR score >= 60) AND minutes IS NOT NULL AND minutes <= 480"


def _enriched(spark, d):
    return backlog.enrich(list_rows(spark, d), entries(spark, d))


@query("fold_title_groups", f"WITH {CAT} SELECT kind, {fold('title')} AS fold_key, count(*) AS n FROM cat GROUP BY ALL")
def _(spark, d):
    return entries(spark, d).groupBy("kind", fold_title(F.col("title")).alias("fold_key")).agg(F.count("*").alias("n"))


@query("match_backlog", f"WITH {MATCHED} SELECT user_id, row_id, kind, title, year, matches, match_pos FROM matched")
def _(spark, d):
    rows = matching.match_lists(list_rows(spark, d), matching.title_index(entries(spark, d)))
    return rows.select("user_id", "row_id", "kind", "title", "year", "matches", "match_pos")


@query("ambiguity_count", f"WITH {MATCHED} SELECT kind, matches, count(*) AS n_rows FROM matched GROUP BY ALL")
def _(spark, d):
    rows = matching.match_lists(list_rows(spark, d), matching.title_index(entries(spark, d)))
    return rows.groupBy("kind", "matches").agg(F.count("*").alias("n_rows"))


_ENR_COLS = "user_id, row_id, kind, status, title, creator, year, genre, minutes, score, basis, verified, in_catalogue"


@query("enrich_backlog", f"WITH {ENRICHED} SELECT {_ENR_COLS} FROM enr")
def _(spark, d):
    return _enriched(spark, d).select(*_ENR_COLS.split(", "))


@query(
    "quality_and_minutes",
    f"WITH {ENRICHED} SELECT kind, basis, verified, count(*) AS n, CAST(sum(score) AS BIGINT) AS score, CAST(sum(minutes) AS BIGINT) AS minutes FROM enr GROUP BY ALL",
)
def _(spark, d):
    return _enriched(spark, d).groupBy("kind", "basis", "verified").agg(
        F.count("*").alias("n"), F.sum("score").alias("score"), F.sum("minutes").alias("minutes")
    )


@query("filter_export_status", f"WITH {ENRICHED} SELECT row_id, status FROM enr WHERE status = 'doing'")
def _(spark, d):
    return backlog.eligible(_enriched(spark, d), status="doing").select("row_id", "status")


@query("filter_floor", f"WITH {ENRICHED} SELECT row_id, score FROM enr WHERE score IS NULL OR score >= 70")
def _(spark, d):
    return backlog.eligible(_enriched(spark, d), status="any", min_score=70).select("row_id", "score")


@query("filter_budget", f"WITH {ENRICHED} SELECT row_id, minutes FROM enr WHERE minutes IS NOT NULL AND minutes <= 120")
def _(spark, d):
    return backlog.eligible(_enriched(spark, d), status="any", minutes=120).select("row_id", "minutes")


@query(
    "rank_backlog",
    f"""WITH {ENRICHED} SELECT user_id, row_id, kind, title, score, minutes, basis, row_number() OVER (PARTITION BY user_id
      ORDER BY score DESC NULLS LAST, minutes ASC NULLS LAST, row_id) AS rank FROM enr WHERE {FIT}
    QUALIFY rank <= 100""",
)
def rank_backlog(spark, d):
    rows = backlog.eligible(_enriched(spark, d), minutes=480, min_score=60)
    return backlog.rank_backlog(rows).select("user_id", "row_id", "kind", "title", "score", "minutes", "basis", "rank")


@query("sorted_backlog", f"WITH {ENRICHED} SELECT user_id, row_id, score, minutes FROM enr WHERE status = 'todo'")
def _(spark, d):
    rows = backlog.eligible(_enriched(spark, d))
    return backlog.rank_backlog(rows, limit=None).select("user_id", "row_id", "score", "minutes")


@query(
    "backlog_stats",
    f"""WITH {ENRICHED} SELECT user_id, count(*) AS total, count(*) FILTER (status = 'todo') AS considered,
    count(*) FILTER (status = 'todo' AND in_catalogue) AS matched, count(*) FILTER (status = 'todo' AND minutes > 0) AS timed,
    count(*) FILTER ({FIT}) AS shown FROM enr GROUP BY user_id""",
)
def _(spark, d):
    return backlog.backlog_stats(_enriched(spark, d), minutes=480, min_score=60)


@query(
    "time_budget_options",
    f"""WITH {ENRICHED}, pre(kind, budget) AS (VALUES ('movies', 90), ('movies', 120), ('movies', 150), ('shows', 480),
      ('shows', 1200), ('shows', 3000), ('books', 240), ('books', 480), ('books', 900))
    SELECT user_id, kind, budget, count(*) FILTER (minutes <= budget) AS fits FROM enr JOIN pre USING (kind) GROUP BY ALL""",
)
def _(spark, d):
    return backlog.budget_options(spark, _enriched(spark, d))


# ---- reconciliation ----

_FIRST = f"""{CAT},
fw AS (SELECT kind, {slug('title')} AS slug, min(pos) AS pos, arg_min({{'title': title, 'year': year, 'metacritic': metacritic}}, pos) AS w
  FROM cat WHERE kind <> 'books' GROUP BY 1, 2),
lk0 AS (SELECT kind, slug, pos // 4 AS q, (pos // 4) % 10 AS c, w FROM fw WHERE (pos // 4) % 10 <> 0),
lk1 AS (SELECT *, CAST(w.year + CASE WHEN c = 3 THEN 6 ELSE q % 3 END AS INTEGER) AS y,
  CAST(CASE WHEN c <> 4 THEN coalesce(w.metacritic, 50) + (q % 3 - 1) END AS INTEGER) AS s FROM lk0),
lookup AS (SELECT kind, slug, c = 1 AS missing, CASE WHEN c = 1 THEN 404 ELSE 200 END AS status,
  CASE WHEN c = 2 THEN 'Zz ' || w.title WHEN c = 5 THEN w.title || ' Complete Edition' ELSE w.title END AS title,
  CASE WHEN kind = 'games' THEN s END AS headline, CASE WHEN kind = 'games' AND q % 4 <> 0 THEN s END AS pc,
  CASE WHEN kind = 'games' THEN y END AS game_year, CASE WHEN kind <> 'games' THEN s END AS score,
  CASE WHEN kind <> 'games' THEN y END AS screen_year FROM lk1)"""

_FA, _FB = fold("c.title"), fold("h.title")
_SHORT = "CASE WHEN length(fa) <= length(fb) THEN fa ELSE fb END"
_LONG = "CASE WHEN length(fa) <= length(fb) THEN fb ELSE fa END"

VERDICTS = f"""{_FIRST},
due AS (SELECT c.kind, c.pos, c.title, c.year, {slug('c.title')} AS slug, c.metacritic, c.verified FROM cat c
  WHERE c.kind = 'games' OR (c.kind IN ('movies', 'shows') AND c.metacritic IS NOT NULL)),
jj AS (SELECT c.*, h.slug IS NOT NULL AS hit, coalesce(h.missing, false) AS missing, h.title AS found_title, {_FA} AS fa, {_FB} AS fb,
  coalesce(h.game_year, h.screen_year) AS fy, CASE WHEN c.kind = 'games' THEN coalesce(h.pc, h.headline) ELSE h.score END AS t, h.pc
  FROM due c LEFT JOIN lookup h ON h.kind = c.kind AND h.slug = c.slug),
vv AS (SELECT *, CASE
    WHEN NOT hit OR missing OR (kind <> 'games' AND t IS NULL) THEN 'not found'
    WHEN NOT (fa <> '' AND fb <> '' AND (fa = fb OR (length({_SHORT}) >= 8 AND starts_with({_LONG}, {_SHORT})))) THEN 'title mismatch'
    WHEN NOT coalesce(CASE WHEN kind = 'games' THEN fy >= 1950 AND abs(year - fy) <= 2 ELSE fy >= 1880 AND abs(year - fy) <= 3 END, false) THEN 'year mismatch'
    WHEN t IS NULL THEN 'unscored' WHEN coalesce(t = metacritic, false) THEN 'agree' ELSE 'corrected' END AS verdict FROM jj),
verdicts AS (SELECT kind, pos, title, year, slug, metacritic, verified, verdict,
  CASE WHEN verdict IN ('agree', 'corrected') THEN t END AS truth,
  verdict IN ('agree', 'corrected') AND kind = 'games' AND pc IS NULL AS headline_only, found_title FROM vv)"""


def _verdicts(spark, d):
    return rec.reconcile(entries(spark, d), lookup_cache(spark, d))


@query("reconcile", f"WITH {VERDICTS} SELECT kind, pos, slug, verdict, truth, headline_only, found_title FROM verdicts")
def _(spark, d):
    return _verdicts(spark, d).select("kind", "pos", "slug", "verdict", "truth", "headline_only", "found_title")


@query(
    "reconcile_summary",
    f"WITH {VERDICTS} SELECT kind, verdict, count(*) AS n, count(*) FILTER (headline_only) AS headline_only FROM verdicts GROUP BY ALL",
)
def _(spark, d):
    return rec.reconcile_summary(_verdicts(spark, d))


@query(
    "sample_verdicts",
    f"""WITH {VERDICTS}, r AS (SELECT kind, pos, title, verdict, row_number() OVER (PARTITION BY kind, verdict ORDER BY pos) AS rank FROM verdicts)
    SELECT * FROM r WHERE (verdict = 'corrected' AND rank <= CASE kind WHEN 'games' THEN 15 ELSE 12 END)
      OR (verdict = 'year mismatch' AND rank <= CASE kind WHEN 'games' THEN 12 ELSE 10 END)
      OR (verdict IN ('title mismatch', 'not found') AND rank <= CASE kind WHEN 'games' THEN 10 ELSE 6 END)""",
)
def _(spark, d):
    return rec.sample_verdicts(_verdicts(spark, d)).select("kind", "pos", "title", "verdict", "rank")


@query(
    "pending_lookups",
    f"""WITH {_FIRST} SELECT DISTINCT kind, {slug('title')} AS slug FROM cat WHERE kind <> 'books'
    AND NOT EXISTS (SELECT 1 FROM lookup h WHERE h.kind = cat.kind AND h.slug = {slug('cat.title')})""",
)
def _(spark, d):
    return rec.pending_lookups(entries(spark, d).filter("kind <> 'books'"), lookup_cache(spark, d))


_SNAP = f"""{VERDICTS}, snap AS (SELECT c.kind, c.pos, CASE WHEN v.truth IS NOT NULL THEN v.truth ELSE c.metacritic END AS metacritic,
  CASE WHEN v.verdict IS NOT NULL THEN v.truth IS NOT NULL ELSE c.verified END AS verified,
  v.truth IS NOT NULL AND c.metacritic IS DISTINCT FROM v.truth AS changed,
  v.verdict IS NOT NULL AND c.verified <> (v.truth IS NOT NULL) AS badge_changed
  FROM cat c LEFT JOIN verdicts v ON v.kind = c.kind AND v.pos = c.pos)"""


@query("apply_updates", f"WITH {_SNAP} SELECT kind, pos, metacritic, verified, changed, badge_changed FROM snap")
def _(spark, d):
    snap = rec.apply_updates(entries(spark, d), _verdicts(spark, d))
    return snap.select("kind", "pos", "metacritic", "verified", "changed", "badge_changed")


@query(
    "update_counts",
    f"WITH {_SNAP} SELECT kind, count(*) FILTER (changed) AS changed, count(*) FILTER (badge_changed) AS badges FROM snap GROUP BY kind",
)
def _(spark, d):
    return rec.update_counts(rec.apply_updates(entries(spark, d), _verdicts(spark, d)))


@query("batch_keys", f"WITH {NUM} SELECT kind, pos, idx // 18 AS batch FROM num")
def _(spark, d):
    return rec.batch_keys(number_items(entries(spark, d).select("kind", "pos"))).select("kind", "pos", "batch")


@query(
    "confirmed_results",
    f"WITH {CAT} SELECT count(*) AS total, count(*) FILTER (pos % 3 <> 0 AND metacritic IS NOT NULL) AS confirmed FROM cat WHERE kind IN ('movies', 'shows')",
)
def _(spark, d):
    screen = entries(spark, d).filter("kind IN ('movies', 'shows')").select("kind", "pos", "title", "year", "metacritic")
    batched = rec.batch_keys(number_items(screen))
    result = F.struct(
        F.concat_ws("|", "title", "year").alias("key"), "metacritic", (F.col("pos") % 3 != 0).alias("found")
    )
    return rec.confirmed_results(batched.groupBy("kind", "batch").agg(F.collect_list(result).alias("results")))
