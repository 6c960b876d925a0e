"""Oracle SQL of the recommendation build."""

from __future__ import annotations

from ..functions import fixed
from ..operators.similarity import AXES, Lexicon
from .oracle import NUM, base_title, norm, q

# Words of the test corpus that stand in for seeds, since the fixed lists are English.
EXTRA = {
    "moral": "rewh orantion", "interior": "thatin", "system": "ononst", "uncanny": "hehely", "youth": "eux",
    "deduction": "orre", "making": "tre", "journey": "ier", "confine": "sch", "violence": "ung", "wonder": "eau",
    "history": "elle", "future": "aux", "warm": "thon", "grim": "thha", "epic": "thre", "small": "thnt",
}
LEX = Lexicon.fixed(EXTRA)


def each(template: str, sep: str = ", ", names=AXES) -> str:
    return sep.join(template.replace("@", a) for a in names)


_STOP = ", ".join(q(w) for w in sorted(set(fixed.STOP.split()) | set(fixed.JARGON.split())))

WORDS = f"""{NUM},
occ AS (
  SELECT * FROM (SELECT kind, pos, genre, unnest(regexp_extract_all(lower(coalesce(blurb, '')), '[a-z]+')) AS word FROM cat)
  WHERE length(word) > 2 AND word NOT IN ({_STOP})
),
words AS MATERIALIZED (SELECT kind, pos, genre, word, count(*) AS tf FROM occ GROUP BY ALL),
dfs AS (SELECT word, count(*) AS df FROM words GROUP BY word)"""

_SEEDS = ", ".join(f"({q(n)}, {q(w)})" for n, w in LEX.rows())


def inflect_sql(w: str) -> str:
    stem = f"left({w}, length({w}) - 1)"
    return f"""[{w},
      CASE WHEN regexp_matches({w}, '[^aeiou]y$') THEN {stem} || 'ies'
           WHEN regexp_matches({w}, '(s|x|z|ch|sh)$') THEN {w} || 'es' ELSE {w} || 's' END,
      CASE WHEN {w} LIKE '%e' THEN {w} || 'd' ELSE {w} || 'ed' END,
      CASE WHEN {w} LIKE '%e' THEN {stem} || 'ing' ELSE {w} || 'ing' END,
      {w} || 'ly']"""


_PRIORS = ", ".join(
    "(" + ", ".join([q(g), *[str(float(p.get(a, 0))) for a in [*AXES, "tone", "scale"]]]) + ")"
    for g, p in fixed.GENRE_PRIOR.items()
)
_GLEN = "sqrt(" + each("g_@ * g_@", " + ") + ")"

PRIORS = f"""prior0(genre, {each('g_@')}, prior_tone, prior_scale) AS (VALUES {_PRIORS}),
prior AS (SELECT genre, {each('CAST(g_@ AS DOUBLE) AS g_@')}, CAST(prior_tone AS DOUBLE) AS prior_tone, CAST(prior_scale AS DOUBLE) AS prior_scale,
  {each(f'CASE WHEN {_GLEN} > 0 THEN CAST(g_@ AS DOUBLE) / {_GLEN} ELSE 0 END AS u_@')} FROM prior0)"""

PARTS = f"""{WORDS}, {PRIORS},
seed(list, seed) AS (VALUES {_SEEDS}),
form AS (SELECT DISTINCT list, unnest({inflect_sql('seed')}) AS word FROM seed),
lex AS (SELECT word, {each("max(CASE WHEN list = '@' THEN 1 ELSE 0 END) AS hit_@")},
  max(CASE WHEN list = 'warm' THEN 1 ELSE 0 END) - max(CASE WHEN list = 'grim' THEN 1 ELSE 0 END) AS tone_hit,
  max(CASE WHEN list = 'epic' THEN 1 ELSE 0 END) - max(CASE WHEN list = 'small' THEN 1 ELSE 0 END) AS scale_hit
  FROM form GROUP BY word),
bas AS (SELECT count(*) AS n, {each('sum(coalesce(u_@, 0)) / count(*) AS m_@')},
  sum(coalesce(prior_tone, 0)) / count(*) AS m_tone, sum(coalesce(prior_scale, 0)) / count(*) AS m_scale
  FROM cat LEFT JOIN prior USING (genre)),
wsum AS (SELECT word, count(*) AS df, {each('sum(coalesce(u_@, 0)) AS s_@')}, sum(coalesce(prior_tone, 0)) AS s_tone,
  sum(coalesce(prior_scale, 0)) AS s_scale FROM words LEFT JOIN prior USING (genre) GROUP BY word),
learned AS (SELECT word, df, {each('(s_@ / df - m_@) * (df / (df + 8)) AS l_@', names=[*AXES, 'tone', 'scale'])}
  FROM wsum, bas WHERE df >= 3 AND df <= n * 0.05),
sums AS (SELECT kind, pos, {each('sum(coalesce(hit_@, 0) * tf) AS b_@')}, {each('sum(coalesce(l_@, 0) * tf) AS l_@')},
  sum(coalesce(tone_hit, 0) * tf) AS tone_hits, sum(coalesce(scale_hit, 0) * tf) AS scale_hits,
  sum(coalesce(l_tone, 0) * tf) AS l_tone, sum(coalesce(l_scale, 0) * tf) AS l_scale
  FROM words LEFT JOIN learned USING (word) LEFT JOIN lex USING (word) GROUP BY kind, pos),
parts AS MATERIALIZED (SELECT gid, num.kind, num.pos, kind_rank, idx, genre, {norm('title')} AS title_key, {base_title('title')} AS base_key,
  {norm('coalesce(author, creator)')} AS maker,
  CASE WHEN num.kind = 'books' THEN rating / 5 * 100 ELSE metacritic END AS score, ratings_count,
  {each('coalesce(g_@, 0) AS g_@')},
  {each('CAST(coalesce(b_@, 0) AS DOUBLE) AS b_@', names=[a for a in AXES if a != 'history'])},
  CAST(coalesce(b_history, 0) AS DOUBLE) + CASE WHEN regexp_matches(coalesce(blurb, ''), '\\b(1[0-9][0-9][0-9]|20[0-2][0-9])s?\\b') THEN 0.5 ELSE 0 END AS b_history,
  {each('coalesce(l_@, 0) AS l_@')},
  coalesce(tone_hits, 0) AS tone_hits, coalesce(scale_hits, 0) AS scale_hits, coalesce(l_tone, 0) AS l_tone,
  coalesce(l_scale, 0) AS l_scale, coalesce(prior_tone, 0) AS prior_tone, coalesce(prior_scale, 0) AS prior_scale
  FROM num LEFT JOIN sums USING (kind, pos) LEFT JOIN prior USING (genre)),
hits AS (SELECT count(*) AS n, {each('count(*) FILTER (g_@ > 0 OR b_@ > 0) AS h_@')} FROM parts),
idf AS (SELECT n, {each('h_@')}, {each('ln(n / greatest(1, h_@)) / ln(20) AS i_@')} FROM hits)"""

_LEN = "sqrt(" + each("r_@ * r_@", " + ") + ")"

VECTORS = f"""{PARTS},
raw AS (SELECT gid, kind, pos, kind_rank, idx, title_key, base_key, maker, score,
  coalesce(score >= 60, false) AND NOT (kind = 'books' AND coalesce(ratings_count, 250) < 250) AS eligible,
  {each('greatest(0, 0.42::DOUBLE * sqrt(g_@) + 2.30::DOUBLE * sqrt(b_@) + 1.45::DOUBLE * l_@) * i_@ AS r_@')},
  round(greatest(-1, least(1, prior_tone + tone_hits * 0.55::DOUBLE + 1.3::DOUBLE * l_tone)), 9) AS tone,
  round(greatest(-1, least(1, prior_scale + scale_hits * 0.45::DOUBLE + 1.3::DOUBLE * l_scale)), 9) AS scale
  FROM parts, idf),
vec AS MATERIALIZED (SELECT gid, kind, pos, kind_rank, idx, title_key, base_key, maker, score, eligible, tone, scale,
  {each(f'round(CASE WHEN {_LEN} > 0 THEN r_@ / {_LEN} ELSE 0 END, 9) AS v_@')} FROM raw)"""

RELATED = """(i.title_key = j.title_key OR (i.base_key <> '' AND i.base_key = j.base_key)
  OR (length(i.title_key) >= 8 AND length(j.title_key) >= 8 AND left(i.title_key, 8) = left(j.title_key, 8)))"""
SAME_MAKER = "(i.maker <> '' AND i.maker = j.maker)"
_COS = each("i.v_@ * j.v_@", " + ")


def score_sql(shared: str) -> str:
    return f"""((({_COS}) + CASE WHEN {shared} > 0 THEN 0.85::DOUBLE * least({shared}, 3) / 3 ELSE 0 END
      - 0.30::DOUBLE * abs(i.scale - j.scale) + 0.10::DOUBLE * ((j.score - 60) / 40::DOUBLE))
      * greatest(0, 1 - 0.62::DOUBLE * abs(i.tone - j.tone) * abs(i.tone - j.tone)))"""


_LOW = [f"least(i.v_{a}, j.v_{a})" for a in AXES]
_TOP = "greatest(" + ", ".join(_LOW) + ")"
AXIS = f"(CASE WHEN {_TOP} <= 0 THEN -1 " + " ".join(f"WHEN {low} = {_TOP} THEN {k}" for k, low in enumerate(_LOW)) + " END)"

RARE = f"""{VECTORS},
rare AS (SELECT words.kind, words.pos, word, gid, kind_rank, eligible FROM words JOIN dfs USING (word) JOIN vec USING (kind, pos)
  WHERE df BETWEEN 2 AND 40),
pairs AS MATERIALIZED (SELECT a.gid, b.gid AS neighbour, count(*) AS shared FROM rare a JOIN rare b USING (word)
  WHERE a.kind_rank <> b.kind_rank AND b.eligible GROUP BY ALL)"""

CANDS = f"""{RARE},
allp AS (SELECT i.gid, i.kind_rank, j.kind_rank AS target_rank, j.gid AS neighbour,
  {score_sql('coalesce(p.shared, 0)')} AS sim, {AXIS} AS axis
  FROM vec i JOIN vec j ON j.eligible AND j.kind_rank <> i.kind_rank
  LEFT JOIN pairs p ON p.gid = i.gid AND p.neighbour = j.gid
  WHERE NOT {RELATED} AND NOT {SAME_MAKER}),
cand AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid, target_rank ORDER BY sim DESC, neighbour) AS place
  FROM allp WHERE sim >= 0.22) WHERE place <= 8)"""

SLOTS = f"""{CANDS},
slots AS (SELECT gid, kind_rank, target_rank, neighbour, axis, sim, place AS pick,
  row_number() OVER (PARTITION BY gid ORDER BY target_rank, place) - 1 AS slot FROM cand WHERE place <= 3)"""

# The serial rule itself: one item per step in turn order, inbound counts in a list.
_TAKE = "list_filter(t.c{k}, lambda x: s.inbound[x + 1] < 40)[1:3]"
ASSIGNED = f"""RECURSIVE {CANDS},
turns AS MATERIALIZED (SELECT num.gid, row_number() OVER (ORDER BY num.idx, num.kind_rank) AS turn,
  {', '.join(f"coalesce(list(c.neighbour ORDER BY c.place) FILTER (c.target_rank = {k}), []) AS c{k}" for k in range(4))}
  FROM num LEFT JOIN cand c ON c.gid = num.gid GROUP BY num.gid, num.idx, num.kind_rank),
walk AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS gid, list_transform(range((SELECT count(*) FROM num)), lambda x: 0) AS inbound,
    CAST([] AS BIGINT[]) AS picks
  UNION ALL
  SELECT turn, gid, list_transform(inbound, lambda x, i: x + CASE WHEN list_contains(picks, i - 1) THEN 1 ELSE 0 END), picks
  FROM (SELECT t.turn, t.gid, s.inbound, {' || '.join(_TAKE.format(k=k) for k in range(4))} AS picks
        FROM walk s JOIN turns t ON t.turn = s.turn + 1)
),
taken AS (SELECT gid, unnest(picks) AS neighbour, unnest(range(len(picks))) AS slot FROM walk WHERE turn > 0),
aslots AS (SELECT k.gid, c.target_rank, k.neighbour, k.slot, c.axis, c.sim, c.kind_rank,
  row_number() OVER (PARTITION BY k.gid, c.target_rank ORDER BY c.place) AS pick
  FROM taken k JOIN cand c ON c.gid = k.gid AND c.neighbour = k.neighbour)"""
