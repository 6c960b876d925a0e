"""Fuzzy title search."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions.scores import char_mask
from ..operators import fuzzy
from ..sources.catalogue import entries, read_table
from .oracle import BEST, CAT, q as quote
from .registry import query

WORDS = ["eau", "  Thnt  on ", "dra 195", "der ung", "é la", "fr 12", "horror", "zq", "mystery 19", "The And", "rts"]

_RAW = """concat_ws(' · ', nullif(CASE WHEN kind = 'books' THEN author WHEN kind <> 'games' THEN creator END, ''), nullif(genre, ''), CAST(nullif(year, 0) AS VARCHAR))"""
_BITS = " + ".join(
    [f"CASE WHEN contains(hay, '{chr(97 + i)}') THEN {1 << i} ELSE 0 END" for i in range(26)]
    + [f"CASE WHEN regexp_matches(hay, '[0-9]') THEN {1 << 26} ELSE 0 END"]
)
INDEX = f"""{CAT},
fx0 AS (SELECT kind, pos, title AS label, {_RAW} AS sub,
  greatest(0, least(1, CASE WHEN kind = 'games' THEN coalesce(metacritic, 0) / 100 WHEN kind = 'books' THEN coalesce(rating, 0) / 5 ELSE {BEST} / 100 END)) AS pop
  FROM cat WHERE coalesce(title, '') <> ''),
fx1 AS (SELECT *, CASE WHEN sub <> '' THEN label || ' ' || sub ELSE label END AS raw FROM fx0),
fx2 AS (SELECT *, CASE WHEN length(strip_accents(lower(raw))) = length(raw) THEN strip_accents(lower(raw)) ELSE lower(raw) END AS hay FROM fx1),
fx AS (SELECT kind, pos, label, sub, hay, CAST(length(label) AS INTEGER) AS tl, CAST({_BITS} AS INTEGER) AS mask, round(pop, 6) AS pop FROM fx2)"""


@query("fuzzy_index", f"WITH {INDEX} SELECT * FROM fx")
def _(spark, d):
    return fuzzy.fuzzy_index(entries(spark, d)).withColumn("pop", F.round("pop", 6))


_FLAT = "trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[ \\t\\n\\r\\f\\v\\x{A0}]+', ' ', 'g'), ' ')"


@query("norm_query", f"SELECT conv_id, turn, md5({_FLAT}) AS q, CAST(length({_FLAT}) AS INTEGER) AS n FROM conversations")
def _(spark, d):
    q = fuzzy.norm_query(F.col("text"))
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.md5(q).alias("q"), F.length(q).alias("n"))


@query(
    "char_mask",
    f"WITH h AS (SELECT conv_id, turn, lower(text) AS hay FROM conversations) SELECT conv_id, turn, CAST({_BITS} AS INTEGER) AS mask FROM h",
)
def _(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", char_mask(F.lower("text")).alias("mask"))


def _mask(q: str) -> int:
    """Bits of the letters and of any digit."""
    return sum(1 << k for k in {ord(c) - 97 if "a" <= c <= "z" else 26 for c in q if "a" <= c <= "z" or "0" <= c <= "9"})


PROBES = ["eau", "dra 195", "mystery 19", "qzx"]


@query(
    "mask_prefilter",
    f"WITH {INDEX} " + " UNION ALL ".join(
        f"SELECT {i} AS query_no, kind, count(*) AS candidates FROM fx WHERE ({_mask(q)} & ~mask) = 0 GROUP BY kind" for i, q in enumerate(PROBES)
    ),
)
def _(spark, d):
    index = fuzzy.fuzzy_index(entries(spark, d)).select("kind", "mask")
    probes = F.array(*[F.struct(F.lit(i).alias("query_no"), F.lit(_mask(q)).alias("qmask")) for i, q in enumerate(PROBES)])
    rows = index.select("kind", "mask", F.inline(probes)).filter(fuzzy.mask_allows(F.col("qmask"), F.col("mask")))
    return rows.groupBy("query_no", "kind").agg(F.count("*").alias("candidates"))


# ---- the scorer in SQL: placements as lists of places, walked character by character ----


def _flat(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return " ".join(bare.split())


_LEAD = "({i} = 1 OR NOT regexp_matches(substr(h, {i} - 1, 1), '^[A-Za-z0-9]$'))"
_NEXT = "instr(substr(h, CAST({a} AS INTEGER) + 1), c)"
_FORWARD = f"""list_reduce(ch, lambda a, c: CASE WHEN a = '-1' OR {_NEXT.format(a='a')} = 0 THEN '-1'
  ELSE CAST(CAST(a AS INTEGER) + {_NEXT.format(a='a')} AS VARCHAR) END, CAST(st AS VARCHAR))"""
_LIM = "CAST(split_part(a, ';', 1) AS INTEGER)"
_BACK_AT = f"({_LIM} - instr(reverse(left(h, {_LIM})), c) + 1)"
_BACKWARD = f"""list_reduce(list_reverse(ch), lambda a, c: CAST({_BACK_AT} - 1 AS VARCHAR) || ';' || {_BACK_AT} || ',' || split_part(a, ';', 2), fin || ';')"""
_LEADS_AFTER = f"list_filter(range({_LIM} + 1, e + 1), lambda i: substr(h, i, 1) = c AND {_LEAD.format(i='i')})"
_START_AT = f"CASE WHEN len({_LEADS_AFTER}) > 0 THEN {_LEADS_AFTER}[1] ELSE {_LIM} + {_NEXT.format(a=_LIM)} END"
_STARTS = f"""list_reduce(ch, lambda a, c: CASE WHEN a = '-1' OR {_NEXT.format(a="split_part(a, ';', 1)")} = 0 THEN '-1'
  ELSE CAST({_START_AT} AS VARCHAR) || ';' || split_part(a, ';', 2) || ({_START_AT}) || ',' END, '0;')"""
_JOINED = "p[k] = p[k - 1] + 1"
_RUN = "(k - list_max(list_filter(range(1, k + 1), lambda j: j = 1 OR p[j] <> p[j - 1] + 1)))"
_WORTH = f"""16 * n
  + coalesce(list_sum(list_transform(range(2, n + 1), lambda k: CASE WHEN {_JOINED} THEN 12 + 4 * least({_RUN}, 4) ELSE -least(4 * (p[k] - p[k - 1] - 1), 26) END)), 0)
  + list_sum(list_transform(p, lambda i: CASE WHEN i = 1 THEN 34 WHEN {_LEAD.format(i='i')} THEN 24 ELSE 0 END))
  + CASE WHEN n > 1 AND len(list_filter(p, lambda i: NOT {_LEAD.format(i='i')})) = 0 THEN 14 * n ELSE 0 END
  - least((p[1] - 1) * 1.2::DOUBLE, 24) - least(e, 70) * 0.18::DOUBLE
  + CASE WHEN p[n] - p[1] = n - 1 THEN 26 + CASE WHEN p[1] = 1 THEN 26 ELSE 0 END + CASE WHEN n = e THEN 30 ELSE 0 END ELSE 0 END"""
_PLACES = "list_transform(list_filter(string_split(csv, ','), lambda x: x <> ''), lambda x: CAST(x AS INTEGER))"


def hits_sql(queries: list[str]) -> str:
    """CTE `hit`: query_no, kind, pos, score, places (from 0) of every item at or above the floor."""
    values = ", ".join(f"({i}, {quote(_flat(w))}, {_mask(_flat(w))})" for i, w in enumerate(queries) if _flat(w))
    return f"""{INDEX},
fq(query_no, q, qmask) AS (VALUES {values}),
pr AS (SELECT query_no, q, kind, fx.pos, hay, tl, fx2.pop AS pop, string_split(q, '') AS ch FROM fq JOIN fx ON (qmask & ~mask) = 0 JOIN fx2 USING (kind, pos, hay)),
zn AS (SELECT query_no, q, kind, pos, pop, ch, 0 AS z, tl AS e, left(hay, tl) AS h FROM pr
  UNION ALL SELECT query_no, q, kind, pos, pop, ch, 1, length(hay), hay FROM pr),
st AS (SELECT *, 0 AS ord, 0 AS st FROM zn
  UNION ALL SELECT * EXCLUDE (w), 1 + w.o AS ord, w.i - 1 AS st FROM (SELECT *, unnest(list_transform(
    list_filter(range(2, e + 1), lambda i: substr(h, i, 1) = ch[1] AND {_LEAD.format(i='i')})[1:3], lambda i, o: {{'i': i, 'o': o}})) AS w FROM zn)),
fw AS (SELECT *, {_FORWARD} AS fin FROM st),
pl AS (SELECT query_no, q, kind, pos, pop, z, e, h, ord, split_part({_BACKWARD}, ';', 2) AS csv FROM fw WHERE fin <> '-1'
  UNION ALL SELECT query_no, q, kind, pos, pop, z, e, h, 1, split_part(b, ';', 2) FROM (SELECT *, {_STARTS} AS b FROM zn) WHERE b <> '-1'),
pp AS (SELECT *, {_PLACES} AS p, length(q) AS n FROM pl),
sc AS (SELECT *, {_WORTH} AS worth FROM pp),
bz AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_no, kind, pos, z ORDER BY round(worth, 9) DESC, ord) = 1),
bi AS (SELECT *, round(CASE WHEN z = 0 THEN worth ELSE worth * 0.62::DOUBLE END + 14 * pop, 9) AS score FROM bz
  QUALIFY row_number() OVER (PARTITION BY query_no, kind, pos ORDER BY z) = 1),
hit AS (SELECT query_no, kind, pos, score, list_transform(p, lambda i: i - 1) AS places FROM bi WHERE score >= CASE WHEN n <= 2 THEN 0 ELSE 22 * n END),
top AS (SELECT *, row_number() OVER (PARTITION BY query_no, kind ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY query_no, kind) AS total FROM hit
  QUALIFY rank <= 6)"""


_HITS = hits_sql(WORDS)


@query("fuzzy_search", f"WITH {_HITS} SELECT query_no, kind, rank, pos, round(score, 6) AS score, total, places FROM top")
def fuzzy_search(spark, d):
    found = fuzzy.fuzzy_search(fuzzy.fuzzy_index(entries(spark, d)), WORDS)
    return found.select("query_no", "kind", "rank", "pos", F.round("score", 6).alias("score"), "total", "places")


@query("fuzzy_totals", f"WITH {_HITS} SELECT DISTINCT query_no, kind, total FROM top")
def _(spark, d):
    found = fuzzy.fuzzy_search(fuzzy.fuzzy_index(entries(spark, d)), WORDS)
    return found.select("query_no", "kind", "total").distinct()


@query("fuzzy_score", f"WITH {hits_sql(['mystery 19'])} SELECT kind, pos, round(score, 6) AS score FROM hit")
def _(spark, d):
    index = fuzzy.fuzzy_index(entries(spark, d))
    q = F.lit("mystery 19")
    maybe = index.filter(fuzzy.mask_allows(F.lit(_mask("mystery 19")), F.col("mask")))
    scored = maybe.withColumn("score", fuzzy.fuzzy_score(q, "hay", "tl", "pop"))
    kept = scored.filter(F.col("score") >= fuzzy.score_floor(F.length(q)))
    return kept.select("kind", "pos", F.round("score", 6).alias("score"))


def _runs(lo: str, hi: str) -> str:
    rel = f"list_transform(list_filter(places, lambda x: x >= {lo} AND x < {hi}), lambda x: x - ({lo}))"
    heads = f"list_filter({rel}, lambda x: NOT list_contains({rel}, x - 1))"
    tails = f"list_filter({rel}, lambda x: NOT list_contains({rel}, x + 1))"
    return f"list_transform({heads}, lambda a, i: a || '-' || (({tails})[i] + 1))"


@query(
    "highlight_spans",
    f"""WITH {_HITS} SELECT query_no, kind, rank, label, sub, {_runs('0', 'tl')} AS label_spans,
    {_runs('tl + 1', 'tl + 1 + length(sub)')} AS sub_spans FROM top JOIN fx USING (kind, pos)""",
)
def _(spark, d):
    index = fuzzy.fuzzy_index(entries(spark, d))
    found = fuzzy.fuzzy_search(index, WORDS).join(index.select("kind", "pos", "label", "sub", "tl"), ["kind", "pos"])
    return found.select(
        "query_no", "kind", "rank", "label", "sub",
        fuzzy.highlight_spans(F.col("places"), F.lit(0), F.col("tl")).alias("label_spans"),
        fuzzy.highlight_spans(F.col("places"), F.col("tl") + 1, F.col("tl") + 1 + F.length("sub")).alias("sub_spans"),
    )
