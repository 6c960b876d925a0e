"""Column expressions on their own, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as sc, text as tx
from ..functions.register import register_functions
from ..operators.matching import titles_agree, years_agree, years_agree_strict
from ..sources.catalogue import entries, read_table
from .oracle import BEST, CAT, base_title, fold, fold_loose, jsround, norm, slug
from .registry import query


@query("best_score", f"WITH {CAT} SELECT kind, pos, {BEST} AS best FROM cat")
def _(spark, d):
    return entries(spark, d).select("kind", "pos", sc.best_score().alias("best"))


@query(
    "text_keys",
    f"""WITH {CAT} SELECT pos, {fold('title')} AS folded, {fold_loose('title')} AS loose, {slug('title')} AS slug, {norm('title')} AS normal,
    {base_title('title')} AS base, left({norm('title')}, 8) AS pre8 FROM cat""",
)
def _(spark, d):
    t = F.col("title")
    return entries(spark, d).select(
        "pos", tx.fold_title(t).alias("folded"), tx.fold_loose(t).alias("loose"), tx.slugify(t).alias("slug"),
        tx.norm_title(t).alias("normal"), tx.base_title(t).alias("base"), tx.title_prefix8(t).alias("pre8"),
    )


@query("fold_whole_texts", f"SELECT doc_id, md5({fold('text')}) AS folded, md5({norm('text')}) AS normal, md5({slug('text')}) AS slug FROM documents")
def _(spark, d):
    t = F.col("text")
    return read_table(spark, d, "documents").select(
        "doc_id", F.md5(tx.fold_title(t)).alias("folded"), F.md5(tx.norm_title(t)).alias("normal"), F.md5(tx.slugify(t)).alias("slug")
    )


@query("strip_accents", "SELECT conv_id, turn, md5(strip_accents(text)) AS bare FROM conversations")
def _(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.md5(tx.strip_accents(F.col("text"))).alias("bare"))


_RAW = """([ '="978' || event_id || '"', '=""', ' plain ' || event_id, '"' || event_id || '"', '' ])[CAST(event_id % 5 AS INTEGER) + 1]"""


@query(
    "unwrap_excel",
    f"""WITH r AS (SELECT event_id, {_RAW} AS raw FROM events) SELECT event_id, trim(CASE WHEN starts_with(trim(raw), '="')
    THEN regexp_replace(substr(trim(raw), 3), '"$', '') ELSE trim(raw) END) AS isbn FROM r""",
)
def _(spark, d):
    e = F.col("event_id").cast("string")
    raw = F.array(
        F.concat(F.lit('="978'), e, F.lit('"')), F.lit('=""'), F.concat(F.lit(" plain "), e),
        F.concat(F.lit('"'), e, F.lit('"')), F.lit(""),
    )
    cell = F.element_at(raw, (F.col("event_id") % 5 + 1).cast("int"))
    return read_table(spark, d, "events").select("event_id", tx.unwrap_excel(cell).alias("isbn"))


_NUMS = """([ '$' || value, 'n/a', '-' || event_id || ' BC', '1.2.' || event_id, '--' || event_id, '.5', '' ])[CAST(event_id % 7 AS INTEGER) + 1]"""


@query(
    "to_number",
    f"""WITH r AS (SELECT event_id, regexp_replace({_NUMS}, '[^0-9.\\-]', '', 'g') AS s FROM events)
    SELECT event_id, TRY_CAST(nullif(regexp_extract(s, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)', 0), '') AS DOUBLE) AS n FROM r""",
)
def _(spark, d):
    e = F.col("event_id").cast("string")
    raw = F.array(
        F.concat(F.lit("$"), F.col("value").cast("string")), F.lit("n/a"), F.concat(F.lit("-"), e, F.lit(" BC")),
        F.concat(F.lit("1.2."), e), F.concat(F.lit("--"), e), F.lit(".5"), F.lit(""),
    )
    cell = F.element_at(raw, (F.col("event_id") % 7 + 1).cast("int"))
    return read_table(spark, d, "events").select("event_id", tx.to_number(cell).alias("n"))


@query(
    "clean_trailing",
    r"SELECT event_id, trim(regexp_replace('  ' || event_type || ([' -', ' – ', ':,', ' x', '—  '])[CAST(event_id % 5 AS INTEGER) + 1], '[\s\-–—:,]+$', ''), ' ') AS t FROM events",
)
def _(spark, d):
    ends = F.array(*[F.lit(s) for s in (" -", " – ", ":,", " x", "—  ")])
    cell = F.concat(F.lit("  "), "event_type", F.element_at(ends, (F.col("event_id") % 5 + 1).cast("int")))
    return read_table(spark, d, "events").select("event_id", tx.clean_trailing(cell).alias("t"))


@query(
    "fmt_count",
    """WITH n AS (SELECT doc_id, n_chars * (doc_id % 9000 + 1) AS n FROM documents) SELECT doc_id, CASE
    WHEN n >= 10000000 THEN printf('%.0f', n / 1000000) || 'M' WHEN n >= 1000000 THEN printf('%.1f', n / 1000000) || 'M'
    WHEN n >= 1000 THEN CAST(floor(n / 1000 + 0.5) AS INTEGER) || 'K' ELSE CAST(n AS VARCHAR) END AS shown FROM n""",
)
def _(spark, d):
    n = F.col("n_chars") * (F.col("doc_id") % 9000 + 1)
    return read_table(spark, d, "documents").select("doc_id", sc.fmt_count(n).alias("shown"))


@query(
    "fmt_year",
    f"WITH {CAT} SELECT pos, CASE WHEN year IS NULL THEN '—' WHEN year < 0 THEN abs(year) || ' BC' ELSE CAST(year AS VARCHAR) END AS shown FROM cat",
)
def _(spark, d):
    return entries(spark, d).select("pos", sc.fmt_year(F.col("year")).alias("shown"))


_MIN = "nullif(CASE WHEN kind = 'movies' THEN runtime WHEN kind = 'shows' THEN runtime * 10 * coalesce(nullif(seasons, 0), 1) END, 0)"


@query(
    "fmt_minutes",
    f"""WITH {CAT}, m AS (SELECT pos, {_MIN} AS m FROM cat) SELECT pos, m AS minutes, CASE WHEN m IS NULL THEN '—' WHEN m < 60 THEN m || ' min'
    WHEN m // 60 < 24 AND m % 60 > 0 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE (m // 60) || 'h' END AS shown FROM m""",
)
def _(spark, d):
    m = sc.entry_minutes()
    return entries(spark, d).select("pos", m.alias("minutes"), sc.fmt_minutes(m).alias("shown"))


@query(
    "basis_label",
    f"WITH {CAT} SELECT kind, CASE WHEN kind = 'books' THEN 'readers' WHEN verified THEN 'critics ✓' ELSE 'critics' END AS label, count(*) AS n FROM cat GROUP BY ALL",
)
def _(spark, d):
    label = sc.basis_label(F.col("kind"), F.col("verified")).alias("label")
    return entries(spark, d).groupBy("kind", label).agg(F.count("*").alias("n"))


_OTHER = "title || CASE WHEN pos % 3 = 0 THEN ' Complete Edition' WHEN pos % 3 = 1 THEN '' ELSE '!' END"
_LEFT, _RIGHT = fold("title"), fold(f"CASE WHEN pos % 5 = 0 THEN 'Zz ' || title ELSE {_OTHER} END")


@query(
    "titles_agree",
    f"""WITH {CAT}, f AS (SELECT pos, {_LEFT} AS a, {_RIGHT} AS b FROM cat)
    SELECT pos, a <> '' AND b <> '' AND (a = b OR (least(length(a), length(b)) >= 8 AND (starts_with(a, b) OR starts_with(b, a)))) AS agree FROM f""",
)
def _(spark, d):
    p, t = F.col("pos"), F.col("title")
    end = F.when(p % 3 == 0, " Complete Edition").when(p % 3 == 1, "").otherwise("!")
    other = F.when(p % 5 == 0, F.concat(F.lit("Zz "), t)).otherwise(F.concat(t, end))
    return entries(spark, d).select("pos", titles_agree(t, other).alias("agree"))


@query(
    "years_agree",
    f"""WITH {CAT}, y AS (SELECT pos, year AS a, CASE WHEN pos % 6 <> 0 THEN CAST(year + pos % 9 - 4 AS INTEGER) END AS b FROM cat)
    SELECT pos, a IS NULL OR b IS NULL OR abs(a - b) <= 3 AS lenient, coalesce(b >= 1950 AND abs(a - b) <= 2, false) AS games,
    coalesce(b >= 1880 AND abs(a - b) <= 3, false) AS screen FROM y""",
)
def _(spark, d):
    a, p = F.col("year"), F.col("pos")
    b = F.when(p % 6 != 0, a + (p % 9 - 4)).cast("int")
    return entries(spark, d).select(
        "pos", years_agree(a, b).alias("lenient"), years_agree_strict(a, b, 2, 1950).alias("games"),
        years_agree_strict(a, b, 3, 1880).alias("screen"),
    )


@query(
    "sql_functions",
    f"""WITH {CAT} SELECT pos, {fold('title')} AS folded, {slug('title')} AS slug, {norm('title')} AS normal, {BEST} AS best,
    CASE WHEN year IS NULL THEN '—' WHEN year < 0 THEN abs(year) || ' BC' ELSE CAST(year AS VARCHAR) END AS shown,
    CASE WHEN metacritic IS NULL THEN 'none' WHEN metacritic >= 75 THEN 'good' WHEN metacritic >= 50 THEN 'mid' ELSE 'bad' END AS band,
    year IS NULL OR abs(year - 1990) <= 3 AS near FROM cat""",
)
def _(spark, d):
    register_functions(spark)
    return spark.sql(
        """SELECT pos, fold_title(title) AS folded, slugify(title) AS slug, norm_title(title) AS normal,
        best_score(metacritic, imdb, rt) AS best, fmt_year(year) AS shown, score_band(metacritic, 75, 50) AS band,
        years_agree(year, 1990, 3) AS near FROM {items}""",
        items=entries(spark, d),
    )


@query(
    "js_round",
    f"SELECT event_id, {jsround('value * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END)')} AS n FROM events",
)
def _(spark, d):
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    return read_table(spark, d, "events").select("event_id", sc.js_round(F.col("value") * sign).alias("n"))
