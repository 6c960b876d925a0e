"""Quality gate and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as dq, reports
from ..operators.summaries import catalogue_stats
from ..session import materialise
from ..sources.artefacts import slim_index
from ..sources.catalogue import entries, kind_spans, read_table, texts
from ..sources.neighbour_files import metadata
from .oracle import CAT, q
from .recommend_queries import assigned, features
from .registry import query

TABLES = "documents labels pages conversations events benchmark embeddings".split()
MARKERS = ["<title>", "<article>", "<p><b>", 'charset="utf-8"']


@query(
    "exists_nonempty",
    " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS n_rows, count(*) > 0 AS ok FROM {t}" for t in TABLES),
)
def _(spark, d):
    return dq.exists_nonempty({t: read_table(spark, d, t) for t in TABLES})


_COUNT = "CAST((length(html) - length(replace(html, {m}, ''))) / length({m}) AS INTEGER)"


@query(
    "declared_once",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT page_id, {q(m)} AS marker, {_COUNT.format(m=q(m))} AS found FROM pages" for m in MARKERS
    ) + ") WHERE found <> 1",
)
def _(spark, d):
    return dq.declared_once(read_table(spark, d, "pages"), MARKERS)


@query(
    "stats_match",
    f"""WITH {CAT}, c AS (SELECT kind, count(*) AS n FROM cat GROUP BY kind)
    SELECT kind, n + 1 AS stored, n AS current FROM c WHERE kind IN ('books', 'shows')""",
)
def _(spark, d):
    now = catalogue_stats(entries(spark, d))
    drift = F.when(F.col("kind").isin("books", "shows"), F.col("n") + 1).otherwise(F.col("n"))
    return dq.stats_match(now.withColumn("n", drift), now)


_REFS = "r AS (SELECT ref, min(page_id) AS first_page, count(*) AS uses FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) AS ref FROM pages) GROUP BY ref)"


@query(
    "referential_check",
    f"""WITH {_REFS}, t AS (SELECT DISTINCT '/' || unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS ref FROM documents)
    SELECT r.ref, first_page, uses FROM r WHERE ref NOT IN (SELECT ref FROM t WHERE ref IS NOT NULL)""",
)
def _(spark, d):
    tokens = F.explode(F.split("text", "[ \\t\\n\\r]+"))
    known = read_table(spark, d, "documents").select(tokens.alias("t")).select(F.concat(F.lit("/"), "t").alias("ref"))
    return dq.unresolved(dq.references(read_table(spark, d, "pages")), known, "ref")


_STAMP = "regexp_extract(html, 'html lang=\"([^\"]*)\"', 1)"
_SITE = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(
    "stamp_consistency",
    f"""SELECT {_SITE} AS site, count(DISTINCT {_STAMP}) AS stamps, min({_STAMP}) AS low, max({_STAMP}) AS high, count(*) AS n
    FROM pages GROUP BY 1 HAVING count(DISTINCT {_STAMP}) <> 1""",
)
def _(spark, d):
    rows = read_table(spark, d, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site"), F.regexp_extract("html", 'html lang="([^"]*)"', 1).alias("stamp")
    )
    return dq.stamp_consistency(rows, "site", "stamp")


_VIS = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)const [A-Z]+ = \\[.*?\\];\\n', '', 'g'), '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g')"


@query(
    "hardcoded_counts",
    f"""WITH {CAT}, n AS (SELECT DISTINCT count(*) // 10 AS number FROM cat GROUP BY kind),
    v AS (SELECT page_id, {_VIS} AS text FROM pages)
    SELECT page_id, number FROM v, n WHERE number > 0 AND (contains(text, format('{{:,}}', number)) OR regexp_matches(text, '\\b' || number || '\\b'))""",
)
def _(spark, d):
    counts = kind_spans(entries(spark, d).select("kind")).select(F.floor(F.col("n") / 10).alias("n"))
    return dq.hardcoded_counts(read_table(spark, d, "pages"), counts)


@query(
    "index_alignment",
    """SELECT 'count_gaps' AS "check", 0 AS bad UNION ALL SELECT 'offset_gaps', 0 UNION ALL SELECT 'length_gaps', 0 UNION ALL SELECT 'stray', 0""",
)
def _(spark, d):
    f = features(spark, d)
    packed = reports.pack_neighbours(f.ids, assigned(spark, d), reports.slot_digits(f.ids))
    return dq.index_alignment(f.ids, slim_index(entries(spark, d)), packed, metadata(f.ids))


@query("required_title", f"WITH {CAT} SELECT kind, count(*) FILTER (coalesce(title, '') = '') AS untitled, count(*) AS n FROM cat GROUP BY kind")
def _(spark, d):
    return dq.required_title(entries(spark, d))


_TOKENS = "unnest(regexp_extract_all(lower(text), '[a-z]+'))"
_UNDEF = f"""u AS (SELECT token, min(item_id) AS first_place FROM (SELECT item_id, {_TOKENS} AS token FROM benchmark) GROUP BY token),
k AS (SELECT DISTINCT token FROM (SELECT {_TOKENS} AS token FROM documents)),
undef AS (SELECT token, first_place FROM u WHERE token NOT IN (SELECT token FROM k))"""


@query("undefined_tokens", f"WITH {_UNDEF} SELECT * FROM undef")
def _(spark, d):
    return dq.undefined_tokens(read_table(spark, d, "benchmark"), "item_id", read_table(spark, d, "documents"))


@query(
    "severity_report",
    f"""WITH {CAT}, {_UNDEF}, c AS (
      SELECT 'titles' AS "check", (SELECT count(*) FROM cat WHERE coalesce(title, '') = '') AS bad, 'fail' AS s
      UNION ALL SELECT 'titles declared once', (SELECT count(*) FROM pages WHERE {_COUNT.format(m="'<title>'")} <> 1), 'fail'
      UNION ALL SELECT 'tokens', (SELECT count(*) FROM undef), 'warn'),
    r AS (SELECT "check", bad, CASE WHEN bad = 0 THEN 'ok' ELSE s END AS severity FROM c)
    SELECT * FROM r UNION ALL SELECT 'overall', CAST(sum(bad) AS BIGINT),
      CASE max(CASE severity WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END FROM r""",
)
def _(spark, d):
    untitled = entries(spark, d).filter(F.coalesce("title", F.lit("")) == "")
    pages = read_table(spark, d, "pages")
    return dq.severity_report(
        [
            dq.check_row("titles", untitled),
            dq.check_row("titles declared once", dq.declared_once(pages, ["<title>"])),
            dq.check_row(
                "tokens", dq.undefined_tokens(read_table(spark, d, "benchmark"), "item_id", read_table(spark, d, "documents")), "warn"
            ),
        ]
    )


def _tree(leaves: str, name: str = "h") -> str:
    out, prev = leaves, f"{name}0"
    for i in range(1, 6):
        out += f", {name}{i} AS (SELECT id >> 12 AS id, sha256(string_agg(h, '' ORDER BY id)) AS h FROM {prev} GROUP BY 1)"
        prev = f"{name}{i}"
    return out


@query(
    "dataset_fingerprint",
    "WITH " + _tree("""h0 AS (SELECT page_id AS id, sha256(page_id || ':' || regexp_replace(html, 'track\\([0-9]+\\)', '', 'g')) AS h FROM pages)""")
    + " SELECT left(h, 10) AS fingerprint FROM h5",
)
def _(spark, d):
    return dq.fingerprint(read_table(spark, d, "pages"), "page_id", F.col("html"), r"track\([0-9]+\)")


@query(
    "catalogue_fingerprint",
    f"WITH {CAT}, " + _tree("""h0 AS (SELECT pos AS id, sha256(pos || ':' || kind || '|' || coalesce(title, '') || '|' || coalesce(CAST(year AS VARCHAR), '') || '|' || blurb) AS h FROM cat)""")
    + " SELECT left(h, 10) AS fingerprint FROM h5",
)
def _(spark, d):
    content = F.concat_ws("|", "kind", F.coalesce("title", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), "blurb")
    return dq.fingerprint(texts(spark, d), "pos", content)


_INPUTS = ", ".join(
    [
        _tree("""p0 AS (SELECT page_id AS id, sha256(page_id || ':' || regexp_replace(html, 'track\\([0-9]+\\)', '', 'g')) AS h FROM pages)""", "p"),
        _tree("""b0 AS (SELECT item_id AS id, sha256(item_id || ':' || text) AS h FROM benchmark)""", "b"),
        _tree("""d0 AS (SELECT doc_id AS id, sha256(doc_id || ':' || text) AS h FROM documents)""", "d"),
    ]
)


@query(
    "inputs_fingerprint",
    f"""WITH {_INPUTS}, f AS (SELECT left(sha256('pages:' || (SELECT h FROM p5) || '|benchmark:' || (SELECT h FROM b5) || '|documents:' || (SELECT h FROM d5)), 10) AS fingerprint)
    SELECT 1 AS run, fingerprint, true AS published FROM f UNION ALL SELECT 2, fingerprint, false FROM f""",
)
def _(spark, d):
    """All inputs in order, published once; the second run finds its stamp and writes nothing."""
    own = [
        ("pages", dq.fingerprint(read_table(spark, d, "pages"), "page_id", F.col("html"), r"track\([0-9]+\)", digits=64)),
        ("benchmark", dq.fingerprint(read_table(spark, d, "benchmark"), "item_id", F.col("text"), digits=64)),
        ("documents", dq.fingerprint(read_table(spark, d, "documents"), "doc_id", F.col("text"), digits=64)),
    ]
    fresh = dq.inputs_fingerprint(own)
    stored = materialise(fresh, "stamp")
    first = dq.publish(fresh, stored.limit(0)).select(F.lit(1).alias("run"), "fingerprint", "published")
    return first.unionByName(dq.publish(fresh, stored).select(F.lit(2).alias("run"), "fingerprint", "published"))
