"""Streams run over all available input, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import micros
from ..operators import matching
from ..sources.catalogue import entries, read_table
from ..streaming import cache, debounce, lockout, runner, sets
from .list_queries import MATCHED
from .lookup_queries import ARTICLES, articles
from .registry import query

HOUR6 = 6 * 3600

_NEXT = "SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events"


@query(
    "debounce",
    f"WITH n AS ({_NEXT}) SELECT user_id, event_id FROM n WHERE nxt IS NULL OR nxt - ts >= INTERVAL 6 HOUR OR event_type = 'signup'",
)
def _(spark, d):
    ev = read_table(spark, d, "events")
    return debounce.debounce(ev, "user_id", HOUR6, F.col("event_type") == "signup").select("user_id", "event_id")


@query(
    "debounce_stream",
    f"""WITH n AS ({_NEXT}) SELECT user_id, event_id FROM n WHERE (nxt IS NULL OR nxt - ts >= INTERVAL 6 HOUR)
    AND ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def _(spark, d):
    stream = debounce.debounce_stream(runner.event_stream(spark, d), "user_id", "6 hours")
    return runner.run_available(stream, "debounce").select("user_id", "event_id")


_LOCK = """RECURSIVE t AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'signup' AS good,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'signup')),
s AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(0 AS BIGINT) AS fails, CAST(0 AS BIGINT) AS until_us
  FROM (SELECT DISTINCT user_id FROM t)
  UNION ALL
  SELECT s.user_id, t.n, t.event_id, CASE WHEN t.us < s.until_us THEN 'locked' WHEN t.good THEN 'ok' ELSE 'failed' END,
    CASE WHEN t.us < s.until_us THEN s.fails WHEN t.good THEN 0 ELSE s.fails + 1 END,
    CASE WHEN t.us < s.until_us THEN s.until_us WHEN t.good THEN 0 WHEN s.fails + 1 < 2 THEN s.until_us
      ELSE t.us + ([0, 0, 300, 900, 3600, 86400])[least(s.fails + 1, 5) + 1] * CAST(1000000 AS BIGINT) END
  FROM s JOIN t ON t.user_id = s.user_id AND t.n = s.n + 1)"""
_LOCK_SQL = f"WITH {_LOCK} SELECT user_id, event_id, outcome, fails, until_us FROM s WHERE n > 0"


@query("progressive_lockout", _LOCK_SQL)
def _(spark, d):
    return lockout.lockout(lockout.attempts(read_table(spark, d, "events")))


@query("progressive_lockout_segments", _LOCK_SQL)
def _(spark, d):
    """Every key takes the way of the long ones, a week per segment."""
    tries = lockout.attempts(read_table(spark, d, "events"))
    return lockout.lockout(tries, long_key=0, segment_seconds=7 * 86_400)


@query("progressive_lockout_stream", _LOCK_SQL)
def _(spark, d):
    tries = runner.Ending(lockout.attempts(runner.event_stream(spark, d)))
    return runner.run_available(lockout.lockout_stream(tries.stream), "lockout", ending=tries).drop("batch")


_RECENT_SQL = """WITH u AS (SELECT user_id, event_type AS kind, json_extract_string(props, '$.k') AS item_id, ts, event_id FROM events),
l AS (SELECT user_id, kind, item_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM u GROUP BY 1, 2, 3)
SELECT user_id, kind, item_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
FROM l QUALIFY rank <= 8"""


@query("recent_items_stream", _RECENT_SQL)
def _(spark, d):
    uses = runner.event_stream(spark, d).select(
        "user_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("item_id"),
        "ts", micros(F.col("ts")).alias("us"), "event_id",
    )
    lists = runner.run_available(sets.recent_stream(uses), "recents")
    return sets.latest_version(lists).select("user_id", "kind", "item_id", "event_id", "rank")


@query(
    "toggle_state_stream",
    """SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS toggles FROM events
    WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1""",
)
def _(spark, d):
    clicks = runner.event_stream(spark, d).filter("event_type = 'click'").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    )
    counts = runner.run_available(sets.toggle_stream(clicks, ["user_id", "k"]), "toggles", "update")
    newest = counts.groupBy("user_id", "k").agg(F.max("toggles").alias("toggles"))
    return newest.filter(F.col("toggles") % 2 == 1)


@query(
    "compare_tray_stream",
    """WITH RECURSIVE t AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 9 AS k,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('click', 'view')),
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, '' AS action, CAST([] AS BIGINT[]) AS tray FROM (SELECT DISTINCT user_id FROM t)
      UNION ALL SELECT s.user_id, t.n, t.event_id,
        CASE WHEN list_contains(s.tray, t.k) THEN 'removed' WHEN len(s.tray) >= 4 THEN 'refused' ELSE 'added' END,
        CASE WHEN list_contains(s.tray, t.k) THEN list_filter(s.tray, lambda x: x <> t.k) WHEN len(s.tray) >= 4 THEN s.tray ELSE list_append(s.tray, t.k) END
      FROM s JOIN t ON t.user_id = s.user_id AND t.n = s.n + 1)
    SELECT user_id, event_id, action, tray FROM s WHERE n > 0""",
)
def _(spark, d):
    toggles = runner.event_stream(spark, d).filter(F.col("event_type").isin("click", "view")).select(
        "user_id", "event_id", "ts", (F.get_json_object("props", "$.k").cast("long") % 9).alias("k")
    )
    ending = runner.Ending(toggles)
    return runner.run_available(sets.tray_stream(ending.stream), "tray", ending=ending).drop("batch")


@query("backlog_stream_enrich", f"WITH {MATCHED} SELECT row_id, kind, title, matches, match_pos FROM matched")
def _(spark, d):
    """List rows arrive as events and meet the catalogue's title index, which is static."""
    items = entries(spark, d)
    e = F.col("event_id")
    docs = items.select("kind", "pos", "title", "year")
    arriving = runner.event_stream(spark, d).withColumn("pos", F.floor(e / 10)).join(docs, "pos")
    title = (
        F.when(e % 13 == 0, F.concat("title", F.lit(" nowhere known")))
        .when(e % 5 == 1, F.concat(F.lit("The "), F.lower("title")))
        .when(e % 5 == 2, F.concat("title", F.lit("!")))
        .otherwise(F.col("title"))
    )
    rows = arriving.select(
        e.alias("row_id"), "kind", title.alias("title"), F.when(e % 11 != 0, F.col("year") + (e % 9 - 4)).cast("int").alias("year")
    )
    matched = matching.match_lists(rows, matching.title_index(items))
    return runner.run_available(matched, "enrich").select("row_id", "kind", "title", "matches", "match_pos")


_STATUS = "([200, 404, 429, 503, 0, 200, 403])[CAST(event_id % 7 AS INTEGER) + 1]"


@query(
    "lookup_cache_merge",
    f"""WITH a AS (SELECT json_extract_string(props, '$.k') AS key, {_STATUS} AS status, event_id AS seq, value FROM events)
    SELECT key, arg_max(status, seq) AS status, max(seq) AS seq, arg_max(value, seq) AS value FROM a
    WHERE status > 0 AND status <> 429 AND status < 500 GROUP BY key""",
)
def _(spark, d):
    codes = F.array(*[F.lit(c) for c in (200, 404, 429, 503, 0, 200, 403)])
    answers = runner.event_stream(spark, d).select(
        F.get_json_object("props", "$.k").alias("key"),
        F.element_at(codes, (F.col("event_id") % 7 + 1).cast("int")).alias("status"),
        "value",
        F.col("event_id").alias("seq"),
    )
    return cache.merge_stream(answers).read()


@query(
    "cache_migrate",
    f"WITH {ARTICLES} SELECT article_id FROM art1 WHERE w IN (20, 40, 60, 120, 250, 330, 500, 960, 1280, 1920, 3840) OR (w IS NULL AND original IS NOT NULL)",
)
def _(spark, d):
    old = articles(spark, d).select("article_id", F.coalesce("thumb", "original").alias("value"))
    return cache.migrate_cache(old).select("article_id")
