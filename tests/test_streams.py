"""Lockout, debounce, tray and cache against serial loops; streams against batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marquee.streaming import cache, debounce, lockout, sets
from marquee.streaming.runner import Ending, run_available

START = dt.datetime(2024, 1, 1)


def serial_lockout(rows):
    """Rows of one key in order."""
    out, fails, until = {}, 0, 0
    steps = [0, 0, 300, 900, 3600, 86400]
    for us, e, good in sorted(rows):
        if us < until:
            out[e] = ("locked", fails, until)
            continue
        if good:
            fails, until = 0, 0
        else:
            fails += 1
            if steps[min(fails, 5)]:
                until = us + steps[min(fails, 5)] * 1_000_000
        out[e] = ("ok" if good else "failed", fails, until)
    return out


@pytest.mark.parametrize("share_ok,long_key,segment", [(0.3, 10**9, 60), (0.3, 0, 900), (0.05, 0, 60), (0.02, 40, 3600), (0.5, 0, 10**7)])
def test_lockout(spark, share_ok, long_key, segment):
    rng = random.Random(7)
    rows, e = [], 0
    for user in range(6):
        t = 0
        for _ in range(400 if user == 0 else 30):
            t += rng.choice([0, 1, 30, 200, 1000, 4000, 90_000]) * 1_000_000
            rows.append((user, e, t, rng.random() < share_ok))
            e += 1
    df = spark.createDataFrame(rows, "user_id long, event_id long, us long, ok boolean")
    got = {r["event_id"]: (r["outcome"], r["fails"], r["until_us"]) for r in lockout.lockout(df, long_key, segment).collect()}
    want = {}
    for user in range(6):
        want |= serial_lockout([(us, ev, ok) for u, ev, us, ok in rows if u == user])
    assert got == want


@pytest.mark.parametrize("gap", [5, 60])
def test_debounce_with_a_hot_key(spark, gap):
    rng = random.Random(gap)
    t, rows = 0.0, []
    for e in range(800):
        t += rng.choice([0, 0.5, 2, 5, 30, 60, 400, 5000])
        rows.append((e, "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", START + dt.timedelta(seconds=t), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp, now boolean")
    got = {r["event_id"] for r in debounce.debounce(df, "key", gap, F.col("now")).collect()}
    want = set()
    for i, (e, k, ts, now) in enumerate(rows):
        later = [r[2] for r in rows[i + 1 :] if r[1] == k]
        if now or not later or (later[0] - ts).total_seconds() >= gap:
            want.add(e)
    assert got == want


def test_tray():
    steps = sets.tray_fold([], [1, 2, 3, 4, 5, 2, 5, 1])
    assert [a for a, _ in steps] == ["added"] * 4 + ["refused", "removed", "added", "removed"]
    assert steps[-1][1] == [3, 4, 5]


def test_only_definitive_answers_are_kept(spark):
    cols = "key string, status int, value double, seq long"
    old = spark.createDataFrame([("a", 200, 1.0, 1), ("b", 404, None, 1)], cols)
    new = spark.createDataFrame([("a", 503, 9.0, 5), ("b", 200, 2.0, 3), ("c", 429, 3.0, 2), ("d", 404, None, 2), ("e", None, 1.0, 2)], cols)
    got = {r["key"]: (r["status"], r["value"]) for r in cache.merge_cache(old, new).collect()}
    assert got == {"a": (200, 1.0), "b": (200, 2.0), "d": (404, None)}


def test_cache_merge_over_several_batches(spark):
    """A stream in three files, one per micro-batch, ends as the batch merge of all rows."""
    from marquee.session import fresh_path

    cols = "key string, status int, value double, seq long"
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 9)}", rng.choice([200, 404, 503, 429]), float(i), i) for i in range(90)]
    path = fresh_path(spark, "answers")
    for n in range(3):
        spark.createDataFrame(rows[n * 30 : n * 30 + 30], cols).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(path)
    got = {tuple(r) for r in cache.merge_stream(stream).read().collect()}
    want = {tuple(r) for r in cache.merge_cache(None, spark.createDataFrame(rows, cols)).select("key", "status", "value", "seq").collect()}
    assert got == want


def test_cache_writes_follow_the_batch(spark, monkeypatch):
    """Many small batches onto a cache: runs are merged level by level, a second stream goes on from the first one's
    checkpoint, a repeated batch changes nothing, and old runs go."""
    from marquee.session import fresh_path

    monkeypatch.setattr(cache.CacheStore, "FAN", 3)
    cols = "key string, status int, value double, seq long"
    rng = random.Random(2)
    rows = [(f"k{rng.randint(0, 400)}", rng.choice([200, 200, 404, 503]), float(i), i) for i in range(220)]
    path, root = fresh_path(spark, "answers"), fresh_path(spark, "cache")
    parts = [rows[:100], *[rows[100 + 10 * n : 110 + 10 * n] for n in range(12)]]

    def put(some):
        for part in some:
            spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(path)

    read = lambda: spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(path)
    put(parts[:6])
    cache.merge_stream(read(), root)
    put(parts[6:])
    store = cache.merge_stream(read(), root)
    assert store.version() == 12
    want = {tuple(r) for r in cache.merge_cache(None, spark.createDataFrame(rows, cols)).select("key", "status", "value", "seq").collect()}
    assert {tuple(r) for r in store.read().collect()} == want
    runs = store._runs(12)
    assert len(runs) <= 3 * 3 and max(level for _, level, _ in runs) >= 2
    # Rows written by the last batches: those of the batch, and a merge of small runs now and then.
    written = {p.getName(): spark.read.parquet(f"{root}/run/{p.getName()}").count() for _, p in store._files("run")}
    assert sum(n for name, n in written.items() if name.endswith("-0")) <= 220
    assert sum(written.values()) < 220 * (1 + max(level for _, level, _ in runs))
    store.add(spark.createDataFrame(parts[12], cols), 12)
    assert {tuple(r) for r in store.read().collect()} == want
    assert store.vacuum() > 0 and {tuple(r) for r in store.read().collect()} == want


def test_recents_and_lockout_streams_over_several_batches(spark):
    from marquee.session import fresh_path

    rng = random.Random(5)
    rows = [(rng.randint(0, 3), "game", str(rng.randint(0, 20)), (i + 1) * 1_000_000, i, rng.random() < 0.2) for i in range(240)]
    cols = "user_id long, kind string, item_id string, us long, event_id long, ok boolean"
    path = fresh_path(spark, "uses")
    for n in range(4):
        spark.createDataFrame(rows[n * 60 : n * 60 + 60], cols).coalesce(1).write.mode("append").parquet(path)
    # Batches follow the files' times, which are those of the writes above.
    read = lambda: spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(path)
    lists = sets.latest_version(run_available(sets.recent_stream(timed(read().drop("ok"))), "recent-test"))
    got = {(r["user_id"], r["rank"]): r["item_id"] for r in lists.collect()}
    for u in range(4):
        seen = []
        for r in sorted((r for r in rows if r[0] == u), key=lambda r: -r[4]):
            if r[2] not in seen:
                seen.append(r[2])
        assert [got[(u, n + 1)] for n in range(8)] == seen[:8]
    ending = Ending(timed(read().select("user_id", "event_id", "us", "ok")))
    out = run_available(lockout.lockout_stream(ending.stream), "lock-test", ending=ending).collect()
    want = {}
    for u in range(4):
        want |= serial_lockout([(r[3], r[4], r[5]) for r in rows if r[0] == u])
    assert {r["event_id"]: (r["outcome"], r["fails"], r["until_us"]) for r in out} == want


def in_files(spark, files, cols):
    """A stream with a micro-batch per list of rows."""
    from marquee.session import fresh_path

    path = fresh_path(spark, "files")
    for rows in files:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(path)


TRIES = "user_id long, event_id long, us long, ok boolean"


def timed(stream):
    return stream.withColumn("ts", F.timestamp_micros("us"))


def test_rows_out_of_order_within_the_watermark(spark):
    """Files hold rows up to four minutes out of order: the stream ends as the batch does."""
    rng = random.Random(11)
    rows = [(rng.randint(0, 4), e, (e + 1) * 7_000_000, rng.random() < 0.15) for e in range(300)]
    mixed = sorted(rows, key=lambda r: r[2] + rng.randint(0, 240) * 1_000_000)
    files = [mixed[i : i + 60] for i in range(0, 300, 60)]
    ending = Ending(timed(in_files(spark, files, TRIES)))
    got = run_available(lockout.lockout_stream(ending.stream), "mixed", ending=ending)
    want = lockout.lockout(spark.createDataFrame(rows, TRIES))
    plain = lambda df: sorted(tuple(r) for r in df.select("user_id", "event_id", "outcome", "fails", "until_us").collect())
    assert plain(got) == plain(want)
    # Outcomes came as the watermark went on, not all at the end.
    assert got.select("batch").distinct().count() > 2

    trays = Ending(timed(in_files(spark, files, TRIES)).select("user_id", "event_id", "ts", (F.col("event_id") % 6).alias("k")))
    got = run_available(sets.tray_stream(trays.stream), "mixed-tray", ending=trays)
    by_id = {r["event_id"]: (r["action"], r["tray"]) for r in got.collect()}
    for user in range(5):
        own = [r for r in rows if r[0] == user]
        assert [by_id[r[1]] for r in own] == sets.tray_fold([], [r[1] % 6 for r in own])


def test_rows_behind_the_watermark_are_dropped(spark):
    minute = 60_000_000
    files = [[(1, 1, minute, False)], [(1, 2, 60 * minute, False)], [(2, 3, 61 * minute, False)], [(1, 4, 5 * minute, True), (1, 5, 62 * minute, False)]]
    ending = Ending(timed(in_files(spark, files, TRIES)))
    got = run_available(lockout.lockout_stream(ending.stream), "late", ending=ending).collect()
    # The success of minute 5 came when the watermark stood at minute 50: the count goes on.
    assert {r["event_id"]: (r["outcome"], r["fails"]) for r in got} == {1: ("failed", 1), 2: ("failed", 2), 3: ("failed", 1), 5: ("locked", 2)}


@pytest.mark.parametrize("per_file", [1, 3])
def test_idle_keys_are_forgotten(spark, per_file):
    """By event time, whatever the micro-batches: after two days without a row the count starts anew."""
    day = 86_400_000_000
    rows = [(1, 1, 1000, False), (1, 2, day, False), (2, 3, 2 * day, False), (1, 4, 4 * day, False), (2, 5, 20 * day, True), (1, 6, 20 * day + 1, False)]
    files = [rows[i : i + per_file] for i in range(0, len(rows), per_file)]
    ending = Ending(timed(in_files(spark, files, TRIES)))
    got = run_available(lockout.lockout_stream(ending.stream, idle_days=2), "idle", ending=ending).collect()
    assert {r["event_id"]: r["fails"] for r in got} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 0, 6: 1}


def test_recents_are_forgotten(spark):
    """After two days of event time without a use a user's list starts anew; null items are items as well."""
    cols = "user_id long, kind string, item_id string, us long, event_id long"
    day = 86_400_000_000
    files = [[(1, "game", "a", 1000, 1), (2, None, None, 1000, 2)], [(3, "book", "x", 9 * day, 3)], [(1, "game", "b", 10 * day, 4)], [(1, "game", "a", 10 * day + 1, 5), (2, None, None, 10 * day, 6)]]
    lists = run_available(sets.recent_stream(timed(in_files(spark, files, cols)), idle_days=2), "idle-recents").collect()
    assert {(r["version"], r["rank"], r["item_id"]) for r in lists if r["user_id"] == 1} == {(1, 1, "a"), (1, 1, "b"), (2, 1, "a"), (2, 2, "b")}
    assert {(r["version"], r["rank"], r["item_id"]) for r in lists if r["user_id"] == 2} == {(1, 1, None)}
