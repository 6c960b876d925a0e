"""The recommendation build does the same work with less moved: no item per cell, no word or pair through a join."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marquee.functions import fixed
from marquee.operators import neighbours as nb, similarity as sim
from marquee.operators.sorting import top_per_group
from marquee.session import materialise

from .test_neighbours import brute_force, random_vectors

TEXTS = "kind string, pos long, genre string, blurb string"
META = "kind string, pos long, gid long, kind_rank int, eligible boolean"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_targets_pass_by_in_parts(spark, hot):
    """Tasks bounded on both sides; with `hot`, far more than eight equal targets."""
    df, rows = random_vectors(spark, 240, 11, hot)
    found = nb.plain_candidates(df, 100_000, 16, 60, 50)
    got = top_per_group(found, ["gid", "target_rank"], [F.desc("sim"), F.asc("neighbour")], 8)
    assert {(r["gid"], r["target_rank"], r["neighbour"]) for r in got.collect()} == brute_force(rows)


def test_items_are_not_dealt_to_every_cell(spark):
    df, _ = random_vectors(spark, 400, 3)
    sides = []

    def seen(pilots, k):
        def run(batches):
            for pdf in batches:
                yield pdf[["task"]].assign(item=pdf["kind_rank"] < 0, bytes=pdf["longs"].str.len())

        return run

    whole, shape = nb._best, nb.CANDIDATE
    nb._best, nb.CANDIDATE = seen, "task int, item boolean, bytes long"
    try:
        sides = nb.plain_candidates(df, 2_000_000, 16).groupBy("item").agg(F.sum("bytes").alias("n")).collect()
    finally:
        nb._best, nb.CANDIDATE = whole, shape
    assert {r["item"]: r["n"] for r in sides}[True] == 400 * 8 * len(nb.ITEM_LONGS)


def test_words_are_counted_where_texts_are_read(spark):
    texts = spark.createDataFrame(
        [("games", 1, "a", "Oak oak, elm the be oak-tree"), ("games", 2, "b", None), ("games", 3, "b", "12 ab"),
         ("books", 4, "a", "elm"), ("books", 4, "a", "elm yew"), (None, 5, "a", "oak")], TEXTS)
    meta = spark.createDataFrame([("games", i, i, 0, True) for i in (1, 2, 3)] + [("books", 4, 4 + i, 1, True) for i in range(2)], META)
    got = {(r["pos"], r["word"]): (r["copies"], r["tf"]) for r in sim.word_counts(texts, meta).collect()}
    assert got == {(1, "oak"): (1, 3), (1, "elm"): (1, 1), (1, "tree"): (1, 1), (4, "elm"): (2, 2), (4, "yew"): (2, 1)}
    single = sim.word_counts(texts.filter("kind = 'games'"), meta.filter("kind = 'games'"))
    assert "Join" not in plan(single) and "Aggregate" not in plan(single) and "Repartition" not in plan(single)


def test_words_are_counted_in_the_bytes_of_a_batch(spark):
    """As a plain loop counts them: ends of texts, letters of several bytes, letters that lower to ASCII, short runs."""
    drop = set((fixed.STOP + " " + fixed.JARGON).split())
    texts = ["oak", "elm", "", None, "Oak\u00e9oak OAK-oaken the", "\u212aelp \u0130dle", "ab cde", "x" * 70 + " the", "12 \u7d19 --", "yew oak", "elm", "e"]
    rows = [("games", i, "a", t) for i, t in enumerate(texts * 40)]
    df = spark.createDataFrame(rows, TEXTS).coalesce(1)
    found = sim.content_words(df, ["kind", "pos"])
    assert "MapInArrow" in plan(found) and "Generate" not in plan(found)
    lowered = {r["pos"]: r["t"] for r in df.select("pos", F.lower("blurb").alias("t")).collect()}
    want = Counter((p, w) for p, t in lowered.items() for w in re.findall("[a-z]+", t or "") if len(w) > 2 and w not in drop)
    assert {(r["pos"], r["word"]): r["tf"] for r in found.collect()} == want
    assert [f.name for f in found.schema] == ["kind", "pos", "word", "tf"]


def test_profiles_are_summed_in_one_shuffle(spark):
    counts = spark.createDataFrame(
        [("games", i, g, 1, w, 1) for i, (g, w) in enumerate([("Fantasy", "oak"), ("Horror", "oak"), (None, "oak"), ("none such", "oak"), ("Fantasy", "elm")])],
        "kind string, pos long, genre string, copies long, word string, tf long")
    priors = sim.prior_table(spark)
    base = {a: 0.0 for a in [*sim.AXES, "tone", "scale"]} | {"n": 100}
    found = sim.learn_profiles(counts, priors, base)
    assert plan(found).count("Aggregate") == 1
    got = {r["word"]: r for r in found.collect()}
    tone = {r["genre"]: r["prior_tone"] for r in priors.collect()}
    assert got["oak"]["df"] == 4 and got["elm"]["df"] == 1 and got["elm"]["l_tone"] is None
    assert got["oak"]["l_tone"] == pytest.approx((tone["Fantasy"] + tone["Horror"]) / 4 * 4 / (4 + fixed.SHRINK))


def test_keys_are_made_before_items_are_numbered(spark):
    """The tasks that number items are few; regular expressions run where the catalogue is read."""
    from marquee.schema import ITEM

    row = {"kind": "games", "pos": 4, "title": "The Oak 2", "metacritic": 90}
    narrow = spark.createDataFrame([tuple(row.get(f.name) for f in ITEM)], ITEM).drop("blurb").withColumn("period", F.lit(0.5))
    meta = sim.item_meta(narrow)
    shown = plan(meta)
    assert 0 <= shown.find("Window") < shown.find("regexp_replace")
    got = meta.first()
    assert (got["gid"], got["turn"], got["title_key"], got["base_key"], got["period"]) == (0, 0, "the oak 2", "oak", 0.5)


def test_lists_are_merged_in_tasks_of_bounded_size(spark):
    rows = [(i, 0, i, 1, 100 + (i + k) % 12, 0.5 + k / 100 + side / 1000, side) for i in range(6) for k in range(8) for side in (0, 1)]
    both = spark.createDataFrame(rows, nb.CANDIDATE)
    shown = plan(nb.best_of_both(both, 4_000_000))
    tasks = int(re.search(r"RepartitionByExpression \[gid#\d+L?, target_rank#\d+\], (\d+)", shown)[1])
    assert tasks * nb.TASK_PAIRS >= 4_000_000 * 3 * 2 * fixed.WIDE
    got = nb.best_of_both(both, 6).collect()
    assert len(got) == 48 and all(r["axis"] == 1 for r in got)
    assert [r["place"] for r in sorted(got, key=lambda r: (r["gid"], -r["sim"]))] == [*range(1, 9)] * 6


def test_learned_sums_beyond_the_broadcast(spark):
    names = [f"l_{a}" for a in [*sim.AXES, "tone", "scale"]]
    profiles = spark.createDataFrame(
        [(f"w{i}", 3 + i % 7, *[float(i)] * len(names)) for i in range(40)] + [("often", 900, *[None] * len(names))],
        "word string, df long, " + ", ".join(f"{n} double" for n in names))
    words = spark.createDataFrame(
        [("games", p, f"w{(p * 7 + i) % 40}", 1 + i % 3) for p in range(30) for i in range(9)] + [("games", 1, "often", 5)],
        "kind string, pos long, word string, tf long")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(sim.learned_sums(words, profiles, ["kind", "pos"]))
    for most in (1, 10, 39):
        assert key(sim.learned_sums(words, profiles, ["kind", "pos"], most)) == whole


def test_pairs_are_scored_where_they_are_made(spark):
    df, rows = random_vectors(spark, 60, 4)
    v = materialise(df, "test-vectors")
    words = [(r[1], r[2], "a", 1, f"w{k}", 1) for r in rows for k in range(30) if (r[0] * 7 + k * k) % 11 == 0]
    counts = spark.createDataFrame(words, "kind string, pos long, genre string, copies long, word string, tf long")
    profiles = materialise(sim.document_frequency(counts), "test-profiles")
    f = sim.Features(v.select("kind", "pos", "kind_rank", "gid", "turn"), counts, profiles, None, v, {})
    found = nb.rare_scores(f, nb.rare_meetings(f, nb.SCORED))
    shown = plan(found)
    assert 0 <= shown.find("Generate") < shown.find("Join")
    by_word = {}
    for kind, pos, _, _, w, _ in words:
        by_word.setdefault(w, []).append(pos)
    shared = {}
    for items in by_word.values():
        if fixed.RARE_DF[0] <= len(items) <= fixed.RARE_DF[1]:
            for i in items:
                for j in items:
                    if rows[i][3] != rows[j][3] and rows[j][9]:
                        shared[i, j] = shared.get((i, j), 0) + 1
    pairs = spark.createDataFrame([(i, j, n) for (i, j), n in shared.items()], "gid long, neighbour long, shared long")
    want = (
        pairs.alias("p").join(v.alias("i"), F.col("p.gid") == F.col("i.gid")).join(v.alias("j"), F.col("p.neighbour") == F.col("j.gid"))
        .select("p.gid", "p.neighbour", nb.pair_score(F.col("p.shared")).alias("sim"), nb.shared_axis().alias("axis"))
    )
    key = lambda d: sorted(map(tuple, d.select("gid", "neighbour", "sim", "axis").collect()))
    assert key(found) == key(want)


def test_years_are_found_as_before(spark):
    """The pattern asks for the digit first, which changes no answer; plain loop with the rule as written."""
    from marquee.functions.text import period_signal

    rng = random.Random(5)
    texts = [None, "", "1999", "a1999", "_2012", "1999s", "1999st", "20300", "2030", "2029.", "11999 1999", "é1850é"]
    texts += ["".join(rng.choice("0129 s_aé") for _ in range(rng.randrange(4, 14))) for _ in range(4000)]
    rule = re.compile(r"(?<![A-Za-z0-9_])(1[0-9][0-9][0-9]|20[0-2][0-9])s?(?![A-Za-z0-9_])")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["p"] for r in df.select("i", period_signal(F.col("t")).alias("p")).collect()}
    assert got == {i: 0.5 if rule.search(t or "") else 0.0 for i, t in enumerate(texts)}
    assert df.select(period_signal(F.col("t")).alias("p"))._jdf.queryExecution().optimizedPlan().toString().count("(?=[12])") == 1


def test_words_of_repeated_keys_meet_in_tasks_of_bounded_size(spark):
    """Not in the tasks that read the texts, whose maps of words would grow with their share of the input."""
    texts = spark.createDataFrame([("games", i % 30, "a", f"oak elm yew{i % 7} " * 5000) for i in range(300)], TEXTS)
    meta = spark.createDataFrame([("games", i % 30, i, 0, True) for i in range(300)], META)
    found = sim.word_counts(texts, meta)
    shown = plan(found)
    tasks = int(re.search(r"RepartitionByExpression \[kind#\d+, pos#\d+L, word#\d+\], (\d+)", shown)[1])
    assert tasks * sim.TASK_BYTES >= 300 * 75_000
    assert found.rdd.getNumPartitions() >= tasks
    got = {(r["pos"], r["word"]): (r["copies"], r["tf"]) for r in found.collect()}
    want = Counter()
    for i in range(300):
        want.update({(i % 30, w): 5000 for w in ("oak", "elm", "yew")})
    assert got == {k: (10, n) for k, n in want.items()}


@pytest.mark.parametrize("copies", [3, 5])
def test_items_that_are_alike_are_scored_once(spark, copies):
    """Items under other numbers but equal in all that scores read, a null tone among them."""
    df, rows = random_vectors(spark, 80, 6, 0.3)
    df = df.withColumn("tone", F.when(F.col("gid") % 9 != 4, F.col("tone")))
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    many = many.withColumns({"gid": F.col("gid") * copies + F.col("copy"), "turn": 10_000 - F.col("gid") * copies - F.col("copy")}).drop("copy")
    many = materialise(many, "test-alike")
    dealt, whole = [], nb._plain_candidates

    def counted(items, *rest):
        dealt.append(items.count())
        return whole(items, *rest)

    best = lambda found: sorted(
        tuple(r) for r in top_per_group(found, ["gid", "target_rank"], [F.desc("sim"), F.asc("neighbour")], 8).drop("rank").collect()
    )
    items = nb.pair_keys(many, "item").drop("score", "eligible")
    nb._plain_candidates = counted
    try:
        got = best(nb.plain_candidates(many, 100_000, 16, 60, 50))
    finally:
        nb._plain_candidates = whole
    assert dealt == [items.select(*nb.ITEM_FLOATS, "kind_rank", *nb.KEYS).distinct().count()] and dealt[0] <= 80
    assert got == best(whole(items, many, 100_000, 16, 60, 50)) and len(got) > 80


def test_rounds_do_not_bring_candidates_to_their_cutoffs(spark):
    """Cutoffs are broadcast whatever size Spark takes them for; past the bound they are joined, with the same picks."""
    rows = [(g, 9, g, 0, (g + k * (k + 1)) % 40, 0.5, 0, k + 1) for g in range(400) for k in range(8)]
    cands = spark.createDataFrame(rows, nb.CANDIDATE + ", place int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    most = nb.BROADCAST_CUTOFFS
    try:
        picks = nb.assign(cands, 4, 3)
        assert "strategy=broadcast" in plan(picks)
        got = sorted(map(tuple, picks.collect()))
        nb.BROADCAST_CUTOFFS = 0
        picks = nb.assign(cands, 4, 3)
        assert "strategy=broadcast" not in plan(picks)
        assert sorted(map(tuple, picks.collect())) == got
    finally:
        nb.BROADCAST_CUTOFFS = most
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_floors_are_set_before_pairs_are_scored():
    """A task scores few pairs exactly, finds what a plain loop finds, and rows without a number stop nothing."""
    rng = np.random.default_rng(8)

    def side(n, rank):
        v = np.abs(rng.normal(0, 1, (n, len(nb.VEC)))) ** 3
        rows = pd.DataFrame(np.round(v / np.linalg.norm(v, axis=1)[:, None], 9), columns=nb.VEC)
        rows["tone"], rows["scale"] = np.round(rng.uniform(-1, 1, (2, n)), 9)
        rows["score"] = rng.integers(60, 100, n).astype("f8")
        rows.loc[rng.random(n) < 0.01, "tone"] = np.nan
        for k in nb.KEYS:
            rows[k] = rng.integers(0, 50 if k.startswith("pre") else 1 << 60, n)
        return rows.assign(gid=np.arange(n) + 100_000 * rank, kind_rank=rank, turn=np.arange(n))

    items, targets = side(700, 0), side(9000, 1)
    packed = [items.assign(grp=0)], [targets.drop(columns="turn")]
    rows = pd.concat([*nb._pack_items(packed[0]), *nb._pack_targets(64)(packed[1])]).assign(task=3)
    rows["kind_rank"] = rows["kind_rank"].fillna(-1).astype(int)
    scored, whole = [], nb.pair_scores

    def counted(left, right):
        out = whole(left, right)
        scored.append(out.size)
        return out

    nb.pair_scores = counted
    try:
        got = {held: pd.concat(nb._best(held, 8)([rows])) for held in (1 << 19, 2000)}
    finally:
        nb.pair_scores = whole
    assert sum(scored) < 2 * 700 * 9000 * 0.02
    sim = nb.score_block({c: items[c].to_numpy() for c in items}, {c: targets[c].to_numpy() for c in targets})
    want = set()
    for i, row in enumerate(np.where(sim >= fixed.MIN_SIM, sim, -np.inf)):
        want |= {(i, 100_000 + j, row[j]) for j in np.argsort(-row, kind="stable")[:8] if row[j] > -np.inf}
    for found in got.values():
        assert set(zip(found["gid"], found["neighbour"], found["sim"])) == want


def test_rounds_find_picks_within_a_row(spark):
    """No sort and no exchange of candidates in a round; the same picks as by ranking open candidates, gaps included."""
    rng = random.Random(9)
    rows = [(g, 9, 400 - g, m, rng.randrange(60), 0.5, 0, k) for g in range(200) for m in range(2) for k in sorted(rng.sample(range(1, 9), rng.randrange(1, 9)))]
    cands = materialise(spark.createDataFrame(rows, nb.CANDIDATE + ", place int"), "test-cands")
    lists = materialise(nb._lists(cands, 8), "test-lists")
    for full in ([], [(n, rng.randrange(150, 420)) for n in range(0, 60, 2)]):
        cutoffs = spark.createDataFrame(full, "neighbour long, cutoff long")
        found = nb._list_proposals(lists, cutoffs, 3, 8)
        assert not any(x in plan(found) for x in ("Window", "Sort", "Aggregate", "Repartition"))
        want = sorted((r["neighbour"], r["turn"]) for r in nb._proposals(cands, cutoffs, 3).collect())
        assert sorted(map(tuple, found.select("neighbour", "turn").collect())) == want
    first = nb._list_proposals(lists, None, 3, 8)
    assert "Join" not in plan(first) and first.count() == nb._proposals(cands, spark.createDataFrame([], "neighbour long, cutoff long"), 3).count()


@pytest.mark.parametrize("longest", [8, 11])
def test_picks_do_not_depend_on_how_rounds_read_lists(spark, longest):
    """Lists longer than eight, and cutoffs too many to broadcast, go through the join."""
    rng = random.Random(longest)
    rows = [(g, 9, (g * 7) % 300, 0, t, 0.5, 0, k + 1) for g in range(300) for k, t in enumerate(rng.sample(range(30), longest))]
    cands = spark.createDataFrame(rows, nb.CANDIDATE + ", place int")
    got = sorted(map(tuple, nb.assign(cands, 6, 2).collect()))
    most = nb.BROADCAST_CUTOFFS
    nb.BROADCAST_CUTOFFS = 0
    try:
        assert sorted(map(tuple, nb.assign(cands, 6, 2).collect())) == got and len(got) > 100
    finally:
        nb.BROADCAST_CUTOFFS = most


def test_pairs_that_cannot_reach_the_floor_are_not_shuffled(spark):
    df, rows = random_vectors(spark, 60, 4)
    v = materialise(df, "test-vectors")
    words = [(r[1], r[2], "a", 1, f"w{k}", 1) for r in rows for k in range(30) if (r[0] * 7 + k * k) % 11 == 0]
    counts = spark.createDataFrame(words, "kind string, pos long, genre string, copies long, word string, tf long")
    profiles = materialise(sim.document_frequency(counts), "test-profiles")
    f = sim.Features(v.select("kind", "pos", "kind_rank", "gid", "turn"), counts, profiles, None, v, {})
    met = nb.rare_meetings(f, nb.SCORED)
    found = nb.rare_scores(f, met, fixed.MIN_SIM)
    shown = plan(found)
    assert "0.22" in shown[shown.find("RepartitionByExpression"):]
    key = lambda d: sorted(map(tuple, d.collect()))
    every = nb.rare_scores(f, met)
    assert key(found) == key(every.filter(F.col("sim") >= fixed.MIN_SIM)) and 0 < found.count() < every.count()


def test_hits_and_learned_sums_come_from_one_pass(spark):
    """Words with a profile, with hits, with both and with none; profiles beyond the broadcast too."""
    names = [f"l_{a}" for a in [*sim.AXES, "tone", "scale"]]
    profiles = spark.createDataFrame(
        [(f"w{i}", 3 + i % 7, *[float(i)] * len(names)) for i in range(40)] + [("often", 900, *[None] * len(names))],
        "word string, df long, " + ", ".join(f"{n} double" for n in names))
    lexicon = spark.createDataFrame([("w3", 1, -1), ("w39", 0, 1), ("often", 1, 0), ("never", 1, 1)], "word string, b_moral int, tone_hits int")
    words = spark.createDataFrame(
        [("games", p, f"w{(p * 7 + i) % 40}", 1 + i % 3) for p in range(30) for i in range(9)]
        + [("games", 1, "often", 5), ("games", 77, "often", 2), ("games", 78, "none", 2)],
        "kind string, pos long, word string, tf long")
    item = ["kind", "pos"]
    hits = words.join(lexicon, "word").groupBy(*item).agg(*[F.sum(F.col(c) * F.col("tf")).alias(c) for c in ("b_moral", "tone_hits")])
    want = sorted(map(str, sim.learned_sums(words, profiles, item).join(hits, item, "full").collect()))
    assert len(want) == 31
    for most in (1, 10, 39, 100):
        found = sim.learned_sums(words, profiles, item, most, lexicon)
        assert sorted(map(str, found.collect())) == want
    assert plan(found).count("Aggregate") == 1


def test_scarce_words_are_found_once_beyond_the_broadcast(spark):
    """Sums beyond the broadcast and rare words both read the counts of scarce words; results are as without them."""
    rng = random.Random(2)
    texts = spark.createDataFrame([("games" if p % 2 else "books", p, "Fantasy", " ".join(f"{'abcdefgh'[w % 8]}oak{'ijklmnop'[w // 8 % 8]}{'qrstuvwx'[w // 64]}" for w in (int(512 * rng.random() ** 3) for _ in range(12)))) for p in range(150)], TEXTS)
    from marquee.schema import ITEM

    row = {"title": "The Oak", "metacritic": 90, "rating": 4.5, "ratings_count": 900, "year": 1990, "genre": "Fantasy"}
    narrow = spark.createDataFrame(
        [tuple((row | {"kind": r["kind"], "pos": r["pos"], "title": f"The {r['pos']}"}).get(f.name) for f in ITEM) for r in texts.collect()], ITEM
    ).drop("blurb").withColumn("period", F.lit(0.5))
    key = lambda d: sorted(map(str, d.collect()))
    most, whole = sim.BROADCAST_WORDS, sim.build_features(texts, narrow)
    assert whole.scarce is None
    sim.BROADCAST_WORDS = 12
    try:
        f = sim.build_features(texts, narrow)
        assert 0 < f.scarce.count() < f.counts.count()
        scarce = f.scarce.inputFiles()[0].rsplit("/", 2)[-2]
        rare = nb.rare_meetings(f)
        assert any(scarce in x for x in rare.inputFiles())
        assert key(rare.select(*nb.pair())) == key(nb.rare_meetings(whole).select(*nb.pair()))
    finally:
        sim.BROADCAST_WORDS = most
    assert key(f.vectors) == key(whole.vectors)
