"""Exactness of blocked scoring and of the parallel assignment."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions import fixed
from marquee.operators import neighbours as nb
from marquee.operators.adaptations import adaptations
from marquee.operators.similarity import AXES
from marquee.operators.sorting import top_per_group
from marquee.session import materialise


def random_vectors(spark, n, seed, hot=0.0):
    """Items of four kinds; a share `hot` of them is one and the same item under other names."""
    rng = np.random.default_rng(seed)
    rows = []
    twin = None
    for g in range(n):
        v = np.where(rng.random(13) < 0.5, 0, rng.random(13))
        v = np.round(v / (np.linalg.norm(v) or 1), 9)
        tone, scale = (float(np.round(x, 9)) for x in rng.uniform(-1, 1, 2))
        score = None if rng.random() < 0.2 else float(rng.integers(40, 100))
        if twin is not None and rng.random() < hot:
            v, tone, scale, score = twin
        elif twin is None and score and score > 60:
            twin = (v, tone, scale, score)
        title = f"{rng.choice(['alpha', 'beta', 'gamma franchise', 'delta'])} {rng.integers(0, n)}"
        maker = str(rng.choice(["", "ann", "bob", "cy"]))
        kind = g * 4 // n
        rows.append((g, fixed_kind(kind), g, kind, g, title, title.split()[0], maker, score, bool(score and score >= 60), tone, scale, *map(float, v)))
    cols = "gid long, kind string, pos long, kind_rank int, turn long, title_key string, base_key string, maker string, score double, eligible boolean, tone double, scale double, "
    return spark.createDataFrame(rows, cols + ", ".join(f"v_{a} double" for a in AXES)), rows


def fixed_kind(k):
    return ["games", "books", "movies", "shows"][k]


def brute_force(rows):
    """Plain loops over all pairs."""
    best = {}
    for a in rows:
        for b in rows:
            if a[3] == b[3] or not b[9]:
                continue
            pre = len(a[5]) >= 8 and len(b[5]) >= 8 and a[5][:8] == b[5][:8]
            if a[5] == b[5] or (a[6] and a[6] == b[6]) or pre or (a[7] and a[7] == b[7]):
                continue
            s = 0.0
            for x, y in zip(a[12:], b[12:]):
                s += x * y
            s -= 0.30 * abs(a[11] - b[11])
            s += 0.10 * ((b[8] - 60) / 40)
            gap = abs(a[10] - b[10])
            s *= max(0.0, 1 - 0.62 * gap * gap)
            if s >= 0.22:
                best.setdefault((a[0], b[3]), []).append((-s, b[0]))
    return {(g, k, j) for (g, k), c in best.items() for _, j in sorted(c)[:8]}


@pytest.mark.parametrize(
    "grain,chunk,hot,block",
    [(0, 2048, 0.0, 65536), (100_000, 16, 0.0, 65536), (2_000_000, 7, 0.0, 65536), (100_000, 16, 0.4, 65536), (0, 40, 0.4, 25)],
)
def test_plain_candidates_equal_all_pairs(spark, grain, chunk, hot, block):
    df, rows = random_vectors(spark, 240, 5, hot)
    got = top_per_group(
        nb.plain_candidates(df, grain, chunk, block), ["gid", "target_rank"], [F.desc("sim"), F.asc("neighbour")], 8
    )
    assert {(r["gid"], r["target_rank"], r["neighbour"]) for r in got.collect()} == brute_force(rows)


def test_bounds_are_never_below_a_score():
    rng = np.random.default_rng(1)

    def side(n):
        v = rng.random((n, 13)) * (rng.random((n, 13)) < 0.4)
        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
        out = {f"v_{a}": v[:, i] for i, a in enumerate(AXES)}
        out |= {"gid": np.arange(n), "tone": rng.uniform(-1, 1, n), "scale": rng.uniform(-1, 1, n), "score": rng.uniform(60, 100, n)}
        out |= {k: rng.integers(-(2**62), 2**62, n) for k in nb.KEYS}
        return out

    import pandas as pd

    left, right = side(200), side(50)
    cell = {f"v_{a}": [right[f"v_{a}"].max()] for a in AXES}
    for c in ("tone", "scale"):
        cell |= {f"{c}_lo": [right[c].min()], f"{c}_hi": [right[c].max()]}
    cell["top"] = [right["score"].max()]
    bound = nb.cell_bounds(left, pd.DataFrame(cell))[:, 0]
    assert (nb.score_block(left, right).max(axis=1) <= bound + nb.SLACK).all()


def greedy(cands, cap, quota):
    """The serial rule: items by turn, each takes its best candidates with room."""
    inbound, picks = {}, set()
    by_item = {}
    for turn, gid, medium, place, target in cands:
        by_item.setdefault((turn, gid), {}).setdefault(medium, []).append((place, target))
    for (turn, gid), media in sorted(by_item.items()):
        for medium in sorted(media):
            taken = 0
            for _, target in sorted(media[medium]):
                if taken == quota:
                    break
                if inbound.get(target, 0) >= cap:
                    continue
                inbound[target] = inbound.get(target, 0) + 1
                picks.add((gid, target))
                taken += 1
    return picks


@pytest.mark.parametrize("seed,items,targets,cap", [(1, 150, 12, 4), (2, 300, 40, 8), (3, 200, 200, 1), (4, 400, 9, 40)])
def test_assignment_equals_serial_greedy(spark, seed, items, targets, cap):
    rng = random.Random(seed)
    turns = list(range(items))
    rng.shuffle(turns)
    cands = []
    for g in range(items):
        for medium in range(3):
            pool = [medium * targets + t for t in range(targets)]
            # A few targets are everyone's favourites.
            picked = sorted(rng.sample(pool, min(8, targets)), key=lambda t: (t % targets > 2, rng.random()))
            cands += [(turns[g], g, medium, i + 1, t) for i, t in enumerate(picked)]
    df = spark.createDataFrame(
        [(g, 9, t, m, j, 0.5, 0, p) for t, g, m, p, j in cands],
        "gid long, kind_rank int, turn long, target_rank int, neighbour long, sim double, axis int, place int",
    )
    got = {(r["gid"], r["neighbour"]) for r in nb.assign(df, cap, 3).collect()}
    assert got == greedy(cands, cap, 3)


def test_two_paths_equal_full_scoring(spark):
    """The bonus path and the plain path together rank as the full score does."""
    df, rows = random_vectors(spark, 120, 9)
    rng = random.Random(3)
    shared = {(a[0], b[0]): rng.randint(1, 4) for a in rows for b in rows if a[3] != b[3] and b[9] and rng.random() < 0.05}
    pairs = spark.createDataFrame([(g, j, n) for (g, j), n in shared.items()], "gid long, neighbour long, shared long")
    v = materialise(df, "test-vectors")
    scored = (
        pairs.alias("p").join(v.alias("i"), F.col("p.gid") == F.col("i.gid")).join(v.alias("j"), F.col("p.neighbour") == F.col("j.gid"))
        .filter(~nb.related() & ~nb.same_maker())
        .select("p.gid", F.col("j.kind_rank").alias("target_rank"), "p.neighbour", nb.pair_score(F.col("p.shared")).alias("sim"))
        .filter("sim >= 0.22")
    )
    both = nb.plain_candidates(v).select("gid", "target_rank", "neighbour", "sim").unionByName(scored)
    merged = both.groupBy("gid", "target_rank", "neighbour").agg(F.max("sim").alias("sim"))
    got = top_per_group(merged, ["gid", "target_rank"], [F.desc("sim"), F.asc("neighbour")], 8)
    every = (
        v.alias("i").join(v.alias("j"), (F.col("i.kind_rank") != F.col("j.kind_rank")) & F.col("j.eligible"))
        .join(pairs.alias("p"), (F.col("p.gid") == F.col("i.gid")) & (F.col("p.neighbour") == F.col("j.gid")), "left")
        .filter(~nb.related() & ~nb.same_maker())
        .select(F.col("i.gid").alias("gid"), F.col("j.kind_rank").alias("target_rank"), F.col("j.gid").alias("neighbour"),
                nb.pair_score(F.coalesce("p.shared", F.lit(0))).alias("sim"))
        .filter("sim >= 0.22")
    )
    want = top_per_group(every, ["gid", "target_rank"], [F.desc("sim"), F.asc("neighbour")], 8)
    key = lambda d: {(r["gid"], r["target_rank"], r["neighbour"], round(r["sim"], 9)) for r in d.collect()}
    assert key(got) == key(want)


def test_adaptations_with_a_hot_title(spark):
    rows = [(g, g % 4, "hot" if g % 3 == 0 else f"t{g // 2}") for g in range(600)]
    df = spark.createDataFrame(rows, "gid long, kind_rank int, base_key string")
    got = {r["gid"]: r["others"] for r in adaptations(df).collect()}
    for g, k, b in rows:
        others = [h for h, l, c in rows if c == b and l != k][:4]
        assert got.get(g, []) == others


def test_limits_of_the_build():
    assert (fixed.CAP, fixed.WIDE, fixed.K_PER_MEDIUM) == (40, 8, 3)
    assert len(fixed.GENRE_PRIOR) == 51 and len(AXES) == 13
