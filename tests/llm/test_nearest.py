"""Nearest neighbours against all pairs, with hot, null and broken vectors."""

import numpy as np
import pytest

from marquee.llm import nearest


def plain(rows, k):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != 16:
            continue
        ok.setdefault(i, np.array(v, "f4").astype("f8"))
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in ids[ids % 50 == 0]:
        s = x @ ok[q] / (n * np.sqrt(ok[q] @ ok[q]))
        s[ids == q] = -np.inf
        out[int(q)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k] if np.isfinite(s[j])]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = (base[rng.integers(0, 40, 1500)] + 0.6 * rng.normal(size=(1500, 16))).astype("f4")
    x[300:900] = x[300]  # one very common vector
    out = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    out += [(5000, None), (5050, [0.0] * 16), (5100, [1.0] * 15 + [None]), (5150, [float("nan")] * 16), (5200, [1.0, 2.0]), (5250, []), (None, [1.0] * 16), (5300, [float("inf")] * 16)]
    return out + [out[50]]


def test_recall_and_order(spark, rows):
    frame = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in nearest.nearest(frame, lambda i: i % 50 == 0, sample_rows=600).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = plain(rows, 5)
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 6)) and len({m[1] for m in mine}) == 5 and q not in {m[1] for m in mine}
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(mine, mine[1:]))
        exact = dict(near)
        assert all(abs(exact[m[1]] - m[2]) < 1e-12 for m in mine if m[1] in exact)
        hits += len({m[1] for m in mine} & set(exact))
        total += len(near)
    assert hits >= 0.9 * total
    hot = [q for q in want if 300 <= q < 900]
    assert all([m[1] for m in sorted(got[q])] == [i for i in range(300, 306) if i != q][:5] for q in hot)


def test_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = nearest.nearest(frame, lambda i: i % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got)] == [(0, 1, 1), (0, 2, 2)]
    assert nearest.nearest(frame.filter("vec_id = 0"), lambda i: i % 50 == 0).count() == 0
    assert nearest.nearest(frame.limit(0), lambda i: i % 50 == 0).count() == 0


def test_search_takes_nearest_branches_first():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = nearest.Forest(x, 4, 8)
    far = forest._distance_to_leaves(x[3])
    forest.reach = float(np.quantile(far, 0.3))
    assert sorted(forest.search(x[3], 1)) == np.flatnonzero(far <= forest.reach).tolist()
    own = forest.leaves(x)
    assert (own == forest.sample_leaf).all() and (far[own[:, 3]] == 0).all()
