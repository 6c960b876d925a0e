"""Near copies, leaks, language, quality and secrets against plain loops, with awkward rows."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from marquee.llm import decontaminate, language, near_dup, quality, secrets, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, None, "src/a.env", 0) for i, t in rows], schema)


def split(text):
    return regex.findall(r"[\p{L}\p{N}\p{M}]+", (text or "").lower())


def prose(rng, n, vocabulary=400):
    return [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}" for _ in range(n)]


AWKWARD = ["", "  ...  ", "One, two; THREE", "x×y “quoted” Ж мир", "a" * 100_000, "é́a ñ", "\x00 \x1c z", "日本 語 12", "a-b_c d'e"]


def test_words_match_a_pattern():
    hashes, bounds = words.word_hashes(pa.array(AWKWARD))
    assert np.diff(bounds).tolist() == [len(split(t)) for t in AWKWARD]
    same = {}
    for t, a, b in zip(AWKWARD, bounds, bounds[1:]):
        for w, h in zip(split(t), hashes[a:b].tolist()):
            assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


# ---- near copies ----


def runs(text, k=5):
    w = split(text)
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def plain_lcs(a, b):
    """Bit-parallel: a cleared bit of the row is a place where the subsequence grows."""
    masks = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - bin(row).count("1")


def plain_classes(docs, threshold=0.8):
    parent = {i: i for i, _ in docs}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    rs = {i: runs(t) for i, t in docs}
    for (i, a), (j, b) in itertools.combinations(docs, 2):
        x, y = rs[i], rs[j]
        if not x or not y:
            similar = not x and not y and (a or "") == (b or "")
        elif min(len(x), len(y)) < threshold * max(len(x), len(y)):
            similar = False
        else:
            n = plain_lcs(x, y)
            similar = n / (len(x) + len(y) - n) >= threshold
        if similar:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in docs}


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        at = rng.randrange(max(1, len(ws)))
        kind = rng.random()
        ws[at : at + 1] = [] if kind < 0.3 else [ws[at], "added"] if kind < 0.6 else [f"new{rng.randrange(9)}"]
    return ws


def test_classes_match_all_pairs(spark):
    rng = random.Random(4)
    docs = [None, "", "", "...", "..", "one two", "One, two!", "one two three", "a a a a a a a", "a a a a a a a a"]
    shared = prose(rng, 60)
    for _ in range(25):
        base = prose(rng, rng.randrange(40, 160))
        docs += [" ".join(base), " ".join(edited(rng, base, rng.randrange(6))), " ".join(base[20:] + base[:20]), " ".join(shared + base[:60])]
    rows = list(enumerate(docs))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain_classes(rows)


def test_a_large_group_of_near_copies(spark):
    """A third of the rows are near copies of one text, a third share a passage and nothing else."""
    rng = random.Random(5)
    master, passage = prose(rng, 120), prose(rng, 50)
    docs = [" ".join(edited(rng, master, rng.randrange(4))) for _ in range(150)]
    docs += [" ".join(prose(rng, 35) + passage + prose(rng, 35)) for _ in range(150)]
    docs += [" ".join(prose(rng, 100)) for _ in range(50)] + [" ".join(master)] * 40
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain_classes(rows)


def links_of(spark, bands, n=60, pairs=20):
    """Links of texts with given sketches, of which the first 2 * pairs are twins with one other word."""
    rng = random.Random(11)
    texts = [prose(rng, 60) for _ in range(n)]
    for i in range(pairs):
        texts[2 * i + 1] = texts[2 * i][:30] + ["other"] + texts[2 * i][31:]
    reps = spark.createDataFrame([(i, 56, bands(i), 1) for i in range(n)], "rep long, n long, bands array<long>, copies long")
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    links, _ = near_dup.link(reps, rows, 5, 0.8, 16)
    return {(r["a"], r["b"]) for r in links.collect()}


def test_links_of_no_leader_are_found(spark):
    """All texts are in one bucket in every band: most twins are no leaders."""
    assert links_of(spark, lambda i: list(range(16)), n=200) == {(2 * i, 2 * i + 1) for i in range(20)}


def test_links_in_one_large_bucket_are_found(spark):
    """The only equal sketch of all twins is in a large bucket, whose splits leave each text alone."""
    assert links_of(spark, lambda i: [0] + [100 * i + j for j in range(1, 16)]) == {(2 * i, 2 * i + 1) for i in range(20)}


def test_only_exact_counts(spark):
    """Links are tested until classes are known, not all of them, so no number of links is given."""
    rows = frame(spark, [(1, "p q r s t u")])
    assert near_dup.near_duplicates(rows).columns == near_dup.near_duplicates(rows.limit(0)).columns == ["doc_id", "class_id", "n_copies"]


def test_near_copies_edges(spark):
    rows = frame(spark, [(7, "p q r s t u"), (7, "p q r s t u"), (3, "p q r s t u"), (None, "p q r s t u")])
    got = sorted((str(r["doc_id"]), r["class_id"], r["n_copies"]) for r in near_dup.near_duplicates(rows).collect())
    assert got == [("3", 3, 3), ("7", 3, 3), ("7", 3, 3), ("None", None, None)]
    assert near_dup.near_duplicates(rows.limit(0)).count() == 0
    assert near_dup.near_duplicates(rows.filter("doc_id is null")).count() == 1


@pytest.mark.parametrize("seed", range(6))
def test_banded_alignment(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a = [rng.randrange(12) for _ in range(rng.randrange(1, 60))]
        b = edited(rng, a, rng.randrange(5)) or [1]
        b = [x if isinstance(x, int) else 99 for x in b]
        n = plain_lcs(a, b)
        want = n / (len(a) + len(b) - n) >= 0.8
        assert near_dup.is_similar(np.array(a, "u8"), np.array(b, "u8"), 0.8) == want, (a, b)


# ---- leaks ----


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, " ".join(prose(rng, n)) + ". Answer is " + f"zeta{i} omega{i}.") for i, n in enumerate([12, 20, 33, 50, 64, 90, 300, 41, 28])]
    items += [(20, "tiny item here"), (21, None), (22, "..."), (3, "again " + " ".join(prose(rng, 30)))]
    filler = lambda n: " ".join(prose(rng, n))
    docs = [(i, filler(300)) for i in range(60)]
    docs += [(100 + i, f"{filler(rng.randrange(0, 90))} {t} {filler(70)}") for i, t in items if t and len(split(t)) > 8 and i != 3]
    reworded = split(items[3][1])
    for at in range(0, len(reworded) - 8, 3):
        reworded[at] = f"other{at}"
    docs += [(200, filler(50) + " " + " ".join(reworded) + " " + filler(50)), (201, items[3][1]), (202, filler(40_000) + " " + items[2][1]), (203, "a tiny item here"), (204, "tiny other item here")]
    docs += [(None, items[1][1]), (300, None), (301, "")]
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, docs), benchmark).collect()}
    want = {(100 + i, i) for i, t in items if t and len(split(t)) > 8 and i != 3} | {(200, 3), (201, 3), (202, 2), (203, 20), (None, 1)}
    assert got == want
    assert decontaminate.leaks(frame(spark, docs), benchmark.limit(0)).count() == 0
    assert decontaminate.leaks(frame(spark, docs).limit(0), benchmark).count() == 0


def test_batched_lcs():
    rng = np.random.default_rng(3)
    items, around = rng.integers(1, 9, (40, 12)).astype("u4"), rng.integers(1, 9, (40, 30)).astype("u4")
    items[:, 9:] *= rng.integers(0, 2, (40, 1)).astype("u4")
    assert decontaminate.lcs(items, around).tolist() == [plain_lcs([x for x in a if x], list(b)) for a, b in zip(items, around)]


# ---- language ----


def plain_viterbi(scores, penalty):
    value, back = list(scores[0]), []
    for s in scores[1:]:
        best = max(range(len(value)), key=lambda i: value[i])
        back.append([i if value[i] >= value[best] - penalty else best for i in range(len(value))])
        value = [max(value[i], value[best] - penalty) + s[i] for i in range(len(value))]
    path = [max(range(len(value)), key=lambda i: value[i])]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_viterbi_matches_a_loop():
    rng = np.random.default_rng(8)
    lengths = [0, 1, 7, 30, 2, 0, 13]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores = -rng.integers(0, 6, (bounds[-1], 3)).astype("f8")
    path = language.viterbi(scores, bounds, 4.0)
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            assert path[a:b].tolist() == plain_viterbi(scores[a:b], 4.0)


def test_language(spark):
    rng = random.Random(9)
    latin = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    aa, bb, cc = ["ka", "mo", "ti"], ["sch", "ung", "ei"], ["пр", "ив", "ет"]
    rows = [(i, latin(p, 60), name) for i, (p, name) in enumerate([(aa, "aa"), (bb, "bb"), (cc, "cc")] * 20)]
    docs = spark.createDataFrame([*rows, (900, "skip me", None)], "doc_id long, text string, lang string")
    model = language.train(docs.select("lang", "text"))
    mixed = latin(aa, 30) + " " + latin(bb, 20)
    asked = [(1, mixed), (2, None), (3, "12 34 !?"), (4, latin(cc, 3)), (5, "日本語"), (6, ""), (None, latin(bb, 4)), (1, mixed)]
    out = language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"]).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(asked) and by[1]["lang_pred"] == "aa" and 0.4 < by[1]["score"] < 0.8
    assert [(s["lang"], s["first_word"], s["words"]) for s in by[1]["spans"]] == [("aa", 0, 30), ("bb", 30, 20)]
    assert (by[2]["lang_pred"], by[3]["lang_pred"], by[6]["lang_pred"]) == ("und",) * 3 and by[2]["score"] == 0
    assert by[4]["lang_pred"] == "cc" and by[None]["lang_pred"] == "bb" and by[5]["lang_pred"] in ("aa", "bb", "cc")
    assert {r["lang_pred"] for r in language.identify_documents(docs.filter("lang is null")).collect()} == {"und"}
    assert language.identify_documents(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count() > 100


# ---- quality ----


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.8
    m = len(quality.LABELLERS)
    pattern = np.zeros(len(good), "i8")
    for j in range(m):
        vote = np.where(~good & (rng.random(len(good)) < 0.4), 1, 0)
        if j == m - 1:
            vote = np.where(good & (rng.random(len(good)) < 0.9), 2, vote)
        pattern = pattern * 3 + vote
    patterns, inverse, counts = np.unique(pattern, return_inverse=True, return_counts=True)
    post, table, prior = quality.estimate(patterns, counts.astype("f8"))
    assert abs(prior - 0.8) < 0.03 and np.abs(table[:, 0, 1] - 0.4).max() < 0.06
    assert ((post[inverse] > 0.5) == good).mean() > 0.97


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 3000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = docs.select("doc_id", "text", F.lit(1).alias("score")).unionByName(spark.createDataFrame([(-1, None, 1), (-2, " \n", 1), (None, "The words of a text and some more of the same.", 1)], "doc_id long, text string, score int"))
    got = quality.score_quality(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[-1]["score"] == by[-2]["score"] == 0 and not by[-1]["keep"] and None in by
    both = got.join(labels, "doc_id").collect()
    assert sum((r["quality"] == 1) == r["keep"] for r in both) > 0.93 * len(both)
    good = [r for r in both if r["quality"] == 1]
    assert sum(r["keep"] for r in good) > 0.98 * len(good)
    assert quality.score_quality(rows.limit(0)).count() == 0
    assert {r["keep"] for r in quality.score_quality(rows.filter("doc_id < 0")).collect()} == {False}


# ---- secrets ----

KEY = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


def secret_docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        text = [f'set token = "{value}" now', f"password={value} ok", f"order 4{rng.randrange(10**14, 10**15)} paid", f"see https://host.example/{rng.randrange(10**12)}x/a"][i % 4]
        rows.append((i, " ".join(prose(rng, 20)) + " " + text))
    rows += [(500, f"the digest {KEY} alone"), (501, None), (502, ""), (None, f'api_key: "{KEY}"'), (503, f"a={KEY},b={KEY[::-1]} {KEY}")]
    return frame(spark, rows)


def test_scan_and_redact(spark):
    docs = secret_docs(spark)
    found = secrets.scan(docs)
    rows = found.collect()
    flagged = Counter(r["doc_id"] for r in rows if r["is_secret"])
    assert all(flagged[i] == (1 if i % 4 < 2 else 0) for i in range(120))
    assert None in flagged and not {501, 502} & {r["doc_id"] for r in rows}
    assert len({r["value"] for r in rows if r["doc_id"] == 503}) == 2
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, found).collect()}
    assert clean[0].endswith('set token = "[secret]" now') and re.search(r"order \d{16} paid$", clean[2])
    assert clean[501] is None and clean[502] == "" and KEY in clean[None]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_scan_without_labels(spark):
    only = frame(spark, [(1, f"the digest {KEY} alone"), (2, f"password={KEY}")])
    got = {r["doc_id"]: r["is_secret"] for r in secrets.scan(only).collect()}
    assert got == {1: False, 2: True}
    assert secrets.scan(only.limit(0)).count() == 0
