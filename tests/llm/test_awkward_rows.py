"""Rows that once went wrong: null and shared ids in bulk, equal rows only, loose marks, short and long items, very long texts."""

import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marquee.llm import decontaminate, language, nearest, quality
from marquee.llm.packing import WordIds
from marquee.llm.token_counts import count_tokens

from .test_text_operators import frame, prose


def test_counts_of_rows_that_share_an_id(spark):
    """Each row is counted on its own, whatever its id is: null for most, and equal texts among them."""
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.9 else rng.randrange(5), " ".join(prose(rng, rng.randrange(0, 9)))) for _ in range(3000)]
    rows += [(1, "same")] * 50 + [(None, None), (None, "")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = Counter(tuple(r)[:3] for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect())
    assert got == Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_word_table_is_bounded():
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = WordIds(tok, most=50, most_chars=2000)
    rng = random.Random(6)
    for _ in range(40):
        texts = [" ".join(prose(rng, 12)), "x" * 5000]
        assert ids(texts) == [ids.whole(t) for t in texts]
        assert len(ids.new) <= 50 + 20 and len(ids.old) <= 50 + 20


def test_quality_of_equal_rows(spark):
    """Thousands of copies of one text, and of two: every row has a score, equal rows the same one."""
    good, bad = "the house of the people and the garden was in order " * 4, "!!!! |||| ###"
    for texts in ([good], [good, bad]):
        rows = [(i, texts[i % len(texts)]) for i in range(6000)]
        got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        scores = {texts[r["doc_id"] % len(texts)]: set() for r in got}
        for r in got:
            scores[texts[r["doc_id"] % len(texts)]].add(r["score"])
        assert len(got) == 6000 and all(len(s) == 1 for s in scores.values())
        assert all(0 <= x <= 1 for s in scores.values() for x in s)


def test_scorer_follows_plain_gradient_steps():
    rng = np.random.default_rng(2)
    x = rng.random((60, 5)).astype("f4")
    y = (x[:, 0] > x[:, 1]).astype("f8") * 0.9 + 0.05
    w, b = quality.fit(x, y)
    pw, pb, vw, vb = [0.0] * 5, 0.0, [0.0] * 5, 0.0
    for _ in range(quality.STEPS):
        e = [1 / (1 + np.exp(-(sum(a * c for a, c in zip(r, pw)) + pb))) - t for r, t in zip(x.tolist(), y)]
        grad = [sum(e[i] * x[i, j] for i in range(60)) / 60 + quality.SHRINK * pw[j] for j in range(5)]
        vw = [0.9 * v - quality.RATE * g for v, g in zip(vw, grad)]
        vb = 0.9 * vb - quality.RATE * sum(e) / 60
        pw, pb = [a + v for a, v in zip(pw, vw)], pb + vb
    assert np.allclose(w, pw, atol=1e-3) and abs(b - pb) < 1e-3


def test_marks_are_no_letters(spark):
    rows = [(i, "the of and to in is", "en") for i in range(8)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "́́ ̀"), (2, "1⃣ 2⃣"), (3, "été"), (4, "́the")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("en", 1.0), 4: ("en", 1.0)}


def test_very_long_text_in_two_languages(spark):
    """Scores come from parts of a text; the spans do not show where it was cut."""
    a, b = "kamoti timoka " * 150_000, "schungei eischung " * 100_000
    model = language.train(spark.createDataFrame([("aa", "kamoti timoka moka"), ("bb", "schungei eischung ungsch")], "lang string, text string"))
    row = language.identify(spark.createDataFrame([(1, a + b)], "doc_id long, text string"), model, ["doc_id"]).first()
    assert [(s["lang"], s["first_word"], s["words"]) for s in row["spans"]] == [("aa", 0, 300_000), ("bb", 300_000, 200_000)]


def test_too_many_languages_are_an_error(spark):
    import pytest

    rows = [(f"l{i}", "a b") for i in range(language.MOST_LANGUAGES + 1)]
    with pytest.raises(ValueError):
        language.train(spark.createDataFrame(rows, "lang string, text string"))


def test_short_items_anywhere(spark):
    """Items of a few words in long texts, beside rare words and over the ends of stretches, once per document."""
    rng = random.Random(16)
    items = [(1, "alpha"), (2, "beta gamma"), (3, "one two three four five six seven"), (4, "never there at all"), (5, "beta gamma")]
    long = prose(rng, 70_000, 10**6)
    for at, text in ((40, "beta gamma"), (32_766, "one two three four five six seven"), (69_990, "alpha"), (50_000, "beta")):
        long[at] = text
    docs = [(1, " ".join(long)), (2, "gamma beta"), (3, "one two three four five six"), (4, "ALPHA, alpha! alpha"), (5, "x" + " beta" * 300 + " gamma"), (6, " ".join(prose(rng, 300)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, docs), benchmark).collect()}
    assert got == {(1, 1), (1, 2), (1, 5), (1, 3), (4, 1), (5, 2), (5, 5)}


def test_long_items_with_an_answer(spark):
    """Three in ten words of a long item's last part are changed and its last sentence is there; without the sentence it is another text."""
    rng = random.Random(17)
    body = prose(rng, 400, 10**6)
    answer = "the result is zeta omega kappa"
    changed = body.copy()
    for at in range(0, 400, 20):
        changed[at : at + 7] = prose(rng, 7, 10**6)
    docs = [(1, " ".join(prose(rng, 50) + changed) + ". " + answer), (2, " ".join(changed)), (3, " ".join(prose(rng, 500, 10**6)) + " " + answer)]
    benchmark = spark.createDataFrame([(9, " ".join(body) + ". " + answer + ".")], "item_id long, text string")
    found = decontaminate.leaks(frame(spark, docs), benchmark)
    assert {r["doc_id"] for r in found.collect()} == {1}
    given = benchmark.select("item_id", F.lit(" ".join(body)).alias("text"), F.lit(answer).alias("answer"))
    assert {r["doc_id"] for r in decontaminate.leaks(frame(spark, docs), given, answer_col="answer").collect()} == {1}


def test_blocks_cut_by_salt_find_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.standard_normal(8)]) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    few = lambda n: sorted((*r[:3], round(r[3], 12)) for r in nearest.nearest(table, lambda i: i % 50 == 0, group_rows=n).collect())
    assert few(1 << 14) == few(60)


def test_pipeline_tells_rows_of_one_id_apart(spark):
    """One id with three texts, one of which is a copy, one a leak; near copies without an id; equal rows."""
    rng = random.Random(5)
    texts = [" ".join(prose(rng, 80)) + "." for _ in range(8)]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (2, f"{texts[2]} {item}"), (None, texts[3]), (None, texts[3]), (None, texts[3] + " more"), (None, texts[4]), (7, texts[4]), (None, f"{texts[5]} {item}"), (8, texts[6]), (8, texts[6]), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from marquee.session import materialise

    docs = materialise(docs, "docs")
    single = materialise(corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.001"), "single")
    got = sorted(((r["doc_id"], r["text"]) for r in single.collect()), key=repr)
    want = [(1, texts[0]), (2, texts[1]), (2, f"{texts[2]} {item}"), (7, texts[4]), (None, f"{texts[5]} {item}"), (8, texts[6]), (9, None)]
    assert [x for x in got if x[0] is not None or x[1] != texts[3] and x[1] != texts[3] + " more"] == sorted(want, key=repr)
    assert len(got) == len(want) + 1
    clean = corpus_pipeline.decontamination(spark, single, "/root/testdata/sf0.001").collect()
    assert not any(item in (r["text"] or "") for r in clean) and len(clean) == len(got) - 2


ALONE = """
import sys
sys.path.insert(0, {repo!r})
from marquee.session import local_session
import __spark_entry__
spark = local_session("4", "4")
for name in sys.argv[1:]:
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_executors_need_no_copy_of_the_package(spark, tmp_path):
    """The package is on the driver's path only: workers start in another folder."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "alone.py").write_text(ALONE.format(repo=repo))
    names = ["op1_decontamination", "op5_language_id", "op7_nearest_neighbours", "op11_spelling_variants", "op12_conversation_repair", "op13_sharding", "fuzzy_search", "progressive_lockout_stream"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "alone.py", *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.split()[0] in names] == names
