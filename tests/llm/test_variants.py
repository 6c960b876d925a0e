"""Spelling variants against plain loops over all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from marquee.llm.variants import Acceptor, Composition, runs_of_letters, spelling_variants, vocabulary
from marquee.session import materialise


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_vocabulary(rows, least=5, times=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least
    return {w: k for w, k in n.items() if k >= times}


def plain_variants(n):
    out = {}
    for w in n:
        near = [x for x in n if x != w and is_near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best is not None and n[best] >= 2 * n[w] else None, len(near))
    ends = {}
    for w in n:
        end = w
        while out[end][0] is not None:
            end = out[end][0]
        ends[w] = end
    return {w: (form, ends[w], n[w], k, None if form is None else n[form]) for w, (form, k) in out.items()}


def found(vocab, **how):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(vocab, **how).collect()}


def test_composition_accepts_the_near_pairs():
    rng = random.Random(1)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 60))})
        acceptor = Acceptor(words)
        assert acceptor.size[acceptor.start] == len(words)
        got = sorted(tuple(sorted(p)) for p in Composition(acceptor).pairs().T.tolist())
        assert got == sorted(p for p in itertools.combinations(range(len(words)), 2) if is_near(words[p[0]], words[p[1]]))


def test_acceptor_is_minimal():
    """Equal suffix sets are one state: two symbols in four places, and the end."""
    words = sorted("".join(w) for w in itertools.product("ab", repeat=4))
    assert len(Acceptor(words).arcs) == 5


def test_very_long_words():
    words = sorted(["a" * 20_000, "a" * 19_999, "b" * 9_999 + "a", "b" * 10_000])
    got = Composition(Acceptor(words)).pairs()
    assert sorted(tuple(sorted(p)) for p in got.T.tolist()) == [(0, 1), (2, 3)]


@pytest.mark.parametrize("most", [3, 60, 10**6])
def test_variants_at_any_size_of_cells(spark, most):
    """Also with a prefix that a third of all words share, and words that are prefixes of others."""
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(150)}
    words |= {"aaaa" + "".join(rng.choice("abé") for _ in range(rng.randint(0, 4))) for _ in range(120)}
    n = {w: rng.choice([1, 2, 3, 9, 30, 31]) for w in words}
    vocab = materialise(spark.createDataFrame(list(n.items()), "word string, n long"), "words")
    assert found(vocab, most=most) == plain_variants(n)


def test_documents(spark):
    rng = random.Random(3)
    base = ["Voiture", "voitures", "TABLEAU", "tableaux", "élève", "élèves", "maison", "maisons", "a×b÷cde", "ÀÉÎÐÿ", "Ābcdef"]
    rows = [(i, " ".join(rng.choices(base, k=40)) + rng.choice(["", ".", "1", "\n"])) for i in range(200)]
    rows += [(None, "voiture " * 30), (None, None), (7, ""), (7, None), (8, "x" * 3_000_000 + " maison" * 9), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, word string, n int")
    n = plain_vocabulary(rows)
    vocab = vocabulary(frame)
    assert {r["word"]: r["n"] for r in vocab.collect()} == n
    assert any(len(w) == 5 for w in n)
    assert found(vocab) == plain_variants(n)
    assert found(vocabulary(frame.limit(0))) == {}


def test_runs_do_not_depend_on_where_a_text_is_cut():
    text = "Ab cccādd-ee " * 500
    whole = Counter()
    for part in runs_of_letters(text, 7):
        whole += part
    assert whole == next(runs_of_letters(text))
    assert whole == Counter({b"ab": 500, b"ccc": 500, b"dd": 500, b"ee": 500})
