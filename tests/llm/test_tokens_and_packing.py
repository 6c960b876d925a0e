"""Token counts and packing against the tokenizers themselves, with awkward rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm.packing import best_fit, pack, pack_documents
from marquee.llm.token_counts import count_tokens
from marquee.session import materialise

SCHEMA = "doc_id long, text string, lang string, n long, piece string, length long"
TEXTS = [
    None,
    "",
    "   \n\n  ",
    "It's we'll DON'T 's ''s 12345 x²¼ µm",
    "a<|endoftext|>b <|endoftext|>",
    "<|startoftext|> déjà vu  ß İstanbul\u0085x y",
    "日本語 и русский текст \U0001f600 ़ ͸ ࢏",
    "\x00\x01\x1c a\x1db",
    "word " * 6000,
    "a" * 20000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, 1, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "xx", 2, "clash", 7), (3, "other", "xx", 2, "clash", 7), (None, "no id", None, 0, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = sorted(
        ((r["doc_id"] if r["doc_id"] is not None else -1), len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False).ids))
        for r in docs.collect()
    )
    got = count_tokens(docs, path).collect()
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert count_tokens(docs.limit(0), path).count() == 0


def pieces(text):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    return [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]


def placed_well(rows, capacity=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= capacity
    return len(bins)


def test_pack_documents(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = pack_documents(docs, path).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    want = sorted(key((r["doc_id"], *p)) for r in docs.collect() for p in pieces(r["text"]))
    assert sorted(key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows) == want
    total = sum(r["length"] for r in rows)
    assert placed_well(rows) <= -(-total // 4096) + 1
    assert pack_documents(docs.limit(0), path).count() == 0


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 101, 300).tolist(), reverse=True)
    bins, offsets = best_fit(lengths, 100)
    free = {}
    for n, b, off in zip(lengths, bins, offsets):
        fits = [s for s in free.values() if s >= n]
        if b in free:
            assert free[b] == min(fits) and off == 100 - free[b]
        else:
            assert not fits and off == 0
        free[b] = free.get(b, 100) - n


@pytest.mark.parametrize("shape", ["mixed", "large", "same id"])
def test_residual_rounds(spark, shape):
    """Many small groups, merged in rounds, come close to one best fit over everything."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(60, 64, 500) if shape == "large" else rng.integers(1, 90, 3000)
    one = F.lit(7) if shape == "same id" else F.col("doc_id")
    rows = [(i, 0, 0, int(n), i, i) for i, n in enumerate(lengths)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long").withColumn("doc_id", one.cast("long"))
    out = pack(materialise(frame, "test"), capacity=100, group_items=400).collect()
    assert sorted(r["length"] for r in out) == sorted(lengths.tolist())
    used = placed_well(out, 100)
    best = len(set(best_fit(sorted(lengths.tolist(), reverse=True), 100)[0]))
    assert used <= best * 1.03 + 1


def test_groups_stay_bounded(spark):
    """No two of the pieces fit together: no round may gather them in one group."""
    rows = [(i, 0, 0, 60 + i % 4, i, i) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")
    out = pack(materialise(frame, "test"), capacity=100, group_items=50).collect()
    assert placed_well(out, 100) == len(out) == 500
    sizes = {}
    for r in out:
        group = r["sequence_id"] >> 24
        sizes[group] = sizes.get(group, 0) + 1
    assert max(sizes.values()) <= 2 * 50


def test_words_need_only_merges():
    """Words of plain text are merged one by one, not sent through the library's normalising and cutting again."""
    from marquee.llm.packing import WordIds

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    class Counted:
        calls = 0

        def __getattr__(self, name):
            return getattr(tok, name)

        def encode(self, *args, **how):
            Counted.calls += 1
            return tok.encode(*args, **how)

    texts = ["Déjà vu, NAÏVE straße; don't we'll 42x it's «ça» £5 ½ x² ¡hola! soft\xadhyphen a\xa0b", "plain words only, plain."]
    got = WordIds(Counted())(texts)
    assert Counted.calls == 0
    assert got == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
