"""Language identification of mixed texts: script ranges, word scores, Viterbi with a switching penalty.

Model: per language the frequencies of byte trigrams of words (with word ends), hashed to BUCKETS,
and the shares of the scripts its words are written in, counted over all training rows.

A word's script, read from the code point of its first letter, narrows the candidates to the
languages that use this script for at least SCRIPT_SHARE of their words. A candidate's score is the
log-likelihood of the word relative to the best candidate, not below -FLOOR. Viterbi picks the sequence of languages with
the best sum of scores less SWITCH per change; equal sequences prefer the language that comes first
in alphabetical order. A text's language is the one whose spans hold most letters (bytes of words); the score is
their share.

Defined results: `und` with score 0 for null texts and texts without a letter; a text whose scripts no
language uses gets the first language that training saw most often, with the share as usual; null ids are kept; repeated rows
get equal results; further columns are left out; without training rows every text is `und`; an
empty table gives an empty result. Marks that stand on no letter are none. More than MOST_LANGUAGES languages are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .registry import released, ship
from .words import mix, runs_of, slices

BUCKETS = 1 << 16
SMOOTHING = 0.1
SCRIPT_SHARE = 0.01
FLOOR = 12.0
SWITCH = 10.0
#: The tables of the model have a column per language.
MOST_LANGUAGES = 256
NEVER = -1e4
UNKNOWN = "und"

#: First and last code point of the scripts' main blocks.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0531, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF),
    ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF),
    ("Ethiopic", 0x1200, 0x137F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "Other"]
_LOWS = np.array([a for _, a, _ in SCRIPTS])
_HIGHS = np.array([b for _, _, b in SCRIPTS])
_CODES = np.array([SCRIPT_NAMES.index(n) for n, _, _ in SCRIPTS])
_BYTE = mix(np.arange(3 * 256, dtype="u8") + np.uint64(99)).reshape(3, 256)


def first_letters(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code point that starts at each of the places."""
    last = len(raw) - 1
    b = [raw[np.minimum(starts + j, last)].astype("i8") for j in range(4)]
    low = [x & 0x3F for x in b]
    return np.select(
        [b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
        [b[0], (b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2]],
        (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3],
    )


def scripts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    point = first_letters(raw, starts)
    at = np.searchsorted(_LOWS, point, "right") - 1
    inside = (at >= 0) & (point <= _HIGHS[at])
    return np.where(inside, _CODES[at], len(SCRIPT_NAMES) - 1)


def trigrams(raw: np.ndarray, word: np.ndarray, starts: np.ndarray):
    """(bucket of the trigram that ends at each place, which places count): a word's trigrams end at
    its bytes and at the place after it."""
    n = len(raw)
    one = np.where(word, raw, 0)
    two = np.zeros(n, "u1")
    three = np.zeros(n, "u1")
    two[1:] = one[:-1]
    three[2:] = one[:-2]
    two[starts] = 0
    three[starts] = 0
    later = starts + 1
    later = later[later < n]
    three[later] = 0
    h = _BYTE[0][one] + _BYTE[1][two] * np.uint64(3) + _BYTE[2][three] * np.uint64(7)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype("i8") & (BUCKETS - 1), word | (two > 0)


def _count(names):
    """Training rows -> counts per language of trigram buckets, and of words per script after them."""

    def run(batches):
        codes = {n: i for i, n in enumerate(names)}
        counts = np.zeros((len(names), BUCKETS + len(SCRIPT_NAMES)), "i8")
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, word, starts, bounds = runs_of(part.column("text"), with_digits=False)
                if not len(starts):
                    continue
                lang = np.array([codes[x] for x in part.column("lang").to_pylist()])
                of_word = np.repeat(lang, np.diff(bounds))
                gram, used = trigrams(raw, word, starts)
                of_byte = np.repeat(of_word, np.diff(np.append(starts, len(raw))))
                used = used[starts[0] :]
                width = counts.shape[1]
                key = np.concatenate([of_byte[used] * width + gram[starts[0] :][used], of_word * width + BUCKETS + scripts(raw, starts)])
                counts += np.bincount(key, minlength=counts.size).reshape(counts.shape)
        i, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(counts[i, k])], ["lang", "k", "n"])

    return run


class Model:
    """Log-frequencies (buckets x languages), which languages use which script, and prior order."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        grams, words = counts[:, :BUCKETS].astype("f8"), counts[:, BUCKETS:].astype("f8")
        total = grams.sum(axis=1, keepdims=True)
        self.logs = np.log((grams + SMOOTHING) / (total + SMOOTHING * BUCKETS)).T.astype("f4").copy()
        share = words / np.maximum(words.sum(axis=1, keepdims=True), 1)
        self.uses = (share >= SCRIPT_SHARE).T.copy()
        self.usual = int(np.argmax(words.sum(axis=1))) if len(names) else 0

    def all_scores(self, raw, word, starts, step: int = 1 << 20):
        """Scores of all words, from about `step` bytes at a time, so that a long text needs no large table of bytes."""
        if len(raw) <= 2 * step:
            return self.word_scores(raw, word, starts)
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(raw), step)))
        cuts = cuts[cuts < len(starts)]
        ends = np.append(starts[cuts[1:]], len(raw))
        parts = []
        for a, b, end in zip(cuts, np.append(cuts[1:], len(starts)), ends):
            at = starts[a]
            parts.append(self.word_scores(raw[at:end], word[at:end], starts[a:b] - at))
        return np.concatenate(parts)

    def word_scores(self, raw, word, starts):
        """Score of each word in each language: relative to the best candidate, NEVER for others."""
        gram, used = trigrams(raw, word, starts)
        part = self.logs[gram[starts[0] :]]
        part *= used[starts[0] :, None]
        like = np.add.reduceat(part, starts - starts[0], axis=0)
        can = self.uses[scripts(raw, starts)]
        like = np.where(can, like, -np.inf)
        best = like.max(axis=1, keepdims=True)
        with np.errstate(invalid="ignore"):
            s = np.where(can, np.maximum(like - best, -FLOOR), NEVER)
        none = ~can.any(axis=1)
        s[none] = 0.0
        return s


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word. All texts advance together, longest first; a step handles the texts that still have a word."""
    n_words = np.diff(bounds)
    order = np.argsort(-n_words, kind="stable")
    begin, size = bounds[:-1][order], n_words[order]
    longest = int(size[0]) if len(size) else 0
    path = np.zeros(len(scores), "i2")
    if not longest:
        return path
    live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    value = scores[begin[: live[0]]].astype("f8")
    # By word: whether a language came from itself, and which other it would have come from.
    stay, lead = np.zeros(scores.shape, bool), np.zeros(len(scores), "i2")
    for t in range(1, longest):
        n = live[t]
        v, here = value[:n], begin[:n] + t
        top = v.argmax(axis=1)
        jump = v[np.arange(n), top][:, None] - penalty
        keeps = v >= jump
        stay[here], lead[here] = keeps, top
        value[:n] = np.where(keeps, v, jump) + scores[here]
    at = value.argmax(axis=1).astype("i2")
    for t in range(longest - 1, -1, -1):
        n = live[t]
        here = begin[:n] + t
        path[here] = at[:n]
        if t:
            at[:n] = np.where(stay[here, at[:n]], at[:n], lead[here])
    return path


SPAN = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))


def _label(shared):
    """Rows (key columns, text) -> key columns, lang_pred, score, spans."""

    def run(batches):
        model = shared()
        names = np.array(model.names, object)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, word, starts, bounds = runs_of(part.column("text"), with_digits=False)
                n = part.num_rows
                pred, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
                if len(starts) and len(names):
                    path = viterbi(model.all_scores(raw, word, starts), bounds, SWITCH)
                    letters = np.add.reduceat(word[starts[0] :].astype("i8"), starts - starts[0])
                    doc = np.repeat(np.arange(n), np.diff(bounds))
                    held = np.bincount(doc * len(names) + path, letters, n * len(names)).reshape(n, -1)
                    total = held.sum(axis=1)
                    known = model.uses[scripts(raw, starts)].any(axis=1)
                    seen = np.bincount(doc, known, n) > 0
                    best = np.where(seen, held.argmax(axis=1), model.usual)
                    some = total > 0
                    score[some] = held[np.flatnonzero(some), best[some]] / total[some]
                    pred = np.where(some, names[best], UNKNOWN).tolist()
                    new = np.ones(len(path), bool)
                    new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
                    at = np.flatnonzero(new)
                    size = np.diff(np.append(at, len(path)))
                    for a, d, l, m in zip((at - bounds[doc[at]]).tolist(), doc[at].tolist(), path[at].tolist(), size.tolist()):
                        spans[d].append({"lang": model.names[l], "first_word": a, "words": m})
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(pred, pa.string()), pa.array(score), pa.array(spans, SPAN)], [*part.schema.names[:-1], "lang_pred", "score", "spans"]
                )

    return run


def train(rows: DataFrame) -> Model:
    """Counts over all rows (lang, text) with a language; the table of counts has at most BUCKETS rows per language."""
    rows = rows.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in the training rows")
    counts = np.zeros((len(names), BUCKETS + len(SCRIPT_NAMES)), "i8")
    if names:
        got = rows.mapInArrow(released(_count(names)), "lang long, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
        counts[got["lang"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
    return Model(names, counts)


def identify(rows: DataFrame, model: Model, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, lang_pred, score, spans (lang, first_word, words) of every row. Only the text is looked at."""
    shared = ship(rows.sparkSession, model)
    texts = rows.select(*keys, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(released(_label(shared)), f"{kinds}, lang_pred string, score double, spans array<struct<lang: string, first_word: bigint, words: bigint>>")


def fold(id_col: str = "doc_id"):
    """Remainder by which rows are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans: trained on the rows that are not held out."""
    held = F.coalesce(fold() == 2, F.lit(False))
    model = train(docs.filter(~held).select("lang", "text"))
    return identify(docs.withColumn("held_out", held).select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])
