"""Quality classifier from weak labels.

1. Labellers: simple rules look at one trait each and vote good, bad, or not at all. A text's votes are one number,
   its pattern, of at most 3 ** len(LABELLERS).
2. Expectation-maximisation over the pattern counts of all texts estimates how each labeller votes on
   good and on bad texts (Dawid and Skene, with abstaining as an outcome; a rule's bad votes on good texts are held
   below FALSE_ALARMS) and the share of good texts; no labelled data is used. It gives each pattern the posterior of being good.
3. Scorer: a logistic regression over hashed features (words, neighbouring kinds of characters, classes of traits)
   learns the posteriors, on TRAIN_ROWS rows with the smallest hashes; all rows are scored.

Defined results: null texts and texts without a word have score 0, no posterior and are not kept; null ids
are kept; repeated rows get equal results; further columns are left out; a corpus of one kind only gives
scores near its majority vote; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import BYTE, PLACE, mix, slices, word_hashes

WORDS = 1024
SHAPES = 512
TRAITS = 512
WIDTH = WORDS + SHAPES + TRAITS
TRAIN_ROWS = 4000
#: Rows that are scored together.
ROWS = 512
FALSE_ALARMS = 0.002
STEPS = 300
RATE = 0.5
SHRINK = 1e-4

#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = (
    "the of and to in is was for that with as on at by it this are be from he or an have not "
    "der die das und von zu den mit ein eine ist im dem nicht sich auf für als auch "
    "le la les de des et un une en que qui dans pour par sur est au du "
    "el los las del y por con para una se su al es lo"
).split()

#: Name, trait, the side and the bound beyond which it votes bad, the bound up to which it votes good (none: it never does).
LABELLERS = [
    ("symbols", "symbols", "above", 0.04, None),
    ("distinct words", "distinct", "below", 0.35, None),
    ("capitals", "capitals", "above", 0.3, None),
    ("bars", "bars", "above", 0.2, None),
    ("repeated lines", "repeated", "above", 0.4, None),
    ("exclamations", "exclamations", "above", 0.4, None),
    ("function words", "function", "below", 0.03, 0.08),
]

#: Kinds of bytes: 0 other, 1 lower, 2 capital, 3 digit, 4 blank, 5 line end, 6 mark, 7 symbol.
_KIND = np.zeros(256, "u1")
for _kind, _chars in ((4, b" \t\r"), (5, b"\n"), (6, b".,;:!?'\"()-"), (7, b"#$%&*|{}<>^~@=+/\\_[]`")):
    _KIND[list(_chars)] = _kind
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 1


_FUNCTION = word_hashes(pa.array([" ".join(FUNCTION_WORDS)]))[0]
_FUNCTION_BITS = np.zeros(1 << 16, bool)
_FUNCTION_BITS[_FUNCTION & np.uint64(0xFFFF)] = True


def traits(part: pa.RecordBatch):
    """(word hashes, bounds, kinds of bytes, byte bounds, traits by name) of a slice of texts."""
    col = part.column("text")
    words, bounds = word_hashes(col)
    off = np.frombuffer(col.buffers()[1], "<i4", len(col) + 1, col.offset * 4).astype("i8")
    data = col.buffers()[2]
    raw = np.frombuffer(data, "u1")[off[0] : off[-1]] if data is not None else np.zeros(0, "u1")
    off = off - off[0]
    size, n = np.maximum(np.diff(off), 1), np.maximum(np.diff(bounds), 1)
    doc = np.repeat(np.arange(len(col)), np.diff(off))
    kind = _KIND[raw]
    share = lambda hit: np.bincount(doc[hit], minlength=len(col))
    of_word = np.repeat(np.arange(len(col)), np.diff(bounds))

    # Text number in the high bits, 40 bits of the word below: equal words of a text become neighbours.
    key = np.sort(of_word.astype("u8") << np.uint64(40) | words >> np.uint64(24))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    n_distinct = np.bincount((key[new] >> np.uint64(40)).astype("i8"), minlength=len(col))
    # Lines: sums of placed bytes between line ends.
    starts = np.flatnonzero(np.append(True, raw[:-1] == 10)) if len(raw) else np.zeros(0, "i8")
    starts = np.union1d(starts, off[:-1][np.diff(off) > 0])
    line = np.zeros(0, "u8")
    line_doc = doc[starts] if len(raw) else np.zeros(0, "i8")
    if len(raw):
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
        line = np.add.reduceat(BYTE[raw] * PLACE[place & (len(PLACE) - 1)], starts) ^ mix(line_doc.astype("u8") + np.uint64(3))
    _, first = np.unique(line, return_index=True)
    n_lines = np.bincount(line_doc, minlength=len(col))
    different = np.bincount(line_doc[first], minlength=len(col))
    # Few words pass a look at 16 of their bits; those are compared whole.
    maybe = np.flatnonzero(_FUNCTION_BITS[words & np.uint64(0xFFFF)])
    function = np.zeros(len(words), bool)
    function[maybe] = np.isin(words[maybe], _FUNCTION)
    got = {
        "symbols": share(kind == 7) / size,
        "distinct": n_distinct / n,
        "capitals": share(kind == 2) / size,
        "bars": share(raw == ord("|")) / n,
        "repeated": 1 - different / np.maximum(n_lines, 1),
        "exclamations": share(raw == ord("!")) / n,
        "function": np.bincount(of_word, function, len(col)) / n,
    }
    return words, bounds, kind, off, got


def votes(got: dict, n_words: np.ndarray) -> np.ndarray:
    """Pattern of each text: base three, 0 no vote, 1 bad, 2 good. Texts of under ten words get votes on characters only."""
    pattern = np.zeros(len(n_words), "i8")
    for _, trait, side, bad, good in LABELLERS:
        v = got[trait]
        is_bad = v > bad if side == "above" else v < bad
        is_good = np.zeros(len(v), bool) if good is None else v <= good if side == "above" else v >= good
        vote = np.where(is_bad, 1, np.where(is_good, 2, 0))
        if trait in ("distinct", "repeated", "function"):
            vote = np.where(n_words >= 10, vote, 0)
        pattern = pattern * 3 + vote
    return np.where(n_words > 0, pattern, -1)


def _patterns(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            _, bounds, _, _, got = traits(part)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(votes(got, np.diff(bounds)))], ["doc_id", "h", "pattern"])


def vectors(part: pa.RecordBatch):
    """(texts x WIDTH hashed features, words per text); each family of features is scaled by itself."""
    words, bounds, kind, off, got = traits(part)
    rows = part.num_rows
    of_word = np.repeat(np.arange(rows), np.diff(bounds))
    a = np.bincount(of_word * WORDS + (words >> np.uint64(50)).astype("i8") % WORDS, minlength=rows * WORDS).reshape(rows, WORDS)
    a = np.sqrt(a / np.maximum(np.diff(bounds), 1)[:, None])
    doc = np.repeat(np.arange(rows, dtype="i4") * SHAPES, np.diff(off))
    # Kinds of a character and the two before it in the same text.
    one, two = np.zeros((2, len(kind)), "i4")
    one[1:], two[2:] = kind[:-1], kind[:-2]
    starts = off[:-1][np.diff(off) > 0]
    one[starts] = two[starts] = 0
    second = starts + 1
    two[second[second < len(kind)]] = 0
    doc += (kind.astype("i4") << 6) | (one << 3) | two
    b = np.bincount(doc, minlength=rows * SHAPES).reshape(rows, SHAPES)
    b = np.sqrt(b / np.maximum(np.diff(off), 1)[:, None])
    c = np.zeros((rows, TRAITS))
    for j, (_, trait, *_rest) in enumerate(LABELLERS):
        step = np.minimum((np.minimum(got[trait], 1.0) * 40).astype("i8"), 40)
        c[np.arange(rows), j * 41 + step] = 0.5
    return np.hstack([0.3 * a, b, c]).astype("f4"), np.diff(bounds)


def _examples(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            x = vectors(part)[0].astype("<f2")
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("pattern"), pa.array([r.tobytes() for r in x], pa.binary())], ["h", "pattern", "x"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """Posterior of good for each pattern; votes of each labeller given the class; share of good texts."""
    m = len(LABELLERS)
    vote = np.stack([(patterns // 3 ** (m - 1 - j)) % 3 for j in range(m)], axis=1)
    # A start in which the rules mean what they say; without it the classes could come out the other way round.
    post = np.where((vote == 1).any(1), 0.05, 0.95)
    table, prior = np.zeros((m, 2, 3)), 0.5
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])
        prior = (w[1].sum() + 1) / (w.sum() + 2)
        for j in range(m):
            for v in range(3):
                table[j, :, v] = w[:, vote[:, j] == v].sum(1) + 1
        table /= table.sum(axis=2, keepdims=True)
        # Rules see different faults, so most votes of a bad text are not bad; what binds them is that a
        # good text seldom gets a bad vote at all.
        table[:, 1, 1] = np.minimum(table[:, 1, 1], FALSE_ALARMS)
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(np.array([1 - prior, prior]))[:, None] + sum(np.log(table[j][:, vote[:, j]]) for j in range(m))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table, prior


def fit(x: np.ndarray, y: np.ndarray):
    """Weights and bias of a logistic regression on soft labels, by gradient steps with momentum."""
    w, b = np.zeros(x.shape[1], "f4"), 0.0
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(STEPS):
        e = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        vw = 0.9 * vw - RATE * (x.T @ e / len(y) + SHRINK * w)
        vb = 0.9 * vb - RATE * float(e.mean())
        w, b = (w + vw).astype("f4"), b + vb
    return w, b


def _score(shared):
    def run(batches):
        w, b = shared.value
        for batch in batches:
            # Short texts are many to a slice, and each is a row of WIDTH numbers.
            for part in (some.slice(a, ROWS) for some in slices(batch, "text") for a in range(0, some.num_rows, ROWS)):
                x, n_words = vectors(part)
                # Rounded, so that equal texts score the same whatever rows they stand among.
                s = 1 / (1 + np.exp(-np.clip(x.astype("f8") @ w.astype("f8") + b, -30, 30)))
                s = np.round(np.where(n_words > 0, s, 0.0), 9)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(s)], ["doc_id", "h", "score"])

    return run


def score_quality(docs: DataFrame, bar: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, keep per row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text).alias("h"), text.alias("text"))
    counted = rows.mapInArrow(_patterns, "doc_id long, h long, pattern long").groupBy("pattern")
    # Equal rows share a pattern, so the sum of its distinct rows is about theirs.
    seen = counted.agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different")).toArrow()
    patterns, counts = seen["pattern"].to_numpy(), seen["n"].to_numpy()
    known = patterns >= 0
    if not known.any():
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("keep"))
    post, _, _ = estimate(patterns[known], counts[known].astype("f8"))
    of_pattern = dict(zip(patterns[known].tolist(), post.tolist()))
    # Copies of one row are one example, so the share is one of distinct rows: few of them are all taken.
    share = min(1.0, 1.25 * TRAIN_ROWS / sum(seen["different"].to_pylist()))
    some = rows.filter(F.shiftrightunsigned("h", 1) <= min(int(share * 2**62) * 2, 2**63 - 1))

    def with_patterns(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, bounds, _, _, got = traits(part)
                whole = pa.RecordBatch.from_arrays([*part.columns, pa.array(votes(got, np.diff(bounds)))], [*part.schema.names, "pattern"])
                yield from _examples([whole])

    examples = some.mapInArrow(with_patterns, "h long, pattern long, x binary").filter("pattern >= 0").dropDuplicates(["h"]).toArrow().sort_by("h")
    examples = examples.slice(0, TRAIN_ROWS)
    x = np.frombuffer(b"".join(examples["x"].to_pylist()), "<f2").reshape(-1, WIDTH).astype("f4")
    y = np.array([of_pattern[p] for p in examples["pattern"].to_pylist()])
    if not len(y):
        raise ValueError("no row was chosen to learn from")
    shared = spark.sparkContext.broadcast(fit(x, y))
    scored = rows.mapInArrow(_score(shared), "doc_id long, h long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= bar).alias("keep"))
