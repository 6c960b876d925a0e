"""Benchmark decontamination by latent semantic retrieval.

1. Words: one pass turns texts into stored word hashes, in stretches of at most STRETCH words that
   overlap, so that later passes read four bytes a word and no stretch is long.
2. Passage statistics: stretches are cut into passages of PASSAGE words; a term's IDF comes from the number of
   passages that hold it, over all texts. Terms are hashed to TERMS columns.
3. Randomised SVD of the passages' TF-IDF matrix A: its row space is sketched as S A, where the
   random matrix S has one signed entry per passage, so a task adds each passage to one of SKETCH
   rows; tasks' sketches are summed in blocks, in two levels. The SVD of the sketch gives the right singular vectors.
4. Candidate search: a term's vector is its row of V / sigma, times its weight. Windows about as long as the benchmark's
   items slide over every stretch by half their length; those whose cosine with an item is at least
   COSINE are candidates.
5. Checks on words: the longest common subsequence (LCS) of an item and the words around the window. At least
   COPIED of an item's words in order are a copy; at least REWORDED are a paraphrase if the answer is there as well
   (ANSWERED of its words in order). The answer is the item's answer column, or its last sentence.

The weight of a term is its IDF to the power IDF_POWER: function words otherwise decide the cosine of short windows.
Items are taken in blocks of at most ITEMS per pass, which bounds what is broadcast. Items longer
than LONGEST words are checked in equal parts; a text that holds a part holds the item; a last sentence is looked for with the last
part, an answer that is given with each. Items of fewer than FEW words are looked up in the hashes of all runs of as many words and count only if
all of them are there, in order, and nothing else between.

Defined results: one row per document id and item that it holds, with the best stretch; null texts and texts without words hold
nothing; documents with null ids are searched and reported together with a null id; items without a word or
with a null text are never found; repeated documents and repeated item ids give one row; further
columns are left out; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .registry import released, ship
from .words import mix, slices, word_hashes

PASSAGE = 64
TERMS = 1 << 14
SKETCH = 160
IDF_POWER = 3
STRETCH = 1 << 15
BLOCK = 8
LONGEST = 128
FEW = 8
COSINE = 0.42
COPIED = 0.7
REWORDED = 0.5
ANSWERED = 0.8
ITEMS = 20_000
CHUNK = 1 << 16
SALTS = 64

HIT = "doc_id long, item_id long, first_word long, n_words long, lcs double, answer double"


def _words(batches):
    """Texts -> stretches of word hashes; a stretch repeats the last 2 * LONGEST words of the one before."""
    step = STRETCH - 2 * LONGEST
    for batch in batches:
        for part in slices(batch, "text"):
            words, bounds = word_hashes(part.column("text"))
            words = (words >> np.uint64(32)).astype("<u4")
            ids, first, out = [], [], []
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                n = int(bounds[i + 1] - bounds[i])
                for a in range(0, max(n - 2 * LONGEST, min(n, 1)), step):
                    ids.append(doc_id)
                    first.append(a)
                    out.append(words[bounds[i] + a : bounds[i] + min(n, a + STRETCH)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "first", "words"])


def stretches(batch: pa.RecordBatch, most: int = 1 << 17):
    """Parts of a batch of about `most` words: (part, word hashes, first word of each stretch and the end)."""
    for part in slices(batch, "words", 4 * most):
        col = part.column("words")
        n = pc.binary_length(col).to_numpy(zero_copy_only=False) // 4
        yield part, np.frombuffer(b"".join(col.to_pylist()), "<u4"), np.concatenate([[0], np.cumsum(n)])


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint32(9)).astype("i8") & (TERMS - 1)


def passages(bounds: np.ndarray, size: int):
    """First word of each passage (texts are cut every `size` words) and the end."""
    n = np.diff(bounds)
    per = -(-n // size)
    first = np.repeat(bounds[:-1], per)
    step = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return np.append(first + step * size, bounds[-1])


def _frequencies(batches):
    """Passages per term, and the number of passages under term -1."""
    seen, total = np.zeros(TERMS, "i8"), 0
    for batch in batches:
        for _, words, bounds in stretches(batch, 1 << 18):
            cuts = passages(bounds, PASSAGE)
            which = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            key = np.sort(which * TERMS + terms_of(words))
            once = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
            seen += np.bincount(once & (TERMS - 1), minlength=TERMS)
            total += len(cuts) - 1
    k = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(seen[k], total))], ["term", "n"])


def idf_of(words: DataFrame) -> np.ndarray:
    got = words.mapInArrow(released(_frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    seen = np.zeros(TERMS)
    seen[term[term >= 0]] = n[term >= 0]
    total = int(n[term < 0].sum())
    return (np.log((1 + total) / (1 + seen)) ** IDF_POWER).astype("f4")


def _sketch(shared):
    """Sum of signed unit TF-IDF passages per row of the sketch, as blocks of CHUNK entries."""

    def run(batches):
        idf = shared.value
        held = np.zeros(SKETCH * TERMS, "f4")
        for batch in batches:
            for _, words, bounds in stretches(batch, 1 << 19):
                cuts = passages(bounds, PASSAGE)
                n = np.diff(cuts)
                which = np.repeat(np.arange(len(n)), n)
                term = terms_of(words)
                weight = idf[term]
                # A passage's row and sign come from its words, so a task that runs again makes the same sketch.
                own = mix(np.add.reduceat(words.astype("u8"), cuts[:-1]))
                row = (own >> np.uint64(20)).astype("i8") % SKETCH
                size = np.sqrt(np.add.reduceat(weight * weight, cuts[:-1]))
                sign = np.where(own & np.uint64(1), 1.0, -1.0) / np.maximum(size, 1e-9)
                held += np.bincount(row[which] * TERMS + term, weight * sign[which], held.size).astype("f4")
        names = ["chunk", "at", "v"]
        for c in range(0, held.size, CHUNK):
            at = np.flatnonzero(held[c : c + CHUNK]).astype("<i4")
            if len(at):
                dense = 2 * len(at) > CHUNK
                v = held[c : c + CHUNK] if dense else held[c + at]
                yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK]), pa.array([b"" if dense else at.tobytes()]), pa.array([v.tobytes()])], names)

    return run


def _add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of the blocks of one number, one batch at a time."""
    chunk, total = 0, np.zeros(CHUNK, "f8")
    for pdf in parts:
        chunk = pdf["chunk"].iloc[0]
        for at, v in zip(pdf["at"], pdf["v"]):
            v = np.frombuffer(v, "<f4")
            if len(at):
                total[np.frombuffer(at, "<i4")] += v
            else:
                total += v
    yield pd.DataFrame({"chunk": [chunk], "at": [b""], "v": [total.astype("<f4").tobytes()]})


def term_vectors(words: DataFrame, idf: np.ndarray) -> np.ndarray:
    """TERMS + 1 rows: weight times V / sigma of the randomised SVD of all passages; the last row is zero."""
    shared = words.sparkSession.sparkContext.broadcast(idf)
    block = "chunk long, at binary, v binary"
    # Two levels, so that no task sums the blocks of all tasks.
    parts = words.mapInArrow(released(_sketch(shared)), block).withColumn("salt", F.spark_partition_id() % SALTS)
    some = parts.groupBy("chunk", "salt").applyInPandas(_add, block)
    got = some.groupBy("chunk").applyInPandas(_add, block).toArrow()
    sketch = np.zeros(SKETCH * TERMS, "f4")
    for c, v in zip(got["chunk"].to_pylist(), got["v"].to_pylist()):
        sketch[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(v, "<f4")
    sketch = sketch.reshape(SKETCH, TERMS)
    values, left = np.linalg.eigh(sketch.astype("f8") @ sketch.T.astype("f8"))
    order = np.flatnonzero(values > 1e-9 * max(values.max(), 1e-30))
    if not len(order):
        return np.zeros((TERMS + 1, 1), "f4")
    # V = A^T U / sigma, and a folded-in row is a V / sigma
    folded = (idf[:, None] * (sketch.T @ (left[:, order] / values[order]))).astype("f4")
    return np.vstack([folded, np.zeros((1, folded.shape[1]), "f4")])


_SENTENCE = regex.compile(r"(?<=[.!?:\n])\s+")


class Items:
    """Items of one block as word hashes, with their vectors per window size."""

    def __init__(self, ids, texts, answers, vectors):
        short = lambda x: (word_hashes(pa.array(x, pa.string()))[0] >> np.uint64(32)).astype("u4")
        words, bounds = short([t or "" for t in texts]), word_hashes(pa.array([t or "" for t in texts], pa.string()))[1]
        tails = [(a if a is not None else _last_sentence(t or "")) for a, t in zip(answers, texts)]
        tail_words, tail_bounds = short(tails), word_hashes(pa.array(tails, pa.string()))[1]
        self.ids, self.words, self.answers, self.by_size, few = [], [], [], {}, {}
        for i, item in enumerate(ids):
            own, tail = words[bounds[i] : bounds[i + 1]], tail_words[tail_bounds[i] : tail_bounds[i + 1]]
            if 0 < len(own) < FEW:
                few.setdefault(len(own), []).append((item, own))
                continue
            # Parts of about the same length, so that none is short.
            cuts = np.linspace(0, len(own), -(-len(own) // LONGEST) + 1).astype("i8").tolist()
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                part = own[a:b]
                size = max(2 * BLOCK, 1 << (len(part) - 1).bit_length())
                v = vectors[terms_of(part)].sum(axis=0)
                self.by_size.setdefault(size, []).append((len(self.ids), v / max(np.sqrt(v @ v), 1e-30)))
                self.ids.append(item)
                self.words.append(part)
                # The last sentence stands with the last part; an answer that was given may stand anywhere.
                self.answers.append(tail if answers[i] is not None or k == len(cuts) - 2 else part[:0])
        self.by_size = {s: (np.array([i for i, _ in x]), np.array([v for _, v in x], "f4").T.copy()) for s, x in self.by_size.items()}
        # Items of few words, by length: sorted hashes of their words in order, and the items.
        self.few = {}
        for n, x in few.items():
            runs = run_hashes(np.concatenate([w for _, w in x]), n)[::n]
            order = np.argsort(runs, kind="stable")
            self.few[n] = runs[order], np.array([k for k, _ in x], object)[order], np.array([w for _, w in x])[order]


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, "u8")
    total = np.zeros(len(words) - n + 1, "u8")
    for j in range(n):
        total = mix(total + words[j : len(words) - n + 1 + j].astype("u8") + np.uint64(j + 1))
    return total


def _last_sentence(text: str) -> str:
    parts = [p for p in _SENTENCE.split(text) if p.strip()]
    return parts[-1] if len(parts) > 1 else ""


def lcs(items: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each row of items with the same row of around; zeros match nothing.

    The table's rows are computed for all pairs at once."""
    row = np.zeros((len(items), around.shape[1] + 1), "i2")
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        same = (around == word) & (word != 0)
        np.maximum(row[:, 1:], row[:, :-1] + same, out=row[:, 1:])
        np.maximum.accumulate(row, axis=1, out=row)
    return row[:, -1]


def padded(words: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    at = low[:, None] + np.arange(width)
    return np.where(at < high[:, None], words[np.minimum(at, len(words) - 1)], 0)


def few_words(items: Items, words: np.ndarray, bounds: np.ndarray):
    """(item, stretch, first word, number of words) where all words of a short item stand one right after another."""
    for n, (runs, ids, own) in items.few.items():
        here = run_hashes(words, n)
        left = np.searchsorted(runs, here, "left")
        at = np.flatnonzero((left < len(runs)) & (runs[np.minimum(left, len(runs) - 1)] == here))
        stretch = np.searchsorted(bounds, at, "right") - 1
        # The first place in a stretch says all.
        _, once = np.unique(stretch * (len(runs) + 1) + left[at], return_index=True)
        at, stretch = at[once], stretch[once]
        for p, d, k in zip(at.tolist(), stretch.tolist(), left[at].tolist()):
            while k < len(runs) and runs[k] == here[p]:
                if p + n <= bounds[d + 1] and (words[p : p + n] == own[k]).all():
                    yield ids[k], d, p, n
                k += 1


def judge(items: Items, numbers: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(LCS share, answer share, is held) of candidate pairs: item numbers, and the stretch of words to look at."""
    share, answer = np.zeros(len(numbers)), np.zeros(len(numbers))
    kept = np.zeros(len(numbers), bool)
    if not len(numbers):
        return share, answer, kept
    mine = [items.words[k] for k in numbers.tolist()]
    n = np.array([len(x) for x in mine])
    for a in range(0, len(numbers), 2048):
        cut = slice(a, a + 2048)
        wide = np.zeros((len(n[cut]), n[cut].max()), "u4")
        for i, x in enumerate(mine[cut]):
            wide[i, : len(x)] = x
        share[cut] = lcs(wide, padded(words, low[cut], high[cut], int((high - low)[cut].max()))) / n[cut]
    for i in np.flatnonzero(share >= REWORDED).tolist():
        tail = items.answers[numbers[i]]
        if len(tail):
            answer[i] = lcs(tail[None, :], words[low[i] : high[i]][None, :])[0] / len(tail)
        kept[i] = share[i] >= COPIED or answer[i] >= ANSWERED
    return share, answer, kept


def window_vectors(words, bounds, vectors):
    """(running sums of the blocks' vectors, first word of each block and the end, blocks per stretch)."""
    cuts = passages(bounds, BLOCK)
    n = np.diff(cuts)
    term = np.append(terms_of(words), len(vectors) - 1)
    at = cuts[:-1, None] + np.arange(BLOCK)
    at = np.where(np.arange(BLOCK) < n[:, None], at, len(words))
    sums = vectors[term[at[:, 0]]]
    for j in range(1, BLOCK):
        sums += vectors[term[at[:, j]]]
    total = np.zeros((len(sums) + 1, sums.shape[1]))
    np.cumsum(sums, axis=0, dtype="f8", out=total[1:])
    return total, cuts, -(-np.diff(bounds) // BLOCK)


def windows(n_blocks, size, stride):
    """(stretch, first block, one past the last block) of all windows."""
    first_block = np.cumsum(n_blocks) - n_blocks
    each = np.maximum(1, -(-(n_blocks - size) // stride) + 1) * (n_blocks > 0)
    doc = np.repeat(np.arange(len(n_blocks)), each)
    a = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * stride
    return doc, first_block[doc] + a, first_block[doc] + np.minimum(a + size, n_blocks[doc])


def _search(shared, cosine: float):
    """Stretches -> the items they hold."""
    names = [x.split()[0] for x in HIT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        items, vectors = shared()
        of_item = np.array(items.ids, object)
        for batch in batches:
            for part, words, bounds in stretches(batch):
                total, cuts, n_blocks = window_vectors(words, bounds, vectors)
                ids, first = part.column("doc_id").to_pylist(), part.column("first").to_numpy(zero_copy_only=False)
                short = [(ids[d], item, int(first[d] + p - bounds[d]), n, 1.0, 0.0) for item, d, p, n in few_words(items, words, bounds)]
                if short:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*short), kinds)], names)
                for size, (numbers, unit) in items.by_size.items():
                    doc, a, b = windows(n_blocks, size // BLOCK, max(1, size // BLOCK // 2))
                    for at in range(0, len(doc), 1 << 14):
                        some = slice(at, at + (1 << 14))
                        v = (total[b[some]] - total[a[some]]).astype("f4")
                        bar = cosine * np.sqrt(np.einsum("ij,ij->i", v, v))
                        w, i = np.nonzero(v @ unit >= np.maximum(bar, 1e-30)[:, None])
                        d = doc[at + w]
                        low = np.maximum(cuts[a[at + w]] - size // 2, bounds[d])
                        high = np.minimum(cuts[b[at + w]] + size // 2, bounds[d + 1])
                        share, answer, kept = judge(items, numbers[i], words, low, high)
                        if kept.any():
                            k = np.flatnonzero(kept)
                            cols = (
                                [ids[x] for x in d[k].tolist()], of_item[numbers[i[k]]].tolist(),
                                (first[d[k]] + low[k] - bounds[d[k]]).tolist(), (high[k] - low[k]).tolist(), share[k].tolist(), answer[k].tolist(),
                            )
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", answer_col: str | None = None, cosine: float = COSINE,
) -> DataFrame:
    """doc_id, item_id, first_word, n_words (the words checked), lcs, answer (shares) of every item a document holds."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    asked = benchmark.select(
        F.col(item_col).cast("long").alias("item_id"),
        F.col(item_text_col).cast("string").alias("text"),
        (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("answer"),
    ).filter("text is not null")
    n_items = asked.count()
    if not n_items:
        return spark.createDataFrame([], HIT)
    words = materialise(texts.mapInArrow(released(_words), "doc_id long, first long, words binary"), "words")
    vectors = term_vectors(words.select("words"), idf_of(words.select("words")))
    blocks = -(-n_items // ITEMS)
    out = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        items = Items(block["item_id"].to_pylist(), block["text"].to_pylist(), block["answer"].to_pylist(), vectors)
        shared = ship(spark, (items, vectors))
        got = words.mapInArrow(released(_search(shared, cosine)), HIT)
        out = got if out is None else out.unionByName(got)
    best = F.max(F.struct("lcs", "answer", (-F.col("first_word")).alias("f"), "n_words")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("m.f")).alias("first_word"), "m.n_words", "m.lcs", "m.answer"
    )
