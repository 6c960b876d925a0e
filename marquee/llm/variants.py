"""Spelling variants by finite-state composition: vocabulary o one edit o vocabulary.

Words are maximal runs of Latin letters, lower case in A-Z; a slip of the key (a documented rule of the query, `damage`)
may delete one code point. Words of at least `least` code points that occur at least `times` times are the vocabulary.

The composed machine reads a word and writes a near one: both copies of the acceptor follow the same symbols,
take one edit arc (insert, delete, replace), and from there on read equal suffixes. The edit stands where
the two words first differ, so each pair has one accepting path. The machine is partitioned by initial states:

* a cell is a prefix that at most `most` words share (and whose own prefixes are shared by more). Its task minimises
  the acceptor of its words and enumerates the accepted pairs from the state that the prefix leads to;
* the prefixes above the cells carry the edits at their own end: from there both copies stand behind the edit arc and
  accept equal suffixes, so a state is a group of words that have prefix and suffix in common: at most one per
  symbol of the alphabet and one without a symbol.

No task holds more than `most` words or one such group, whatever prefix is common. States are numbered by how many words they
accept, so a pair is two numbers and languages of shared states are enumerated once.
Per word only the number of near words and the best one leave a task, never its pairs.

The best near word is the form if it occurs at least `ratio` times as often. Counts at least double along forms,
so there is no circle, and roots come from pointer doubling.

Defined results: a null text has no words; a null id counts as the empty string in the damage rule; repeated rows
count each time; ties of counts go to the first word in code-point order; further columns are left out, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

LEAST = 5
TIMES = 3
RATIO = 2
MOST = 4096
#: One in so many (document, word) pairs loses a code point.
SLIP = 97

#: Latin-1 bytes: letters A-Z in lower case, a-z and from U+00C0 on as they are, all else blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of_letters(text: str, step: int = 1 << 20):
    """Counters of the runs [A-Za-z\\u00C0-\\u00FF]+ of a text, of about `step` characters each."""
    raw = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + step)
        end = len(raw) if end < 0 else end
        yield Counter(raw[at:end].split())
        at = end


def damage(word: bytes, start: int, slip: int = SLIP) -> bytes:
    """The word less one code point, if its checksum behind `start` says so; Latin-1 bytes are code points."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % slip:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _counted(least: int, slip: int, flush: int = 150_000, flush_chars: int = 64 << 20):
    """Documents -> words with their occurrences, summed within the task."""

    def run(batches):
        seen, held = Counter(), 0

        def out():
            words = pa.array([w.decode("latin-1") for w in seen], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found in runs_of_letters(text):
                    for word, n in found.items():
                        word = damage(word, start, slip)
                        if len(word) >= least:
                            seen[word] += n
                held += len(text)
                if len(seen) > flush or held > flush_chars:
                    yield out()
                    seen.clear()
                    held = 0
        yield out()

    return run


def vocabulary(docs: DataFrame, least: int = LEAST, times: int = TIMES, slip: int = SLIP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least `least` code points and `times` occurrences; stored."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    seen = rows.mapInArrow(_counted(least, slip), "word string, n long")
    return materialise(seen.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times), "vocabulary")


class Acceptor:
    """Minimal acceptor of sorted distinct words. State s: arcs[s] maps a symbol to a state, final[s], and size[s], the
    number of words accepted from it; states below come first. Words are numbered in code-point order."""

    def __init__(self, words: list[str]):
        self.arcs, self.final, self.size = [], [], []
        known: dict = {}
        # Path of the last word: (symbol that led here, arcs so far, whether a word ends here).
        path: list = [["", {}, False]]

        def fold(depth: int) -> None:
            while len(path) > depth + 1:
                symbol, arcs, final = path.pop()
                path[-1][1][symbol] = self._state(known, arcs, final)

        last = ""
        for word in words:
            shared = 0
            while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
                shared += 1
            fold(shared)
            path += [[symbol, {}, False] for symbol in word[shared:]]
            path[-1][2] = True
            last = word
        fold(0)
        self.start = self._state(known, path[0][1], path[0][2])

    def _state(self, known: dict, arcs: dict, final: bool) -> int:
        key = (final, tuple(arcs.items()))
        s = known.get(key)
        if s is None:
            s = known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.size.append(final + sum(self.size[t] for t in arcs.values()))
        return s

    def offsets(self, s: int) -> dict:
        """Symbol -> number of the first word behind its arc."""
        out, at = {}, int(self.final[s])
        for symbol, t in self.arcs[s].items():
            out[symbol] = at
            at += self.size[t]
        return out


_NONE = np.zeros((2, 0), "i8")


def _joined(parts: list) -> np.ndarray:
    return _NONE if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)


class Composition:
    """Accepted pairs of acceptor o one edit o acceptor, as 2 x n arrays of word numbers; each unordered pair once."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.off = [acceptor.offsets(s) for s in range(len(acceptor.arcs))]
        self.after: dict = {}

    def common(self, s: int, t: int, skip: str | None = None) -> list:
        """Symbols on which both states go on, but `skip`."""
        x, y = self.a.arcs[s], self.a.arcs[t]
        if len(x) > len(y):
            return [c for c in y if c in x and c != skip]
        return [c for c in x if c in y and c != skip]

    def moved(self, s: int, t: int, symbols: list, ends: bool) -> np.ndarray:
        """Pairs of equal words from s and t that go on by the symbols, whose targets are known, or end here."""
        parts = [np.zeros((2, 1), "i8")] if ends and self.a.final[s] and self.a.final[t] else []
        for c in symbols:
            got = self.after[self.a.arcs[s][c], self.a.arcs[t][c]]
            if got.shape[1]:
                parts.append(got + np.array([[self.off[s][c]], [self.off[t][c]]]))
        return _joined(parts)

    def equal(self, s: int, t: int) -> np.ndarray:
        """Pairs behind the edit arc: words that both states accept. Without recursion, since words can be long."""
        todo = [(s, t)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.after:
                todo.pop()
                continue
            if x == y:
                self.after[x, y] = np.tile(np.arange(self.a.size[x]), (2, 1))
                continue
            symbols = self.common(x, y)
            open_ = [p for c in symbols if (p := (self.a.arcs[x][c], self.a.arcs[y][c])) not in self.after]
            if open_:
                todo += open_
            else:
                self.after[x, y] = self.moved(x, y, symbols, True)
        return self.after[s, t]

    def edits(self, s: int) -> list:
        """Pairs whose edit is the next arc from s."""
        out, arcs, off = [], list(self.a.arcs[s].items()), self.off[s]
        for k, (c, x) in enumerate(arcs):
            for d, y in arcs[k + 1 :]:
                got = self.equal(x, y)
                if got.shape[1]:
                    out.append(got + np.array([[off[c]], [off[d]]]))
            # The symbol is deleted: what follows is read from s, not by the same symbol.
            symbols = self.common(x, s, c)
            for e in symbols:
                self.equal(self.a.arcs[x][e], self.a.arcs[s][e])
            got = self.moved(x, s, symbols, True)
            if got.shape[1]:
                out.append(got + np.array([[off[c]], [0]]))
        return out

    def pairs(self) -> np.ndarray:
        """All pairs from the initial state."""
        before: list = []
        for s in range(len(self.a.arcs)):
            parts = self.edits(s)
            for c, t in self.a.arcs[s].items():
                if before[t].shape[1]:
                    parts.append(before[t] + self.off[s][c])
            before.append(_joined(parts))
        return before[self.a.start]


def near_of(pairs: np.ndarray, n: np.ndarray):
    """(words with near ones, how many, the best: largest n, then the first) from unordered pairs of word numbers."""
    src, dst = np.concatenate([pairs[0], pairs[1]]), np.concatenate([pairs[1], pairs[0]])
    order = np.lexsort((dst, -n[dst], src))
    src, dst = src[order], dst[order]
    words, first, count = np.unique(src, return_index=True, return_counts=True)
    return words, count, dst[first]


NEAR = "word string, near long, less long, form string"


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Words of one cell -> those with near words in it."""
    words, counts = zip(*sorted(zip(pdf["word"].tolist(), pdf["n"].tolist())))
    n, depth = np.array(counts), int(pdf["depth"].iloc[0])
    pairs = Composition(Acceptor([w[depth:] for w in words])).pairs()
    some, count, best = near_of(pairs, n)
    named = np.array(words, object)
    return pd.DataFrame({"word": pd.Series(named[some], dtype=object), "near": count, "less": -n[best], "form": pd.Series(named[best], dtype=object)})


def partitions(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """Adds cell and depth: the shortest prefix that at most `most` words share, and its length. Shorter prefixes are shared by more."""
    left, done, depth = vocab.select("word", "n"), None, 0
    while True:
        keyed = left.withColumn("cell", F.substring("word", 1, depth)).withColumn("depth", F.lit(depth))
        large = materialise(keyed.groupBy("cell").count().filter(F.col("count") > most).select("cell"), "prefixes")
        part = keyed.join(large, "cell", "left_anti")
        done = part if done is None else done.unionByName(part)
        if large.isEmpty():
            return materialise(done.select("word", "n", "cell", "depth"), "cells")
        left = materialise(keyed.join(large, "cell", "left_semi").select("word", "n"), "words")
        depth += 1


def _edits_above(words: DataFrame) -> DataFrame:
    """Near words whose edit stands at the end of a prefix above the cells: groups with prefix and suffix in common."""
    each = words.filter("depth > 0").select("word", "n", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("p"))
    size = F.char_length("word")
    behind = lambda k: F.substring("word", F.col("p") + 1 + k, size)
    at = lambda rest, symbol: each.filter(F.col("p") <= size).select(
        "p", F.concat(F.substring("word", F.lit(1), F.col("p")), rest).alias("key"), F.substring(rest, 1, 1).alias("next"), symbol.alias("symbol"), "word", "n"
    )
    with_symbol = at(behind(1), F.substring("word", F.col("p") + 1, F.lit(1))).filter(F.col("symbol") != "")
    rows = with_symbol.unionByName(at(behind(0), F.lit("")))
    member = F.struct((-F.col("n")).alias("less"), "word", "symbol")
    groups = rows.groupBy("p", "key", "next").agg(F.collect_list(member).alias("ms")).filter(F.size("ms") > 1)
    # A word without the symbol is near to those with one, unless the next symbol is the same: then they differ later on.
    fits = lambda x, y: (x != y) & ((x != "") & (y != "") | (F.concat(x, y) != F.col("next")))
    one = groups.select("next", F.explode("ms").alias("m"), "ms")
    others = F.filter("ms", lambda y: fits(F.col("m.symbol"), y["symbol"]))
    got = one.select(F.col("m.word").alias("word"), others.alias("ys")).filter(F.size("ys") > 0)
    best = F.array_min(F.transform("ys", lambda y: F.struct(y["less"].alias("less"), y["word"].alias("form"))))
    return got.select("word", F.size("ys").cast("long").alias("near"), best.alias("best")).select("word", "near", "best.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root) by pointer doubling; forms must not run in a circle."""
    to = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = materialise(to.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("went")), "roots")
        to = step.select("word", "root")
        if step.filter("went").isEmpty():
            return to


def spelling_variants(vocab: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a stored vocabulary (word, n)."""
    words = partitions(vocab, most)
    tasks = max(2 * vocab.sparkSession.sparkContext.defaultParallelism, -(-vocab.count() // (4 * most)))
    inside = words.repartition(tasks, "cell").groupBy("cell").applyInPandas(_cell, NEAR)
    every = inside.unionByName(_edits_above(words))
    near = materialise(every.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "form")).alias("best")), "near")
    known = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    is_form = -F.col("best.less") >= F.col("n") * ratio
    known = materialise(known.select("word", "n", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
