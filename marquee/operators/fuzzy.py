"""Fuzzy title search for a table of queries over the whole catalogue.

Items are dealt into groups of about ITEMS, queries into chunks of about QUERIES; every group meets every chunk in a task
that is bounded on both sides. Within it an inverted index says which items can hold which characters, as one bit
per item: a character followed, anywhere later, by another; a character next to another; a character at the start of a word.
Queries are looked up in it and only items whose best conceivable worth reaches the floor are scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions import fixed
from ..functions.scores import char_mask, popularity
from ..functions.text import accent_table, strip_accents
from ..session import materialise
from .placement import DIGITS, code_points, placed, starts_of_words
from .sorting import top_per_group

ITEMS = 4096
QUERIES = 8192

# ------------------------------------------------------------------ columns


def fold_same_length(c: Column) -> Column:
    """Lowered, without accents where that keeps every position in place."""
    low = F.lower(c)
    bare = strip_accents(low)
    wide = accent_table()[2]
    return F.when((F.length(bare) == F.length(c)) & ~low.rlike(wide), bare).otherwise(low)


def norm_query(c: Column) -> Column:
    flat = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.btrim(F.regexp_replace(flat, r"[ \t\n\r\f\x0B\xA0]+", " "), F.lit(" "))


def fuzzy_index(items: DataFrame) -> DataFrame:
    """kind, pos, label, sub, hay, tl, mask, pop: everything a search reads."""
    maker = F.when(F.col("kind") == "books", F.col("author")).when(F.col("kind") != "games", F.col("creator"))
    year = F.nullif(F.col("year"), F.lit(0)).cast("string")
    parts = F.array(F.nullif(maker, F.lit("")), F.nullif(F.col("genre"), F.lit("")), year)
    sub = F.array_join(F.array_compact(parts), " · ")
    named = items.filter(F.coalesce("title", F.lit("")) != "").select(
        "kind", "pos", F.col("title").alias("label"), sub.alias("sub"), popularity().alias("pop")
    )
    raw = F.when(F.col("sub") != "", F.concat("label", F.lit(" "), "sub")).otherwise(F.col("label"))
    return named.withColumn("hay", fold_same_length(raw)).select(
        "kind", "pos", "label", "sub", "hay", F.length("label").alias("tl"), char_mask(F.col("hay")).alias("mask"), "pop"
    )


def mask_allows(query_mask: Column, mask: Column) -> Column:
    """No character of the query is missing from the item."""
    return query_mask.bitwiseAND(F.bitwise_not(mask)) == 0


def score_floor(length: Column) -> Column:
    return F.when(length <= 2, F.lit(0)).otherwise(fixed.FUZZY_FLOOR * length)


# ------------------------------------------------------------------ scorer


@pandas_udf(T.DoubleType())
def fuzzy_score(query: pd.Series, hay: pd.Series, title_len: pd.Series, pop: pd.Series) -> pd.Series:
    """Score of a query against an item, null where it does not match."""
    asked = (query.fillna("") != "") & hay.notna()
    out = np.full(len(query), np.nan)
    some = [c[asked] for c in (query, hay, title_len, pop)]
    out[asked.to_numpy()], _ = placed(some[0].tolist(), some[1].tolist(), some[2].to_numpy(), some[3].to_numpy())
    return pd.Series(out)


# ------------------------------------------------------------------ index

#: Classes of characters: letters, digits, the blank, and all others by their code.
CLASSES = 64
_CLASS = np.array([*range(37, 64)] * 5, "i8")[:128]
_CLASS[ord("a") : ord("z") + 1] = np.arange(26)
_CLASS[ord("0") : ord("9") + 1] = np.arange(26, 36)
_CLASS[ord(" ")] = 36
_FAR = 1 << 30


def joined_at_best(joined: np.ndarray) -> np.ndarray:
    """Worth of so many characters that stand next to the one before, if they make one run."""
    streak = np.minimum(joined, fixed.FUZZY_STREAK_MAX)
    rest = (joined - streak) * fixed.FUZZY_STREAK_MAX
    return fixed.FUZZY_JOINED * joined + fixed.FUZZY_STREAK * (streak * (streak + 1) // 2 + rest)


def classes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], 37 + codes.astype("i8") % 27)


class Field:
    """Index of the first `ends` characters of texts: per class and item the first and last place and whether it starts a
    word, per pair of classes and item whether they stand next to each other."""

    def __init__(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        items, width = kinds.shape
        self.ends = ends
        at = np.arange(width)
        row, col = np.nonzero(at < ends[:, None])
        c = kinds[row, col]
        self.first = np.full((CLASSES, items), _FAR, "i4")
        self.last = np.full((CLASSES, items), -1, "i4")
        np.minimum.at(self.first, (c, row), col)
        np.maximum.at(self.last, (c, row), col)
        self.lead = np.zeros((CLASSES, items), bool)
        led = starts[row, col]
        self.lead[c[led], row[led]] = True
        self.next_to = np.zeros((CLASSES * CLASSES, items), bool)
        row, col = np.nonzero(at[1:] < ends[:, None]) if width > 1 else (row[:0], col[:0])
        self.next_to[kinds[row, col] * CLASSES + kinds[row, col + 1], row] = True

    def at_best(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items that can hold the classes in order, the most that a placement in them can be worth)."""
        n = len(c)
        ok = self.last[c[0]] >= 0
        for a, b in zip(c, c[1:]):
            ok = ok & (self.first[a] < self.last[b])
        some = np.flatnonzero(ok)
        if not len(some):
            return some, np.zeros(0)
        lead = self.lead[c][:, some]
        joined = self.next_to[c[:-1] * CLASSES + c[1:]][:, some].sum(axis=0) if n > 1 else np.zeros(len(some), "i8")
        first, end = self.first[c[0], some], self.ends[some]
        most = fixed.FUZZY_CHARACTER * n + joined_at_best(joined) - fixed.FUZZY_GAP * (n - 1 - joined) + fixed.FUZZY_WORD_START * lead.sum(axis=0)
        most = most + np.where(first == 0, fixed.FUZZY_FIELD_START - fixed.FUZZY_WORD_START, 0)
        if n > 1:
            most = most + np.where(lead.all(axis=0), fixed.FUZZY_INITIAL * n, 0)
        whole = fixed.FUZZY_WHOLE + fixed.FUZZY_PREFIX * (first == 0) + fixed.FUZZY_EXACT
        most = most + np.where(joined == n - 1, whole, 0)
        most = most - np.minimum(first * fixed.FUZZY_LATE, fixed.FUZZY_LATE_MAX)
        return some, most - np.minimum(end, fixed.FUZZY_LENGTH_MAX) * fixed.FUZZY_LENGTH


class Index:
    """Inverted index of a group of items over the title and over the whole text."""

    def __init__(self, texts: list[str], titles: np.ndarray, popular: np.ndarray):
        codes, lengths = code_points(texts)
        kinds, starts = classes(codes), starts_of_words(codes) if codes.shape[1] else np.zeros(codes.shape, bool)
        self.bonus = fixed.FUZZY_POPULAR * popular
        self.title, self.whole = Field(kinds, starts, np.minimum(titles, lengths)), Field(kinds, starts, lengths)

    def candidates(self, query: str, floor: float) -> np.ndarray:
        """Items that can be worth the floor or more."""
        c = classes(np.array([ord(ch) for ch in query]))
        a, most_a = self.title.at_best(c)
        b, most_b = self.whole.at_best(c)
        a = a[most_a + self.bonus[a] >= floor - 1e-6]
        b = b[most_b * fixed.FUZZY_REST + self.bonus[b] >= floor - 1e-6]
        return np.union1d(a, b)


# ------------------------------------------------------------------ search

PARTIAL = "query_no int, kind string, pos long, score double, places array<int>, hits long"
#: Pairs that are scored together.
PAIRS = 1 << 16


def floor_of(n: int) -> int:
    return 0 if n <= 2 else fixed.FUZZY_FLOOR * n


def best_of(query: np.ndarray, kind: np.ndarray, pos: np.ndarray, score: np.ndarray, keep: int):
    """(rows of the best `keep` per query and kind, first row of each query and kind, its number of rows)."""
    order = np.lexsort((pos, -score, kind, query))
    new = np.ones(len(order), bool)
    new[1:] = (query[order][1:] != query[order][:-1]) | (kind[order][1:] != kind[order][:-1])
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, len(order)))
    rank = np.arange(len(order)) - np.repeat(start, sizes)
    return order[rank < keep], order[start], sizes


def _search(keep: int):
    """A group of items and a chunk of queries -> the best `keep` per query and kind, and the number of hits."""

    def run(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        texts, titles, popular = items["hay"].tolist(), items["tl"].to_numpy(), items["pop"].to_numpy()
        pos = items["pos"].to_numpy()
        names, kind = np.unique(items["kind"].to_numpy(dtype=object).astype(str), return_inverse=True)
        index, asked = Index(texts, titles, popular), queries["q"].tolist()
        numbers = queries["query_no"].to_numpy()
        hits: list[tuple] = []
        held: list[tuple] = []

        def score(pairs: list[tuple[int, np.ndarray]]) -> None:
            q = np.concatenate([np.full(len(i), no) for no, i in pairs])
            i = np.concatenate([i for _, i in pairs])
            got, places = placed([asked[k] for k in q], [texts[k] for k in i], titles[i], popular[i])
            floors = np.array([floor_of(len(x)) for x in asked])[q]
            good = np.flatnonzero(got >= floors)
            if not len(good):
                return
            q, i, got = q[good], i[good], np.round(got[good], DIGITS)
            best, first, sizes = best_of(q, kind[i], pos[i], got, keep)
            held.extend((q[r], kind[i[r]], pos[i[r]], got[r], places[good[r]]) for r in best)
            hits.extend(zip(q[first], kind[i[first]], sizes))

        waiting, n = [], 0
        for no, text in enumerate(asked):
            some = index.candidates(text, floor_of(len(text)))
            if len(some):
                waiting.append((no, some))
                n += len(some)
            # A query is scored in one piece, so its best are final.
            if n >= PAIRS:
                score(waiting)
                waiting, n = [], 0
        if waiting:
            score(waiting)
        out = [(numbers[q], names[k], p, s, at.tolist(), None) for q, k, p, s, at in held]
        out += [(numbers[q], names[k], None, None, None, c) for q, k, c in hits]
        frame = pd.DataFrame(out, columns=["query_no", "kind", "pos", "score", "places", "hits"])
        return frame.astype({"query_no": "int32", "kind": object, "pos": "Int64", "score": "float64", "hits": "Int64"})

    return run


def fuzzy_search(index: DataFrame, queries: DataFrame | list[str], keep: int = fixed.FUZZY_KEEP) -> DataFrame:
    """Best `keep` items per query and kind with rank, score, matched places, and `total`, the
    number of all hits. Queries are texts, or a table of query_no and raw text of any length; the catalogue is
    read once, and what leaves a task are a few rows per query."""
    spark = index.sparkSession
    if not isinstance(queries, DataFrame):
        queries = spark.createDataFrame(list(enumerate(queries)), "query_no int, raw string")
    asked = queries.select(F.col("query_no").cast("int").alias("query_no"), norm_query(F.col("raw")).alias("q")).filter("q <> ''")
    narrow = index.select("kind", "pos", "hay", "tl", "pop")
    groups, chunks = max(1, -(-narrow.count() // ITEMS)), max(1, -(-asked.count() // QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = narrow.withColumn("group", F.pmod(F.xxhash64("kind", "pos"), F.lit(groups)).cast("int")).withColumn("chunk", each(chunks))
    met = asked.withColumn("chunk", F.pmod(F.xxhash64("query_no", "q"), F.lit(chunks)).cast("int")).withColumn("group", each(groups))
    tasks = min(groups * chunks, 16 * spark.sparkContext.defaultParallelism)
    by = ["group", "chunk"]
    left, right = dealt.repartition(tasks, *by).groupBy(*by), met.repartition(tasks, *by).groupBy(*by)
    partial = materialise(left.cogroup(right).applyInPandas(_search(keep), PARTIAL), "fuzzy")
    totals = partial.filter("pos IS NULL").groupBy("query_no", "kind").agg(F.sum("hits").alias("total"))
    top = top_per_group(
        partial.filter("pos IS NOT NULL").drop("hits"), ["query_no", "kind"], [F.desc("score"), F.asc("pos")], keep
    )
    return top.join(totals, ["query_no", "kind"])


def highlight_spans(places: Column, start: Column, end: Column) -> Column:
    """Runs of matched places within [start, end), relative to start, as 'from-to' texts."""
    rel = F.transform(F.filter(places, lambda p: (p >= start) & (p < end)), lambda p: p - start)
    heads = F.filter(rel, lambda p: ~F.array_contains(rel, p - 1))
    tails = F.filter(rel, lambda p: ~F.array_contains(rel, p + 1))
    return F.zip_with(heads, tails, lambda a, b: F.concat(a.cast("string"), F.lit("-"), (b + 1).cast("string")))
