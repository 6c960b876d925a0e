"""Near-duplicate classes by Order MinHash and banded alignment.

Texts are sequences of words (lower case, letters, digits and marks). Texts with the same words are
one representative, found by a sum over fingerprints. A representative's runs of K words are
labelled by how often the run has occurred before in the text. Each of BANDS sketches keeps the two smallest
labelled runs under its own order, in the order in which they stand in the text, so it is
sensitive to what is moved as well as to what is changed. Equal sketches make candidates.

Similarity of two texts is L / (n + m - L): n and m are their numbers of runs, L the longest common subsequence of their runs,
which for texts without moved passages is the Jaccard similarity of their runs. Candidates are
verified by an alignment in the band of diagonals that a similarity of THRESHOLD leaves open, so
the decision is exact. Links are closed to classes.

Candidates without pairs of a whole group: a bucket of at most SMALL texts compares them with one another (a constant per
text). Texts of larger buckets are first linked cheaply: buckets are split by further sketches, twice, and
each text of a bucket that stays large meets LEADERS of it. Leaders are the texts with most copies, then the
first in one order of all texts, so the buckets of one kind share them.
An exact rest follows: similar texts have a run in common among the rarest of both, at a place from which on enough
runs are left (prefix and position filter over labelled runs), so all pairs of texts of large buckets
that have such a run and are in two classes are aligned. No similar pair of them is left out; only the
texts apart from the main class of a run make pairs. A pair is aligned once.

Defined results: a null text is empty; texts without a word are copies if they are equal; texts of fewer words than K have one
run; null ids stay in the result without a class (class_id null, kept); repeated rows are copies of
one another and carry one class, and rows that share an id but not the words are compared by any of their texts; ties go to the smallest id; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialise
from .registry import released
from .words import mix, shingles, slices, word_hashes

K = 5
THRESHOLD = 0.8
BANDS = 16
SMALL = 16
LEADERS = 4

SIGNATURE = "doc_id long, f1 long, f2 long, n_words long, bands array<long>"
_U = np.uint64


def occurrence_labels(runs: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hash of each run with the number of its earlier occurrences in the same text."""
    doc = np.repeat(np.arange(len(off) - 1, dtype="u8"), np.diff(off))
    own = runs ^ mix(doc + _U(1))
    ordered = np.sort(own)
    if not (ordered[1:] == ordered[:-1]).any():
        return runs
    at = np.argsort(own, kind="stable")
    ordered = own[at]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    seen = np.empty(len(at), "u8")
    seen[at] = (np.arange(len(at)) - start).astype("u8")
    return np.where(seen > 0, mix(runs + seen * _U(0x9E3779B97F4A7C15)), runs)


def order_minhash(runs: np.ndarray, off: np.ndarray, bands: int) -> np.ndarray:
    """Sketch of each text that has runs: texts x bands. A sketch holds two runs in text order."""
    n = np.diff(off)
    full = np.flatnonzero(n)
    starts = off[:-1][full]
    labelled = occurrence_labels(runs, off)
    which = np.repeat(np.arange(len(full)), n[full])
    out = np.empty((len(full), bands), "u8")
    top = _U(0xFFFFFFFFFFFFFFFF)
    for j in range(bands):
        salt = mix(np.array([j + 1], "u8"))[0]
        v = (labelled ^ salt) * (salt | _U(1))
        v ^= v >> _U(32)
        first = np.minimum.reduceat(v, starts)
        at1 = np.flatnonzero(v == first[which])
        p1 = at1[np.searchsorted(at1, starts)]
        v[at1] = top
        second = np.minimum.reduceat(v, starts)
        at2 = np.flatnonzero(v == second[which])
        p2 = at2[np.searchsorted(at2, starts)]
        p2 = np.where(n[full] > 1, p2, p1)
        a, b = runs[np.minimum(p1, p2)], runs[np.maximum(p1, p2)]
        out[:, j] = mix(a * _U(3) + mix(b) + salt)
    return out


def _signatures(k: int, bands: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                words, off = word_hashes(texts)
                n = np.diff(off)
                f = np.zeros((2, len(n)), "u8")
                full = np.flatnonzero(n)
                sketch = np.zeros((len(n), bands), "u8")
                if len(full):
                    place = np.arange(len(words), dtype="u8") - np.repeat(off[:-1].astype("u8"), n)
                    for i in range(2):
                        f[i, full] = np.add.reduceat(mix(words + (place + _U(1)) * _U(0xD6E8FEB86659FD93 + 2 * i)), off[:-1][full])
                    runs, at = shingles(words, off, k)
                    sketch[full] = order_minhash(runs, at, bands)
                for i in np.flatnonzero(n == 0).tolist():
                    raw = np.frombuffer(texts[i].as_buffer(), "u1") if len(texts[i].as_py()) else np.zeros(0, "u1")
                    spread = mix(raw.astype("u8") + np.arange(1, len(raw) + 1, dtype="u8") * _U(0x9E3779B97F4A7C15))
                    f[:, i] = spread.sum(dtype="u8"), _U(len(raw))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype="i4") * bands), pa.array(sketch.reshape(-1).view("i8")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(f[0].view("i8")), pa.array(f[1].view("i8")), pa.array(n), lists],
                    ["doc_id", "f1", "f2", "n_words", "bands"],
                )

    return run


def common_runs(a: np.ndarray, b: np.ndarray, low: int, high: int) -> int:
    """Longest common subsequence of a and b along paths whose diagonals j - i stay in [low, high]."""
    width, m = high - low + 1, len(b)
    padded = np.zeros(m + 2 * width + len(a) + abs(low) + abs(high) + 2, b.dtype)
    valid = np.zeros(len(padded), bool)
    base = width + abs(low)
    padded[base : base + m], valid[base : base + m] = b, True
    row = np.zeros(width + 1, "i4")
    for i in range(len(a)):
        s = base + i + low
        same = (padded[s : s + width] == a[i]) & valid[s : s + width]
        row[:width] = np.maximum.accumulate(np.maximum(row[1:], row[:width] + same))
        row[width] = 0
    return int(row.max())


def is_similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether L / (n + m - L) >= threshold for two sequences of runs."""
    n, m = len(a), len(b)
    need = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    if min(n, m) < need:
        return False
    # What both hold, regardless of order, bounds what an alignment can find.
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < need:
        return False
    short = min(n, m)
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    rest = short - head
    differs = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1]) if rest else np.zeros(0)
    tail = int(differs[0]) if len(differs) else rest
    found = head + tail
    if found >= need:
        return True
    spare = n + m - 2 * need
    low, high = -((spare - (m - n)) // 2), (spare + (m - n)) // 2
    return found + common_runs(a[head : n - tail], b[head : m - tail], low, high) >= need


def _verify(k: int, threshold: float):
    """Pairs with both texts -> the pairs that are similar."""

    def run(batches):
        for batch in batches:
            keep = []
            for part in slices(batch, "left", 1 << 20):
                ends = []
                for name in ("left", "right"):
                    words, off = word_hashes(part.column(name))
                    ends.append(shingles(words, off, k))
                (x, xo), (y, yo) = ends
                keep += [is_similar(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]], threshold) for i in range(part.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of representatives whose texts are similar; each pair is aligned once."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("right"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return both.mapInArrow(released(_verify(k, threshold)), "a long, b long")


def close(links: DataFrame) -> DataFrame:
    """(rep, comp) of all texts with a link: connected components. Every round each vertex joins the
    neighbour of the lowest priority, links are renamed to the joined vertices, and loops and
    repetitions go; priorities are drawn anew per round, so a chain shrinks by a constant factor as well."""
    steps, left = [], links.select("a", "b")
    for step in range(200):
        ways = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("v"))
        joined = ways.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", rank("a"))["v"].alias("to"))
        steps.append(materialise(joined, "joined"))
        to = lambda end, name: steps[-1].select(F.col("v").alias(end), F.col("to").alias(name))
        ends = left.join(to("a", "x"), "a").join(to("b", "y"), "b").filter("x <> y")
        left = materialise(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if left.isEmpty():
            break
    # From the last round back: where the vertices of a round end up.
    ended = steps[-1]
    for joined in reversed(steps[:-1]):
        later = ended.select(F.col("v").alias("to"), F.col("to").alias("end"))
        ended = joined.join(later, "to", "left").select("v", F.coalesce("end", "to").alias("to"))
    return materialise(ended.select(F.col("v").alias("rep"), F.col("to").alias("comp")), "comp")


def buckets_of(reps: DataFrame, small: int):
    """(small buckets, large buckets, crowd): rows (bucket, rep, n) of buckets with at least two texts, and
    the (rep) of all texts that were in a large bucket before any split.

    Bucket keys are hashes of one sketch; buckets above `small` are split by one more sketch, twice.
    """
    bands = len(reps.first()["bands"])
    level = reps.filter("n > 0").select("rep", "n", F.posexplode("bands").alias("j", "s"))
    level = level.select("rep", "n", "j", F.xxhash64("j", "s").alias("bucket"))
    few = crowd = None
    for depth in range(3):
        sizes = level.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        level = materialise(level.join(sizes, "bucket"), "buckets")
        part = level.filter(F.col("size") <= small).select("bucket", "rep", "n")
        few = part if few is None else few.unionByName(part)
        large = level.filter(F.col("size") > small)
        if depth == 0:
            crowd = materialise(large.select("rep").distinct(), "crowd")
        if depth == 2:
            return few, large.select("bucket", "rep", "n"), crowd
        level = large.select("rep", "n", "bucket", ((F.col("j") + 1) % bands).alias("j"))
        level = level.join(reps.select("rep", "bands"), "rep").select(
            "rep", "n", "j", F.xxhash64("bucket", "j", F.element_at("bands", (F.col("j") + 1).cast("int"))).alias("bucket")
        )


def _ordered(frame: DataFrame, threshold: float) -> DataFrame:
    """Pairs with lengths that can be similar, smaller id first, once each."""
    fits = F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-6
    return frame.filter((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link(reps: DataFrame, rows: DataFrame, k: int, threshold: float, small: int):
    """(links, comp of the linked ones or None) of representatives (rep, n = runs, bands, copies); rows has the texts."""
    few, large, crowd = buckets_of(reps, small)
    met = few.select("rep").unionByName(crowd).distinct().select(F.col("rep").alias("doc_id"))
    texts = materialise(rows.join(met.hint("shuffle_hash"), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text"), "texts")
    member = F.struct("rep", "n")
    # At most `small` texts in a bucket: their pairs are a constant per text.
    lists = few.groupBy("bucket").agg(F.collect_list(member).alias("ms"))
    each = lists.select(F.explode("ms").alias("x"), "ms").select("x", F.explode(F.filter("ms", lambda y: y["rep"] > F.col("x.rep"))).alias("y"))
    near = each.select(F.col("x.rep").alias("a"), F.col("x.n").alias("n"), F.col("y.rep").alias("b"), F.col("y.n").alias("m"))
    found = near
    some = not large.isEmpty()
    if some:
        large = materialise(large.join(reps.select("rep", "copies"), "rep"), "large")
        found = near.unionByName(_with_leaders(large, LEADERS))
    pairs = materialise(_ordered(found, threshold), "pairs")
    links = materialise(verify(pairs, texts, k, threshold), "near")
    comp = None if links.isEmpty() else close(links)
    if crowd.isEmpty():
        return links, comp
    rest = rest_pairs(texts.join(crowd, "rep", "left_semi"), comp, k, threshold).join(pairs, ["a", "b"], "left_anti")
    again = materialise(verify(materialise(rest, "rest"), texts, k, threshold), "near")
    if again.isEmpty():
        return links, comp
    links = links.unionByName(again)
    return links, close(links)


def _labelled_runs(k: int):
    """Texts -> their runs, told apart by their number of earlier occurrences; t tells apart texts of one id."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, off = word_hashes(part.column("text"))
                runs, at = shingles(words, off, k)
                n = np.diff(at)
                cols = [np.repeat(part.column(c).to_numpy(), n) for c in ("rep", "t")]
                cols += [np.repeat(n, n), occurrence_labels(runs, at).view("i8")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "t", "n", "run"])

    return run


def rest_pairs(texts: DataFrame, comp: DataFrame | None, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of the texts that can be similar and are in two classes, smaller id first, once each.

    Two similar texts have at least threshold * (n + m) / (1 + threshold) labelled runs in common. In one order of
    all runs, rare ones first, that many are left from the first common one on in both of them.
    """
    texts = texts.withColumn("t", F.xxhash64("text")).dropDuplicates(["rep", "t"])
    runs = materialise(texts.select("rep", "t", "text").mapInArrow(released(_labelled_runs(k)), "rep long, t long, n long, run long"), "runs")
    # Runs of one text only come first in its order and match nothing.
    often = runs.groupBy("run").agg(F.count("*").alias("freq")).filter("freq > 1")
    back = W.partitionBy("rep", "t").orderBy(F.desc("freq"), F.desc("run"))
    ranked = runs.join(often, "run").withColumn("left", F.row_number().over(back)).filter(F.col("left") >= F.col("n") * threshold - 1e-6)
    if comp is None:
        prefix = ranked.withColumn("comp", F.col("rep"))
    else:
        prefix = ranked.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    prefix = materialise(prefix.select("run", "rep", "n", "left", "comp"), "prefix")
    kinds = prefix.groupBy("run", "comp").count().groupBy("run").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"), F.count("*").alias("kinds"))
    here = materialise(prefix.join(kinds.filter("kinds > 1"), "run"), "here")
    other = here.select("run", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("left").alias("left_b"), F.col("comp").alias("comp_b"))
    x = here.filter("comp <> main").withColumnRenamed("rep", "a")
    need = (F.col("n") + F.col("m")) * (threshold / (1 + threshold)) - 1e-6
    both = x.join(other, (x["run"] == other["run"]) & (F.col("comp") != F.col("comp_b")) & (F.least("left", "left_b") >= need))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_leaders(members: DataFrame, leaders: int) -> DataFrame:
    """Each member of a bucket with the bucket's leaders: the one with most copies, then by one order of all texts."""
    rank = W.partitionBy("bucket").orderBy(F.xxhash64("rep", F.lit(0)), "rep")
    first = members.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= leaders).select("bucket", "rep", "n")
    most = members.groupBy("bucket").agg(F.max(F.struct("copies", F.xxhash64("rep").alias("h"), "rep", "n")).alias("l"))
    lead = first.unionByName(most.select("bucket", "l.rep", "l.n")).distinct()
    # At most leaders + 1 in a list; a member's buckets mostly name the same ones.
    lists = lead.groupBy("bucket").agg(F.collect_list(F.struct("rep", "n")).alias("ls"))
    met = members.join(lists, "bucket").groupBy("rep", "n").agg(F.array_distinct(F.flatten(F.collect_list("ls"))).alias("ls"))
    met = met.select(F.col("rep").alias("a"), "n", F.explode("ls").alias("l"))
    return met.select("a", "n", F.col("l.rep").alias("b"), F.col("l.n").alias("m"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, bands: int = BANDS, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id of the class), n_copies (rows with the same words) per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = materialise(rows.mapInArrow(released(_signatures(k, bands)), SIGNATURE), "signatures")
    key = ["f1", "f2", "n_words"]
    named = signed.filter("doc_id is not null")
    reps = named.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("bands").alias("bands"))
    runs = F.when(F.col("n_words") >= k, F.col("n_words") - (k - 1)).otherwise((F.col("n_words") > 0).cast("long"))
    reps = materialise(reps.withColumn("n", runs), "reps")
    if reps.isEmpty():
        none = F.lit(None).cast("long")
        return signed.select("doc_id", none.alias("class_id"), none.alias("n_copies"))
    _, comp = link(reps, rows, k, threshold, small)
    if comp is None:
        comp = reps.select("rep", F.col("rep").alias("comp")).limit(0)
    least = comp.groupBy("comp").agg(F.min("rep").alias("least"))
    classes = reps.select(*key, "rep", "copies").join(comp.join(least, "comp").select("rep", "least"), "rep", "left")
    classes = materialise(classes.select(*key, F.coalesce("least", "rep").alias("class_id"), F.col("copies").alias("n_copies")), "classes")
    out = named.select("doc_id", *key).join(classes, key).select("doc_id", "class_id", "n_copies")
    none = F.lit(None).cast("long")
    return out.unionByName(signed.filter("doc_id is null").select("doc_id", none.alias("class_id"), none.alias("n_copies")))
