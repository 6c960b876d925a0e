"""Best-fit packing of token sequences by hierarchical residual merging.

Tokenising turns each document into pieces of at most `capacity` tokens and keeps only their
lengths and checksums. Pieces are dealt into groups of bounded size; each group packs its pieces
best fit, longest first. Bins that are nearly full are final. The others become items themselves:
they are dealt anew into as many groups of about the same bounded size as they need, and best fit runs again over
each group, round after round, until a round merges nothing. A bin's place in a later bin
is a shift, so a piece's final place is its first offset plus the shifts on the way up.

Groups are formed from counts and hashes of single items, never from keys, so no key can make a group large, and
bins that no other bin fits into stay in groups of that size and end the rounds.

Defined results: a null text is empty (one end token); every repeated row is packed on its own;
null ids stay null; pieces with equal lengths are ordered by id and piece; further columns of the
input are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .registry import released
from .token_counts import per_worker, tokenizer
from .words import slices

CAPACITY = 4096
GROUP_ITEMS = 20_000
NEARLY_FULL = 0.99
MAX_ROUNDS = 12

#: Fixed value: the split of the word-end vocabulary, after lower-casing.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin text without composing marks: normalising leaves it as it is but for case and white space.
LATIN = r"[\t-\r !-˿‐-‧‰-⁞€]*+"

#: Characters that byte-level vocabularies write for bytes that cannot be seen; the others stand for themselves.
UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
BYTES = {b: 256 + k for k, b in enumerate(UNSEEN)}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


class WordIds:
    """Texts -> token ids as little-endian 32-bit bytes.

    Runs of characters without white space are looked up; the words of unknown ones are encoded
    once each. The look-up table has two generations, each bounded in entries and characters, so what is frequent stays.
    """

    def __init__(self, tok, most: int = 300_000, most_chars: int = 8 << 20):
        self.tok, self.most, self.most_chars = tok, most, most_chars
        self.new, self.old, self.held = {}, {}, 0
        self.find = regex.compile(WORD).findall
        self.latin = regex.compile(LATIN).fullmatch
        added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.added = {k: np.array([i], "<u4").tobytes() for k, i in added.items()}
        names = sorted(map(re.escape, added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(names) + ")") if names else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words_of(self, chunk: str):
        """Words of a lower-case run without white space; letters, alone or with one mark behind, need no pattern."""
        if chunk.isalpha():
            return (chunk,)
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return (chunk[:-1], chunk[-1])
        return self.find(chunk)

    def encode_words(self, words: list[str]) -> dict:
        """Words that are normalised and cut already, so only the merges are left to do; a merge knows bytes as characters."""
        merge, put = self.tok.model.tokenize, {}
        for w in words:
            spelt = w if w.isascii() else w.encode().decode("latin-1").translate(BYTES)
            put[w] = array("I", [t.id for t in merge(spelt)]).tobytes()
        return put

    def turn(self) -> None:
        if len(self.new) > self.most or self.held > self.most_chars:
            self.new, self.old, self.held = {}, self.new, 0

    def learn(self, chunks: set) -> None:
        """Puts the ids of all chunks into the newer generation."""
        new, old, unknown = self.new, self.old.get, []
        self.held += sum(map(len, chunks))
        for c in chunks:
            got = old(c)
            if got is None:
                unknown.append(c)
            else:
                new[c] = got
        parts = [self.words_of(c) for c in unknown]
        known = {}
        for p in parts:
            for w in p:
                known[w] = new.get(w) or old(w)
        known |= self.encode_words([w for w, got in known.items() if got is None])
        for c, p in zip(unknown, parts):
            new[c] = known[p[0]] if len(p) == 1 else b"".join([known[w] for w in p])

    def is_plain(self, text: str) -> bool:
        """Whether lower case and white space are all that the normaliser changes."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.latin(text) is not None
        return not any(c in raw for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f"))

    def pieces(self, text: str):
        """Parts of a text: lists of chunks, or ids where the library has to encode."""
        parts = self.special.split(text) if self.special is not None and self.special.search(text) else [text]
        for k, p in enumerate(parts):
            yield self.added[p] if k % 2 else p.lower().split() if self.is_plain(p) else self.whole(p)

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.turn()
        get, docs, unknown = self.new.get, [], set()
        for text in texts:
            parts = []
            for p in self.pieces(text):
                got = list(map(get, p)) if type(p) is list else [p]
                if None in got:
                    unknown.update([c for c, g in zip(p, got) if g is None])
                parts.append((p, got))
            docs.append(parts)
        if unknown:
            self.learn(unknown)
        out = []
        for parts in docs:
            for p, got in parts:
                if None in got:
                    got[:] = [get(c) if g is None else g for c, g in zip(p, got)]
            out.append(b"".join([b"".join(got) for _, got in parts]))
        return out


def _cut(vocabulary, end_id: int, capacity: int):
    """Documents -> their pieces. The salt numbers a task's pieces, so equal rows can go to different groups."""

    def run(batches):
        tok = tokenizer(vocabulary.value)
        ids = per_worker(("word ids", vocabulary.value), lambda: WordIds(tok))
        end = np.array([end_id], "<u4").tobytes()
        salt, width = 0, 4 * capacity
        for batch in (part for b in batches for part in slices(b, "text", 2 << 20)):
            cols = [[] for _ in range(6)]
            for doc_id, got in zip(batch.column(0).to_pylist(), ids(batch.column(1).to_pylist())):
                got = memoryview(got + end)
                for k, at in enumerate(range(0, len(got), width)):
                    part = got[at : at + width]
                    salt += 1
                    for c, v in zip(cols, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), salt)):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
            )

    return run


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = CAPACITY, id_col="doc_id", text_col="text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, salt."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(released(_cut(vocabulary, end_id, capacity)), PIECES)


def best_fit(lengths, capacity: int):
    """(bin, offset) of each length, in the order given: the fullest bin that still takes it.

    Bins are kept by free space; a bit per free space says which lists are not empty, so the
    smallest sufficient one is the lowest set bit at or above the length.
    """
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, bins, offsets, n_bins = 0, [], [], 0
    for length in lengths:
        fits = bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                bits ^= 1 << space
        else:
            space, b, n_bins = capacity, n_bins, n_bins + 1
        bins.append(b)
        offsets.append(capacity - space)
        left = space - length
        if left:
            by_space[left].append(b)
            bits |= 1 << left
    return bins, offsets


def _pack_group(order, capacity: int, level: int):
    """One group -> its rows with bin and offset; bins are numbered by level, group and place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=[False] + [True] * (len(order) - 1), kind="stable", na_position="first")
        bins, offsets = best_fit(pdf["length"].tolist(), capacity)
        base = (level << 56) + (int(pdf["grp"].iloc[0]) << 24)
        return pdf.assign(bin=base + np.array(bins, "int64"), off=np.array(offsets, "int64"))

    return run


def _bins(placed: DataFrame) -> DataFrame:
    return placed.groupBy("grp", "bin").agg(F.sum("length").alias("length"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of token_pieces), which must be a stored table."""
    full = int(capacity * nearly_full)
    groups = max(1, -(-pieces.count() // group_items))
    keyed = pieces.withColumn("grp", F.pmod(F.hash("doc_id", "piece", "salt"), F.lit(groups)).cast("long"))
    placed = materialise(
        keyed.groupBy("grp").applyInPandas(
            _pack_group(["length", "doc_id", "piece", "salt"], capacity, 0), f"{PIECES}, grp long, bin long, off long"
        ),
        "packed",
    )
    # moved: first bin -> the bin that holds it now, and its shift there
    moved = None
    left = materialise(_bins(placed).filter(F.col("length") < full), "underfull")
    before = None
    for level in range(1, MAX_ROUNDS + 1):
        n = left.count()
        if n < 2 or before == n:
            break
        before, groups = n, -(-n // group_items)
        dealt = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).alias("grp")
        items = left.select(dealt, F.col("bin").alias("item"), "length")
        step = materialise(
            items.groupBy("grp").applyInPandas(
                _pack_group(["length", "item"], capacity, level), "grp long, item long, length long, bin long, off long"
            ),
            "repacked",
        )
        hop = step.select(F.col("item").alias("at"), F.col("bin").alias("to"), F.col("off").alias("by"))
        if moved is None:
            moved = hop.select(F.col("at").alias("first"), F.col("to").alias("now"), F.col("by").alias("shift"))
        else:
            moved = materialise(
                moved.join(hop, moved["now"] == hop["at"], "left").select(
                    "first", F.coalesce("to", "now").alias("now"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")
                ),
                "moved",
            )
        left = materialise(_bins(step).filter(F.col("length") < full), "underfull")
    if moved is None:
        return placed.withColumn("sequence_id", F.col("bin")).withColumn("offset", F.col("off")).drop("grp", "bin", "off", "salt")
    return placed.join(moved, placed["bin"] == moved["first"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("now", "bin").alias("sequence_id"),
        (F.col("off") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = CAPACITY, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(materialise(token_pieces(docs, tokenizer_file, end_id, capacity), "pieces"), capacity, **how)
