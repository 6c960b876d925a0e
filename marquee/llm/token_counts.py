"""Token counts without token ids: pieces are counted once per distinct pre-token.

The tokenizer's own pre-tokenizer cuts a text into pre-tokens that are encoded independently, so
a text's token count is the sum over its distinct pre-tokens of frequency times pieces. Distinct
pre-tokens are found by one aggregation, encoded once each, and joined back to the per-document
frequencies. The most frequent ones (at most HOT of at most HOT_BYTES bytes each, so a few MB)
travel as a broadcast dictionary; all others meet their counts in a shuffle join.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null ids are kept; a repeated
row is repeated in the result; further columns of the input are left out, whatever their names;
an empty table gives an empty result. Strings of added tokens inside a text count as one token,
as the library does by default.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

HOT = 1 << 18
HOT_BYTES = 64

#: Fixed value: the split of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks on whose letters and digits all Unicode versions agree; other texts are cut by the library itself.
SETTLED = (
    r"[\x00-ԯ‐-‧‰-⁞₠-₿℀-↋←-⏿"
    r"　-〿ぁ-ゖゝ-ヺ一-龥가-힣]*+"
)


def per_worker(key, make):
    """What a Python worker keeps between its tasks: small things that take long to make. Functions reach tasks by value, with variables
    of their own, so it is a module of its own among the worker's modules."""
    import sys
    from types import ModuleType

    kept = sys.modules.setdefault("_marquee_kept", ModuleType("_marquee_kept"))
    key = (key[0], hash(key[1]))
    if not hasattr(kept, "values"):
        kept.values = {}
    if key not in kept.values:
        kept.values[key] = make()
    return kept.values[key]


def tokenizer(json_text: str):
    """One tokenizer per worker and vocabulary."""
    from tokenizers import Tokenizer

    return per_worker(("tokenizer", json_text), lambda: Tokenizer.from_str(json_text))


def cutter(tok):
    """text -> its pre-tokens; strings of added tokens come out as pre-tokens of their own."""
    fine = regex.compile(PRE_TOKEN).findall
    settled = regex.compile(SETTLED).fullmatch
    added = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def plain(text):
        if settled(text):
            return fine(text)
        return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def cut(text):
        if special is None or not special.search(text):
            return plain(text)
        out = []
        for k, part in enumerate(special.split(text)):
            out += [part] if k % 2 else plain(part)
        return out

    return cut


def _pre_tokens(vocabulary, flush: int = 150_000):
    """Batches of texts -> distinct pre-tokens with their frequencies, summed within the task."""

    def run(batches):
        cut, seen = cutter(tokenizer(vocabulary.value)), Counter()

        def out():
            return pa.RecordBatch.from_pydict(
                {"piece": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())}
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(cut(text))
                if len(seen) > flush:
                    yield out()
                    seen.clear()
        yield out()

    return run


def _encode(vocabulary):
    """Distinct pre-tokens -> the number of tokens of each."""

    def run(batches):
        tok = tokenizer(vocabulary.value)
        for batch in batches:
            enc = tok.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            counts = pa.array([len(e) for e in enc], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["piece", "n", "tokens"])

    return run


def _frequencies(vocabulary, hot, rows_out: int = 20_000):
    """Documents -> one row that holds what the frequent pre-tokens add up to, and one row for each
    other pre-token with its frequency. The first row's key matches no pre-token and differs per
    document, so that no key gathers rows."""
    names = ["row", "doc_id", "n_bytes", "piece", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        cut, known = cutter(tokenizer(vocabulary.value)), hot.value.get
        cols = [[] for _ in names]

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
            for c in cols:
                c.clear()
            return got

        for batch in batches:
            for row, doc_id, n_bytes, text in zip(*(c.to_pylist() for c in batch.columns)):
                freq = Counter(cut(text))
                total, rare, counts = 0, [], []
                for piece, n in freq.items():
                    k = known(piece)
                    if k is None:
                        rare.append(piece)
                        counts.append(n)
                    else:
                        total += k * n
                m = len(rare)
                cols[0] += [row] * (m + 1)
                cols[1] += [doc_id] * (m + 1)
                cols[2] += [n_bytes] + [0] * m
                cols[3] += [f"\x00{row}"] + rare
                cols[4] += [total] + counts
                if len(cols[0]) >= rows_out:
                    yield out()
        yield out()

    return run


def piece_table(texts: DataFrame, vocabulary) -> DataFrame:
    """(piece, n, tokens) for every distinct pre-token of a one-column frame of texts."""
    seen = texts.mapInArrow(_pre_tokens(vocabulary), "piece string, n long")
    return seen.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(
        _encode(vocabulary), "piece string, n long, tokens int"
    )


def frequent(pieces: DataFrame) -> dict[str, int]:
    """The most frequent short pre-tokens, at most HOT of them: the cut comes from a histogram of
    at most 64 x 16 logarithmic classes."""
    short = pieces.filter(F.octet_length("piece") <= HOT_BYTES)
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    hist = sorted(((r[0], r[1]) for r in short.groupBy(level.alias("k")).count().collect()), reverse=True)
    kept, cut = 0, None
    for k, n in hist:
        if kept + n > HOT:
            break
        kept, cut = kept + n, k
    if cut is None:
        return {}
    got = short.filter(level >= cut).select("piece", "tokens").toArrow()
    return dict(zip(got["piece"].to_pylist(), got["tokens"].to_pylist()))


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = materialise(piece_table(docs.select(text.alias("text")), vocabulary), "pieces")
    known = frequent(pieces)
    hot = spark.sparkContext.broadcast(known)
    # A row's number is its own, whatever its id and text are.
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    ).mapInArrow(_frequencies(vocabulary, hot), "row long, doc_id long, n_bytes long, piece string, n long")
    total = F.sum(F.col("n") * F.coalesce("tokens", F.lit(1)))
    each = (
        rows.join(pieces.select("piece", "tokens"), "piece", "left")
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
    )
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
