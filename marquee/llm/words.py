"""Words of whole batches of texts as 64-bit hashes, without a Python object per word.

A word is a maximal run of letters, digits and marks, in lower case. Texts whose characters are ASCII or accented Latin
letters are cut as byte arrays; other texts are first brought to that form by a regular
expression, which leaves words separated by blanks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_NOT_WORD = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
_NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
#: Marks that stand on no letter.
_LOOSE_MARKS = regex.compile(r"(?<![\p{L}\p{M}])\p{M}+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_IS_LETTER = _IS_WORD.copy()
_IS_LETTER[48:58] = False
#: Lead bytes of two-byte characters that are not all letters, and of longer ones.
_ODD = np.zeros(256, bool)
_ODD[[0xC2, *range(0xCA, 256)]] = True

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


BYTE = mix(np.arange(1, 257, dtype="u8") * _U(0x9E3779B97F4A7C15))
_PLACES = 1 << 16
PLACE = mix(np.arange(7, 7 + _PLACES, dtype="u8")) | _U(1)


def _flat(texts: pa.Array):
    """(bytes of all texts, start of each text and the end), lower case, words as byte runs."""
    low = pc.utf8_lower(texts)
    off = np.frombuffer(low.buffers()[1], "<i4", len(low) + 1, low.offset * 4).astype("i8")
    data = low.buffers()[2]
    raw = np.frombuffer(data, "u1")[off[0] : off[-1]] if data is not None else np.zeros(0, "u1")
    return raw, off - off[0]


def runs_of(texts: pa.Array, with_digits: bool = True):
    """(bytes, which belong to words, start of each word, first word of each text and the end).

    Bytes of a word end at its first byte that belongs to none.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    raw, off = _flat(texts)
    odd = _ODD[raw]
    after = raw[1:] if len(raw) else raw
    odd[:-1] |= (raw[:-1] == 0xC3) & ((after == 0x97) | (after == 0xB7))
    if odd.any():
        hit = np.unique(np.searchsorted(off, np.flatnonzero(odd), "right") - 1)
        some = texts.to_pylist()
        for i in hit.tolist():
            low = some[i].lower()
            some[i] = _NOT_WORD.sub(" ", low) if with_digits else _NOT_LETTER.sub(" ", _LOOSE_MARKS.sub(" ", low))
        raw, off = _flat(pa.array(some, pa.string()))
    word = (_IS_WORD if with_digits else _IS_LETTER)[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = off[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] |= word[edges]
    starts = np.flatnonzero(first)
    return raw, word, starts, np.searchsorted(starts, off)


def word_hashes(texts: pa.Array):
    """(hash of each word, first word of each text and the end) of a string array without nulls."""
    raw, word, starts, bounds = runs_of(texts)
    if not len(starts):
        return np.zeros(0, "u8"), bounds
    # Bytes between words count as zero.
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw), dtype="i4" if len(raw) < 1 << 31 else "i8")
    place -= np.repeat(starts.astype(place.dtype), lengths)
    part = BYTE[raw[starts[0] :]]
    part *= PLACE[place & (_PLACES - 1)]
    part *= word[starts[0] :]
    return mix(np.add.reduceat(part, starts - starts[0])), bounds


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Parts of a batch whose texts have about `most` bytes; a longer text comes alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def shingles(words: np.ndarray, off: np.ndarray, k: int):
    """(hash of each run of k words, first run of each text and the end); a text with fewer words has one run."""
    n = np.diff(off)
    runs = np.where(n >= k, n - k + 1, (n > 0).astype("i8"))
    out = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(off[:-1] - out[:-1], runs) + np.arange(out[-1])
    end = np.repeat(off[1:], runs)
    total = np.zeros(out[-1], "u8")
    for j in range(k):
        here = at + j
        inside = here < end
        total += np.where(inside, words[np.minimum(here, max(len(words) - 1, 0))], _U(0)) * PLACE[j + 11] if len(words) else 0
    return mix(total), out
