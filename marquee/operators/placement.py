"""Where the characters of queries stand in texts, and what that is worth, for whole batches of pairs.

A batch holds pairs of a query and a text with equal query lengths as two matrices of code points. For each
character k of the queries three tables say, for every position of every text, where that character comes next, where it
stood last, and where it next starts a word: running minima and maxima along the text. All placements
are then walks through these tables, one step per character for the whole batch at once:

* tight: each character where it comes next, from the front; then, from where the last one stood, each where it stood last;
* by word starts: each character at its next word start if there is one, else where it comes next;
* tight again from each of the next word starts of the first character, a few times.

A pair is worth its best placement, the first among equals. Placements within the title count in full; only texts
whose titles have none are placed as a whole, at a discount.
"""

from __future__ import annotations

import numpy as np

from ..functions import fixed

DIGITS = 9  # equal scores tie exactly, whatever the order of their terms
#: Cells of a position table: a batch has as many pairs as fit.
CELLS = 1 << 16


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x longest, lengths); unused cells are 0."""
    lengths = np.array([len(t) for t in texts], "i4")
    out = np.zeros((len(texts), int(lengths.max(initial=0))), "u4")
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def starts_of_words(text: np.ndarray) -> np.ndarray:
    """Positions not behind an ASCII letter or digit."""
    low = text | 32
    inner = ((low >= ord("a")) & (low <= ord("z")) & (text < 128)) | ((text >= ord("0")) & (text <= ord("9")))
    return np.concatenate([np.ones((len(text), 1), bool), ~inner[:, :-1]], axis=1)


class Tables:
    """Of texts (pairs x width) and queries (pairs x n): per character, next and last places. `width` stands for none."""

    def __init__(self, query: np.ndarray, text: np.ndarray, lengths: np.ndarray):
        pairs, self.width = text.shape
        self.rows, self.n = np.arange(pairs), query.shape[1]
        self.starts = starts_of_words(text)
        place = np.arange(self.width, dtype="i4")
        used = place < lengths[:, None]
        none = np.full((pairs, 1), self.width, "i4")
        self.next, self.last, self.lead = [], [], []
        for k in range(self.n):
            here = (text == query[:, k, None]) & used
            self.next.append(self._backwards(np.where(here, place, self.width), none))
            self.lead.append(self._backwards(np.where(here & self.starts, place, self.width), none))
            self.last.append(np.maximum.accumulate(np.where(here, place, -1), axis=1))

    @staticmethod
    def _backwards(places: np.ndarray, none: np.ndarray) -> np.ndarray:
        least = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1]
        return np.concatenate([least, none, none], axis=1)

    def tight_end(self, at: np.ndarray) -> np.ndarray:
        """Where the last character stands if each, from `at` on, stands as early as it can."""
        for k in range(self.n):
            at = self.next[k][self.rows, at] + (k < self.n - 1)
        return np.minimum(at, self.width)

    def packed(self, end: np.ndarray) -> np.ndarray:
        """Places as late as they can be with the last at `end`, a place of it."""
        out = np.empty((len(end), self.n), "i4")
        at = np.clip(end, 0, max(self.width - 1, 0))
        for k in range(self.n - 1, -1, -1):
            out[:, k] = self.last[k][self.rows, np.maximum(at, 0)]
            at = out[:, k] - 1
        return out

    def by_starts(self, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, which have one): word starts before `end` where there are any."""
        out, at = np.empty((len(end), self.n), "i4"), np.zeros(len(end), "i4")
        ok = np.ones(len(end), bool)
        for k in range(self.n):
            lead, plain = self.lead[k][self.rows, at], self.next[k][self.rows, at]
            ok &= plain < end
            out[:, k] = np.where(lead < end, lead, plain)
            at = np.minimum(out[:, k] + 1, self.width)
        return out, ok

    def worth(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Worth of the placements `at` (pairs x n) in fields of length `end`."""
        n, first, last = self.n, at[:, 0], at[:, -1]
        lead = self.starts[self.rows[:, None], np.clip(at, 0, self.width - 1)]
        total = n * fixed.FUZZY_CHARACTER + np.where(lead, fixed.FUZZY_WORD_START, 0).sum(axis=1).astype("f8")
        total += np.where(first == 0, fixed.FUZZY_FIELD_START - fixed.FUZZY_WORD_START, 0)
        run = np.zeros(len(at), "i8")
        for k in range(1, n):
            skipped = at[:, k] - at[:, k - 1] - 1
            run = np.where(skipped == 0, run + 1, 0)
            joined = fixed.FUZZY_JOINED + fixed.FUZZY_STREAK * np.minimum(run, fixed.FUZZY_STREAK_MAX)
            total += np.where(skipped == 0, joined, -np.minimum(fixed.FUZZY_GAP * skipped, fixed.FUZZY_GAP_MAX))
        if n > 1:
            total += np.where(lead.all(axis=1), fixed.FUZZY_INITIAL * n, 0)
        total -= np.minimum(first * fixed.FUZZY_LATE, fixed.FUZZY_LATE_MAX)
        total -= np.minimum(end, fixed.FUZZY_LENGTH_MAX) * fixed.FUZZY_LENGTH
        whole = fixed.FUZZY_WHOLE + fixed.FUZZY_PREFIX * (first == 0) + fixed.FUZZY_EXACT * (end == n)
        return total + np.where(last - first == n - 1, whole, 0)


def _of_one_length(query: np.ndarray, text: np.ndarray, lengths: np.ndarray, titles: np.ndarray):
    """(worth, places, whether in the title) of pairs with equal query lengths; worth is -inf without a placement."""
    t = Tables(query, text, lengths)
    front = t.tight_end(np.zeros(len(text), "i4"))
    in_title = front < titles
    end = np.where(in_title, titles, lengths)
    options = [(t.packed(front), front < end)]
    options.append(t.by_starts(end))
    at, going = np.zeros(len(text), "i4"), front < end
    for _ in range(fixed.FUZZY_RESTARTS):
        at = t.lead[0][t.rows, np.minimum(at + 1, t.width)]
        back = t.tight_end(np.minimum(at, t.width))
        going = going & (at < end) & (back < end)
        options.append((t.packed(back), going))
    worth = np.stack([np.where(ok, np.round(t.worth(places, end), DIGITS), -np.inf) for places, ok in options])
    best = worth.argmax(axis=0)
    places = np.stack([p for p, _ in options])[best, t.rows]
    return worth[best, t.rows], places, in_title


def placed(queries: list[str], texts: list[str], titles: np.ndarray, popular: np.ndarray):
    """(score, places) per pair of a non-empty query and a text; the score is NaN where the query is not found.

    `titles` are lengths of the titles that the texts begin with.
    """
    sizes = np.array([(len(q), len(t)) for q, t in zip(queries, texts)], "i8").reshape(-1, 2)
    score, places = np.full(len(queries), np.nan), [None] * len(queries)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    at = 0
    while at < len(order):
        n = sizes[order[at], 0]
        end = int(np.searchsorted(sizes[order, 0], n, "right"))
        # The longest text of a part is its last one.
        widths = sizes[order[at:end], 1] + 2
        fits = int(np.searchsorted(widths * np.arange(1, len(widths) + 1), CELLS, "right"))
        part = order[at : at + max(1, fits)]
        at += len(part)
        text, lengths = code_points([texts[i] for i in part])
        if not text.shape[1]:
            continue
        query, _ = code_points([queries[i] for i in part])
        worth, where, in_title = _of_one_length(query, text, lengths, titles[part])
        found = np.isfinite(worth)
        value = np.where(in_title, worth, worth * fixed.FUZZY_REST) + fixed.FUZZY_POPULAR * popular[part]
        score[part[found]] = value[found]
        for i, p in zip(part[found].tolist(), where[found]):
            places[i] = p
    return score, places
