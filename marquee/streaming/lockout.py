"""Progressive lockout after failed attempts, per key: as a stream and over a whole table.

Success clears the count, failure n locks for the n-th step, attempts during a lock are
ignored, and a lock that ends does not clear the count. The outcome of an attempt depends on
all before it, so a key is a sequence. Short sequences are replayed in one go. A long one is
cut by time: every piece is summarised, in parallel, as a map from the state on entry to the
state on exit; the small maps are chained in order; then all pieces are replayed in parallel
from their known entry states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.clock import micros
from .ordered import IDLE_DAYS, Ordered, in_order
from .runner import WATERMARK

STEPS = [int(s * 1_000_000) for s in fixed.LOCK_STEPS_SECONDS]
TOP = len(STEPS) - 1

OUTCOME = "user_id long, event_id long, outcome string, fails long, until_us long"


def replay(us, ok, fails: int, until: int) -> tuple[list[tuple[str, int, int]], int, int]:
    """Outcome, count and lock end after each attempt, and the final state."""
    out = []
    for t, good in zip(us, ok):
        if t < until:
            out.append(("locked", fails, until))
            continue
        if good:
            fails, until = 0, 0
        else:
            fails += 1
            step = STEPS[min(fails, TOP)]
            if step:
                until = int(t) + step
        out.append(("ok" if good else "failed", fails, until))
    return out, fails, until


def attempts(events: DataFrame) -> DataFrame:
    """Errors are failed attempts, sign-ups successful ones."""
    return events.filter(F.col("event_type").isin("error", "signup")).select(
        "user_id", "event_id", "ts", micros(F.col("ts")).alias("us"),
        (F.col("event_type") == "signup").alias("ok"),
    )


# ------------------------------------------------------------------ stream


class Lockout(Ordered):
    """Count and lock end per key. A cleared count is the initial value, so the key is forgotten at once."""

    fields = "event_id long, us long, ok boolean"
    value = "fails long, until_us long"
    initial = (0, 0)

    def fold(self, value, rows):
        ids, us, ok = zip(*rows)
        out, fails, until = replay(us, ok, *map(int, value))
        frame = pd.DataFrame(out, columns=["outcome", "fails", "until_us"])
        frame.insert(0, "event_id", list(ids))
        return (fails, until), frame


def lockout_stream(tries: DataFrame, watermark: str = WATERMARK, idle_days: int = IDLE_DAYS) -> DataFrame:
    """`tries` as from attempts(), streamed, in any order within the watermark; later ones are dropped."""
    return in_order(tries.select("user_id", "event_id", "ts", "us", "ok"), Lockout("user_id", idle_days), OUTCOME, watermark)


# ------------------------------------------------------------------ whole table

PIECE = "user_id long, seg long, up_to long, reset array<boolean>, count array<long>, until array<long>"
ORDER = ["us", "event_id"]


def _fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcomes of keys that come sorted; only the current key's two numbers are held."""
    key, fails, until = None, 0, 0
    for pdf in batches:
        users = pdf["user_id"].to_numpy()
        us, ok = pdf["us"].to_numpy(), pdf["ok"].to_numpy()
        cuts = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(users)]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if users[a] != key:
                key, fails, until = users[a], 0, 0
            out, fails, until = replay(us[a:b], ok[a:b], fails, until)
            rows += out
        frame = pd.DataFrame(rows, columns=["outcome", "fails", "until_us"])
        frame.insert(0, "event_id", pdf["event_id"].to_numpy())
        frame.insert(0, "user_id", users)
        yield frame


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """Whole (key, segment) runs of sorted input as arrays, also across batch borders."""
    held: dict[str, np.ndarray] | None = None
    for pdf in batches:
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        if held is not None:
            cols = {c: np.concatenate([held[c], v]) for c, v in cols.items()}
        new = (cols["user_id"][1:] != cols["user_id"][:-1]) | (cols["seg"][1:] != cols["seg"][:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield {c: v[a:b] for c, v in cols.items()}
        held = {c: v[cuts[-1] :] for c, v in cols.items()} if len(cols["seg"]) else None
    if held is not None:
        yield held


def segment_exits(us: np.ndarray, ok: np.ndarray) -> list[list[tuple[bool, int, int]]]:
    """Exit state by the first attempt not locked out and the count on entry, from the end.

    (reset, count, until): the count on exit, or what is added to it without a reset; the end
    of the last lock, 0 after a success, -1 if the lock on entry is the last."""
    n = len(us)
    exits = [[] for _ in range(n)] + [[(False, 0, -1)] * (TOP + 1)]
    for s in range(n - 1, -1, -1):
        for f in range(TOP + 1):
            if ok[s]:
                _, count, until = exits[s + 1][0]
                exits[s].append((True, count, max(until, 0)))
                continue
            g = min(f + 1, TOP)
            end = int(us[s]) + STEPS[g] if STEPS[g] else -1
            nxt = int(np.searchsorted(us, end)) if STEPS[g] else s + 1
            reset, count, until = exits[nxt][g]
            exits[s].append((reset, count if reset else count + 1, until if until >= 0 else end))
    return exits


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows are valid for lock ends up to `up_to`; a later lock outlasts the segment. Equal
    neighbours are merged, and paths meet soon, so a segment gives few rows."""
    for run in _segments(batches):
        exits = segment_exits(run["us"], run["ok"])
        n = len(run["us"])
        keep = [s for s in range(n) if s == n - 1 or exits[s] != exits[s + 1]]
        pick = lambda i: [[e[i] for e in exits[s]] for s in keep]
        yield pd.DataFrame(
            {
                "user_id": run["user_id"][keep], "seg": run["seg"][keep], "up_to": run["us"][keep],
                "reset": pick(0), "count": pick(1), "until": pick(2),
            }
        )


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry state per segment. Input is sorted by key, segment and `up_to`; only the current
    state is held."""
    key, seg, fails, until, settled = None, None, 0, 0, True
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.user_id != key:
                key, seg, fails, until = r.user_id, None, 0, 0
            if r.seg != seg:
                seg, settled = r.seg, False
                out.append((key, seg, fails, until))
            if not settled and until <= r.up_to:
                f = min(fails, TOP)
                fails = int(r.count[f]) if r.reset[f] else fails + int(r.count[f])
                until = int(r.until[f]) if r.until[f] >= 0 else until
                settled = True
        yield pd.DataFrame(out, columns=["user_id", "seg", "fails0", "until0"])


def _replay_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for run in _segments(batches):
        rows, _, _ = replay(run["us"], run["ok"], int(run["fails0"][0]), int(run["until0"][0]))
        frame = pd.DataFrame(rows, columns=["outcome", "fails", "until_us"])
        frame.insert(0, "event_id", run["event_id"])
        frame.insert(0, "user_id", run["user_id"])
        yield frame


def lockout(tries: DataFrame, long_key: int = 100_000, segment_seconds: int = 86_400) -> DataFrame:
    """Outcome of every attempt. Keys with more than `long_key` attempts go by segments."""
    sizes = tries.groupBy("user_id").agg(F.count("*").alias("_n"))
    long_keys = sizes.filter(F.col("_n") > long_key).select("user_id")
    rows = tries.select("user_id", "event_id", "us", "ok")
    whole = (
        rows.join(long_keys, "user_id", "left_anti")
        .repartition("user_id")
        .sortWithinPartitions("user_id", *ORDER)
        .mapInPandas(_fold_sorted, OUTCOME)
    )
    seg = F.floor(F.col("us") / (segment_seconds * 1_000_000)).alias("seg")
    cut = rows.join(long_keys, "user_id", "left_semi").select("user_id", "event_id", "us", "ok", seg)
    by_segment = lambda df: df.repartition("user_id", "seg").sortWithinPartitions("user_id", "seg", *ORDER)
    entry = (
        by_segment(cut).mapInPandas(_summaries, PIECE)
        .repartition("user_id")
        .sortWithinPartitions("user_id", "seg", "up_to")
        .mapInPandas(_chain, "user_id long, seg long, fails0 long, until0 long")
    )
    parts = by_segment(cut.join(entry, ["user_id", "seg"])).mapInPandas(_replay_segments, OUTCOME)
    return whole.unionByName(parts)
