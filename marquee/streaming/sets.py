"""Recent items, toggled sets and the compare tray, kept up to date on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from .ordered import DAY_MS, IDLE_DAYS, Ordered, in_order
from .runner import WATERMARK

# ------------------------------------------------------------------ recents

RECENT = "user_id long, version long, rank int, kind string, item_id string, event_id long"
class Recents(StatefulProcessor):
    """The newest eight distinct items of a user as map state, item -> last use; nothing else is kept. Uses can come in any order. An
    event-time timer forgets a user who has used nothing for long."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "version long, last_ms long")
        self.items = handle.getMapState("items", "kind string, item_id string", "us long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows of a micro-batch come before its timers.
        self.forget(timerValues)
        version, last = self.seen.get() if self.seen.exists() else (0, 0)
        before = {tuple(k): tuple(v) for k, v in self.items.iterator()}
        held = dict(before)
        for pdf in rows:
            pdf = pdf[pdf["event_id"].notna()].astype({"us": "int64", "event_id": "int64", "at": "int64"})
            version += len(pdf)
            last = max([last, *(-(-at // 1000) for at in pdf["at"].tolist())])
            for item, use in zip(zip(pdf["kind"].tolist(), pdf["item_id"].tolist()), zip(pdf["us"].tolist(), pdf["event_id"].tolist())):
                if item not in held or held[item] < use:
                    held[item] = use
            held = dict(sorted(held.items(), key=lambda kv: kv[1], reverse=True)[: fixed.RECENT_KEEP])
        for item in before.keys() - held.keys():
            self.items.removeKey(item)
        for item, use in held.items():
            if before.get(item) != use:
                self.items.updateValue(item, use)
        self.seen.update((version, last))
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(
            [(key[0], version, n + 1, k, i, e) for n, ((k, i), (_, e)) in enumerate(held.items())],
            columns=["user_id", "version", "rank", "kind", "item_id", "event_id"],
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget(timerValues)
        return iter(())

    def forget(self, timerValues) -> None:
        if self.seen.exists() and self.seen.get()[1] + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
            self.seen.clear()
            self.items.clear()

    def close(self) -> None:
        pass


def recent_stream(uses: DataFrame, watermark: str = WATERMARK, idle_days: int = IDLE_DAYS) -> DataFrame:
    """`uses` has user_id, kind, item_id, ts, us, event_id. Each trigger emits the whole list of the
    users it touched; the highest version per user is the current one, until the user is forgotten."""
    timed = uses.withWatermark("ts", watermark).withColumn("at", F.unix_micros("ts"))
    narrow = timed.select("user_id", "kind", "item_id", "ts", "at", "us", "event_id")
    return narrow.groupBy("user_id").transformWithStateInPandas(Recents(idle_days * DAY_MS), RECENT, "append", "eventTime")


def latest_version(lists: DataFrame, key: str = "user_id", version: str = "version") -> DataFrame:
    """Rows of the newest version per key. Versions of a key are few per trigger; the maximum
    is an aggregate, so a hot key costs one row per task."""
    newest = lists.groupBy(key).agg(F.max(version).alias(version))
    return lists.join(newest, [key, version], "left_semi")


# ------------------------------------------------------------------ toggles


def toggle_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """Toggle counts per key, in update mode; parity needs no order, hence a plain count."""
    return events.groupBy(*keys).agg(F.count("*").alias("toggles"))


# ------------------------------------------------------------------ compare tray

TRAY = "user_id long, event_id long, action string, tray array<long>"


def tray_fold(tray: list[int], keys, most: int = fixed.COMPARE_MAX) -> list[tuple[str, list[int]]]:
    """A key in the tray leaves it, a new one joins unless the tray is full."""
    out = []
    for k in keys:
        k = int(k)
        if k in tray:
            tray = [x for x in tray if x != k]
            out.append(("removed", tray))
        elif len(tray) >= most:
            out.append(("refused", tray))
        else:
            tray = [*tray, k]
            out.append(("added", tray))
    return out


class Tray(Ordered):
    """At most four keys per user, toggled in order."""

    fields = "event_id long, k long"
    value = "tray array<long>"
    initial = ([],)

    def fold(self, value, rows):
        ids, keys = zip(*rows)
        steps = tray_fold([int(k) for k in value[0]], keys)
        frame = pd.DataFrame({"event_id": list(ids), "action": [a for a, _ in steps], "tray": [t for _, t in steps]})
        return (steps[-1][1],), frame


def tray_stream(toggles: DataFrame, watermark: str = WATERMARK, idle_days: int = IDLE_DAYS) -> DataFrame:
    """`toggles` has user_id, event_id, ts, k, in any order within the watermark; later ones are dropped."""
    return in_order(toggles.select("user_id", "event_id", "ts", "k"), Tray("user_id", idle_days), TRAY, watermark)
