"""Keyed state on a stream in event-time order, with late rows dropped and idle keys forgotten.

Rows of a key wait in its list state until the watermark has passed them; an event-time timer then
hands them over in order, however the files or micro-batches held them. What a key has to remember is
one small value. Rows behind the watermark are dropped. A key without rows for `idle_days` of event time is
forgotten, and so is one whose value is the initial one, so state follows the active keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .runner import WATERMARK

IDLE_DAYS = 365
DAY_MS = 86_400_000


def _passed(at: int) -> int:
    """The first millisecond no earlier than an instant in microseconds."""
    return -(-at // 1000)


class Ordered(StatefulProcessor):
    """Base of processors over rows in order, by event time and event_id; rows without either are ignored.

    A subclass states `fields` (what waits besides the event time, as a schema that starts with `event_id long`), `value` (schema of
    what is remembered), `initial`, and `fold(value, rows) -> (value, frame without the key column)`; rows hold the fields.
    """

    fields: str
    value: str
    initial: tuple

    def __init__(self, key_column: str, idle_days: int = IDLE_DAYS):
        self.key_column, self.idle_ms = key_column, idle_days * DAY_MS

    def fold(self, value: tuple, rows: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = ["at", *(part.split()[0] for part in self.fields.split(", "))]
        self.waiting = handle.getListState("waiting", f"at long, {self.fields}")
        self.kept = handle.getValueState("kept", f"{self.value}, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # There is no watermark yet while it stands at 0.
        late = timerValues.getCurrentWatermarkInMs() * 1000 or -(1 << 62)
        first = None
        for pdf in rows:
            pdf = pdf[pdf["at"].notna() & pdf["event_id"].notna()]
            pdf = pdf.astype({"at": "int64", "event_id": "int64"})
            new = [r for r in zip(*(pdf[c].tolist() for c in self.names)) if r[0] > late]
            if new:
                self.waiting.appendList(new)
                first = min([r[0] for r in new] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(_passed(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in waiting if r[0] <= now_ms * 1000]
        held = self.kept.get() if self.kept.exists() else None
        if not ready:
            if not waiting and held is not None and held[-1] + self.idle_ms <= now_ms:
                self.kept.clear()
            return
        value, last, parts = (self.initial, None, []) if held is None else (tuple(held[:-1]), held[-1], [])
        for stretch in self.stretches(ready):
            if last is not None and _passed(stretch[0][0]) > last + self.idle_ms:
                value = self.initial
            value, part = self.fold(value, [r[1:] for r in stretch])
            parts.append(part)
            last = _passed(stretch[-1][0])
        out = pd.concat(parts, ignore_index=True)
        if value == self.initial:
            self.kept.clear()
        else:
            self.kept.update((*value, last))
            # Fires once the key has been idle for long; a timer for rows that came meanwhile finds a later `last`.
            self.handle.registerTimer(last + self.idle_ms)
        rest = waiting[len(ready) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(_passed(rest[0][0]))
        else:
            self.waiting.clear()
        out.insert(0, self.key_column, key[0])
        yield out

    def stretches(self, rows: list[tuple]) -> Iterator[list[tuple]]:
        """Rows cut where the key was idle for too long, so what is forgotten does not depend on micro-batches."""
        start = 0
        for i in range(1, len(rows)):
            if _passed(rows[i][0]) > _passed(rows[i - 1][0]) + self.idle_ms:
                yield rows[start:i]
                start = i
        yield rows[start:]

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, processor: Ordered, schema: str, watermark: str = WATERMARK) -> DataFrame:
    """Rows with an event time `ts` through the processor, in append mode."""
    late = rows.withWatermark("ts", watermark).withColumn("at", F.unix_micros("ts"))
    return late.groupBy(processor.key_column).transformWithStateInPandas(processor, schema, "append", "eventTime")
