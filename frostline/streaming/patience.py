"""In-order streams that don't wait for ever: a number that hasn't come after a while of event time is given up."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .entries import BLOB, GROUP, KEY_NAME, Entries, Keys, entry_map, group_of, state_name


class PatientOrder(StatefulProcessor):
    """Puts each key's rows, which come in groups of keys, out in the order of a number from 0 on. Rows that came early wait
    in state: FEW of a key beside its next number, the rest in entries of their own.

    The first number that is waited for has until patience after the event time of the least row that waits. The group's
    timer, at the least of its keys' times, gives up what is missing, and goes on from that row. A row whose number was put
    out or given up before is late.
    """

    def __init__(self, key: str, columns: list[str], number: str, patience_ms: int) -> None:
        self.key, self.columns, self.number, self.patience_ms = key, columns, number, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = entry_map(handle, "waiting")
        self.keys, self.due = handle.getValueState("keys", BLOB), handle.getValueState("due", BLOB)

    def _times(self) -> tuple[dict[str, int], int | None]:
        """When each key gives up next, and the time of the group's timer, which is the least of those."""
        held = self.due.get()
        return pickle.loads(held[0]) if held else ({}, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        keys, (due, timer), seen = Keys(self.keys), self._times(), {}
        for batch in rows:
            out = []
            batch = batch.set_axis([GROUP, KEY_NAME, *self.columns, "_time", "_at_ms"], axis=1).sort_values([KEY_NAME, self.number], ignore_index=True)  # Spark loses names
            plain = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in (KEY_NAME, self.number, "_at_ms", *self.columns)]
            for text, here in groupby(zip(*plain, strict=True), key=itemgetter(0)):
                name = state_name(text)
                seen[name] = text
                _, n, held = keys.get(name, (text, 0, None))
                waiting = Entries(name, self.rest, held)
                for _, k, at, *row in here:
                    if k > n and k not in waiting:
                        waiting.put(k, (at, tuple(row)))
                    elif k != n:
                        out.append((text, *row, 0, True))  # put out or given up before, or a number that comes twice
                    else:
                        out.append((text, *row, 0, False))
                        n = self._release(text, waiting, n + 1, out)
                keys.put(name, text, n, waiting.held())
            if out:
                yield self._frame(out)
        yield self._frame(self._go_on(keys, list(seen), due, timer, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        watermark_ms, (due, _) = timerValues.getCurrentWatermarkInMs(), self._times()
        yield self._frame(self._go_on(Keys(self.keys), [name for name, at in due.items() if at <= watermark_ms], due, None, watermark_ms))

    def _release(self, text: str | None, waiting: Entries, n: int, out: list[tuple]) -> int:
        """Puts out what waits from n on without gaps, and returns the number after it."""
        while (found := waiting.pop(n)) is not None:
            out.append((text, *found[1], 0, False))
            n += 1
        return n

    def _go_on(self, keys: Keys, names: list[str], due: dict[str, int], timer: int | None, watermark_ms: int) -> list[tuple]:
        """Gives up what these keys have waited for long enough, and sets the timer for what hasn't been."""
        out: list[tuple] = []
        for name in names:
            text, n, held = keys.get(name, ())
            waiting = Entries(name, self.rest, held)
            due.pop(name, None)
            while (least := waiting.least()) is not None:
                at, row = waiting.pop(least)
                if at + self.patience_ms > watermark_ms:
                    waiting.put(least, (at, row))
                    due[name] = at + self.patience_ms
                    break
                out.append((text, *row, least - n, False))
                n = self._release(text, waiting, least + 1, out)
            keys.put(name, text, n, waiting.held())
        keys.save()
        first = min(due.values(), default=None)
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.due.update((pickle.dumps((due, first)),))
        return out

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, *self.columns, "missing", "late"])

    def close(self) -> None:
        pass


def in_order_or_given_up(rows: DataFrame, key: str, number: str, time: str, delay: str, patience_ms: int) -> DataFrame:
    """The stream rows in the order of number (from 0 on in each key) with missing, how many numbers were given up right
    before, and late.

    time is the event time; delay is how far behind the latest one the watermark is ("1 hour"). A number that hasn't come
    when the watermark is patience_ms past the row that waits behind it is given up, so what waits is bounded by what comes in
    that while. A row that comes for a number given up, or a second one for a number, is put out as late, unless Spark drops it
    before, as it does with rows behind the watermark; it counts those (numRowsDroppedByWatermark). Rows that still wait when
    the stream stops stay in its state. number and time must not be null.
    """
    names = rows.columns
    seen = rows.withColumn("_at_ms", F.unix_millis(time)).withWatermark(time, delay)
    columns = [c for c in names if c not in (key, time)]
    kept = [f for f in rows.schema if f.name in columns]
    schema = StructType([StructField(key, StringType()), *kept, StructField("missing", LongType()), StructField("late", BooleanType())])
    text = F.col(key).cast("string")
    slim = seen.select(group_of(text).alias(GROUP), text.alias(KEY_NAME), *columns, time, "_at_ms")
    out = slim.groupBy(GROUP).transformWithStateInPandas(PatientOrder(key, columns, number, patience_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select(F.col(key).cast(rows.schema[key].dataType).alias(key), *columns, "missing", "late")
