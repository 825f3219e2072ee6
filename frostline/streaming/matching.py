"""The matcher and the release buffer as keyed state of Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.matcher import STEP_SCHEMA, ChainMatcher
from ..params import REPAIR, MatcherParams
from .entries import BLOB, GROUP, KEY_NAME, Entries, Keys, entry_map, group_of, state_name

PART = 10_000  # rows that a task puts out at once


class _InOrder(StatefulProcessor):
    """Takes each key's rows in the order of a number from 0 on without gaps, whatever batch they come in.

    Keys come in groups (in_order_stream()), so that a call has the rows of many. What is known of them is one value of
    state, read and written once a call, with FEW rows of a key that came early; more wait in entries of their own. No more
    than one Arrow batch is in memory beside it. A number that never comes holds up its key for good, and what follows it waits
    in state: a stream whose rows may be lost goes through patience.in_order_or_given_up() first, and is numbered anew.
    """

    number, columns, names = "frame_num", (), ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getValueState("keys", BLOB)
        self.waiting = entry_map(handle, "waiting")

    def fresh(self) -> Any:
        """What a key remembers at first."""
        return None

    def put_out(self, key: Any, rows: Iterator[tuple], memory: Any) -> Iterator[tuple]:
        """What a key's rows in order make."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        keys = Keys(self.keys)
        found = (row for batch in rows for row in self._of_batch(keys, batch))
        while part := list(islice(found, PART)):
            yield pd.DataFrame(part, columns=self.names)
        keys.save()

    def _of_batch(self, keys: Keys, rows: pd.DataFrame) -> Iterator[tuple]:
        rows = rows.set_axis([GROUP, KEY_NAME, *self.columns], axis=1).sort_values([KEY_NAME, self.number], ignore_index=True)  # Spark loses names
        plain = [rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in (KEY_NAME, self.number, *self.columns)]
        for key, here in groupby(zip(*plain, strict=True), key=itemgetter(0)):
            name = state_name(key)
            n, waiting, memory = keys.get(name, (0, None, self.fresh()))
            place = _Place(n, Entries(name, self.waiting, waiting))
            yield from self.put_out(key, place.ready(here), memory)
            keys.put(name, place.n, place.waiting.held(), memory)

    def close(self) -> None:
        pass


class _Place:
    """How far a key has come, and what waits."""

    def __init__(self, n: int, waiting: Entries) -> None:
        self.n, self.waiting = n, waiting

    def ready(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Of rows (key, number, ...) sorted by number those whose turn it is, without key and number."""
        for _, k, *row in rows:
            if k > self.n:
                self.waiting.put(k, tuple(row))
            elif k == self.n:
                yield tuple(row)
                self.n += 1
                while (row := self.waiting.pop(self.n)) is not None:
                    yield row
                    self.n += 1


class MatcherProcessor(_InOrder):
    columns = ("frame_num", "ts_s", "hash_distance", "motion", "distinct_conf")
    names = tuple(c.split()[0] for c in STEP_SCHEMA.split(", "))

    def __init__(self, params: MatcherParams = REPAIR) -> None:
        self.params = params

    def fresh(self) -> ChainMatcher:
        return ChainMatcher(self.params)

    def put_out(self, key: Any, rows: Iterator[tuple], memory: ChainMatcher) -> Iterator[tuple]:
        for row in rows:
            yield from (tuple((s | {"video_id": key})[c] for c in self.names) for s in memory.feed(row))
        memory.told = []


class ReleaseProcessor(_InOrder):
    """Completions in the order of their jobs."""

    number, columns, names = "chain_i", ("chain_i", "out"), ("video_id", "chain_i", "out")

    def put_out(self, key: Any, rows: Iterator[tuple], memory: None) -> Iterator[tuple]:
        return ((key, *row) for row in rows)


def in_order_stream(rows: DataFrame, key: str, processor: _InOrder, schema: str) -> DataFrame:
    """What a processor puts out, key and schema, over a stream's rows in groups of keys. Keys move as text: pandas would
    make numbers beside a null into others."""
    text = F.col(key).cast("string")
    found = rows.select(group_of(text).alias(GROUP), text.alias(KEY_NAME), *processor.columns).groupBy(GROUP)
    out = found.transformWithStateInPandas(processor, outputStructType=f"{key} string, {schema}", outputMode="Append", timeMode="None")
    return out.withColumn(key, F.col(key).cast(rows.schema[key].dataType))


def match_stream(scores: DataFrame, params: MatcherParams = REPAIR) -> DataFrame:
    """The steps of match_steps() over a stream of scores, for any way that it is cut into batches."""
    return in_order_stream(scores, "video_id", MatcherProcessor(params), STEP_SCHEMA.removeprefix("video_id long, "))


def release_stream(completions: DataFrame) -> DataFrame:
    """Completions (video_id, chain_i, out), each released once all before it are done."""
    return in_order_stream(completions, "video_id", ReleaseProcessor(), "chain_i long, out string")


def on_done(released: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a stream that calls back with what each batch has released, in order within a video, and the batch's number.

    After a failure a batch may be told again, under its old number.
    """

    def tell(rows: DataFrame, batch: int) -> None:
        callback(rows.sortWithinPartitions("video_id", "chain_i"), batch)

    return released.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
