"""User-defined operators that may go back over a sequence, run over tables by key: in batch, and as a stream."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..streaming.matching import _InOrder, in_order_stream
from .backtracking import History


@dataclass(frozen=True)
class Operator:
    """What a user defines: body(state, row, history, run) returns the next state.

    row is a tuple of the order's value and the columns; history goes back or clears (see History); run.emit() puts a row of
    schema out, and run.memory is a dictionary that going back doesn't restore. start makes the first state of a key. At most
    `most` items are kept, so that what a key holds is bounded however long it is.
    """

    body: Callable[[Any, tuple, History, "Run"], Any]
    schema: str
    most: int
    start: Callable[[], Any] = int

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]


class Run:
    """An operator on its way through one key."""

    def __init__(self, operator: Operator, held: bytes | None = None) -> None:
        self.operator = operator
        fresh = (operator.start(), History(operator.most), {}, 0)
        self.state, self.history, self.memory, self.step = pickle.loads(held) if held else fresh
        self.out: list[tuple] = []

    def emit(self, *values: Any) -> None:
        self.out.append((self.step, *values))
        self.step += 1

    def feed(self, row: tuple) -> list[tuple]:
        """The rows that a row causes, those of replayed ones included, each after its step."""
        self.out = []
        self.state = self.history.feed(row, self.state, lambda state, item, history: self.operator.body(state, item, history, self))
        return self.out

    def held(self) -> bytes:
        return pickle.dumps((self.state, self.history, self.memory, self.step))


def _plain(rows: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    """Rows as tuples of plain values, nulls as None."""
    return zip(*(rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in names), strict=True)


def replayed(rows: DataFrame, key: str, order: str, operator: Operator, *columns: str) -> DataFrame:
    """(key, step, what the operator puts out), over each key's rows in the order of a column.

    Rows are dealt by key and sorted once; a task runs through them and holds one key's last items. A null key is a key.
    Rows tied in order come in any order, so an operator over ties has to treat them alike. Without rows there are none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, object()
        for part in batches:
            out = []
            for k, row in zip((k for (k,) in _plain(part, [key])), _plain(part, [order, *columns]), strict=True):
                if now is None or k != at:
                    now, at = Run(operator), k
                out += [(k, *x) for x in now.feed(row)]
            yield pd.DataFrame(out, columns=[key, "step", *operator.names])

    slim = rows.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order)
    return slim.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, step long, {operator.schema}")


class ReplayProcessor(_InOrder):
    def __init__(self, key: str, order: str, operator: Operator, columns: tuple[str, ...]) -> None:
        self.number, self.operator, self.columns = order, operator, (order, *columns)
        self.names = (key, "step", *operator.names)

    def fresh(self) -> dict:
        return {"held": None}

    def put_out(self, key: Any, rows: Iterator[tuple], memory: dict) -> Iterator[tuple]:
        now = Run(self.operator, memory["held"])
        yield from ((key, *x) for row in rows for x in now.feed(row))
        memory["held"] = now.held()


def replay_stream(rows: DataFrame, key: str, order: str, operator: Operator, *columns: str) -> DataFrame:
    """The same of a stream, for any way that it is cut into batches; order counts from 0 without gaps in a key. What is kept
    of a key is its state, memory and last items, and rows that came early."""
    return in_order_stream(rows, key, ReplayProcessor(key, order, operator, columns), f"step long, {operator.schema}")


def _after_errors(state: int, row: tuple, history: History, run: Run) -> int:
    frame, kind = row
    run.emit(frame, state + 1)
    if kind == "purchase":
        history.clear()
    elif kind == "error" and frame > run.memory.get("done", -1) and len(history):
        run.memory["done"] = frame
        history.backtrack(min(2, len(history)))
    return state + 1


#: Sees the two frames before an error again, and the error, but never goes back past a purchase.
AFTER_ERRORS = Operator(_after_errors, "frame_num long, counter long", most=6)
