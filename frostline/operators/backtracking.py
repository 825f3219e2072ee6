"""A user-defined operator over a sequence that may go back and run again over what it has seen."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

Body = Callable[[Any, Any, "History"], Any]


@dataclass
class History:
    """What a body sees besides its state and the current item: the items before it, since the last clear.

    A body returns the next state. States are kept to be restored and must not be changed in place.
    """

    most: int | None = None  # items kept
    items: list = field(default_factory=list)  # those before the current one, it, and those to be replayed
    before: list = field(default_factory=list)  # the state before each
    at: int = 0
    back: int = 0

    def __len__(self) -> int:
        return self.at

    def __getitem__(self, i: int) -> Any:
        return self.items[: self.at][i]

    def clear(self) -> list:
        """Forgets the items before the current one, and returns them."""
        if self.back:
            raise ValueError("clear and backtrack in one step")
        gone = self.items[: self.at]
        del self.items[: self.at], self.before[: self.at]
        self.at = 0
        return gone

    def backtrack(self, n: int) -> None:
        """After this step goes on with the item n before the current one, in the state from before it."""
        if not 0 < n <= self.at or self.most is not None and n >= self.most:
            raise ValueError(f"can't go back {n} of {self.at} items")
        self.back = n

    def feed(self, item: Any, state: Any, body: Body) -> Any:
        """Takes the next item, runs body over it and whatever is replayed, and returns the state after that."""
        self.items.append(item)
        while self.at < len(self.items):
            del self.before[self.at :]
            self.before.append(state)
            self.back = 0
            state = body(state, self.items[self.at], self)
            if self.back:
                self.at -= self.back
                state = self.before[self.at]
            else:
                self.at += 1
        if self.most is not None and len(self.items) > self.most:
            extra = len(self.items) - self.most
            del self.items[:extra], self.before[:extra]
            self.at -= extra
        return state


def run_with_backtracking(items: Iterable, state: Any, body: Body, most: int | None = None) -> Any:
    """Runs body over items in order and returns the last state; see History."""
    history = History(most)
    for item in items:
        state = history.feed(item, state, body)
    return state
