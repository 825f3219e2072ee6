"""What a key of a stream holds while it waits: a few entries beside its other state, the rest one by one in a map."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Groups that keys are dealt over. A group is one call with all its rows of a batch, where a call for each key costs more
#: than the rows of a short one.
GROUPS = 1024
FEW = 256  # entries that are read and written with a key's state

GROUP, KEY_NAME = "group_of_keys", "key_of_rows"  # columns of what comes in groups

BLOB = StructType([StructField("blob", BinaryType())])
_PLACE = StructType([StructField("key", StringType()), StructField("name", StringType())])


def group_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS))


def state_name(key: str | None) -> str:
    """The name of a key in state."""
    return "null" if key is None else f"={key}"


def entry_map(handle: StatefulProcessorHandle, name: str):
    return handle.getMapState(name, _PLACE, BLOB)


class Keys:
    """What is known of each key of a group: one value of state, as each reading or writing of state costs about what a
    hundred rows do. A key is taken apart only when it is asked for. With GROUPS of them a group of tens of millions of
    keys' stream has some ten thousands, of FEW entries each at most."""

    def __init__(self, state) -> None:
        held = state.get()
        self.state, self.held = state, pickle.loads(held[0]) if held else {}

    def get(self, name: str, fresh: tuple) -> tuple:
        return pickle.loads(self.held[name]) if name in self.held else fresh

    def put(self, name: str, *value: Any) -> None:
        self.held[name] = pickle.dumps(value)

    def save(self) -> None:
        self.state.update((pickle.dumps(self.held),))


class Entries:
    """Entries of one key by name, FEW of them in memory while the key is at work."""

    def __init__(self, key: str, rest, held: tuple[dict, int] | None = None) -> None:
        self.key, self.rest = key, rest
        self.few, self.more = held or ({}, 0)

    def held(self) -> tuple[dict, int]:
        return self.few, self.more

    def put(self, name: Any, value: Any) -> None:
        """An entry of a new name, or of one that is there in its stead."""
        if name in self.few or len(self.few) < FEW and (not self.more or self._rest(name) is None):
            self.few[name] = value
            return
        self.more += self._rest(name) is None
        self.rest.updateValue((self.key, repr(name)), (pickle.dumps(value),))

    def pop(self, name: Any) -> Any:
        """Takes an entry out; None if there is none."""
        if name in self.few:
            return self.few.pop(name)
        if not self.more or (found := self._rest(name)) is None:
            return None
        self.rest.removeKey((self.key, repr(name)))
        self.more -= 1
        return pickle.loads(found[0])

    def least(self) -> int | None:
        """The least name, where names are numbers. Those of the map are gone through for it, one at a time."""
        found = min(self.few, default=None)
        if self.more:
            found = min((int(name) for key, name in self.rest.keys() if key == self.key and (found is None or int(name) < found)), default=found)
        return found

    def __contains__(self, name: Any) -> bool:
        return name in self.few or self.more > 0 and self._rest(name) is not None

    def _rest(self, name: Any) -> tuple | None:
        return self.rest.getValue((self.key, repr(name)))
