import random
from collections import Counter

import pandas as pd
import pytest

from frostline.operators import replay
from frostline.streaming import entries, lookup, matching, patience


class State:
    """Values and maps of one group, and how often they are called."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, Counter(), set()

    def getValueState(self, name, _):  # noqa: N802 - Spark's name
        return _Value(self, name)

    def getMapState(self, name, *_):  # noqa: N802 - Spark's name
        return _Map(self, name)

    def registerTimer(self, at):  # noqa: N802 - Spark's name
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802 - Spark's name
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802 - Spark's name
        return 0


class _Value:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def get(self):
        self.state.calls["read"] += 1
        return self.state.values.get(self.name)

    def update(self, value):
        self.state.calls["written"] += 1
        self.state.values[self.name] = value


class _Map:
    def __init__(self, state, name):
        self.state, self.values = state, state.values.setdefault(name, {})

    def getValue(self, key):  # noqa: N802 - Spark's name
        self.state.calls["entry"] += 1
        return self.values.get(key)

    def updateValue(self, key, value):  # noqa: N802 - Spark's name
        self.state.calls["entry"] += 1
        self.values[key] = value

    def removeKey(self, key):  # noqa: N802 - Spark's name
        self.state.calls["entry"] += 1
        del self.values[key]

    def keys(self):
        return iter(list(self.values))


@pytest.mark.parametrize("few", [3, 1000])
def test_entries_beyond_a_few_are_in_the_map(monkeypatch, few):
    monkeypatch.setattr(entries, "FEW", few)
    rng, state, want = random.Random(few), State(), {}
    rest, held = _Map(state, "rest"), None
    for _ in range(600):
        found = entries.Entries("a", rest, held)  # as each call finds it
        name = rng.randrange(20)
        if rng.random() < 0.6:
            found.put(name, want.setdefault(name, rng.random()) if name in want else want.setdefault(name, rng.random()))
        else:
            assert found.pop(name) == want.pop(name, None)
        assert (name in found) == (name in want) and found.least() == min(want, default=None)
        held = found.held()
        assert len(held[0]) <= few and len(rest.values) == held[1] == len(want) - len(held[0])


def call(processor, state, rows, columns):
    processor.init(state)
    return [tuple(r) for part in processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), state) for r in part.itertuples(index=False)]


def shuffled(rows, n, seed=1):
    rows = random.Random(seed).sample(rows, len(rows))
    return [rows[i::n] for i in range(n)]


def test_a_group_of_many_keys_reads_its_state_once():
    state = State()
    processor = replay.ReplayProcessor("key", "place", replay.Operator(lambda s, row, h, run: run.emit(row[0]), "place long", most=3), ("value",))
    rows = [(0, str(k), n, n, 1.0) for k in range(50) for n in range(60)]
    out = []
    for part in shuffled(rows, 4):
        out += call(processor, state, [(g, k, n, v) for g, k, n, _, v in part], ["g", "k", "place", "value"])
    assert sorted((int(k), step, place) for k, step, place in out) == [(k, n, n) for k in range(50) for n in range(60)]
    assert state.calls == {"read": 4, "written": 4}


def test_jobs_of_many_videos_read_their_state_once():
    state = State()
    jobs = [(0, str(v), True, f"{v}-{i}", i, f"out{i}", None) for v in range(40) for i in range(9)]
    done = [(0, str(v), False, f"{v}-{i}", None, None, i) for v in range(40) for i in range(9)]
    out = []
    for part in shuffled(jobs + done, 3):
        out += call(lookup.JobLookup(), state, part, ["g", "k", *lookup.COLUMNS])
    assert sorted((int(r[0]), r[1]) for r in out) == [(v, i) for v in range(40) for i in range(9)]
    assert state.calls == {"read": 3, "written": 3}


def test_patience_of_many_keys_reads_its_state_once():
    state = State()
    rows = [(0, str(k), n, None, n * 1000) for k in range(40) for n in range(1, 30)]  # 0 never comes
    out = call(patience.PatientOrder("key", ["place"], "place", 5), state, rows, ["g", "k", "place", "_time", "_at_ms"])
    assert out == [] and state.timers == {1005} and state.calls == {"read": 2, "written": 2}


def test_numbers_beside_a_null_key_stay_as_they_are(spark):
    from frostline.sources.staging import as_stream, run_stream, state_store

    rows = spark.createDataFrame([(k, i, f"o{i}") for k in (None, 5, 2**60 + 1) for i in range(6)], "video_id long, chain_i long, out string")
    with state_store(spark):
        found = run_stream(matching.release_stream(as_stream(rows.repartition(2, "chain_i"))), 2).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in rows.collect()} and len(found) == 18
