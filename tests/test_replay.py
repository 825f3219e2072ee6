import random

import pytest

from frostline.operators import replay
from frostline.plans.queries import STATE_PARTITIONS
from frostline.sources.frames import event_frames
from frostline.sources.staging import as_stream, run_stream, state_store


def _golden(state, row, history, run):
    """Clears at B, goes back three at the first F, and clears at the second D."""
    place, letter = row
    seen = run.memory.setdefault("seen", {})
    seen[letter] = seen.get(letter, 0) + 1
    gone = None
    if letter == "B" or letter == "D" and seen[letter] == 2:
        gone = "".join(x for _, x in history.clear())
    if letter == "F" and seen[letter] == 1:
        history.backtrack(3)
    run.emit(letter, state + 1, gone)
    return state + 1


GOLDEN = replay.Operator(_golden, "letter string, counter long, cleared string", most=6)
SEEN = "ABCDEFCDEFGH"


def check(rows):
    rows = sorted(rows, key=lambda r: r.step)
    assert [r.step for r in rows] == list(range(12)) and "".join(r.letter for r in rows) == SEEN
    assert [r.cleared for r in rows if r.cleared is not None] == ["A", "BC"] and rows[-1].counter == 8


def letters(spark):
    rows = [(k, i, x) for k in (1, 2, None) for i, x in enumerate("ABCDEFGH")]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "key long, place long, letter string")


def test_golden_sequence_over_a_table(spark):
    rows = replay.replayed(letters(spark), "key", "place", GOLDEN, "letter").collect()
    for key in (1, 2, None):
        check([r for r in rows if r.key == key])


@pytest.mark.parametrize("files", [1, 3, 8])
def test_golden_sequence_as_a_stream(spark, files):
    with state_store(spark):
        rows = run_stream(replay.replay_stream(as_stream(letters(spark).where("key IS NOT NULL").repartition(files, "place")), "key", "place", GOLDEN, "letter"), 2).collect()
    for key in (1, 2):
        check([r for r in rows if r.key == key])


def _sums(state, row, history, run):
    """Goes back one at every tenth row, once; keeps nothing of what it emitted."""
    place, value = row
    if place % 10 == 9 and place not in run.memory and len(history):
        run.memory[place] = True
        history.backtrack(1)
    run.emit(place, None if value is None else state + value)
    return state + (value or 0.0)


def test_batch_equals_stream_over_events(spark):
    operator = replay.Operator(_sums, "frame_num long, total double", most=3, start=float)
    frames = event_frames(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), chunk=None)
    batch = replay.replayed(frames, "video_id", "frame_num", operator, "value")
    with state_store(spark):
        stream = run_stream(replay.replay_stream(as_stream(frames.repartition(3, "frame_num")), "video_id", "frame_num", operator, "value"), STATE_PARTITIONS)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_history_is_bounded():
    run = replay.Run(replay.Operator(lambda s, row, h, r: s, "x long", most=5))
    for i in range(10_000):
        run.feed((i,))
    assert len(run.history.items) <= 5 and len(run.held()) < 500


def test_nothing(spark):
    assert replay.replayed(letters(spark).limit(0), "key", "place", GOLDEN, "letter").count() == 0
