import math
import random

import pytest

from frostline.operators.backtracking import run_with_backtracking
from frostline.operators.matcher import ChainMatcher, blend
from frostline.params import REPAIR, VALIDATE, MatcherParams


def test_golden_replay():
    seen, cleared, done = [], [], set()

    def body(count, item, history):
        seen.append(item)
        if item == "B":
            cleared.append(history.clear())
        elif item == "F" and "F" not in done:
            done.add("F")
            history.backtrack(3)
        elif item == "D" and seen.count("D") == 2:
            cleared.append(history.clear())
        return count + 1

    assert run_with_backtracking("ABCDEFGH", 0, body, most=6) == 8
    assert "".join(seen) == "ABCDEFCDEFGH"
    assert cleared == [["A"], ["B", "C"]]


@pytest.mark.parametrize("n", [0, 3])
def test_going_back_too_far(n):
    with pytest.raises(ValueError, match="go back"):
        run_with_backtracking("AB", 0, lambda s, item, history: history.backtrack(n) if item == "B" else s)


def run(motions, params=REPAIR):
    """motions of frames from 1 on; None for a duplicate."""
    matcher, steps = ChainMatcher(params), []
    steps += matcher.feed((0, 0.0, None, None, None))
    for i, m in enumerate(motions, 1):
        steps += matcher.feed((i, i / 60, 0.0 if m is None else 1.0, m or 0.0, 0.0 if m is None else 1.0))
    chains = [(s["frames"], s["frame_num"], s["state"], s["n_additional"], round(s["chain_motion"], 3)) for s in steps if s["outcome"] == "Ok"]
    return [s["frame_num"] for s in steps if s["outcome"] == "FailDuplicate"], chains


D = None
TRACES = {
    "one duplicate": ([D, 2, 1, 1], [5], [([4, 5], 6, "Find", 0, 2.0)]),
    "enough motion": ([D, D, 3, 1, 1], [5, 6], [([4, 5, 6], 7, "Find", 0, 3.0)]),
    "compensation": ([D, D, 0.5, 1, 1, 1, 1], [5, 6], [(list(range(4, 11)), 11, "Compensate", 4, 4.5)]),
    "replay succeeds": ([D, D, 0.9, 9, 1, 1, 1], [5, 6], [([4, 5, 6], 7, "Failed", 0, 0.9)]),
    "replay gives up": ([D, D, 0.2, 9, 1, 1, 1], [5, 6], []),
    "freeze of 15": ([D] * 15 + [3, 1, 1], [*range(5, 18), 19], [([18, 19], 20, "Find", 0, 3.0)]),
    "freeze of 12": ([D] * 12 + [7.2] + [1] * 8, list(range(5, 17)), [(list(range(4, 17)), 17, "Failed", 0, 7.2)]),
    "duplicate while adding": ([D, D, 0.3, D, 9, 1, 1, 1], [5, 6, 8, 8], []),
}


@pytest.mark.parametrize("name", TRACES)
def test_traces(name):
    rest, duplicates, chains = TRACES[name]
    assert run([1, 1, 1, 1, *rest]) == (duplicates, chains)


def test_open_at_the_end():
    assert run([1, 1, 1, D, D, D]) == ([4, 5, 6], [])


def test_freeze_at_the_start():
    assert run([D, D, 1, 1, 1]) == ([1, 2], [])


def by_position(rows, p):
    """The rules again, by position in a list: (frame, length, outcome) of each step."""
    pos = h = n = 0
    v, state, kept, out = (0.0, None, None), "Find", {}, []
    while pos < len(rows):
        kept[pos] = v
        cm, recent, slow = v
        motion, conf = rows[pos]
        length = pos - h
        if length == 0 or motion is None or not math.isfinite(motion):
            out.append((pos, length, "NoScore"))
            state, n, h, pos = "Find", 0, pos, pos + 1
            continue
        cm += motion
        if length > p.max_duplicates + 1:
            o = "FailLong"
        elif 1 - conf >= p.min_duplicate_confidence:
            o = "FailDuplicate"
        elif length < p.min_duplicates:
            o = "FailShort"
        else:
            need = (recent or 0) * (length - 1) * (p.motion_compensate_threshold * (p.mul_motion_compensate_threshold_retry if state == "Failed" else 1))
            if length > p.motion_compensate_start and cm < need:
                o = "CompensationRequired"
            else:
                o = "FailTooMuchMotion" if cm > (slow or 0) * p.max_motion_mul else "Ok"
        out.append((pos, length, o))
        if o == "FailDuplicate":
            v, pos = (cm, recent, slow), pos + 1
            continue
        slow = blend(p.slow_motion_mean_alpha, slow, motion)
        if o == "CompensationRequired" and state != "Failed":
            state, n, v, pos = "Compensate", n + 1, (cm, recent, slow), pos + 1
        elif o in ("FailLong", "FailTooMuchMotion") and state == "Compensate":
            pos, state, n = pos - n, "Failed", 0
            v = kept[pos]
        else:
            v, state, n, h, pos = (0.0, blend(p.recent_motion_mean_alpha, recent, motion), slow), "Find", 0, pos, pos + 1
    return out


@pytest.mark.parametrize("params", [REPAIR, VALIDATE, MatcherParams(max_duplicates=3, min_duplicates=3)])
def test_random_sequences(params):
    rng = random.Random(5)
    for _ in range(400):
        rows = [(None, None)]
        for _ in range(rng.randint(0, 60)):
            dup = rng.random() < 0.5
            rows.append((float("nan") if rng.random() < 0.02 else 0.0 if dup else rng.choice([0.2, 0.9, 1.0, 3.0, 9.0]), 0.0 if dup else 1.0))
        matcher, got = ChainMatcher(params), []
        for i, (m, c) in enumerate(rows):
            got += [(s["frame_num"], s["len"], s["outcome"]) for s in matcher.feed((i, i / 60, c, m, c))]
        assert got == by_position(rows, params)


@pytest.mark.parametrize("per_batch", [1, 3])
def test_stream_equals_batch(spark, tmp_path, per_batch):
    from frostline.operators.matcher import match_steps
    from frostline.sources.frames import event_scores
    from frostline.streaming.matching import match_stream

    scores = event_scores(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("video_id < 5")
    want = {tuple(r) for r in match_steps(scores).select("video_id", "step", "frame_num", "outcome", "chain_i").collect()}
    folder = str(tmp_path / "in")
    scores.repartition(5, "frame_num").write.parquet(folder)  # files mix frames of all videos, out of order
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    name = f"steps_{per_batch}"
    query = match_stream(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {tuple(r) for r in spark.table(name).select("video_id", "step", "frame_num", "outcome", "chain_i").collect()}
    assert got == want


def test_release_in_order(spark, tmp_path):
    from frostline.streaming.matching import release_stream

    schema = "video_id long, chain_i long, out string"
    for part in ([(1, 2, "c"), (1, 1, "b")], [(1, 0, "a"), (2, 1, "y")], [(2, 0, "x")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = release_stream(stream).writeStream.format("memory").queryName("released").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert [r.out for r in spark.table("released").collect() if r.video_id == 1] == ["a", "b", "c"]
    assert [r.out for r in spark.table("released").collect() if r.video_id == 2] == ["x", "y"]
