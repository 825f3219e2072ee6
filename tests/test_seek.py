"""Seeking by number and by time: what is moved and held, and odd rows."""

import duckdb
import pytest

from frostline.operators import sequences
from frostline.plans import mechanisms, queries

NAN, INF = float("nan"), float("inf")

FOUND = """SELECT t.video_id, target, coalesce(min(frame_num) FILTER (round_even(ts_s * 8, 0) = target OR ts_s * 8 > target + 0.5), max(frame_num)) AS frame_num
FROM frames f JOIN targets t ON f.video_id IS NOT DISTINCT FROM t.video_id GROUP BY t.video_id, target"""


def _rows(found):
    return sorted(((r.video_id, r.target, r.frame_num) for r in found.collect()), key=str)


@pytest.mark.parametrize("query", [mechanisms.seek_time, queries.seek_frame])
def test_nothing_that_grows_is_broadcast(spark, query):
    """Files of targets are far smaller than what is made of them to be broadcast."""
    found = query(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    found.collect()


@pytest.mark.parametrize("chunk", [None, 2, 1 << 20])
def test_odd_times(spark, chunk):
    """A video of no number, frames without times, times that are no numbers or fall: as the SQL says."""
    times = {
        1: [0.0, 1.5, 2.5, 2.75, 3.25, 6.0, 6.5],
        2: [0.0, None, 2.5, None],
        3: [None, None],
        4: [0.0, NAN, 2.0, 3.0],
        5: [0.5, 1.5, 2.5, INF],
        6: [4.0, 1.0, 3.5, 0.5, 2.0],
        7: [2.5] * 5,
        None: [0.0, 2.5, 4.5],
    }
    frames = [(v, n, None if q is None else q / 8) for v, many in times.items() for n, q in enumerate(many)]
    targets = [(v, t) for v in times for t in range(-1, 9)]
    con = duckdb.connect()
    con.sql("CREATE TABLE frames (video_id BIGINT, frame_num BIGINT, ts_s DOUBLE)")
    con.sql("CREATE TABLE targets (video_id BIGINT, target BIGINT)")
    con.executemany("INSERT INTO frames VALUES (?, ?, ?)", frames)
    con.executemany("INSERT INTO targets VALUES (?, ?)", targets)
    want = sorted(con.sql(FOUND).fetchall(), key=str)
    frames = spark.createDataFrame(frames, "video_id long, frame_num long, ts_s double")
    targets = spark.createDataFrame(targets, "video_id long, target long")
    assert _rows(sequences.seek_times(frames, targets, 8.0, chunk)) == want


@pytest.mark.parametrize("chunk", [None, 2])
def test_targets_that_repeat_and_videos_without_frames(spark, chunk):
    frames = spark.createDataFrame([(1, 3, 3.0), (1, 5, 5.0), (None, 4, 4.0)], "video_id long, frame_num long, ts_s double")
    targets = spark.createDataFrame([(1, 4), (1, 4), (1, 9), (2, 4), (None, 9), (1, None)], "video_id long, target long")
    assert _rows(sequences.seek_times(frames, targets, 1.0, chunk)) == sorted([(1, 4, 5), (1, 4, 5), (1, 9, 5), (None, 9, 4)], key=str)
    assert _rows(sequences.seek_frames(frames, targets, chunk)) == sorted([(1, 4, 5), (1, 4, 5), (1, 9, 5), (2, 4, None), (None, 9, 4)], key=str)
