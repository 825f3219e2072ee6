from pyspark.sql import functions as F

from frostline.operators import matcher, patching, sequences
from frostline.sources import bucketed
from frostline.sources.frames import event_frames, event_scores


def exchanges(df):
    """What is moved, and what stands below each move, in the plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def below_exchange(plan, name):
    """Whether a scan of the table stands below an exchange."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for i, line in enumerate(lines):
        if name in line and "Scan" in line:
            at = depth(line)
            for above in reversed(lines[:i]):
                if depth(above) < at:
                    at = depth(above)
                    if "Exchange" in above:
                        return True
    return False


def test_overlay_and_semi_join_move_no_frames(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frames = event_frames(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), chunk=None)
        stored = bucketed.stage_bucketed(frames, buckets=4)
        name = stored._jdf.queryExecution().analyzed().toString().split("frostline_")[1][:32]
        patches = spark.range(300).select((F.col("id") % 20).alias("video_id"), (F.col("id") % 15).alias("frame_num"), F.lit(1.0).alias("patch")).distinct()
        for f in (lambda x: patching.patched(x, patches), lambda x: sequences.select_frames(x, patches)):
            plan = exchanges(f(stored))
            assert not below_exchange(plan, name) and "Exchange" in plan
            assert sorted(map(tuple, f(stored).collect())) == sorted(map(tuple, f(frames).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_matcher_moves_and_sorts_nothing(spark):
    scores = event_scores(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    stored = bucketed.stage_bucketed(scores, bucketed.BY_VIDEO, 4)
    found = matcher.match_bucketed(stored)
    assert "Exchange" not in exchanges(found)
    assert sorted(map(str, found.collect())) == sorted(map(str, matcher.match_steps(scores).collect()))
