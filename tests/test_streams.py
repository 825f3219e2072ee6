import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frostline.operators.patching import completed, release_order
from frostline.sources.staging import as_stream, run_stream, shared_path, state_store
from frostline.streaming import lookup, patience

JOBS = "video_id long, chain_i long, key string, out string"
DONE = "video_id long, key string, done_at long"
BEGIN = datetime(2024, 1, 1, tzinfo=UTC)


def in_steps(spark, parts, schema):
    """A stream that comes in batches of these rows, one after the other."""
    path = shared_path(spark)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files go by their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def cut(rows, n, rng):
    rows = rng.sample(rows, len(rows))
    edges = [0, *sorted(rng.sample(range(1, len(rows)), n - 1)), len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def tables(rng):
    jobs = [(v, i, f"{v}-{i}", f"out{i}") for v in (1, 2) for i in range(12)]
    done = [(v, k, rng.randint(0, 99)) for v, i, k, _ in jobs if (v, i) != (2, 7)] + [(1, "none", 5), (3, "1-0", 6)]
    return jobs, done


@pytest.mark.parametrize("seed", range(2))
def test_look_up_of_any_cut_is_the_batch_result(spark, seed):
    rng = random.Random(seed)
    jobs, done = tables(rng)
    with state_store(spark):
        found = run_stream(lookup.release_done(in_steps(spark, cut(jobs, 3, rng), JOBS), in_steps(spark, cut(done, 4, rng), DONE)), 2).collect()
    times = {(v, k): t for v, k, t in done}
    want = []
    for v in (1, 2):
        latest = 0
        for _, i, key, out in (j for j in jobs if j[0] == v):
            if (v, key) not in times:
                break
            latest = max(latest, times[v, key])
            want.append((v, i, out, times[v, key], latest))
    assert sorted(map(tuple, found)) == want


def test_look_up_agrees_with_the_batch_operators(spark):
    done = spark.createDataFrame([(f"{i}-{i + 1}-o{i}", (i * 7) % 10) for i in range(10)], "key string, done_at long")
    jobs = spark.createDataFrame([(1, i, str(i), str(i + 1), f"o{i}") for i in range(10)], "video_id long, chain_i long, in0 string, in1 string, out string")
    batch = release_order(completed(jobs, done), chunk=None).select("video_id", "chain_i", "out", "done_at", "released_at")
    keyed = jobs.select("video_id", "chain_i", F.concat_ws("-", "in0", "in1", "out").alias("key"), "out")
    with state_store(spark):
        stream = run_stream(lookup.release_done(as_stream(keyed.repartition(3)), as_stream(done.select(F.lit(1).cast("long").alias("video_id"), "key", "done_at").repartition(2))), 2)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


FRAMES = "video_id long, frame_num long, ts timestamp, late string, value double"


def frame(n, minute, video=1):
    return (video, n, BEGIN + timedelta(minutes=minute), "x", float(n))


def given_up(spark, parts, patience_min=10, delay="5 minutes"):
    """What comes out, and the stream's progress, from rows in these batches."""
    rows = in_steps(spark, parts, FRAMES).drop("late")
    out, before = shared_path(spark), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        with state_store(spark):
            stream = patience.in_order_or_given_up(rows, "video_id", "frame_num", "ts", delay, patience_min * 60_000)
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark)).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = [(r.frame_num, r.missing, r.late) for r in spark.read.schema(stream.schema).parquet(out).collect()]
    return sorted(found), query.recentProgress


def test_a_missing_number_is_given_up_and_the_state_is_empty(spark):
    rows = [frame(n, n) for n in range(40) if n not in (3, 9, 10)]
    found, progress = given_up(spark, [rows[:20], rows[20:], [frame(40, 60)]])
    assert found == [(n, {4: 1, 11: 2}.get(n, 0), False) for n in range(41) if n not in (3, 9, 10)]
    left = progress[-1]["stateOperators"][0]
    assert left["numRowsTotal"] <= 3  # the next number, and nothing that waits


def test_what_still_waits_is_not_put_out(spark):
    rows = [frame(n, n) for n in range(30) if n != 25]
    found, _ = given_up(spark, [rows])
    assert found == [(n, 0, False) for n in range(25)]


def test_a_row_in_time_fills_its_gap(spark):
    found, _ = given_up(spark, [[frame(0, 0), frame(2, 2), frame(3, 3)], [frame(1, 1)], [frame(4, 40)]])
    assert found == [(n, 0, False) for n in range(5)]


def test_late_rows_are_counted(spark):
    early = [frame(n, n) for n in range(12) if n != 1]
    far = [frame(n, 30 + n) for n in range(12, 14)]
    # 1 has been given up when it comes: behind the watermark Spark counts it; with a time before it, it is told as late
    found, progress = given_up(spark, [early, far, [frame(1, 1)], [frame(1, 50)], [frame(14, 90)]])
    assert [f for f in found if f[2]] == [(1, 0, True)]
    assert [f[:2] for f in found if not f[2]] == [(n, int(n == 2)) for n in range(15) if n != 1]
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1


def test_keys_wait_for_themselves(spark):
    found, _ = given_up(spark, [[frame(0, 0), frame(2, 2), frame(0, 0, 2), frame(1, 1, 2)], [frame(3, 30), frame(2, 31, 2)], [frame(3, 60, 2)]])
    assert found == sorted([(0, 0, False), (2, 1, False), (3, 0, False), (0, 0, False), (1, 0, False), (2, 0, False), (3, 0, False)])
