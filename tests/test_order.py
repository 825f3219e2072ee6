import random
import re

from pyspark.sql import functions as F

from frostline.sources.order import numbered, running_max


def test_chunks_agree_with_one_pass(spark):
    rng = random.Random(1)
    rows = [(k, o, rng.choice([None, rng.randint(0, 50)])) for k in (1, 2, None) for o in rng.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "key long, at long, x int")
    own = {k: sorted((o, x) for kk, o, x in rows if kk == k) for k in (1, 2, None)}
    for r in numbered(df, "key", "at", "place", before=("x",), chunk=16).collect():
        i = own[r.key].index((r.at, r.x))
        assert r.place == i and r.x_before == (own[r.key][i - 1][1] if i else None)
    for to in (0, -1):
        got = running_max(df, "key", "at", F.col("x"), "most", to=to, chunk=16).collect()
        assert len(got) == len(rows)
        for r in got:
            seen = [x for o, x in own[r.key] if x is not None and (o < r.at or to == 0 and o == r.at)]
            assert r.most == max(seen, default=None)


def test_empty(spark):
    df = spark.createDataFrame([], "key long, at long, x int")
    assert numbered(df, "key", "at", "place").count() == 0 and running_max(df, "key", "at", F.col("x"), "most").count() == 0


def test_a_large_key_is_many_tasks(spark):
    df = spark.range(1000).select((F.col("id") % 1).alias("key"), F.col("id").alias("at"))
    out = numbered(df, "key", "at", "place", chunk=10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(key#\d+L, _chunk#\d+L", plan)
    assert out.where("place <> at").count() == 0


def test_scores_in_chunks_and_by_video_agree(spark):
    from frostline.sources.frames import event_scores

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    by_video, in_chunks = (sorted(map(str, event_scores(events, chunk=c).collect())) for c in (None, 7))
    assert by_video == in_chunks
