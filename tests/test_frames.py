import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.functions import losses as L
from frostline.functions import pixels as P
from frostline.functions import text as T
from frostline.operators import datasets, faults, features, logs, matcher, patching, scoring, sequences
from frostline.sources import frames as S


def test_finite_leaves_out_null_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    assert [r.f for r in df.select(S.finite(F.col("x")).alias("f")).collect()] == [True, False, False, False]


def test_lag_files(spark, tmp_path):
    lags = spark.createDataFrame([(9, 2), (3, 1)], "start long, length long")
    S.write_lags(lags, str(tmp_path / "lags"))
    assert [tuple(r) for r in S.read_lags(spark, str(tmp_path / "lags")).orderBy("start").collect()] == [(3, 1), (9, 2)]
    (tmp_path / "bad.csv").write_text("1,2\nx,3\n")
    with pytest.raises(Exception, match="MALFORMED"):
        S.read_lags(spark, str(tmp_path / "bad.csv")).collect()


def test_sample_files(spark, tmp_path):
    motion = spark.createDataFrame([("a", "b", 1.0, 0.5, 0.25)], "f0 string, f1 string, motion double, avg_flow_x double, avg_flow_y double")
    S.append_motion_samples(motion, str(tmp_path / "m"))
    S.append_motion_samples(motion, str(tmp_path / "m"))
    assert S.read_motion_samples(spark, str(tmp_path / "m")).count() == 2  # no row is taken for a header
    dup = spark.createDataFrame([("a", "b", True)], "before string, after string, different boolean")
    S.write_duplicate_samples(dup, str(tmp_path / "d"))
    assert [tuple(r) for r in S.read_duplicate_samples(spark, str(tmp_path / "d")).collect()] == [("a", "b", True)]


def test_images_are_listed_without_augmented_ones(spark, tmp_path):
    (tmp_path / "7").mkdir()
    for name in ("2.png", "1.png", "1.png_0.png", "x.txt"):
        (tmp_path / "7" / name).write_bytes(name.encode())
    rows = S.list_images(spark, str(tmp_path)).collect()
    assert [(r.segment, r.frame_num) for r in rows] == [("7", 1), ("7", 2)]
    samples = spark.createDataFrame([(rows[0].path, rows[1].path)], "before string, after string")
    found = S.images_of(samples, S.read_images(spark, str(tmp_path))).first()
    assert (bytes(found.first_data), bytes(found.second_data)) == (b"1.png", b"2.png")


def test_seek(spark):
    frames = spark.createDataFrame([(1, i, i / 60) for i in range(200)], "video_id long, frame_num long, ts_s double")
    got = S.seek(frames, 1.0, 0.5).orderBy("frame_num").collect()
    assert len(got) == 30 and got[0].frame_num == 0 and got[0].ts_s == 1.0


def test_pixels(spark):
    df = spark.createDataFrame([([255, 255, 255, 10, 20, 30, 7], [1, 2, 2, 1], [1, 3, 2, 5])], "rgb array<int>, a array<int>, b array<int>")
    r = df.select(P.grayscale(F.col("rgb")).alias("g"), P.gradient_bits(F.col("a")).alias("h"), P.hash_distance(P.gradient_bits(F.col("a")), P.gradient_bits(F.col("b")), 9).alias("d"), P.packed_distance(F.lit(7), F.lit(1)).alias("p")).first()
    assert r.g == [255, (770 + 3000 + 870) >> 8] and r.h == [1, 0, 0] and r.d == 1 / 9 and r.p == 2


def _field(number, value):
    """A field of a protocol buffer: a whole number, or bytes, text or a message."""
    varint = lambda n: bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def mean_model(path, channels):
    """An ONNX model whose output is the mean of its input [1, channels, 2, 3]."""
    axes = _field(5, _field(1, "axes") + b"".join(_field(8, a) for a in (1, 2, 3)) + _field(20, 7))
    keep = _field(5, _field(1, "keepdims") + _field(3, 0) + _field(20, 2))
    node = _field(1, "input") + _field(2, "output") + _field(4, "ReduceMean") + axes + keep
    tensor = lambda name, *dims: _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, b"".join(_field(1, _field(1, d)) for d in dims))))
    graph = _field(1, node) + _field(2, "g") + _field(11, tensor("input", 1, channels, 2, 3)) + _field(12, tensor("output", 1))
    path.write_bytes(_field(1, 8) + _field(8, _field(1, "") + _field(2, 13)) + _field(7, graph))
    return str(path)


def test_models_take_scaled_pixels(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    a, b = bytes([0, 51, 102, 153, 204, 255]), bytes([255, 0, 0, 0, 0, 0])
    pairs = spark.createDataFrame([(1, a, b, 0.1), (2, a, b, 0.9)], "frame_num long, before binary, thumb binary, distance double")
    distinct = scoring.model_scores(pairs, scoring.onnx_model(mean_model(tmp_path / "d.onnx", 2), shape=(2, 3)), 0.5)
    got = {r.frame_num: r.distinct for r in distinct.collect()}
    assert abs(got[1] - 1 / (1 + np.exp(-(3 + 1) / 12))) < 1e-6 and got[2] == 1.0
    motion = scoring.model_scores(pairs, scoring.onnx_motion(mean_model(tmp_path / "m.onnx", 1), shape=(2, 3)), float("inf"), "motion")
    assert all(abs(r.motion - (3 - 1) / 6) < 1e-6 for r in motion.collect())


def test_gate_holds_in_the_batch(spark):
    pairs = spark.createDataFrame([(1, [0.0], [1.0], 0.1), (2, [0.0], [1.0], 0.9)], "frame_num long, before array<double>, thumb array<double>, distance double")

    def load():
        def predict(a, b):
            assert len(a) == 1  # the other row doesn't reach the model
            return np.full(len(a), 0.25)

        return predict

    got = {r.frame_num: r.distinct for r in scoring.model_scores(pairs.coalesce(1), load, 0.5).collect()}
    assert got == {1: 0.25, 2: 1.0}


def test_similar_frames_first_pair(spark):
    pairs = spark.createDataFrame([(1, 0.3), (2, 0.9), (3, 0.4)], "frame_num long, distance double")
    assert sorted(r.frame_num for r in sequences.similar_frames(pairs, 0.25, 0.45).collect()) == [0, 1, 3]
    assert sorted(r.frame_num for r in sequences.similar_frames(pairs, 0.35, 0.45).collect()) == [3]


def test_patching_keeps_the_number_of_frames(spark):
    frames = spark.createDataFrame([(1, i, float(i * i)) for i in range(10)], "video_id long, frame_num long, value double")
    chains = spark.createDataFrame([(1, 0, [3, 4, 5], 6)], "video_id long, chain_i long, frames array<long>, end_frame long")
    got = {r.frame_num: r.value for r in patching.patched(frames, patching.interpolated(chains, frames)).collect()}
    assert len(got) == 10 and got[4] == 9 + (36 - 9) / 3 and got[6] == 36
    patches = patching.patch_ranges(chains)
    assert patching.overlapping(patches).count() == 0
    assert patching.overlapping(patches.unionAll(patches)).count() == 1
    jobs = patching.interpolation_jobs(chains)
    done = spark.createDataFrame([("3-6-chain_0/002.png", 5), ("other", 6)], "key string, done_at long")
    assert [r.i for r in patching.completed(jobs, done).collect()] == [2]


def test_injected_lags_keep_apart_and_are_found(spark):
    videos = spark.createDataFrame([(i, 400) for i in range(20)] + [(99, 5)], "video_id long, n_frames long")
    lags = faults.inject_lags(videos)
    rows = lags.collect()
    assert len({r.video_id for r in rows}) == 20 and all(1 <= r.length <= 8 and r.start >= 1 for r in rows)
    for v in range(20):
        own = sorted((r.start, r.length) for r in rows if r.video_id == v)
        assert all(b[0] - (a[0] + a[1]) > 1 for a, b in zip(own, own[1:], strict=False))
    got = faults.scores(faults.confusion(lags, faults.lag_frames(lags))).first()
    assert (got.precision, got.recall, got.f1_score) == (1.0, 1.0, 1.0)


def test_many_lags_are_placed_alike(spark, monkeypatch):
    videos = spark.createDataFrame([(i, 300 + 40 * i) for i in range(12)] + [(99, 5), (98, 10)], "video_id long, n_frames long")
    few = sorted(map(tuple, faults.inject_lags(videos, n_inserts=20).collect()))
    monkeypatch.setattr(faults, "FEW", 0)
    assert sorted(map(tuple, faults.inject_lags(videos, n_inserts=20).collect())) == few
    missing = {r.video_id: (r.n, r.missing) for r in faults.lag_shortfall(videos, faults.inject_lags(videos, n_inserts=20), 20).collect()}
    assert missing[99] == (0, 20) and all(n + m == 20 and m > 0 for n, m in missing.values())


def test_scores_of_nothing_are_nan(spark):
    row = faults.scores(spark.createDataFrame([(5, 0, 0, 0)], "true_negatives long, true_positives long, false_negatives long, false_positives long")).first()
    assert all(x != x for x in (row.precision, row.recall, row.f1_score))


def test_text(spark):
    r = spark.range(1).select(
        T.group(F.lit("a.png b.png 0.5 -> o/002.png done (q - 40.5%)"), T.COMPLETION, 5).alias("q"), T.group(F.lit("a b 0.5 -> c done"), T.COMPLETION, 4).alias("out"), T.group(F.lit('Processing: "x.mp4"'), T.PROCESSING, 1).alias("src"),
        T.group(F.lit('Processing: "x.mp4" to "y.mp4"'), T.PROCESSING, 2).alias("dst"), T.fraction(F.lit("30000/1001")).alias("rate"), T.fraction(F.lit("25")).alias("whole"), T.frame_name(F.lit(1234567)).alias("long"),
        T.kwargs(F.lit("a=1,b=x")).alias("kw"), T.command(F.lit("gets"), F.lit("p")).alias("cmd"),
    ).first()
    assert (r.q, r.out, r.src, r.dst, r.whole, r.long, r.cmd) == ("40.5", "c", "x.mp4", "y.mp4", 25.0, "1234567.png", "gets|p")
    assert abs(r.rate - 29.97) < 0.01 and r.kw["a"].int == 1 and r.kw["b"].str == "x"


def test_literals(spark):
    texts = ["1", "-2.5", "1e3", "True", "None", "'a b'", '"x"', "Truth", "", "1.2.3", "99999999999999999999"]
    got = [tuple(r.v) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.literal(F.col("t")).alias("v")).orderBy("i").collect()]
    none = [None] * 4
    want = [("int", 1, *none[1:]), ("float", None, -2.5, None, None), ("float", None, 1000.0, None, None), ("bool", None, None, True, None), ("none", *none)]
    want += [("str", None, None, None, t) for t in ("a b", "x", "Truth", "", "1.2.3")] + [("float", None, 1e20, None, None)]
    assert got == [(*w, None) for w in want]


def plain(v):
    """The Python value of a literal's struct."""
    if v["kind"] in ("list", "tuple"):
        return {"list": list, "tuple": tuple}[v["kind"]](plain(x) for x in v["items"])
    return None if v["kind"] == "none" else v[v["kind"]]


def test_lists_are_those_of_python(spark):
    import ast

    same = ["[1, 2]", "[]", "()", "(1,)", "(1)", "( 2.5 , 'a b' )", "[True, None, -3]", "['a,b', \"c\"]", " [1,2,] ", "[1e3]", "('x')"]
    other = ["[a, b]", "[1, [2]]", "[1", "1]", "[1 2, x]", "[,]", "(]", "['a' 'b']"]
    texts = same + other
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.literal(F.col("t")).alias("v")).orderBy("i").collect()
    assert [plain(r.v) for r in rows] == [ast.literal_eval(t.strip()) for t in same] + other


def test_arguments_and_lines(spark):
    row = spark.range(1).select(
        T.kwargs(F.lit("a=1,shape=[1, 2],b='x,y',pair=(1,2),a=3,none")).alias("k"), T.kwargs_of(F.array(F.lit("a=b=c"), F.lit("="), F.lit("a="))).alias("one"), T.kwargs_of(F.array().cast("array<string>")).alias("no"),
        T.key_values(F.lit("width=1\r\nheight=2\nwidth=3\nnothing\nodd=a=b")).alias("m"),
    ).first()
    assert {k: plain(v) for k, v in row.k.items()} == {"a": 3, "shape": [1, 2], "b": "x,y", "pair": (1, 2)}
    assert {k: plain(v) for k, v in row.one.items()} == {"": "", "a": ""} and row.no == {}
    assert row.m == {"width": "3", "height": "2", "odd": "a=b"}


def test_fixed_numbers_round_exact_values(spark):
    from decimal import ROUND_HALF_EVEN, Decimal

    rng = random.Random(2)
    values = [2.00005, 1.0005, 0.0005, 0.00015, 2.5, 1e15 + 0.5, 0.0, -0.0004, -1.0005, 123456.78905, 4e9 + 0.00005, 0.99995, 0.00005] + [rng.randint(0, 10**6) / 20000 for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.fixed(F.col("v"), 4).alias("four"), T.fixed(F.col("v"), 3).alias("three")).collect()
    for r in rows:
        for text, digits in ((r.four, 4), (r.three, 3)):
            assert text == str(Decimal(r.v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN)), (r.v, text)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double").select(T.fixed(F.col("v"), 3).alias("t")).collect()
    assert [r.t for r in odd] == ["NaN", "inf", "-inf", None]


def test_a_split_inside_one_key(spark):
    rows = spark.range(1000).select(F.lit("k").alias("k"), "id")
    split = datasets.train_validation(rows, "k")
    assert split.where("is_validation").count() == 250 and split.select("id").distinct().count() == 1000
    alike = datasets.train_validation(spark.range(40).select(F.lit("k").alias("k"), F.lit(1).alias("_row"), F.lit(2).alias("place")), "k")
    assert sorted(r.is_validation for r in alike.collect()) == [False] * 30 + [True] * 10
    some = datasets.train_validation(spark.range(999).select((F.col("id") % 3).alias("k"), "id"), "k", share=0.5)
    assert some.where("is_validation").count() == 499
    assert datasets.train_validation(rows, "k", share=1.0).where("is_validation").count() == 1000


def test_one_pass_of_python(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = sequences.ema_running(S.event_frames(events, chunk=None), 0.3, chunk=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    painted = logs.painted_frames(logs.painted_ranges(logs.parse_log(logs.log_lines(matcher.match_steps(S.event_scores(events))))))
    plan = logs.color_ranges(painted, chunk=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan


def test_colours_in_chunks_and_by_video_agree(spark):
    rng = random.Random(3)
    rows = [(v, n, rng.choice(["a", "a", "b"])) for v in (1, 2) for n in rng.sample(range(300), 200)]
    painted = spark.createDataFrame(rows, "video_id long, frame_num long, color string")
    whole, parts = (sorted(map(tuple, logs.color_ranges(painted, chunk=c).collect())) for c in (None, 7))
    assert whole == parts and sum(r[-1] - r[-2] for r in whole) == 400


def test_seek_by_time(spark):
    times = {0: 0.0, 1: 1.5, 2: 2.5, 3: 2.75, 4: 3.25, 5: 6.0, 6: 6.5}  # in frames
    frames = spark.createDataFrame([(1, n, q / 8) for n, q in times.items()], "video_id long, frame_num long, ts_s double")
    targets = spark.createDataFrame([(1, t) for t in range(9)], "video_id long, target long")
    want = {}
    for t in range(9):
        want[t] = next((n for n, q in times.items() if round(q) == t or q > t + 0.5), 6)
    for chunk in (None, 2):
        assert {r.target: r.frame_num for r in sequences.seek_times(frames, targets, 8.0, chunk).collect()} == want


def test_log_lines_as_the_program_writes_them(spark):
    """Golden lines: a chain with added frames, one after failed compensation, a run given up, and what they paint."""
    steps = [
        (1, 0, 5, 1, "Find", 0, "FailDuplicate", 0.0, 0.01, 0.2, None, None),
        (1, 1, 11, 7, "Compensate", 4, "Ok", 4.50004, 0.01236, 0.98765, 0, [i / 60 for i in range(4, 11)]),
        (1, 2, 23, 3, "Failed", 0, "Ok", 0.9, None, 1.0, 1, [20 / 60, 21 / 60, 22 / 60]),
        (1, 3, 45, 14, "Find", 0, "FailLong", 0.0, 0.0, 0.0, None, None),
        (1, 4, 60, 3, "Failed", 0, "CompensationRequired", 0.0, 0.0, 1.0, None, None),
        (1, 5, 70, 3, "Compensate", 2, "FailTooMuchMotion", 0.0, 0.0, 1.0, None, None),
        (1, 6, 72, 1, "Find", 0, "FailShort", 0.0, 0.0, 1.0, None, None),
    ]
    schema = "video_id long, step long, frame_num long, len int, state string, n_additional int, outcome string, chain_motion double, diff double, end_conf double, chain_i long, timestamps array<double>"
    lines = logs.log_lines(spark.createDataFrame(steps, schema))
    assert [r.line for r in lines.orderBy("step").collect()] == [
        "[DEBUG] Found duplicate at #5",
        "[INFO] Duplicate chain 0 found #4-#10, length: 7, diff: 0.0124, end_conf: 0.9877, chain_motion: 4.5000, state: CompensateMotion { n_additional: 4 } at 0.067s",
        "[INFO] Duplicate chain 1 found #20-#22, length: 3, diff: 0.0000, end_conf: 1.0000, chain_motion: 0.9000, state: FailedCompensate at 0.333s",
        "[DEBUG] Skipping duplicate chain #31-#45: #FailLong, state: FindDuplicate",
        "[DEBUG] Skipping duplicate chain #57-#60: #CompensationRequired, state: FailedCompensate",
    ]
    ranges = logs.color_ranges(logs.painted_frames(logs.painted_ranges(logs.parse_log(lines)))).orderBy("start").collect()
    assert [(r.color, r.start, r.stop) for r in ranges] == [("replaced", 5, 7), ("additional", 7, 10), ("failed", 21, 23), ("skipped", 32, 45), ("skipped", 58, 60)]


def test_colours_by_rank(spark):
    colors = ["duplicate", "skipped", "failed", "additional", "replaced"]
    rows = [(1, i, 9, c) for i, c in enumerate(colors)]
    painted = logs.painted_frames(spark.createDataFrame(rows, "video_id long, start long, stop long, color string"))
    assert [r.color for r in painted.orderBy("frame_num").collect()] == [*colors, *["replaced"] * 4]


def test_other_log_lines_are_read_too(spark):
    line = "[INFO] Duplicate chain 3 found #4-#10, length: 7, score: 1, chain_motion: 4.500, state: FindDuplicate"
    row = logs.parse_log(spark.createDataFrame([(1, 0, line)], "video_id long, step long, line string")).first()
    assert (row.chain_i, row.length, row.chain_motion, row.state, row["diff"], row.at_s) == (3, 7, 4.5, "FindDuplicate", None, None)


def test_lags_by_video(spark, tmp_path):
    lags = spark.createDataFrame([(7, 9, 2), (7, 3, 1), (8, 1, 1)], "video_id long, start long, length long")
    S.write_video_lags(lags, str(tmp_path / "lags"))
    back = S.read_video_lags(spark, str(tmp_path / "lags"))
    assert sorted(map(tuple, back.collect())) == [(7, 3, 1), (7, 9, 2), (8, 1, 1)]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "12.lags.csv").write_text("4,2\n")
    assert [tuple(r) for r in S.read_video_lags(spark, str(tmp_path / "files")).collect()] == [(12, 4, 2)]
    assert faults.confusion(back, faults.lag_frames(lags)).count() == 2


def test_history_and_averages_in_chunks(spark):
    frames = spark.createDataFrame([(v, i, float((i * 7 + v) % 5)) for v in (1, 2) for i in range(23)], "video_id long, frame_num long, value double")
    for r in sequences.history(frames, 3, chunk=5).collect():
        assert r.before == list(range(max(0, r.frame_num - 3), r.frame_num))
    assert sequences.history(frames, 3, chunk=5).count() == 46
    whole, parts = ({(r.video_id, r.frame_num): r.ema for r in sequences.ema_running(frames, 0.3, chunk=c).collect()} for c in (None, 4))
    ema = None
    for i in range(23):
        x = float((i * 7 + 1) % 5)
        ema = x if ema is None else 0.3 * x + 0.7 * ema
        assert abs(whole[1, i] - ema) < 1e-12 and abs(parts[1, i] - ema) < 1e-12
    assert len(parts) == 46
    targets = spark.createDataFrame([(1, t) for t in (0, 4, 22, 23, 99)], "video_id long, target long")
    gaps = frames.where("frame_num % 3 = 1")
    for chunk in (None, 6):
        assert {r.target: r.frame_num for r in sequences.seek_frames(gaps, targets, chunk).collect()} == {0: 1, 4: 4, 22: 22, 23: 22, 99: 22}


def test_boundary_frames(spark):
    frames = spark.createDataFrame([(1, i, bytes([i])) for i in range(10)], "video_id long, frame_num long, data binary")
    chains = spark.createDataFrame([(1, 0, [3, 4, 5], 6)], "video_id long, chain_i long, frames array<long>, end_frame long")
    rows = sequences.boundary_frames(chains, frames).orderBy("name").collect()
    assert [(r.name, r.frame_num, bytes(r.data)) for r in rows] == [("0.webp", 3, b"\x03"), ("1.webp", 6, b"\x06")]


def test_many_freezes(spark):
    videos = spark.createDataFrame([(1, 100_000)], "video_id long, n_frames long")
    assert faults.inject_lags(videos, n_inserts=60).count() == 60


def test_picture_variations(spark):
    rng = np.random.default_rng(3)
    picture = np.clip(np.cumsum(rng.normal(0, 4, (36, 64)), axis=1) + 128, 0, 255).astype(np.uint8)
    small = features.Augmentation(resolutions=((128, 72),))
    images = spark.createDataFrame([("7/00001.png", 64, 36, picture.tobytes())], "path string, width int, height int, data binary")
    rows = features.picture_variations(images, 3, params=small).collect()
    assert [r.path for r in rows] == [f"7/00001.png_{i}.png" for i in range(3)]
    for r in rows:
        change = np.abs(np.frombuffer(r.data, np.uint8).astype(int).reshape(36, 64) - picture)
        assert 0 < change.mean() < 12
    assert rows == features.picture_variations(images, 3, params=small).collect()
    assert np.abs(features.jpeg_round_trip(picture, 95).astype(int) - picture).mean() < np.abs(features.jpeg_round_trip(picture, 10).astype(int) - picture).mean() < 20
    assert (features.jpeg_round_trip(np.full((9, 17), 78, np.uint8), 50) == 78).all()


def test_split_is_exact(spark):
    rows = spark.range(1001).withColumnRenamed("id", "k")
    assert datasets.train_validation(rows, "k").where("is_validation").count() == 250
    assert datasets.train_validation(rows.limit(0), "k").count() == 0
    assert datasets.train_validation(rows.limit(3), "k").where("is_validation").count() == 0


def test_variations(spark):
    images = spark.createDataFrame([("a.png", [1.0, 250.0])], "path string, thumb array<double>")
    got = datasets.variations(images).collect()
    assert [r.path for r in got] == ["a.png_0.png", "a.png_1.png", "a.png_2.png"] and all(0 <= x <= 255 for r in got for x in r.thumb)
    assert datasets.variations(images).collect() == got


def test_losses(spark):
    r = spark.range(1).select(L.smooth_l1(F.lit(1.0), F.lit(1.5)).alias("near"), L.smooth_l1(F.lit(1.0), F.lit(3.0)).alias("far"), L.motion_target(F.lit(0.0), F.lit(3.0), F.lit(4.0)).alias("still"), L.motion_target(F.lit(1.0), F.lit(3.0), F.lit(4.0)).alias("moving"), L.denormalised(F.lit(-9.0), F.lit(1.0), F.lit(2.0)).alias("relu")).first()
    assert r.near == pytest.approx(0.125 / 0.65) and r.far == pytest.approx(2 - 0.325) and r.still == 0 and r.moving == pytest.approx(1.8) and r.relu == 0


def test_features_of_frames(spark):
    from frostline.operators import features

    rng = np.random.default_rng(0)
    picture = rng.integers(0, 256, (140, 210, 3), dtype=np.uint8)
    darker = (picture * 0.98).astype(np.uint8)
    rows = [(1, i, i / 60, 210, 140, bytearray(x.tobytes())) for i, x in enumerate((picture, darker, picture[:, ::-1]))]
    frames = spark.createDataFrame(rows, "video_id long, frame_num long, ts_s double, width int, height int, data binary")
    got = features.frame_features(frames).orderBy("frame_num").collect()
    assert got[0].hash_width == 3 and len(got[0].hash) == 3 * 2 and len(got[0].thumb) == 320 * 180
    assert got[0].hash == got[1].hash and got[0].hash != got[2].hash
    flat = np.full((90, 160), 77, np.uint8)
    assert (features.resize(flat, 320, 180) == 77).all() and (features.resize(flat, 7, 3) == 77).all()
    ramp = np.tile(np.arange(0, 250, 10, dtype=np.uint8), (5, 1))
    assert features.gradient_hash(ramp, 5, 2).all() and not features.gradient_hash(ramp[:, ::-1], 5, 2).any()
    assert features.luma(bytes([255, 255, 255, 10, 20, 30]), 2, 1).tolist() == [[255, (770 + 3000 + 870) >> 8]]


def test_rates_and_log(spark, tmp_path):
    r = spark.range(1).select(S.frame_rate(F.lit(0.0), F.lit(None).cast("double")).alias("a"), S.frame_rate(F.lit(0.0), F.lit(25.0)).alias("b"), S.frame_index(F.lit(5), F.lit(0.5), F.lit(1.0)).alias("c"), S.frame_index(F.lit(-5), F.lit(0.5), F.lit(1.0)).alias("d")).first()
    assert tuple(r) == (60.0, 25.0, 2, 0)
    S.write_log(spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "video_id long, step long, line string"), str(tmp_path / "log"))
    assert [x.value for x in S.read_log(spark, str(tmp_path / "log")).collect()] == ["a", "b"]
