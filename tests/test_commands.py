from pyspark.sql import functions as F

from frostline.__main__ import main
from frostline.functions import pixels as P
from frostline.functions import text as T
from frostline.sources.frames import append_motion_samples, event_frames, event_scores, read_duplicate_samples
from frostline.sources.images import read_pictures

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_commands(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    at = {n: str(tmp_path / n) for n in ("scores", "frames", "found", "fixed", "lagged", "rated", "pairs", "similar", "view")}
    event_scores(events).write.parquet(at["scores"])
    event_frames(events).write.parquet(at["frames"])
    main(["find", at["scores"], at["found"]])
    assert spark.read.parquet(at["found"] + "/chains").count() == 145
    main(["find", at["scores"], at["found"], "--max-motion-mul", "0.0"])
    assert spark.read.parquet(at["found"] + "/chains").count() < 145
    main(["fix", at["frames"], at["scores"], at["fixed"]])
    fixed = spark.read.parquet(at["fixed"] + "/frames")
    assert fixed.count() == 1000 and fixed.where("is_patched").count() > 100
    main(["insert-lags", at["frames"], at["lagged"], "--inserts", "2"])
    assert spark.read.parquet(at["lagged"] + "/lags").groupBy("video_id").count().agg(F.max("count")).first()[0] == 2
    main(["validate", at["scores"], at["lagged"] + "/lags", at["rated"]])
    assert 0 < spark.read.parquet(at["rated"] + "/all").first().recall < 1
    spark.createDataFrame([(1, 0.005), (2, 0.5)], "frame_num long, distance double").write.parquet(at["pairs"])
    main(["extract-similar", at["pairs"], at["similar"], "--max", "0.01"])
    assert sorted(r.frame_num for r in spark.read.parquet(at["similar"]).collect()) == [0, 1]
    (tmp_path / "run.log").write_text("[INFO] other\n[DEBUG] Found duplicate at #5\n[INFO] Duplicate chain 0 found #4-#7, length: 4, diff: 0.0000, end_conf: 1.0000, chain_motion: 2.0000, state: FindDuplicate at 0.067s\n")
    main(["view-log", str(tmp_path / "run.log"), at["view"]])
    assert [tuple(r) for r in spark.read.parquet(at["view"]).collect()] == [(0, "replaced", 5, 8)]


def test_dataset_is_built_from_images(spark, tmp_path):
    (tmp_path / "images" / "7").mkdir(parents=True)
    for frame in range(6):
        for name in (f"{frame}.png", f"{frame}.png_0.png", f"{frame}.png_1.png"):
            (tmp_path / "images" / "7" / name).write_bytes(b"x")
    main(["build-dataset", str(tmp_path / "images"), str(tmp_path / "out")])
    parts = {n: read_duplicate_samples(spark, str(tmp_path / "out" / n)) for n in ("train", "val")}
    n = {k: v.count() for k, v in parts.items()}
    assert n["val"] == (n["train"] + n["val"]) // 4 and n["train"] + n["val"] == 5 * (2 * 3 + 1 + 7)
    assert parts["train"].where("different").count() > 0


def test_motion_samples_are_split(spark, tmp_path):
    rows = [(f"a{i}", f"b{i}", i / 7, float(i), -float(i)) for i in range(41)]
    append_motion_samples(spark.createDataFrame(rows, "f0 string, f1 string, motion double, avg_flow_x double, avg_flow_y double"), str(tmp_path / "motion"))
    main(["split-motion", str(tmp_path / "motion"), str(tmp_path / "out")])
    parts = [spark.read.option("header", True).csv(str(tmp_path / "out" / n)) for n in ("val", "train")]
    assert [p.count() for p in parts] == [10, 31] and parts[0].columns == ["f0", "f1", "motion", "avg_flow_x", "avg_flow_y"]
    assert {r.f0 for p in parts for r in p.collect()} == {r[0] for r in rows}


def test_boundary_pictures(spark, tmp_path):
    spark.createDataFrame([(1, 0, [3, 4], 5)], "video_id long, chain_i long, frames array<long>, end_frame long").write.parquet(str(tmp_path / "chains"))
    spark.createDataFrame([(1, n, 2, 1, bytes([n, n + 1])) for n in range(8)], "video_id long, frame_num long, width int, height int, data binary").write.parquet(str(tmp_path / "pictures"))
    main(["boundary-pictures", str(tmp_path / "chains"), str(tmp_path / "pictures"), str(tmp_path / "out")])
    found = {r.name: bytes(r.data) for r in read_pictures(spark, str(tmp_path / "out")).collect()}
    assert found == {"chain_0/0.webp.png": b"\x03\x04", "chain_0/1.webp.png": b"\x05\x06"}


def test_paths_and_arguments(spark):
    row = spark.range(1).select(
        T.parent(F.lit("a/b/c.png")).alias("parent"), T.parent(F.lit("c.png")).alias("top"), T.with_extension(F.lit("a.b/c.mp4"), "log").alias("log"), T.with_extension(F.lit("a.b/c"), "log").alias("none"),
        T.denied(F.array(F.lit("-y"), F.lit("-i")), ["-i"]).alias("denied"), T.denied(F.array(F.lit("-y")), ["-i"]).alias("fine"), P.direction(F.lit(0.0), F.lit(-1.0)).alias("down"), P.to_full_range(F.array(F.lit(2.0), F.lit(2.0))).alias("flat"),
    ).first()
    assert (row.parent, row.top, row.log, row.none, row.denied, row.fine, row.flat) == ("a/b", "", "a.b/c.log", "a.b/c.log", True, False, [0.0, 0.0])
    assert abs(row.down - 4.712389) < 1e-6
