import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frostline.functions import png
from frostline.sources import images, raw
from frostline.sources.commit import HIDDEN
from frostline.sources.frames import read_images

PUSH = "spark.sql.python.filterPushdown.enabled"


def picture(rng, width, height, channels=3):
    return rng.integers(0, 256, (height, width, channels), dtype=np.uint8).tobytes()


@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3]), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(width, height, channels, seed):
    pixels = picture(np.random.default_rng(seed), width, height, channels)
    assert png.decode(png.encode(pixels, width, height)) == (width, height, pixels)


def filtered(pixels, kinds, width, channels):
    """Rows of pixels after the format's filters, byte by byte."""
    rows, out, above = np.frombuffer(pixels, np.uint8).reshape(len(kinds), -1).tolist(), b"", [0] * (width * channels)
    for kind, row in zip(kinds, rows, strict=True):
        left, corner = [0] * channels + row, [0] * channels + above
        guess = []
        for i, up in enumerate(above):
            a, c = left[i], corner[i]
            p = a + up - c
            near = min((abs(p - a), 0, a), (abs(p - up), 1, up), (abs(p - c), 2, c))[2]
            guess.append((0, a, up, (a + up) // 2, near)[kind])
        out += bytes([kind]) + bytes((x - g) & 255 for x, g in zip(row, guess, strict=True))
        above = row
    return out


@pytest.mark.parametrize("channels", [1, 3])
def test_png_of_all_filters_is_read(channels):
    import struct
    import zlib

    width, kinds = 7, [0, 1, 2, 3, 4, 4, 3, 2, 1]
    pixels = picture(np.random.default_rng(3), width, len(kinds), channels)
    head = struct.pack(">IIBBBBB", width, len(kinds), 8, png.COLOUR[channels], 0, 0, 0)
    body = zlib.compress(filtered(pixels, kinds, width, channels))
    data = png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"tEXt", b"x") + png._chunk(b"IDAT", body[:9]) + png._chunk(b"IDAT", body[9:]) + png._chunk(b"IEND", b"")
    assert png.decode(data) == (width, len(kinds), pixels)


def test_odd_png_files_are_errors():
    good = png.encode(b"abc", 3, 1)
    for bad in (b"", b"GIF89a", good[:30] + b"x" + good[31:]):
        with pytest.raises(ValueError):
            png.decode(bad)
    with pytest.raises(ValueError, match="no picture"):
        png.encode(b"ab", 3, 1)


def test_pictures_are_written_and_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"chain_{i}/{n}.png", 4, 3, picture(rng, 4, 3, c), "x") for i in range(4) for n, c in (("0.webp", 3), ("1.webp", 1))]
    df = spark.createDataFrame(rows, "name string, width int, height int, data binary, path string")
    images.write_pictures(df.repartition(3), str(tmp_path / "out"))
    found = images.read_pictures(spark, str(tmp_path / "out"))
    assert sorted((r.name, r.width, r.height, bytes(r.data)) for r in found.collect()) == sorted(r[:4] for r in rows)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(HIDDEN)]
    assert read_images(spark, f"file://{tmp_path}/out").count() == 8


def test_frame_names_below_segments(spark, tmp_path):
    df = spark.createDataFrame([(f"seg/{n:05}.png", 1, 1, bytes([n])) for n in (3, 12)], "name string, width int, height int, data binary")
    images.write_pictures(df, str(tmp_path / "out"))
    assert sorted((r.segment, r.frame_num) for r in read_images(spark, f"file://{tmp_path}/out").collect()) == [("seg", 3), ("seg", 12)]


@pytest.mark.parametrize("bad", [("../up.png", 1, 1, b"a"), ("ok9.png", 2, 1, b"a"), ("ok1.png", 1, 1, b"a")])
def test_a_failed_write_leaves_no_file(spark, tmp_path, bad):
    rows = [(f"ok{i}.png", 1, 1, b"a") for i in range(6)] + [bad]
    with pytest.raises(Exception, match="below the target|no picture|written twice"):
        images.write_pictures(spark.createDataFrame(rows, "name string, width int, height int, data binary").repartition(3), str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def frames_table(spark, n=40, width=3, height=2):
    rng = np.random.default_rng(2)
    rows = [(v, i, picture(rng, width, height)) for v in (4, 7) for i in range(n)]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "video_id long, frame_num long, data binary")


def test_raw_frames_are_written_and_read(spark, tmp_path):
    rows, df = frames_table(spark)
    raw.write_frames(df.repartition(5), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["4.rgb", "7.rgb"]
    found = raw.read_frames(spark, str(tmp_path / "out"), width=3, height=2, rate=20, partitionBytes=180)
    assert sorted((r.video_id, r.frame_num, bytes(r.data)) for r in found.collect()) == sorted(rows)
    assert found.rdd.getNumPartitions() == 2 * 4  # ten frames each
    assert {(r.frame_num, r.ts_s) for r in found.collect()} == {(i, i / 20) for i in range(40)}


def test_seek_reads_its_ranges_only(spark, tmp_path):
    rows, df = frames_table(spark)
    raw.write_frames(df, f"file://{tmp_path}/out")
    found = raw.seek_raw(spark, f"file://{tmp_path}/out", 0.5, 0.35, width=3, height=2, rate=20, partitionBytes=54)
    assert found.rdd.getNumPartitions() == 2 * 3  # seven frames of each video, three a task
    want = sorted((v, n - 10, d) for v, n, d in rows if 10 <= n < 17)
    assert sorted((r.video_id, r.frame_num, bytes(r.data)) for r in found.collect()) == want


def test_filters_become_ranges(spark, tmp_path):
    _, df = frames_table(spark)
    raw.write_frames(df, str(tmp_path / "out"))
    before = spark.conf.get(PUSH, None)
    spark.conf.set(PUSH, "true")
    try:
        whole = raw.read_frames(spark, str(tmp_path / "out"), width=3, height=2, rate=20, partitionBytes=18)
        for condition, n in (("frame_num >= 10 AND frame_num < 14", 4), ("frame_num = 39", 1), ("frame_num > 38", 1), ("ts_s >= 1.0 AND ts_s <= 1.1", 3), ("ts_s > 100", 0), ("frame_num < 0", 0)):
            part = whole.where(condition)
            assert part.count() == 2 * n and part.rdd.getNumPartitions() <= 2 * (n + 2) + 1, condition
    finally:
        spark.conf.unset(PUSH) if before is None else spark.conf.set(PUSH, before)


def test_frames_with_gaps_are_not_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, b"abc"), (1, 2, b"abc")], "video_id long, frame_num long, data binary")
    with pytest.raises(Exception, match="should be"):
        raw.write_frames(df, str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_y4m_files_are_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    planes = {"444": 3 * 15, "420jpeg": 15 + 2 * 6, "mono": 15}
    for i, (kind, size) in enumerate(planes.items()):
        body = [rng.integers(16, 236, size, dtype=np.uint8).tobytes() for _ in range(3)]
        (tmp_path / f"{i}.y4m").write_bytes(f"YUV4MPEG2 W5 H3 F30000:1001 Ip A1:1 C{kind}\n".encode() + b"".join(b"FRAME\n" + b for b in body) + b"FRAME\ncut")
    found = raw.read_frames(spark, str(tmp_path)).collect()
    assert sorted((r.video_id, r.frame_num) for r in found) == [(v, n) for v in range(3) for n in range(3)]
    assert all(len(r.data) == 45 and r.width == 5 and r.ts_s == pytest.approx(r.frame_num * 1001 / 30000) for r in found)
    grey = next(r for r in found if r.video_id == 2)
    pixels = np.frombuffer(grey.data, np.uint8).reshape(15, 3)
    assert (pixels[:, 0] == pixels[:, 1]).all() and (pixels[:, 1] == pixels[:, 2]).all()


def test_colours_of_y4m():
    flat = lambda y, u, v: raw.to_rgb(np.full((1, 1), y), np.full((1, 1), u), np.full((1, 1), v))[0, 0].tolist()
    assert flat(16, 128, 128) == [0, 0, 0] and flat(235, 128, 128) == [255, 255, 255]
    red = flat(81, 90, 240)  # red in studio range
    assert red[0] > 250 and red[1] < 5 and red[2] < 5


def test_odd_y4m_files_are_errors(spark, tmp_path):
    for name, head in (("a", b"RIFF"), ("b", b"YUV4MPEG2 W2 H2 C422\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.y4m").write_bytes(head)
        with pytest.raises(Exception, match="Y4M|not read"):
            raw.read_frames(spark, str(tmp_path / name)).collect()
    (tmp_path / "1.y4m").write_bytes(b"YUV4MPEG2 W2 H1 Cmono\nFRAME\nabOTHER\ncd")
    with pytest.raises(Exception, match="no frame"):
        raw.read_frames(spark, str(tmp_path / "1.y4m")).collect()


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert raw.read_frames(spark, str(tmp_path / "none"), width=1, height=1).where(F.col("frame_num") > 3).count() == 0
