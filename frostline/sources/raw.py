"""Uncompressed video files as tables: raw RGB24, and Y4M in 4:4:4, 4:2:0 or grey.

A frame has a fixed size, so a range of frames is a range of bytes: files are read in ranges, a task each, and limits of
frame numbers or times become ranges before anything is read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .commit import HiddenFolder, Written, file_system

SCHEMA = "video_id long, frame_num long, ts_s double, width int, height int, data binary"
PUSH = "spark.sql.python.filterPushdown.enabled"
PARTITION = 64 << 20  # bytes of a file that a task reads, about
BATCH = 8 << 20
#: Words of the file format (fixed values).
MAGIC, FRAME = b"YUV4MPEG2", b"FRAME\n"


@dataclass(frozen=True)
class Layout:
    """Where the frames of a file are: the bytes of its head, of a frame with what stands before it, and what is in one."""

    width: int
    height: int
    rate: float
    kind: str  # rgb24, 444, 420, mono
    head: int = 0
    mark: int = 0

    @property
    def pixels(self) -> int:
        w, h = self.width, self.height
        return {"rgb24": 3 * w * h, "444": 3 * w * h, "420": w * h + 2 * (-(-w // 2)) * (-(-h // 2)), "mono": w * h}[self.kind]

    @property
    def size(self) -> int:
        return self.mark + self.pixels

    def rgb(self, frame: bytes) -> bytes:
        """A frame's pixels as RGB24."""
        if self.kind == "rgb24":
            return frame
        w, h = self.width, self.height
        planes = np.frombuffer(frame, np.uint8)
        y = planes[: w * h].reshape(h, w)
        if self.kind == "mono":
            return np.repeat(y[:, :, None], 3, axis=2).tobytes()
        across, down = (w, h) if self.kind == "444" else (-(-w // 2), -(-h // 2))
        u, v = planes[w * h :].reshape(2, down, across)
        if self.kind == "420":
            u, v = (c.repeat(2, axis=0)[:h].repeat(2, axis=1)[:, :w] for c in (u, v))
        return to_rgb(y, u, v).tobytes()


def to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Studio-range luma and colour differences as 8-bit RGB; the factors are those of the standard for such video."""
    light, blue, red = (y.astype(np.float64) - 16) * 255 / 219, (u.astype(np.float64) - 128) * 255 / 224, (v.astype(np.float64) - 128) * 255 / 224
    kr, kb = 0.299, 0.114
    r, b = light + 2 * (1 - kr) * red, light + 2 * (1 - kb) * blue
    g = (light - kr * r - kb * b) / (1 - kr - kb)
    return np.clip(np.rint(np.stack([r, g, b], axis=2)), 0, 255).astype(np.uint8)


def y4m_layout(first: bytes) -> Layout:
    """The layout that the first line of a Y4M file tells."""
    line, found, _ = first.partition(b"\n")
    if not found or not line.startswith(MAGIC):
        raise ValueError("not a Y4M file")
    told = {word[:1]: word[1:] for word in line.decode("ascii").split(" ")[1:]}
    colour = told.get("C", "420")
    kind = next((k for k in ("444", "420", "mono") if re.fullmatch(rf"{k}(jpeg|mpeg2|paldv)?", colour)), None)
    if kind is None:
        raise ValueError(f"colours {colour} are not read")
    num, den = (told.get("F") or "60:1").split(":")
    return Layout(int(told["W"]), int(told["H"]), int(num) / int(den) if int(den) else 60.0, kind, len(line) + 1, len(FRAME))


@dataclass(frozen=True)
class FrameRange(InputPartition):
    path: str
    video_id: int
    layout: Layout
    first: int
    after: int  # the frame after the last
    base: int  # the frame that is number 0


def _first_at(rate: float, time: float) -> int:
    """The first frame that isn't before a time."""
    n = max(0, math.ceil(max(time, 0) * rate) - 1)
    while n / rate < time:
        n += 1
    return n


class RawFrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.low, self.high = 0, math.inf  # frame numbers
        self.from_s, self.to_s = 0.0, math.inf

    def partitions(self) -> list[FrameRange]:
        """A range for each task. Only heads and sizes of files are read here."""
        files, root = file_system(self.options["path"])
        at = files.get_file_info(root)
        found = [at] if at.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((f for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._" and "/_" not in f.path[len(root) :]), key=lambda f: f.path)
        size = int(self.options.get("partitionbytes", PARTITION))
        out = []
        for place, f in enumerate(found):
            layout = self._layout(files, f.path)
            number = re.match(r"\d+", f.base_name)
            n = (f.size - layout.head) // layout.size  # a frame that was cut off is none
            base, end = self._clip(layout, n)  # frames are numbered from where reading starts
            low = max(base + self.low, _first_at(layout.rate, self.from_s))
            high = min(base + self.high + 1, end, math.inf if self.to_s == math.inf else math.floor(self.to_s * layout.rate) + 2)
            step = max(1, size // layout.size)
            video = int(number[0]) if number else place
            out += [FrameRange(f.path, video, layout, k, min(k + step, int(high)), base) for k in range(int(low), int(high), step)]
        return out

    def _clip(self, layout: Layout, n: int) -> tuple[int, int]:
        """The first frame that is asked for, and the one after the last."""
        start, duration = float(self.options.get("start", 0)), self.options.get("duration")
        first = _first_at(layout.rate, start)
        return first, min(n, _first_at(layout.rate, start + float(duration))) if duration else n

    def _layout(self, files: fs.FileSystem, path: str) -> Layout:
        if path.endswith(".y4m"):
            with files.open_input_file(path) as file:
                return y4m_layout(file.read(4096))
        return Layout(int(self.options["width"]), int(self.options["height"]), float(self.options.get("rate", 60)), "rgb24")

    def read(self, partition: FrameRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are none
            return
        layout = partition.layout
        files, _ = file_system(self.options["path"])
        step = max(1, BATCH // (3 * layout.width * layout.height))
        with files.open_input_file(partition.path) as file:
            for k in range(partition.first, partition.after, step):
                n = min(step, partition.after - k)
                file.seek(layout.head + k * layout.size)
                block = file.read(n * layout.size)
                frames = [block[i * layout.size : (i + 1) * layout.size] for i in range(n)]
                if any(len(f) < layout.size or f[: layout.mark] != FRAME[: layout.mark] for f in frames):
                    raise ValueError(f"{partition.path} has no frame where one should be")
                number = np.arange(k, k + n)
                yield pa.RecordBatch.from_pydict({
                    "video_id": pa.array([partition.video_id] * n, pa.int64()), "frame_num": pa.array(number - partition.base, pa.int64()), "ts_s": pa.array(number / layout.rate, pa.float64()),
                    "width": pa.array([layout.width] * n, pa.int32()), "height": pa.array([layout.height] * n, pa.int32()),
                    "data": pa.array([layout.rgb(f[layout.mark :]) for f in frames], pa.binary()),
                })


class PushedRawFrameReader(RawFrameReader):
    """For sessions that push filters down; Spark refuses it in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        """Limits of frame_num and ts_s make the ranges smaller; all filters are checked again by Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("frame_num",):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            elif column == ("ts_s",):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.from_s = max(self.from_s, value)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.to_s = min(self.to_s, value)
            yield f


class _RawWriter(DataSourceArrowWriter):
    """A file NUMBER.rgb for each video, its frames in the order of their rows."""

    def __init__(self, path: str) -> None:
        self.folder = HiddenFolder(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, here, mine = self.folder.task()
        files.create_dir(here, recursive=True)
        video, out, following = None, None, 0
        try:
            for batch in iterator:
                for v, n, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("video_id", "frame_num", "data")), strict=True):
                    if v != video:
                        if out is not None:
                            out.close()
                        mine.names.append(f"{v}.rgb")
                        video, following, out = v, 0, files.open_output_stream(f"{here}/{v}.rgb")
                    if n != following:
                        raise ValueError(f"video {v} has frame {n} where {following} should be")
                    following += 1
                    out.write(data)
        finally:
            if out is not None:
                out.close()
        return mine

    def commit(self, messages) -> None:
        self.folder.commit(messages)

    def abort(self, messages) -> None:
        self.folder.abort()


class RawFrames(DataSource):
    """Files of raw frames below path. Options: path; width, height and rate (60) of files that aren't Y4M; partitionBytes;
    start and duration in seconds, of what is read; push (true or false), whether filters are taken.

    A file whose name begins with a number is the video of that number, another one that of its place among them.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return PushedRawFrameReader(options) if options.get("push") == "true" else RawFrameReader(options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _RawWriter(self.options["path"])


def read_frames(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Frames (video_id, frame_num, ts_s, width, height, data: RGB24) of the files below path. Filters on frame_num and
    ts_s are pushed down in sessions that allow it (spark.sql.python.filterPushdown.enabled, when this is called)."""
    spark.dataSource.register(RawFrames)
    options = {"push": spark.conf.get(PUSH, "false")} | options
    return spark.read.format("raw_frames").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames (video_id, frame_num from 0 without gaps, data) as a file of raw pixels for each video, written by one task
    each, as a file has to be written in order."""
    frames.sparkSession.dataSource.register(RawFrames)
    rows = frames.select("video_id", "frame_num", "data").repartition("video_id").sortWithinPartitions("video_id", "frame_num")
    rows.write.format("raw_frames").mode("append").save(path)


def seek_raw(spark: SparkSession, path: str, start_s: float, duration_s: float, **options: object) -> DataFrame:
    """Frames from a point on, for a while; their numbers restart at 0. Only their bytes are read."""
    return read_frames(spark, path, start=start_s, duration=duration_s, **options)
