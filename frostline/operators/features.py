"""Features of decoded frames: luma thumbnails and gradient hashes, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import REPAIR, MatcherParams

#: Size of the thumbnails that the models take (fixed values).
WIDTH, HEIGHT = 320, 180
SLICE = 64  # frames whose features are in memory at once, a thumbnail of 57,600 bytes each
#: Weights of red, green and blue in luma, out of 256 (fixed values).
LUMA = np.array([77, 150, 29], np.uint32)


@lru_cache(maxsize=64)
def _weights(source: int, target: int) -> np.ndarray:
    """Catmull-Rom weights of each source pixel in each target pixel; the kernel is as wide as the scale when a picture
    shrinks, and edges are renormalised."""
    scale = max(1.0, source / target)
    centers = (np.arange(target) + 0.5) * source / target - 0.5
    x = np.abs(np.arange(source)[None, :] - centers[:, None]) / scale
    near, far = 1.5 * x**3 - 2.5 * x**2 + 1, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2
    w = np.where(x < 1, near, np.where(x < 2, far, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture of 8-bit values at another size."""
    out = _weights(gray.shape[0], height) @ gray.astype(np.float64) @ _weights(gray.shape[1], width).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def luma(rgb: bytes, width: int, height: int) -> np.ndarray:
    pixels = np.frombuffer(rgb, np.uint8, width * height * 3).reshape(height, width, 3)
    return (pixels @ LUMA >> 8).astype(np.uint8)


def gradient_hash(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """width * height bits: whether a pixel of the shrunk picture is darker than the next in its row."""
    small = resize(gray, width + 1, height)
    return (small[:, :-1] < small[:, 1:]).ravel()


def _features(params: MatcherParams):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE) for whole in source for k in range(0, whole.num_rows, SLICE)):
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("video_id", "frame_num", "ts_s", "width", "height", "data")}
            widths, hashes, thumbs = [], [], []
            for w, h, data in zip(*(columns[c].to_pylist() for c in ("width", "height", "data")), strict=True):
                gray = luma(data, w, h)
                across, down = max(1, w // params.diff_hash_resize), max(1, h // params.diff_hash_resize)
                widths.append(across)
                hashes.append(gradient_hash(gray, across, down).astype(np.int8).tolist())
                thumbs.append(resize(gray, WIDTH, HEIGHT).tobytes())
            new = {"hash_width": pa.array(widths, pa.int32()), "hash": pa.array(hashes, pa.list_(pa.int8())), "thumb": pa.array(thumbs, pa.binary())}
            yield pa.RecordBatch.from_pydict({c: columns[c] for c in ("video_id", "frame_num", "ts_s")} | new)

    return run


def frame_features(frames: DataFrame, params: MatcherParams = REPAIR) -> DataFrame:
    """(video_id, frame_num, ts_s, hash_width, hash, thumb) of frames (…, width, height, data: RGB24).

    A batch of Spark's is put out in slices: thumbnails take far more memory than small frames do.
    """

    return frames.select("video_id", "frame_num", "ts_s", "width", "height", "data").mapInArrow(_features(params), "video_id long, frame_num long, ts_s double, hash_width int, hash array<tinyint>, thumb binary")


@lru_cache(maxsize=64)
def _lanczos(source: int, target: int) -> np.ndarray:
    """Weights of a Lanczos kernel of eight source pixels, whatever the scale; pixels beyond the edge are the edge's."""
    centers = (np.arange(target) + 0.5) * source / target - 0.5
    taps = np.floor(centers).astype(np.int64)[:, None] + np.arange(-3, 5)
    x = centers[:, None] - taps
    w = np.sinc(x) * np.sinc(x / 4)
    out = np.zeros((target, source))
    np.add.at(out, (np.arange(target)[:, None], np.clip(taps, 0, source - 1)), w / w.sum(axis=1, keepdims=True))
    return out


@lru_cache(maxsize=64)
def _area(source: int, target: int) -> np.ndarray:
    """Weights by how much of a target pixel each source pixel covers; a picture that grows is interpolated linearly."""
    if target > source:
        centers = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
        return np.maximum(0, 1 - np.abs(np.arange(source)[None, :] - centers[:, None]))
    edges = np.arange(target + 1) * source / target
    left, right = edges[:-1, None], edges[1:, None]
    covered = np.minimum(right, np.arange(source) + 1) - np.maximum(left, np.arange(source))
    return np.maximum(0, covered) * target / source


def _nearest(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    rows, columns = picture.shape[:2]
    return picture[np.arange(height) * rows // height][:, np.arange(width) * columns // width]


def scaled(picture: np.ndarray, width: int, height: int, weights=_lanczos) -> np.ndarray:
    """A picture (rows, columns, channels) at another size, in fractions of 8-bit values."""
    down, across = weights(picture.shape[0], height), weights(picture.shape[1], width)
    return np.stack([down @ picture[:, :, c].astype(np.float64) @ across.T for c in range(picture.shape[2])], axis=2)


def to_bytes(picture: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(picture), 0, 255).astype(np.uint8)


#: Quantisation of luminance and chrominance in the JPEG standard, at quality 50 (fixed values).
JPEG = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
JPEG_COLOUR = np.array([
    [17, 18, 24, 47, 99, 99, 99, 99], [18, 21, 26, 66, 99, 99, 99, 99], [24, 26, 56, 99, 99, 99, 99, 99], [47, 66, 99, 99, 99, 99, 99, 99],
    *[[99] * 8] * 4,
])
#: Luma and colour differences of red, green and blue in JPEG files, and luma in single grey pictures (fixed values).
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
GREY = TO_YCC[0]


def _quantised(plane: np.ndarray, quality: int, table: np.ndarray) -> np.ndarray:
    """What is left of a plane around zero: 8 x 8 cosine transforms, rounded to multiples of the quality's table."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    steps = np.clip((table * scale + 50) // 100, 1, 255)
    k = np.arange(8)
    cosine = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8).swapaxes(1, 2)
    kept = np.rint(cosine @ blocks @ cosine.T / steps) * steps
    return (cosine.T @ kept @ cosine).swapaxes(1, 2).reshape(padded.shape)[:h, :w]


def jpeg_round_trip(gray: np.ndarray, quality: int) -> np.ndarray:
    """What is left of a grey picture after JPEG."""
    return to_bytes(_quantised(gray.astype(np.float64) - 128, quality, JPEG) + 128)


def jpeg_colour(rgb: np.ndarray, quality: int) -> np.ndarray:
    """What is left of a picture in colour after JPEG: colour differences are kept at half the size."""
    ycc = rgb.astype(np.float64) @ TO_YCC.T
    h, w = rgb.shape[:2]
    even = np.pad(ycc[:, :, 1:], ((0, h % 2), (0, w % 2), (0, 0)), mode="edge")
    half = even.reshape(even.shape[0] // 2, 2, even.shape[1] // 2, 2, 2).mean(axis=(1, 3))
    light = _quantised(ycc[:, :, 0] - 128, quality, JPEG) + 128
    differences = [_quantised(half[:, :, c], quality, JPEG_COLOUR).repeat(2, axis=0)[:h].repeat(2, axis=1)[:, :w] for c in (0, 1)]
    return to_bytes(np.stack([light, *differences], axis=2) @ np.linalg.inv(TO_YCC).T)


@dataclass(frozen=True)
class Augmentation:
    """Ranges that a variation's values are drawn from (fixed values); noise is a share of 255."""

    quality: tuple[int, int] = (13, 55)
    detail_noise: tuple[float, float] = (0.0003, 0.01)
    macro_noise: tuple[float, float] = (0.0001, 0.019)
    macro_resize: tuple[float, float] = (1.0, 5.0)
    offset: tuple[float, float] = (-7.0, 7.0)
    resolutions: tuple[tuple[int, int], ...] = ((1280, 720), (1920, 1080))
    passthrough: float = 0.02


def vary(picture: np.ndarray, rng: np.random.Generator, p: Augmentation = Augmentation()) -> np.ndarray:
    """A variation of a picture (rows, columns, 3): at another size it gets fine and coarse noise and an offset for each
    channel and goes through JPEG; the coarse noise and the offsets are taken off again, and it is made grey, (rows,
    columns, 1), and as large as it was. A few pass through the two resizes only, and stay in colour."""
    height, width = picture.shape[:2]
    across, down = p.resolutions[rng.integers(len(p.resolutions))]
    large = to_bytes(scaled(picture, across, down))
    if rng.random() < p.passthrough:
        return to_bytes(scaled(large, width, height))
    size = rng.uniform(*p.macro_resize)
    rows, columns = max(1, round(height / size)), max(1, round(width / size))
    fine = rng.normal(0, rng.uniform(*p.detail_noise) * 255, large.shape)
    coarse = _nearest(rng.normal(0, rng.uniform(*p.macro_noise) * 255, (rows, columns, 3)), across, down)
    undone = coarse + rng.uniform(*p.offset, 3)
    noisy = np.clip(large + fine + undone, 0, 255).astype(np.uint8)
    packed = jpeg_colour(noisy, int(rng.integers(p.quality[0], p.quality[1] + 1)))
    out = to_bytes(scaled(np.clip(packed - undone, 0, 255).astype(np.uint8), width, height, _area))
    return to_bytes(out @ GREY)[:, :, None]


def picture_variations(images: DataFrame, n: int = 3, seed: int = 5, params: Augmentation = Augmentation()) -> DataFrame:
    """n variations of each picture (path, width, height, data: RGB24, or 8-bit grey, which is taken as three channels);
    their names are those of augmented images. Data is grey, or RGB24 of those that pass through. Draws depend on path,
    number and seed only."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            path, w, h, data, number = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "width", "height", "data", "i"))
            for name, across, down, pixels, i in zip(path, w, h, data, number, strict=True):
                rng = np.random.default_rng([seed, i, *name.encode()])
                picture = np.frombuffer(pixels, np.uint8).reshape(down, across, -1)
                out = vary(np.broadcast_to(picture, (down, across, 3)), rng, params).tobytes()
                yield pa.RecordBatch.from_pydict({"path": pa.array([f"{name}_{i}.png"]), "width": pa.array([across], pa.int32()), "height": pa.array([down], pa.int32()), "data": pa.array([out], pa.binary())})

    rows = images.select("path", "width", "height", "data", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return rows.mapInArrow(run, "path string, width int, height int, data binary")
