"""Optical flow between two pictures: in each block the shift that explains the change best, by least squares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAT = 0.01  # a block whose gradients point one way has no shift


def _at(pixels: Column, i: Column) -> Column:
    return F.get(pixels, i)


def _products(a: Column, b: Column, width: int, i: Column) -> list[Column]:
    """Products of the gradients across, down and in time at a pixel inside the picture; those in space are of both
    pictures' mean."""
    slope = lambda step: (_at(a, i + step) - _at(a, i - step) + _at(b, i + step) - _at(b, i - step)) / 4
    x, y, t = slope(1), slope(width), _at(b, i) - _at(a, i)
    return [x * x, x * y, y * y, x * t, y * t]


def _vector(sums: Column) -> Column:
    """The shift (x, y) that solves a block's equations."""
    xx, xy, yy, xt, yt = (sums[n] for n in ("xx", "xy", "yy", "xt", "yt"))
    det, trace = xx * yy - xy * xy, xx + yy
    sure = det > FLAT * trace * trace
    solved = lambda v: F.when(sure, v / F.nullif(det, F.lit(0.0))).otherwise(F.lit(0.0))
    return F.struct(solved(xy * yt - yy * xt).alias("x"), solved(xy * xt - xx * yt).alias("y"))


def flow_vectors(pairs: DataFrame, width: int, block: int = 3, key: str = "frame_num", before: str = "before", after: str = "thumb") -> DataFrame:
    """(key, block, x, y) of pairs of pictures, arrays of brightness row by row, width pixels a row.

    x and y are by how many pixels what is in a block of block x block pixels moves to the right and down. Blocks fill the
    picture's inside from its upper left; what is left over at the right and the bottom is in none. A block that is flat, or
    varies along one direction only, has zeros. A pair of which one picture is null, or that differ in size, has no rows.
    """
    a, b = F.col("_a"), F.col("_b")
    rows = pairs.select(key, pairs[before].alias("_a"), pairs[after].alias("_b")).where("size(_a) = size(_b)")
    across, down = (width - 2) // block, F.floor((F.size("_a") / width - 2) / block).cast("int")
    count = down * across
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("xx", "xy", "yy", "xt", "yt")))

    def sums(n: Column) -> Column:
        corner = (F.floor(n / across).cast("int") * block + 1) * width + n % across * block + 1
        inside = F.transform(F.sequence(F.lit(0), F.lit(block * block - 1)), lambda j: corner + F.floor(j / block).cast("int") * width + j % block)

        def add(s: Column, i: Column) -> Column:
            return F.struct(*((s[n] + p).alias(n) for n, p in zip(("xx", "xy", "yy", "xt", "yt"), _products(a, b, width, i), strict=True)))

        return F.aggregate(inside, zero, add)

    found = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda n: _vector(sums(n))))
    return rows.select(key, F.posexplode(found).alias("block", "v")).select(key, "block", "v.x", "v.y")
