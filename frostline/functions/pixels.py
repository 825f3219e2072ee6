"""Column functions over pixels and thumbnails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma of 8-bit channels; the weights, out of 256, are fixed values."""
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def to_byte(x: Column) -> Column:
    """A value from -1 to 1 as 0 to 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x + 1) * 127.5))).cast("int")


def grayscale(rgb: Column) -> Column:
    """Luma of each three of an array of bytes; what is over is left out."""
    n = F.floor(F.size(rgb) / 3).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: luma(F.get(rgb, i * 3), F.get(rgb, i * 3 + 1), F.get(rgb, i * 3 + 2)))


def gradient_bits(pixels: Column) -> Column:
    """1 where a pixel is darker than the next."""
    pairs = F.zip_with(F.slice(pixels, 1, F.size(pixels) - 1), F.slice(pixels, 2, F.size(pixels) - 1), lambda a, b: (a < b).cast("int"))
    return pairs


def hash_distance(a: Column, b: Column, denominator: int) -> Column:
    """Differing bits over a denominator: the square of the hash's width, whatever its height."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(denominator))


def packed_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes packed in longs."""
    return F.bit_count(a.bitwiseXOR(b))


def normalised(pixels: Column) -> Column:
    """8-bit pixels as 0 to 1, as models take them."""
    return F.transform(pixels, lambda x: x.cast("double") / 255)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mean_abs(diff: Column) -> Column:
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size(diff)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gated(distance: Column, score: Column, gate: float) -> Column:
    """The score of pairs whose hash distance is below the gate; the others are distinct for certain."""
    return F.when(distance < gate, score).otherwise(F.lit(1.0))


def magnitude(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def direction(x: Column, y: Column) -> Column:
    """The angle of a vector, from 0 to 2 pi."""
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi))


def to_full_range(values: Column) -> Column:
    """An array stretched to 0 .. 255; all zeros if its values are equal."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.when(high > low, (v - low) / (high - low) * 255).otherwise(0.0))


def above_floor(mean: Column, least: float = 0.2) -> Column:
    """How far a magnitude exceeds a floor, 0 below it."""
    return F.greatest(mean, F.lit(least)) - least
