"""Joins of two tables of half-open ranges on overlap, by bins of several lengths.

A range is put into bins of the least length that isn't shorter than itself, so it lies in two at most, however long it
is. Two ranges that overlap share a bin of the longer one's length: the longer is there at home, the shorter is put into
the one or two bins of that length that it reaches. Lengths go up eightfold, and a range is put only into bins of lengths
that the other table has ranges of, a list of some twenty numbers at most. So the join is an equi-join on key, length and
bin, which Spark can split where a bin is large, and pairs that are compared in vain stay in proportion to those found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage_table

_BITS = 3  # a level's bins are 2^_BITS times as long as those of the level below


def _level(length: Column) -> Column:
    """The lowest level whose bins aren't shorter than length."""
    bits = F.length(F.bin(length - 1))  # of what is left when one is taken, as bins of 2^k hold lengths up to 2^k
    return F.when(length <= 1, 0).otherwise(F.ceil(bits / _BITS)).cast("int")


def _ranges(rows: DataFrame, on: tuple[str, ...], start: str, stop: str, name: str) -> DataFrame:
    """Rows as a struct beside their keys, ends and level; without those that are empty or have no ends."""
    ends = rows.select(*(rows[c].alias(f"_k{i}") for i, c in enumerate(on)), rows[start].cast("long").alias("_start"), rows[stop].cast("long").alias("_stop"), F.struct(*(rows[c] for c in rows.columns)).alias(name))
    ends = ends.where("_start < _stop")
    length = F.greatest(F.col("_stop") - F.col("_start"), F.lit(1))
    return ends.withColumn("_level", _level(length))


def _levels(ranges: DataFrame) -> list[int]:
    """The levels that occur, 22 at most."""
    return sorted(r["_level"] for r in ranges.select("_level").distinct().collect())


def _in_bins(ranges: DataFrame, levels: Column) -> DataFrame:
    """Ranges once for each bin of these levels (an array, none below their own) that they reach into."""
    rows = ranges.withColumn("_l", F.explode(levels))
    at = lambda c: F.expr(f"shiftright({c}, _l * {_BITS})")
    return rows.withColumn("_bin", F.explode(F.array_distinct(F.array(at("_start"), at("_stop - 1")))))


def _among(levels: list[int], above: bool) -> Column:
    """Those of the levels that aren't below a range's own, or are above it."""
    own = F.col("_level")
    return F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: (x > own) if above else (x >= own))


def overlap_join(left: DataFrame, right: DataFrame, on: tuple[str, ...] = (), left_range: tuple[str, str] = ("start", "stop"), right_range: tuple[str, str] = ("start", "stop")) -> DataFrame:
    """Pairs of rows with equal keys whose ranges overlap: the structs left and right, and start and stop of what both cover.

    Ranges are half-open and of whole numbers; what casts to long will do, so dates and times have to be cast by the
    caller. A row whose range is empty, turned round or without an end, or one of whose keys is null, overlaps nothing. Rows
    that are repeated are pairs of their own. Columns may be called alike in both tables. Ranges may be of any length, up to
    those whose length a long holds.
    """
    a, b = stage_table(_ranges(left, on, *left_range, "left")), stage_table(_ranges(right, on, *right_range, "right"))
    levels_a, levels_b = _levels(a), _levels(b)
    home = F.array("_level")
    # the left range is the longer or both are of one level; then the right one is longer
    found = _joined(_in_bins(a, home), _in_bins(b, _among(levels_a, False)), on)
    return found.unionAll(_joined(_in_bins(a, _among(levels_b, True)), _in_bins(b, home), on))


def _joined(a: DataFrame, b: DataFrame, on: tuple[str, ...]) -> DataFrame:
    own = b.select(*(F.col(f"_k{i}").alias(f"_o{i}") for i in range(len(on))), F.col("_start").alias("_from"), F.col("_stop").alias("_to"), "right", F.col("_l").alias("_ol"), F.col("_bin").alias("_obin"))
    same = (F.col("_l") == F.col("_ol")) & (F.col("_bin") == F.col("_obin"))
    for i in range(len(on)):
        same = same & (F.col(f"_k{i}") == F.col(f"_o{i}"))
    begins, ends = F.greatest("_start", "_from"), F.least("_stop", "_to")
    once = F.expr(f"shiftright(greatest(_start, _from), _l * {_BITS})") == F.col("_bin")  # of two bins that both are in
    return a.join(own, same & (begins < ends) & once).select("left", "right", begins.alias("start"), ends.alias("stop"))


def clip_windows(ranges: DataFrame, windows: DataFrame) -> DataFrame:
    """Ranges (video_id, color, start, stop) that reach into each of the windows (video_id, window, low, high), cut to it and
    counted from its start."""
    found = overlap_join(ranges, windows, ("video_id",), right_range=("low", "high"))
    low = F.col("right.low")
    return found.select("left.video_id", "right.window", "left.color", (F.col("start") - low).alias("start"), (F.col("stop") - low).alias("stop"))


def lags_found(lags: DataFrame, finds: DataFrame) -> DataFrame:
    """Each lag (video_id, start, length) with how many finds (video_id, start, length) touch it, and how many of its
    frames they cover, counted once for each find. A lag that nothing touches has zeros."""
    ends = lambda rows: rows.select("video_id", "start", "length", (F.col("start") + F.col("length")).alias("stop"))
    both = overlap_join(ends(lags), ends(finds), ("video_id",))
    hits = both.groupBy(F.col("left.video_id").alias("_v"), F.col("left.start").alias("_s"), F.col("left.length").alias("_n")).agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("covered"))
    out = lags.join(hits, (F.col("video_id") == F.col("_v")) & (F.col("start") == F.col("_s")) & (F.col("length") == F.col("_n")), "left")
    return out.select("video_id", "start", "length", F.coalesce("n", F.lit(0).cast("long")).alias("finds"), F.coalesce("covered", F.lit(0).cast("long")).alias("covered"))
