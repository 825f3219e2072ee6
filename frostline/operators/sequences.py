"""Pairings, runs and averages over frame order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import REPAIR, MatcherParams
from ..sources.frames import finite
from ..sources.order import CHUNK, numbered, running_max, running_maxima
from ..sources.staging import stage_table


def duplicate_frames(scores: DataFrame, params: MatcherParams = REPAIR) -> DataFrame:
    """Frames whose three scores are finite and which are duplicates with enough confidence."""
    sure = finite(F.col("hash_distance"), F.col("motion"), F.col("distinct_conf")) & (1 - F.col("distinct_conf") >= params.min_duplicate_confidence)
    return scores.where(sure).select("video_id", "frame_num", "ts_s", "motion")


def simple_chains(scores: DataFrame, params: MatcherParams = REPAIR, chunk: int | None = CHUNK) -> DataFrame:
    """Runs of duplicates with the frame before them, without compensation or a limit of motion.

    A run is an island: what isn't a duplicate starts one. One that is longer than the limit, or open at the end of its
    video, is left out. The chain's motion includes that of the frame that ends it.
    """
    dup = F.coalesce(1 - F.col("distinct_conf") >= params.min_duplicate_confidence, F.lit(False))
    rows = scores.withColumn("dup", dup)
    rows = running_max(rows, "video_id", "frame_num", F.when(~F.col("dup"), F.col("frame_num")), "since", to=-1, chunk=chunk)
    ends = rows.where("NOT dup AND since IS NOT NULL").select("video_id", F.col("since").alias("island"), F.col("frame_num").alias("end_frame"), F.coalesce("motion", F.lit(0.0)).alias("end_motion"))
    # An island is the frame that it starts with. What is past the limit is dropped before anything is gathered.
    rows = rows.withColumn("island", F.when(F.col("dup"), F.col("since")).otherwise(F.col("frame_num")))
    rows = rows.where(F.col("frame_num") - F.col("island") <= params.max_duplicates + 1)
    runs = rows.groupBy("video_id", "island").agg(
        F.sort_array(F.collect_list("frame_num")).alias("frames"), F.sort_array(F.collect_list("ts_s")).alias("timestamps"), F.sum(F.when(F.col("dup"), F.col("motion")).otherwise(0.0)).alias("run_motion")
    )
    size = F.size("frames") - 1
    runs = runs.where((size >= 1) & (size <= params.max_duplicates)).join(ends, ["video_id", "island"])
    runs = numbered(runs, "video_id", "island", "chain_i", chunk=chunk)
    return runs.select("video_id", "chain_i", "frames", "timestamps", "end_frame", (F.col("run_motion") + F.col("end_motion")).alias("chain_motion"))


def lagged_pairs(frames: DataFrame) -> DataFrame:
    """Each frame with the one two before it and the one before it, where there is one: a join on video and number,
    which no long video makes uneven. Numbers are places, without gaps (numbered() makes them so)."""
    later = frames.select("video_id", F.col("frame_num").alias("frame_before"), F.col("value").alias("v"), F.explode(F.array(F.lit(2), F.lit(1))).alias("lag"))
    later = later.withColumn("frame_num", F.col("frame_before") + F.col("lag"))
    pairs = frames.join(later, ["video_id", "frame_num"])
    return pairs.select("video_id", "frame_num", "lag", "frame_before", F.abs(F.col("value") - F.col("v")).alias("motion"))


def neighbours(thumbs: DataFrame) -> DataFrame:
    """Thumbnails with the one before (before), by frame number, which is a place without gaps."""
    left = thumbs.select((F.col("frame_num") + 1).alias("frame_num"), F.col("thumb").alias("before"))
    return thumbs.join(left, "frame_num")


def similar_frames(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Frames at a distance in [low, high) from the one before; the very first too if its pair is in range."""
    found = pairs.where((F.col("distance") >= low) & (F.col("distance") < high))
    head = pairs.agg(F.min(F.struct("frame_num", "distance")).alias("m")).where((F.col("m.distance") >= low) & (F.col("m.distance") < high))
    return found.select("frame_num").unionAll(head.select((F.col("m.frame_num") - 1).alias("frame_num")))


def select_frames(frames: DataFrame, targets: DataFrame) -> DataFrame:
    """The frames whose (video_id, frame_num) is among the targets, in whatever order those come; each once."""
    return frames.join(targets.select("video_id", "frame_num"), ["video_id", "frame_num"], "left_semi")


def boundary_frames(chains: DataFrame, frames: DataFrame) -> DataFrame:
    """The two frames between which each chain is filled in, (video_id, chain_i, name, frame_num) and the other columns of
    frames: 0.webp is the chain's first frame, 1.webp the one that ended it."""
    ends = F.array(F.struct(F.lit("0.webp").alias("name"), F.element_at("frames", 1).alias("frame_num")), F.struct(F.lit("1.webp").alias("name"), F.col("end_frame").alias("frame_num")))
    return chains.select("video_id", "chain_i", F.inline(ends)).join(frames, ["video_id", "frame_num"])


def history(frames: DataFrame, most: int, chunk: int = CHUNK) -> DataFrame:
    """Each frame with those before it, oldest first, at most so many.

    Windows run over chunks of frame numbers, which are places without gaps; a chunk's last frames are seen by the next
    one too.
    """
    own = F.expr(f"frame_num div {chunk}")
    next_too = F.when(F.pmod("frame_num", F.lit(chunk)) >= chunk - most, own + 1)
    rows = frames.withColumn("_chunk", F.explode(F.array_compact(F.array(own, next_too))))
    before = W.partitionBy("video_id", "_chunk").orderBy("frame_num").rowsBetween(-most, -1)
    return rows.withColumn("before", F.collect_list("frame_num").over(before)).where(F.col("_chunk") == own).drop("_chunk")


def ema_final(values: DataFrame, alpha: float) -> DataFrame:
    """Each video's exponential moving average after its last frame, as a weighted sum: nothing is gathered. Frames are
    numbered from 0 without gaps."""
    rows = values.join(values.groupBy("video_id").agg(F.count("*").alias("n")), "video_id")
    weight = F.pow(F.lit(1 - alpha), F.col("n") - 1 - F.col("frame_num")) * F.when(F.col("frame_num") == 0, 1.0).otherwise(alpha)
    return rows.groupBy("video_id").agg(F.sum(weight * F.col("value")).alias("ema"))


BLOCK = 64  # frames that are averaged by one product


def _ema(values: np.ndarray, alpha: float, carried: float) -> np.ndarray:
    """The average after each of the values, from the one that is carried in on, a block at a time."""
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
    weights, left = np.where(lag >= 0, alpha * (1 - alpha) ** np.maximum(lag, 0), 0.0), (1 - alpha) ** np.arange(1, BLOCK + 1)
    out = np.empty(len(values))
    for k in range(0, len(values), BLOCK):
        n = min(BLOCK, len(values) - k)
        out[k : k + n] = weights[:n, :n] @ values[k : k + n] + left[:n] * carried
        carried = out[k + n - 1]
    return out


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of rows of one key."""
    edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
    return zip(edges, edges[1:], strict=False)


def ema_running(values: DataFrame, alpha: float, chunk: int | None = CHUNK) -> DataFrame:
    """The average after every frame; the first value seeds it.

    Without chunks a video is one task, and the average is made in one pass. With chunks, an average over one is its own
    part and what is left of the average carried in, so chunks are tasks of their own; what each takes over comes from one
    row per chunk.
    """
    place = ["video_id", "_chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ema, seen = None, 0.0, 0
        for rows in batches:
            keys, x = rows[place].to_numpy(), rows["value"].to_numpy(float)
            out, number = np.empty(len(x)), np.empty(len(x))
            for a, b in _runs(keys) if len(x) else ():
                if (here := tuple(keys[a])) != at:
                    at, ema, seen = here, 0.0 if chunk else x[a], 0
                out[a:b] = _ema(x[a:b], alpha, ema)
                number[a:b] = np.arange(seen + 1, seen + 1 + b - a)
                ema, seen = out[b - 1], seen + b - a
            yield rows[["video_id", "_chunk", "frame_num", "value"]].assign(part=out, left=(1 - alpha) ** number)

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, ema = None, 0.0
        for rows in batches:
            out = []
            for v, first, part, left in zip(rows["video_id"], rows["first"], rows["part"], rows["left"], strict=True):
                ema = first if v != video else ema  # the first frame's average is its value
                video = v
                out.append(ema)
                ema = part + left * ema
            yield rows[["_video", "_of"]].assign(carried=out)

    slim = values.select("video_id", "frame_num", "value", F.expr(f"frame_num div {chunk}" if chunk else "0L").alias("_chunk"))
    slim = slim.repartition(*place if chunk else place[:1]).sortWithinPartitions(*place, "frame_num")
    parts = slim.mapInPandas(run, "video_id long, _chunk long, frame_num long, value double, part double, left double")
    if not chunk:
        return parts.select("video_id", "frame_num", F.col("part").alias("ema"))
    parts = stage_table(parts)
    ends = parts.groupBy(*place).agg(F.min_by("value", "frame_num").alias("first"), F.max_by("part", "frame_num").alias("part"), F.max_by("left", "frame_num").alias("left"))
    ends = ends.withColumns({"_video": F.col("video_id"), "_of": F.col("_chunk")}).repartition("video_id").sortWithinPartitions(*place)
    carried = ends.mapInPandas(carry, "_video long, _of long, carried double")
    rows = parts.join(carried, (F.col("video_id") == F.col("_video")) & (F.col("_chunk") == F.col("_of")))
    return rows.select("video_id", "frame_num", (F.col("part") + F.col("left") * F.col("carried")).alias("ema"))


def _with_last(found: DataFrame, frames: DataFrame, number: str, chunk: int | None) -> DataFrame:
    """What was found, in rows of a sequence that has all frame numbers of its videos too, with each video's last frame.
    The targets' rows (of which target isn't null) are kept."""
    if chunk is None:
        return found.withColumn("last", F.max(number).over(W.partitionBy("video_id"))).where("target IS NOT NULL")
    last = frames.groupBy(F.col("video_id").alias("_video")).agg(F.max("frame_num").alias("last"))
    return found.where("target IS NOT NULL").join(last, F.col("video_id").eqNullSafe(F.col("_video")), "left").drop("_video")


def seek_frames(frames: DataFrame, targets: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """For each target (video_id, target): the first frame at or after it, or else the video's last.

    Targets and frames are one sequence per video, read backwards once; no pair of them is compared, and none of the
    tables is broadcast, as there are as many targets as one likes.
    """
    number = F.col("frame_num").cast("long")
    both = frames.select("video_id", (-2 * number - 1).alias("at"), number.alias("number"), F.lit(None).cast("long").alias("target"))
    both = both.unionAll(targets.select("video_id", (-2 * F.col("target").cast("long")).alias("at"), F.lit(None).cast("long"), "target"))
    found = _with_last(running_max(both, "video_id", "at", -F.col("number"), "nearest", chunk=chunk), frames, "number", chunk)
    return found.select("video_id", "target", F.coalesce(-F.col("nearest"), "last").alias("frame_num"))


LATEST = float(1 << 60)  # times in frames are cut there, on both sides; NaN is the latest


def seek_times(frames: DataFrame, targets: DataFrame, rate: float, chunk: int | None = CHUNK) -> DataFrame:
    """For each target (video_id, target) the first frame whose time, in frames at the rate, rounds to it, or is more than
    half a frame past it; or else the video's last. frames has video_id, frame_num and ts_s; a frame without a time is only
    ever found as the last one. Targets of a video without frames are left out.

    Halves are rounded to the even number, so a time right between two frames may be the later one's without being past the
    earlier one. Places of times are counted in halves for that, and each target looks at two of them: the one that its own
    frame begins at, and the one that is past it. Both are in one sequence per video with the frames, read backwards once, as
    in seek_frames(); a target's two rows are then put together.
    """
    exact = F.col("ts_s") * rate
    whole = F.when(exact.isNotNull(), F.greatest(F.least(F.rint(exact), F.lit(LATEST)), F.lit(-LATEST))).cast("long")
    place = 2 * whole - F.when(whole - exact == 0.5, 1).otherwise(0)
    number, none = F.col("frame_num").cast("long"), F.lit(None).cast("long")
    both = frames.select("video_id", (-2 * place - 1).alias("at"), number.alias("number"), whole.alias("whole"), none.alias("target"))
    target = F.col("target").cast("long")
    places = F.explode(F.array(-2 * (2 * target - 1), -2 * (2 * target + 2))).alias("at")
    both = both.unionAll(targets.select("video_id", places, none, none, target))
    both = both.where("at IS NOT NULL") if chunk else both  # all that have no time would be one chunk
    timed = F.col("whole").isNotNull()
    values = {"nearest": F.when(timed, F.struct(-F.col("whole"), -F.col("number"))), "least": F.when(timed, -F.col("number"))}
    found = _with_last(running_maxima(both, "video_id", "at", values, chunk=chunk), frames, "number", chunk)
    own = F.col("at") == -2 * (2 * F.col("target") - 1)
    held = F.when(own & (F.col("nearest.col1") == -F.col("target")), -F.col("nearest.col2"))
    found = found.groupBy("video_id", "target").agg(F.min(held).alias("held"), F.min(F.when(~own, -F.col("least"))).alias("past"), F.max("last").alias("last"), F.count_if(own).alias("n"))
    found = found.select("video_id", "target", F.coalesce(F.least("held", "past"), "last").alias("frame_num"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    return found.where("frame_num IS NOT NULL").drop("col")
