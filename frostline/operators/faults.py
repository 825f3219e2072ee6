"""Synthetic faults, and how well detection finds them."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _draw(what: str, attempt: Column, seed: int) -> Column:
    """A number from 0 on that depends on video, attempt and seed only, in any engine."""
    text = F.concat(F.col("video_id").cast("string"), F.lit(f":{what}:"), attempt.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


FEW = 64  # freezes up to which candidates are compared with all that are taken, inside expressions


def _place(videos: Iterator[pd.DataFrame], n_inserts: int, max_length: int, seed: int, attempts: int) -> Iterator[pd.DataFrame]:
    """The same candidates, each compared with its neighbours among those taken only, which are kept in order."""
    for rows in videos:
        out = []
        for video, n in zip(rows["video_id"].tolist(), rows["n_frames"].tolist(), strict=True):
            room, taken = n - max_length - 1, []
            for a in range(attempts if room > 0 else 0):
                draw = [int(hashlib.md5(f"{video}:{what}:{a}:{seed}".encode()).hexdigest()[:12], 16) for what in "sl"]
                new = (1 + draw[0] % max(room, 1), 1 + draw[1] % max_length)
                at = bisect_left(taken, new)
                near = taken[max(0, at - 1) : at + 1]
                if len(taken) < n_inserts and all(s > sum(new) + 1 or new[0] > s + size + 1 for s, size in near):
                    taken.insert(at, new)
                    out.append((video, *new))
        yield pd.DataFrame(out, columns=["video_id", "start", "length"])


def lag_shortfall(videos: DataFrame, lags: DataFrame, n_inserts: int) -> DataFrame:
    """(video_id, n, missing) of videos that have fewer freezes than wanted."""
    held = lags.groupBy(F.col("video_id").alias("_v")).agg(F.count("*").alias("n"))
    out = videos.join(held, F.col("video_id") == F.col("_v"), "left").select("video_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return out.where(F.col("n") < n_inserts).withColumn("missing", n_inserts - F.col("n"))


def inject_lags(videos: DataFrame, n_inserts: int = 3, max_length: int = 8, seed: int = 1, attempts: int | None = None) -> DataFrame:
    """(video_id, start, length) of random freezes; videos has video_id and n_frames.

    Candidates come in a fixed order and are taken unless they come within a frame of one that was. There are attempts
    of them, or else eight for each freeze wanted, so that a video too short for all has fewer (lag_shortfall() tells which).
    Up to FEW freezes are placed by expressions inside one row, more in Arrow batches, with the same result.
    """
    attempts = attempts or 8 * n_inserts
    if n_inserts > FEW:
        return videos.select("video_id", "n_frames").mapInPandas(lambda rows: _place(rows, n_inserts, max_length, seed, attempts), f"video_id {videos.schema['video_id'].dataType.simpleString()}, start long, length long")
    room = F.col("n_frames") - max_length - 1
    tries = F.transform(
        F.sequence(F.lit(0), F.lit(attempts - 1)),
        lambda a: F.struct((1 + F.pmod(_draw("s", a, seed), F.greatest(F.col("room"), F.lit(1)))).alias("start"), (1 + F.pmod(_draw("l", a, seed), F.lit(max_length))).alias("length")),
    )
    none = F.lit(None).cast("array<struct<start:bigint,length:bigint>>")
    none = F.coalesce(none, F.array().cast("array<struct<start:bigint,length:bigint>>"))

    def add(taken: Column, new: Column) -> Column:
        near = F.exists(taken, lambda t: (t["start"] <= new["start"] + new["length"] + 1) & (new["start"] <= t["start"] + t["length"] + 1))
        return F.when((F.size(taken) >= n_inserts) | near, taken).otherwise(F.concat(taken, F.array(new)))

    rows = videos.withColumn("room", room).where("room > 0").withColumn("tries", tries)
    rows = rows.select("video_id", F.explode(F.aggregate("tries", none, add)).alias("lag"))
    return rows.select("video_id", F.col("lag.start").alias("start"), F.col("lag.length").alias("length"))


def lag_frames(lags: DataFrame) -> DataFrame:
    """The frames that freezes cover, each with the frame it shows: the one before its freeze."""
    rows = lags.where("length > 0").select("video_id", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("frame_num"))
    return rows.select("video_id", "frame_num", (F.col("start") - 1).alias("shown"))


def injected_frames(frames: DataFrame, lags: DataFrame) -> DataFrame:
    """Frames with the freezes put in."""
    hit = frames.join(lag_frames(lags), ["video_id", "frame_num"], "left")
    source = frames.select("video_id", F.col("frame_num").alias("shown"), F.col("value").alias("shown_value"))
    out = hit.join(source, ["video_id", "shown"], "left")
    return out.select("video_id", "frame_num", F.coalesce("shown_value", "value").alias("value"), F.col("shown").isNotNull().alias("is_lag"))


def confusion(lags: DataFrame, found: DataFrame) -> DataFrame:
    """Counts per video of frames by truth and finding. The frames are those up to the end of the last freeze or the
    last find, one more included."""
    truth = lag_frames(lags).select("video_id", "frame_num", F.lit(1).alias("t"))
    seen = found.select("video_id", "frame_num").distinct().withColumn("f", F.lit(1))
    both = truth.join(seen, ["video_id", "frame_num"], "full")
    by = both.groupBy("video_id").agg(
        F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"), F.max(F.when(F.col("f") == 1, F.col("frame_num"))).alias("last")
    )
    ends = lags.groupBy("video_id").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    out = by.join(ends, "video_id", "left")
    n = F.greatest(F.coalesce("end", F.lit(0)), F.coalesce("last", F.lit(0))) + 1
    return out.select("video_id", (n - F.col("tp") - F.col("fp") - F.col("fn")).alias("true_negatives"), F.col("tp").alias("true_positives"), F.col("fn").alias("false_negatives"), F.col("fp").alias("false_positives"))


def scores(counts: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and F1 of confusion counts; 0/0 is NaN."""
    sums = counts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("true_negatives", "true_positives", "false_negatives", "false_positives")))
    nan = F.lit(float("nan"))
    tp = F.col("true_positives").cast("double")
    share = lambda other: F.when(tp + F.col(other) == 0, nan).otherwise(tp / F.nullif(tp + F.col(other), F.lit(0)))
    out = sums.withColumn("precision", share("false_positives")).withColumn("recall", share("false_negatives"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1_score", F.when(F.isnan(both) | (both == 0), nan).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0))))
