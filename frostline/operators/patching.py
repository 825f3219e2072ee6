"""From chains to interpolated frames: jobs, release in order, patches and their overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.order import CHUNK, running_max


def interpolation_jobs(chains: DataFrame) -> DataFrame:
    """One row per in-between of a chain: n of them between its first and end frame, at i / (n + 1)."""
    n = F.size("frames") - 1
    jobs = chains.where(n > 0).withColumn("n", n)
    jobs = jobs.select("video_id", "chain_i", "n", F.col("frames")[0].alias("first"), "end_frame", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    folder = F.format_string("chain_%d", "chain_i")
    return jobs.select(
        "video_id", "chain_i", "i", F.format_string("%d", "first").alias("in0"), F.format_string("%d", "end_frame").alias("in1"), F.concat(folder, F.lit("/"), F.format_string("%03d.png", "i")).alias("out"),
        (F.col("i") / (F.col("n") + 1)).alias("s"), (F.col("i") == F.col("n")).alias("is_last"),
    )


def job_key(in0: Column, in1: Column, out: Column) -> Column:
    return F.concat_ws("-", in0, in1, out)


def completed(jobs: DataFrame, completions: DataFrame) -> DataFrame:
    """Open jobs that are done; a completion without a job is dropped."""
    return jobs.withColumn("key", job_key(F.col("in0"), F.col("in1"), F.col("out"))).join(completions, "key")


def release_order(done: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """When each job may be released: once it and all before it in its video are done."""
    return running_max(done, "video_id", "chain_i", F.col("done_at"), "released_at", chunk=chunk)


def patch_ranges(chains: DataFrame) -> DataFrame:
    """Patches: the frames that are replaced, start to end inclusive, and their images."""
    start, end = F.col("frames")[1], F.element_at("frames", -1)
    images = F.transform(F.sequence(F.lit(1), F.size("frames") - 1), lambda i: F.concat(F.format_string("chain_%d/", F.col("chain_i")), F.format_string("%03d.png", i)))
    return chains.where(F.size("frames") > 1).select("video_id", "chain_i", start.alias("start"), (end - start + 1).alias("length"), images.alias("imgs"))


def overlapping(patches: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """Patches that begin before one before them has ended; a sound list has none. Of patches with one start all but one
    do. A long video is many tasks (see running_max())."""
    rows = patches.withColumn("_stop", F.col("start") + F.col("length"))
    return running_max(rows, "video_id", "start", F.col("_stop"), "_end", to=-1, chunk=chunk).where("start < _end").drop("_stop", "_end")


def interpolated(chains: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames that replace each chain's: a linear blend between the values of its first and end frame."""
    ends = chains.where(F.size("frames") > 1).select("video_id", F.col("frames")[0].alias("f0"), "end_frame", "frames")
    a = frames.select("video_id", F.col("frame_num").alias("f0"), F.col("value").alias("v0"))
    b = frames.select("video_id", F.col("frame_num").alias("end_frame"), F.col("value").alias("v1"))
    both = ends.join(a, ["video_id", "f0"]).join(b, ["video_id", "end_frame"])
    both = both.select("video_id", "v0", "v1", F.size("frames").alias("n"), F.posexplode("frames").alias("i", "frame_num")).where("i > 0")
    return both.select("video_id", "frame_num", (F.col("v0") + F.col("i") / F.col("n") * (F.col("v1") - F.col("v0"))).alias("patch"))


def patched(frames: DataFrame, patches: DataFrame) -> DataFrame:
    """All frames, each with its patch where there is one; their number never changes."""
    out = frames.join(patches, ["video_id", "frame_num"], "left")
    return out.select("video_id", "frame_num", F.coalesce("patch", "value").alias("value"), F.col("patch").isNotNull().alias("is_patched"))
