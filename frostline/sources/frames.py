"""Frame relations: from tables of this library's schema, from text files, and from the tables that stand in for video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import CHUNK, numbered

FRAMERATE = 60.0


def _events(events: DataFrame, chunk: int | None) -> DataFrame:
    rows = events.select(F.col("user_id").alias("video_id"), "event_id", "event_type", "value")
    rows = numbered(rows, "video_id", "event_id", "frame_num", before=("event_type", "value"), chunk=chunk)
    return rows.withColumn("ts_s", F.col("frame_num") / F.lit(FRAMERATE))


def event_frames(events: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """Events as frames: a user is a video, its events in order are frames from 0, at 60 a second.

    They are numbered in chunks of event numbers, so that a large video is many tasks; without, in one pass by video.
    """
    return _events(events, chunk).select("video_id", "frame_num", "event_type", "value", "ts_s")


def event_scores(events: DataFrame, chunk: int | None = None) -> DataFrame:
    """Pair scores of event frames with the frame before: hash_distance, motion, distinct_conf; null on the first.

    Two events of one type in a row are duplicates; motion is the change of the value. For the matcher, to which a
    video is one task anyway, one pass by video moves rows least; elsewhere they are better made in chunks.
    """
    distinct = F.when(F.col("event_type_before").isNotNull(), F.when(F.col("event_type") == F.col("event_type_before"), 0.0).otherwise(1.0))
    motion = F.abs(F.col("value") - F.col("value_before")) / 100
    return _events(events, chunk).select("video_id", "frame_num", "ts_s", "value", distinct.alias("hash_distance"), motion.alias("motion"), distinct.alias("distinct_conf"))


def thumbnails(embeddings: DataFrame) -> DataFrame:
    """Embeddings as the thumbnails of one video: frame_num is vec_id."""
    return embeddings.select(F.col("vec_id").alias("frame_num"), F.transform("embedding", lambda x: x.cast("double")).alias("thumb"))


def finite(*columns: Column) -> Column:
    """All are there and neither NaN nor infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(out, F.lit(False))


def seek(frames: DataFrame, start_s: float, duration_s: float, chunk: int | None = CHUNK) -> DataFrame:
    """Frames from a point on, for a while; their numbers restart at 0. The filter reaches the scan. A long clip is numbered
    in chunks; chunk None does it in one window by video."""
    inside = frames.where((F.col("ts_s") >= start_s) & (F.col("ts_s") < start_s + duration_s))
    return numbered(inside, "video_id", "frame_num", "_place", chunk=chunk).drop("frame_num").withColumnRenamed("_place", "frame_num").select(*frames.columns)


def read_lags(spark: SparkSession, path: str) -> DataFrame:
    """Known lags (start, length) of a CSV file without header; a line that doesn't parse is an error."""
    return spark.read.schema("start long, length long").option("mode", "FAILFAST").csv(path)


def write_lags(lags: DataFrame, path: str) -> None:
    lags.select("start", "length").orderBy("start").write.mode("overwrite").csv(path)


def read_video_lags(spark: SparkSession, path: str) -> DataFrame:
    """Known lags (video_id, start, length) of a folder with a file NUMBER.lags.csv for each video, or with what
    write_video_lags() has written. The number is the video."""
    files = spark.read.schema("start long, length long").option("mode", "FAILFAST").option("recursiveFileLookup", True).csv(path)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"(?:video_id=(\d+)/[^/]*|/(\d+)\.lags\.csv)$", 1)
    other = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)\.lags\.csv$", 1)
    return files.select(F.coalesce(number.try_cast("long"), other.try_cast("long")).alias("video_id"), "start", "length")


def write_video_lags(lags: DataFrame, path: str) -> None:
    """A folder video_id=NUMBER for each video, its lags sorted by start."""
    lags.select("video_id", "start", "length").repartition("video_id").sortWithinPartitions("video_id", "start").write.mode("overwrite").partitionBy("video_id").csv(path)


def write_lag_table(lags: DataFrame, path: str) -> None:
    """Lags (video_id, start, length) as CSV files of many videos each, a video's lags in one of them and sorted by start.
    A folder for each video, as write_video_lags() makes, is one more for the driver to commit and to list."""
    parts = int(lags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lags.select("video_id", "start", "length").repartition(parts, "video_id").sortWithinPartitions("video_id", "start").write.mode("overwrite").csv(path)


def read_lag_table(spark: SparkSession, path: str) -> DataFrame:
    """What write_lag_table() has written; a line that doesn't parse is an error."""
    return spark.read.schema("video_id long, start long, length long").option("mode", "FAILFAST").csv(path)


def read_motion_samples(spark: SparkSession, path: str) -> DataFrame:
    """Motion samples; these files have no header, so none is looked for."""
    return spark.read.schema("f0 string, f1 string, motion double, avg_flow_x double, avg_flow_y double").csv(path)


def append_motion_samples(samples: DataFrame, path: str) -> None:
    samples.select("f0", "f1", "motion", "avg_flow_x", "avg_flow_y").write.mode("append").csv(path)


def write_motion_parts(parts: DataFrame, path: str) -> None:
    """Motion samples with is_validation as two files' folders, train and val, with a header."""
    for name, chosen in (("val", F.col("is_validation")), ("train", ~F.col("is_validation"))):
        parts.where(chosen).select("f0", "f1", "motion", "avg_flow_x", "avg_flow_y").write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def read_duplicate_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("before string, after string, different boolean").option("header", True).csv(path)


def write_duplicate_samples(samples: DataFrame, path: str) -> None:
    samples.select("before", "after", "different").write.mode("overwrite").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


#: Names of images that augmentation has made (a fixed format).
AUGMENTED = r"^.+/[^.]+\.png_.+\.png$"


def read_images(spark: SparkSession, path: str, glob: str = "*.png", augmented: bool = False) -> DataFrame:
    """Images below a folder (path, segment, frame_num, content), with augmented ones or without, in no order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    files = files if augmented else files.where(~F.col("path").rlike(AUGMENTED))
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("segment"), frame_number(F.col("path")).alias("frame_num"), "content")


def list_images(spark: SparkSession, path: str, glob: str = "*.png", augmented: bool = False) -> DataFrame:
    """The same without contents, which are not read then, in name order."""
    return read_images(spark, path, glob, augmented).drop("content").orderBy("path")


def frame_number(path: Column) -> Column:
    """The number before the first .png of a path's last part; null if there is none."""
    return F.split(F.element_at(F.split(path, "/"), -1), r"\.png")[0].try_cast("long")


def write_images(images: DataFrame, path: str) -> None:
    """Images (video_id, name, data, ...) as Parquet, a folder for each video."""
    images.write.mode("overwrite").partitionBy("video_id").parquet(path)


def images_of(samples: DataFrame, images: DataFrame, first: str = "before", second: str = "after") -> DataFrame:
    """Samples with the contents of both their images (first_data, second_data)."""
    a = images.select(F.col("path").alias(first), F.col("content").alias("first_data"))
    b = images.select(F.col("path").alias(second), F.col("content").alias("second_data"))
    return samples.join(a, first).join(b, second)


def frame_rate(average: Column, nominal: Column) -> Column:
    """The first rate that a file tells, or else 60."""
    return F.coalesce(F.when(average > 0, average), F.when(nominal > 0, nominal), F.lit(FRAMERATE))


def frame_count(told: Column, rate: Column, duration_s: Column) -> Column:
    """The number of frames that a file tells, or else what rate and duration make; 0 without either."""
    return F.coalesce(F.when(told > 0, told.cast("long")), F.floor(rate * duration_s).cast("long"), F.lit(0).cast("long"))


def frame_index(pts: Column, time_base: Column, rate: Column) -> Column:
    """The frame that a time stamp belongs to; halves go to the even number."""
    return F.greatest(F.lit(0), F.rint(pts * time_base * rate)).cast("long")


def write_log(lines: DataFrame, path: str) -> None:
    """Log lines (video_id, step, line) as text, in order within each video."""
    lines.repartition("video_id").sortWithinPartitions("video_id", "step").select("line").write.mode("overwrite").text(path)
