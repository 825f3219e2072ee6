"""Frame tables that are dealt out and sorted once, so that what reads them again needs no shuffle of frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .staging import shared_path

BY_FRAME = ("video_id", "frame_num")  # for overlay and semi-join: a long video is in many buckets
BY_VIDEO = ("video_id",)  # for the matcher, to which a video is one task


def save_bucketed(rows: DataFrame, name: str, columns: tuple[str, ...] = BY_FRAME, buckets: int = 200, path: str | None = None) -> DataFrame:
    """Saves rows as a table in buckets of the columns, each one file sorted by video and frame, and reads it.

    path is where its files go, or else the warehouse. A table of that name is replaced.
    """
    writer = rows.repartition(buckets, *columns).write.format("parquet").bucketBy(buckets, *columns).sortBy(*BY_FRAME).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


def stage_bucketed(rows: DataFrame, columns: tuple[str, ...] = BY_FRAME, buckets: int = 200) -> DataFrame:
    """The same as a table of this session in the folder that all executors share."""
    spark: SparkSession = rows.sparkSession
    return save_bucketed(rows, f"frostline_{uuid.uuid4().hex}", columns, buckets, shared_path(spark))
