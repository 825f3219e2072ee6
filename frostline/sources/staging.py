"""Tables in the folder that all executors share, and streams that run over them to their end."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs on
    one machine (tests). On a cluster it has to be set: executors would write to disks of their own otherwise."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="frostline-")
        sc.setCheckpointDir(found)
    return found


_STAGED: list[str] = []


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes with free_staged() or when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/frostline-{uuid.uuid4().hex}"
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    _STAGED.append(path)
    return path


def free_staged(spark: SparkSession, since: int = 0) -> None:
    """Deletes what was staged, from the since-th path on (n_staged() tells how many there are).

    Results that were not written yet read what they were staged from, so this is for a caller that has written them.
    """
    while len(_STAGED) > since:
        system, where = _file_system(spark, _STAGED.pop())
        system.delete(where, True)


def n_staged() -> int:
    return len(_STAGED)


def stage_table(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again.

    Lineage ends there: a lost executor costs the tasks it ran, not the steps before.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_stream(df: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """df as a stream that comes in batches of some of its files."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that map states and timers need, for streams that start inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_stream(stream: DataFrame, partitions: int | None = None) -> DataFrame:
    """What a stream has put out once it has gone through all there is.

    Its state is dealt over the given number of partitions, or else as many as shuffles have; a stream keeps that number
    for good, whatever the session says later.
    """
    spark = stream.sparkSession
    out, before = shared_path(spark), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions or before)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark)).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.schema(stream.schema).parquet(out)
