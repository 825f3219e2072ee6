"""Pictures as PNG files, one each or many in an archive: data sources that write them with commit and abort, and their
pixels read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import png
from .commit import HiddenFolder, Written, file_system

SCHEMA = "name string, width int, height int, data binary"
#: What an archive holds before the next one begins: pictures, and bytes. A task has one in memory.
ARCHIVE_PICTURES, ARCHIVE_BYTES = 1 << 15, 16 << 20
BATCH = 8 << 20  # bytes of pixels that a task puts out at once


class _PictureWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.folder = HiddenFolder(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, here, mine = self.folder.task()
        for batch in iterator:
            for row in batch.select(["name", "width", "height", "data"]).to_pylist():
                self.folder.put(files, here, mine, row["name"], png.encode(row["data"], row["width"], row["height"]))
        return mine

    def commit(self, messages) -> None:
        self.folder.commit(messages)

    def abort(self, messages) -> None:
        self.folder.abort()


class PictureFiles(DataSource):
    """Rows (name, width, height, data: 8-bit grey or RGB) as one PNG file each; name is its path below the target.

    No file is in its place before all tasks have ended. A task that fails, or is run twice, leaves none of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "png_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        _check(schema)
        return _PictureWriter(self.options["path"])


def _check(schema: StructType) -> None:
    missing = {"name", "width", "height", "data"} - set(schema.names)
    if missing:
        raise ValueError(f"pictures need the columns {sorted(missing)}")


class _ArchiveWriter(_PictureWriter):
    """Archives of a task, one after the other. Pictures are stored as they are, as PNG is compressed already."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, here, mine = self.folder.task()
        pictures = (row for batch in iterator for row in batch.select(["name", "width", "height", "data"]).to_pylist())
        block = io.BytesIO()
        archive, n = zipfile.ZipFile(block, "w"), 0
        for row in pictures:
            archive.writestr(zipfile.ZipInfo(row["name"]), png.encode(row["data"], row["width"], row["height"]))
            n += 1
            if n == ARCHIVE_PICTURES or block.tell() >= ARCHIVE_BYTES:
                self._put(archive, block, files, here, mine)
                block = io.BytesIO()
                archive, n = zipfile.ZipFile(block, "w"), 0
        if n:
            self._put(archive, block, files, here, mine)
        return mine

    def _put(self, archive: zipfile.ZipFile, block: io.BytesIO, files: fs.FileSystem, here: str, mine: Written) -> None:
        archive.close()
        self.folder.put(files, here, mine, f"{mine.folder}-{len(mine.names)}.zip", block.getvalue())


@dataclass(frozen=True)
class _Archive(InputPartition):
    path: str


class _ArchiveReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_Archive]:
        """A task for each archive."""
        files, root = file_system(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        return [_Archive(f.path) for f in found if f.type == fs.FileType.File and f.extension == "zip" and "/_" not in f.path[len(root) :]]

    def read(self, partition: _Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are none
            return
        with file_system(self.path)[0].open_input_file(partition.path) as file, zipfile.ZipFile(io.BytesIO(file.read())) as archive:
            rows, size = [], 0
            for name in archive.namelist():
                rows.append((name, *png.decode(archive.read(name))))
                size += len(rows[-1][3]) + len(name)
                if size >= BATCH or len(rows) == ARCHIVE_PICTURES:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"name": pa.string(), "width": pa.int32(), "height": pa.int32(), "data": pa.binary()}
        return pa.RecordBatch.from_pydict({c: pa.array(values, kind) for (c, kind), values in zip(kinds.items(), zip(*rows, strict=True), strict=True)})


class PictureArchives(PictureFiles):
    """The same rows as PNG files in ZIP archives, some to each task: for so many pictures that a file each would leave the
    driver to move and to list millions. A name that comes twice is not noticed."""

    @classmethod
    def name(cls) -> str:
        return "png_archives"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        _check(schema)
        return _ArchiveWriter(self.options["path"])


def write_archives(pictures: DataFrame, path: str) -> None:
    """Writes pictures (name, width, height, data) into archives below path, dealt by name over as many tasks as shuffles
    have; archives that are there stay."""
    spark = pictures.sparkSession
    spark.dataSource.register(PictureArchives)
    rows = pictures.select("name", F.col("width").cast("int"), F.col("height").cast("int"), "data")
    rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name").write.format("png_archives").mode("append").save(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(name, width, height, data) of the pictures in the archives below path."""
    spark.dataSource.register(PictureArchives)
    return spark.read.format("png_archives").load(path)


def write_pictures(pictures: DataFrame, path: str) -> None:
    """Writes pictures (name, width, height, data) below path; files there that are called otherwise stay. A file each is
    moved by the driver and listed by readers: millions belong into archives."""
    pictures.sparkSession.dataSource.register(PictureFiles)
    pictures.select("name", F.col("width").cast("int"), F.col("height").cast("int"), "data").write.format("png_files").mode("append").save(path)


def with_pixels(images: DataFrame) -> DataFrame:
    """images (content: a PNG file) with width, height and data in its stead."""
    names = [c for c in images.columns if c != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name != "content")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [png.decode(x) for x in batch.column(batch.schema.get_field_index("content")).to_pylist()]
            new = {"width": pa.array([w for w, _, _ in found], pa.int32()), "height": pa.array([h for _, h, _ in found], pa.int32()), "data": pa.array([d for _, _, d in found], pa.binary())}
            yield pa.RecordBatch.from_pydict({n: batch.column(batch.schema.get_field_index(n)) for n in names} | new)

    return images.mapInArrow(run, f"{schema}, width int, height int, data binary")


def pair_name(chain: Column, which: Column) -> Column:
    """The file of a chain's picture: a folder for each chain."""
    return F.format_string("chain_%d/%s.png", chain, which)


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(name, width, height, data) of the PNG files below path; name is their path below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(path)
    below = path.rstrip("/").split("://")[-1].removeprefix("file:").strip("/")
    name = F.regexp_replace("path", rf"^.*\Q{below}/\E", "")
    return with_pixels(files.select(name.alias("name"), "content"))
