"""What the operators of this subpackage share: Arrow columns, row keys and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import stage_table


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def append_columns(batch: pa.RecordBatch, names: Iterable[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch, then new ones."""
    kept = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
    return pa.RecordBatch.from_pydict(kept | new)


@contextmanager
def small_batches(spark: SparkSession, rows: str = "1000", size: str = "8m") -> Iterator[None]:
    """Smaller Arrow batches for what is run inside, as whole texts stand in memory several times."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key, None) for key in limits}
    try:
        for key, value in limits.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def nonnull_text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def row_key(df: DataFrame) -> DataFrame:
    """df as rows (_doc, _file, _row): all its columns as one struct, the Parquet file that holds the row and the row's
    number there. No column of df can clash with these.

    Unlike generated ids file and number stay the same whenever the files are read again. A DataFrame that isn't a plain
    scan is staged first.
    """
    try:
        return _located(df)
    except AnalysisException as error:
        if "_metadata" not in str(error):
            raise
        return _located(stage_table(df))


def _located(df: DataFrame) -> DataFrame:
    return df.select(F.struct(*(df[c] for c in df.columns)).alias("_doc"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b: long); root is the smallest node of the component.

    Alternating large-star and small-star rounds: each is a minimum by node (combined before the shuffle) and a join
    that carries the minimum to the node's neighbours, so that a node with very many neighbours is split by Spark's
    skew-join handling. Every round's edges are staged; only a count and a sum reach the driver. Rounds grow with the
    logarithm of the nodes; if there is no fixed point after max_rounds, that is an error.
    """
    now = stage_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    spark, seen = edges.sparkSession, None
    for _ in range(max_rounds):
        facts = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(facts) == seen or not facts[0]:
            break
        seen = tuple(facts)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).where("v <> m")
        now = stage_table(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def component_firsts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, best) for every node of nodes (node: long, first): the least first of the component it is in."""
    roots = stage_table(connected_components(edges).withColumnRenamed("node", "_node"))
    inside = stage_table(nodes.join(roots, F.col("node") == F.col("_node")).select("root", "node", "first"))
    least = stage_table(inside.groupBy("root").agg(F.min("first").alias("best"))).withColumnRenamed("root", "_root")
    moved = inside.join(least, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "best")
    out = nodes.join(moved, F.col("node") == F.col("_node"), "left")
    return stage_table(out.select("node", F.coalesce("best", "first").alias("best")))


@lru_cache(maxsize=1)
def _trim():
    """The C library's way to give memory back that is free, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def lean(run, *held):
    """run, a function over batches of a task, that leaves little behind in the Python worker, which Spark keeps for other
    tasks: what held (cached functions of other work) keeps goes before it begins, free memory when it has ended."""

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cached in held:
            cached.cache_clear()
        try:
            yield from run(source)
        finally:
            pa.default_memory_pool().release_unused()
            if _trim():
                _trim()(0)

    return task


def batches(source: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most so many rows, so that what is derived from a batch stays small."""
    for batch in source:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
