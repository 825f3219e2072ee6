"""Places and running maxima in the order of each key, for keys of any size.

Without a key of more than CHUNK rows (chunk_for() tells) one window by key does. Otherwise a large key's rows are cut
into chunks of its order's numbers. Windows run inside chunks; what a chunk takes over from those before it comes from
one row per chunk. So a key with a third of all rows is many tasks and not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1 << 20


def order_key(*parts: Column, seed: int) -> Column:
    """A random order that depends on the parts and the seed only, in any engine."""
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def chunk_for(rows: DataFrame, key: str, chunk: int = CHUNK) -> int | None:
    """chunk if a key has more rows than that, else None. Counts at once, from the one column."""
    return None if _large(rows, key, chunk).isEmpty() else chunk


def _large(rows: DataFrame, key: str, chunk: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > chunk)


def _chunked(rows: DataFrame, order: str, chunk: int) -> DataFrame:
    return rows.withColumn("_chunk", F.expr(f"{order} div {chunk}"))


def _with_parts(rows: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    parts = parts.withColumnsRenamed({key: "_key", "_chunk": "_of"})
    return rows.join(parts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_chunk").eqNullSafe(F.col("_of"))).drop("_key", "_of", "_chunk")


def numbered(rows: DataFrame, key: str, order: str, name: str, before: tuple[str, ...] = (), chunk: int | None = CHUNK) -> DataFrame:
    """rows with name, the place in the key's order from 0 on, and for each column c of before, c_before of the row at
    the place before. Numbers of the order, which is whole numbers, occur once in a key. A key of at most chunk rows is
    one chunk, however far apart its numbers are."""
    if chunk is None:
        w = W.partitionBy(key).orderBy(order)
        return rows.withColumns({name: (F.row_number().over(w) - 1).cast("long")} | {f"{c}_before": F.lag(c).over(w) for c in before})
    large = _large(rows, key, chunk).select(F.col(key).alias("_key"), F.lit(True).alias("_many"))  # one key in chunk rows at most
    rows = rows.join(large, F.col(key).eqNullSafe(F.col("_key")), "left")
    rows = _chunked(rows, order, chunk).withColumn("_chunk", F.when(F.col("_many"), F.col("_chunk")).otherwise(0)).drop("_key", "_many")
    inside, across = W.partitionBy(key, "_chunk").orderBy(order), W.partitionBy(key).orderBy("_chunk")
    last = F.struct(order, *before)
    parts = rows.groupBy(key, "_chunk").agg(F.count("*").alias("_n"), F.max_by(last, order).alias("_last"))
    parts = parts.select(key, "_chunk", (F.sum("_n").over(across) - F.col("_n")).alias("_ahead"), F.lag("_last").over(across).alias("_carried"))
    rows = rows.withColumns({"_i": F.row_number().over(inside), "_lag": F.lag(last).over(inside)})
    rows = _with_parts(rows, parts, key).withColumn("_row_before", F.coalesce("_lag", "_carried"))
    rows = rows.withColumns({name: (F.col("_ahead") + F.col("_i") - 1).cast("long")} | {f"{c}_before": F.col("_row_before")[c] for c in before})
    return rows.drop("_i", "_lag", "_ahead", "_carried", "_row_before")


def running_max(rows: DataFrame, key: str, order: str, value: Column, name: str, to: int = 0, chunk: int | None = CHUNK) -> DataFrame:
    """rows with name, the greatest value up to the row in the key's order (to = -1: up to the one before it)."""
    return running_maxima(rows, key, order, {name: value}, to, chunk)


def running_maxima(rows: DataFrame, key: str, order: str, values: dict[str, Column], to: int = 0, chunk: int | None = CHUNK) -> DataFrame:
    """The same for several values by name, in one pass."""
    if chunk is None:
        w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, to)
        return rows.withColumns({name: F.max(value).over(w) for name, value in values.items()})
    rows = _chunked(rows.withColumns({f"_value_{name}": value for name, value in values.items()}), order, chunk)
    across = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(key, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, to)
    parts = rows.groupBy(key, "_chunk").agg(*(F.max(f"_value_{name}").alias(f"_most_{name}") for name in values))
    parts = parts.select(key, "_chunk", *(F.max(f"_most_{name}").over(across).alias(f"_carried_{name}") for name in values))
    rows = _with_parts(rows.withColumns({f"_inside_{name}": F.max(f"_value_{name}").over(inside) for name in values}), parts, key)
    rows = rows.withColumns({name: F.greatest(f"_inside_{name}", f"_carried_{name}") for name in values})
    return rows.drop(*(f"_{part}_{name}" for part in ("inside", "carried", "value") for name in values))
