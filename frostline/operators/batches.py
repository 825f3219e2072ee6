"""The place of every row in a seeded shuffle, and batches of a fixed size.

The shuffle is the order of a hash of the key; rows of one key follow each other by a hash of their ties. A place is the
number of rows of keys before, and the rank among the rows of the key. Rows are counted by key first, so that a key with
very many rows is one row there; keys are counted by the first digits of their hash, 65,536 numbers at most, and summed up
inside those. The rows of a key with many are ranked in parts of their own hash. So no sort is of more than a small share
of the rows, unless that many are alike in key and ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.order import order_key
from ..sources.staging import stage_table

MANY = 1 << 16  # rows of a key that are ranked in one task
_BEFORE = (W.unboundedPreceding, -1)


def _sum_before(n: str, w: W) -> Column:
    return F.coalesce(F.sum(n).over(w.rowsBetween(*_BEFORE)), F.lit(0).cast("long"))


def _key_starts(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """(_key, _n, _start): each key's rows, and how many rows come before them."""
    keys = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    keys = keys.withColumn("_hash", order_key(F.col("_key").cast("string"), seed=seed)).withColumn("_bucket", F.substring("_hash", 1, 4))
    keys = stage_table(keys)
    held = keys.groupBy("_bucket").agg(F.sum("_n").alias("_rows"))  # 65,536 rows at most
    held = held.select(F.col("_bucket").alias("_of"), _sum_before("_rows", W.orderBy("_bucket")).alias("_ahead"))
    inside = W.partitionBy("_bucket").orderBy("_hash", "_key")
    keys = keys.withColumn("_inside", _sum_before("_n", inside)).join(F.broadcast(held), F.col("_bucket") == F.col("_of"))
    return keys.select("_key", "_n", (F.col("_ahead") + F.col("_inside")).alias("_start"))


def global_order(rows: DataFrame, key: str, ties: tuple[str, ...] = (), seed: int = 42, many: int = MANY) -> DataFrame:
    """rows with place, from 0 on without gaps, in the order of the hash of key and seed.

    Rows of one key go by the hash of their ties and the seed, then by the ties, nulls first. Rows alike in key and ties
    take their places in any order. A null key is a key like the others. An empty table gives no rows; a column place that
    is there already is replaced. rows has to give the same rows each time it is read.
    """
    rows = rows.drop("place")
    slim = rows.select(F.struct(*(rows[c] for c in rows.columns)).alias("_row"), rows[key].alias("_k"), *(rows[c].alias(f"_t{i}") for i, c in enumerate(ties)))
    tied = [F.col(f"_t{i}") for i in range(len(ties))]
    out = slim.join(_key_starts(rows, key, seed), F.col("_k").eqNullSafe(F.col("_key")))
    out = out.withColumn("_tie", order_key(*(c.cast("string") for c in tied), seed=seed))
    out = out.withColumn("_part", F.when(F.col("_n") > many, F.substring("_tie", 1, 4)).otherwise(""))
    parts = out.where("_part <> ''").groupBy(F.col("_start").alias("_at"), F.col("_part").alias("_nr")).agg(F.count("*").alias("_rows"))  # 65,536 a key at most
    parts = parts.withColumn("_skip", _sum_before("_rows", W.partitionBy("_at").orderBy("_nr"))).drop("_rows")
    rank = F.row_number().over(W.partitionBy("_start", "_part").orderBy("_tie", *(c.asc_nulls_first() for c in tied))) - 1
    out = out.withColumn("_rank", rank).join(parts, (F.col("_start") == F.col("_at")) & (F.col("_part") == F.col("_nr")), "left")
    place = F.col("_start") + F.col("_rank") + F.coalesce("_skip", F.lit(0).cast("long"))
    return out.select("_row.*", place.alias("place"))


def in_batches(rows: DataFrame, size: int, key: str, ties: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """rows with place and batch, a number from 0 on: batches of size rows, the last one of what is left."""
    return global_order(rows.drop("batch"), key, ties, seed).withColumn("batch", F.expr(f"place div {int(size)}"))


def collated(batched: DataFrame, *columns: str) -> DataFrame:
    """One row per batch: batch, n, and each column as an array in the order of places. A batch is of bounded size."""
    found = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("_rows"))
    return found.select("batch", F.size("_rows").cast("long").alias("n"), *(F.col("_rows")[c].alias(c) for c in columns))
