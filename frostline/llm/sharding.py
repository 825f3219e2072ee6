"""Sharding by vector bin packing.

What is placed are groups of equal texts, with three sizes each: bytes, tokens (words) and rows. A group that exceeds
an even share of any of them is split into parts of a quarter of a share. Groups are dealt over blocks by their hash;
in a block, largest first, each goes to the bin where the dot product of its sizes with the bin's residual capacity is
highest, bytes, tokens and rows alike; then the fullest bins exchange items with the emptiest. The bins of FAN blocks are then placed the same way as the bins of a larger block,
those of one block on bins of their own, and so on until one block is left, whose bins are the shards. The law is
`bytes`: sizes are near equal, and so are tokens and rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import append_columns, nonnull_text, stage_table
from .mixing import n_words

SHARDS, GROUPS_PER_BLOCK, FAN, ROUNDS, EVEN = 24, 4000, 128, 64, 0.002
_SIZES = ["bytes", "tokens", "rows"]


def place(sizes: np.ndarray, shards: int, once: bool = False, load: np.ndarray | None = None, share: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item (rows of sizes, one column a dimension): largest first, highest dot product.

    once: no two items on one shard. load: what the shards hold before, updated. share: a shard's capacity.
    """
    share = np.maximum(sizes.sum(axis=0) / shards if share is None else share, 1e-9)
    part = sizes / share
    left = np.ones((shards, sizes.shape[1])) - (0 if load is None else load / share)
    out, free = np.empty(len(sizes), np.int64), np.ones(shards, bool)
    for i in np.lexsort((np.arange(len(sizes)), -part.max(axis=1))).tolist():
        fit = left @ part[i]
        best = int(np.where(free, fit, -np.inf).argmax()) if once else int(fit.argmax())
        free[best] = False
        out[i] = best
        left[best] -= part[i]
    if load is not None:
        np.add.at(load, out, sizes)
    return out


def exchange(sizes: np.ndarray, out: np.ndarray, shards: int) -> np.ndarray:
    """The shards of place(), with the fullest evened out: an item of it goes to one of the emptiest shards, or changes
    places with one of theirs, as long as the fuller of the two becomes less full by that; ROUNDS times at most, and until none exceeds an even share by more than EVEN."""
    part, out = sizes / np.maximum(sizes.sum(axis=0) / shards, 1e-9), out.copy()
    load = np.zeros((shards, sizes.shape[1]))
    np.add.at(load, out, part)
    for _ in range(ROUNDS if shards > 1 else 0):
        fill = load.max(axis=1)
        order = fill.argsort(kind="stable")
        full, low = int(order[-1]), order[:-1][:4]
        own, other = np.flatnonzero(out == full), np.flatnonzero(np.isin(out, low))
        if fill[full] <= 1 + EVEN or not len(own):
            break
        # The last rows stand for empty places of the emptiest shards.
        there = np.concatenate([out[other], low])
        gives = np.concatenate([part[other], np.zeros((len(low), part.shape[1]))])
        change = gives[None, :, :] - part[own][:, None, :]
        worst = np.maximum((load[full] + change).max(axis=2), (load[there][None, :, :] - change).max(axis=2))
        i, j = np.unravel_index(int(worst.argmin()), worst.shape)
        if worst[i, j] >= fill[full] - 1e-9:
            break
        load[full] += change[i, j]
        load[there[j]] -= change[i, j]
        out[own[i]] = there[j]
        if j < len(other):
            out[other[j]] = full
    return out


def _block(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "part"], ignore_index=True)
        sizes = rows[_SIZES].to_numpy(float)
        return rows.assign(bin=exchange(sizes, place(sizes, shards), shards))

    return run


def _merge(shards: int):
    """Bins of some blocks on the bins of one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "bin"], ignore_index=True)
        load, share = np.zeros((shards, len(_SIZES))), rows[_SIZES].to_numpy(float).sum(axis=0) / shards
        put = [place(own[_SIZES].to_numpy(float), shards, once=True, load=load, share=share) for _, own in rows.groupby("block", sort=True)]
        return rows.assign(to=np.concatenate(put))

    return run


def _numbered(names: list[str], shards: int):
    """Counts the rows of each shard that a task has seen."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in source:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            order = np.argsort(shard, kind="stable")
            n = np.bincount(shard, minlength=shards)
            rank = np.empty(len(shard), np.int64)
            rank[order] = np.arange(len(shard)) - np.repeat(np.cumsum(n) - n, n)
            yield append_columns(batch, names, {"_seen": pa.array(rank + seen[shard]), "_task": pa.array(np.full(len(shard), task, np.int32))})
            seen += n

    return run


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    A null text has no bytes, and its size is 8; it is grouped with empty texts. Equal texts share a shard unless they
    exceed an even share. Slots number a shard's rows from 0 without gaps. An empty table gives no rows; other columns
    don't matter.
    """
    text = nonnull_text(F.col(text_col))
    slim = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 8).cast("long").alias("size"), n_words(text).alias("tokens"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))
    slim = stage_table(slim.withColumn("_rid", F.monotonically_increasing_id()))
    groups = slim.groupBy("key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = stage_table(groups)
    total = groups.agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows"), F.count("*")).first()
    shares = [max(1.0, (x or 0) / shards) for x in total[:3]]
    parts = F.ceil(4 * F.greatest(*(F.col(c) / F.lit(s) for c, s in zip(("bytes", "tokens", "rows"), shares, strict=True))))
    hot = groups.withColumn("parts", F.least(parts, F.col("rows"))).where("parts > 4").select(F.col("key").alias("hot"), "parts")
    # No more than three groups for each shard can exceed a share, so this table is bounded.
    rows = slim.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("_rid"), F.col("parts")), F.lit(0)).cast("long")).drop("hot", "parts")
    n_blocks = max(1, -(-(total[3] or 0) // GROUPS_PER_BLOCK))
    units = rows.groupBy("key", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    units = units.withColumn("block", F.pmod(F.xxhash64("key", "part"), F.lit(n_blocks)).cast("int"))
    schema = "key binary, part long, bytes long, tokens long, rows long, block int, bin long"
    units = stage_table(units.groupBy("block").applyInPandas(_block(shards), schema))
    at, bins = ["block", "bin"], units.groupBy("block", "bin").agg(*(F.sum(c).alias(c) for c in _SIZES))
    goes = bins.select(F.col("block").alias("_block"), F.col("bin").alias("_bin"), *at)
    while n_blocks > 1:  # a bin of every block goes to a bin of a block above it
        n_blocks = -(-n_blocks // FAN)
        kind = "block int, bin long, bytes long, tokens long, rows long, up int, to long"
        merged = stage_table(bins.withColumn("up", F.expr(f"block div {FAN}").cast("int")).groupBy("up").applyInPandas(_merge(shards), kind))
        above = merged.select(F.col("block").alias("b"), F.col("bin").alias("n"), "up", "to")
        goes = goes.join(above, (F.col("block") == F.col("b")) & (F.col("bin") == F.col("n"))).select("_block", "_bin", F.col("up").alias("block"), F.col("to").alias("bin"))
        bins = merged.groupBy(F.col("up").alias("block"), F.col("to").alias("bin")).agg(*(F.sum(c).alias(c) for c in _SIZES))
    goes = stage_table(goes.select("_block", "_bin", F.col("bin").cast("int").alias("shard")))
    units = units.join(goes, (F.col("block") == F.col("_block")) & (F.col("bin") == F.col("_bin")))
    units = units.select(F.col("key").alias("_key"), F.col("part").alias("_part"), "shard")
    rows = rows.join(stage_table(units), (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part"))).select("_id", "size", "text_crc32", "shard")
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "size", "text_crc32", "shard"]
    rows = stage_table(rows.mapInArrow(_numbered(names, shards), f"_id {kind}, size long, text_crc32 long, shard int, _seen long, _task int"))
    held = rows.groupBy("shard", "_task").agg(F.count("*").alias("n"))
    held = held.withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("_task")) - F.col("n"))
    held = stage_table(held.select(F.col("shard").alias("_shard"), F.col("_task").alias("_of"), "before"))
    out = rows.join(held, (F.col("shard") == F.col("_shard")) & (F.col("_task") == F.col("_of")))
    slot = (F.col("before") + F.col("_seen")).alias("slot")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
