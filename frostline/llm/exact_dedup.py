"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last 16 bytes says so; each chunk gets a 64-bit identifier, and the text's
recipe is the ordered list of them. Only recipes move between machines, eight bytes for about a kilobyte of text. An
identifier is verified by the chunk catalogue: over the whole corpus all chunks under it must agree in a 128-bit
digest, a checksum and a length. If any pair doesn't, recipes are compared by those wide identifiers instead.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, batches, lean, nonnull_text, small_batches, stage_table, utf8
from .tokens import tokenizer

LEAST, MOST, MASK = 256, 8192, 1023
WIDE = 28  # bytes of a wide identifier: digest, checksum, length
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks: content-defined, each of LEAST to MOST bytes but for the last."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # h[i] then covers the 16 bytes up to i
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends, start = [], 0
    for cut in (np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == 0) + 1).tolist():
        while cut - start > MOST:
            start += MOST
            ends.append(start)
        if cut - start >= LEAST:
            start = cut
            ends.append(cut)
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def recipe_of(data: bytes) -> tuple[bytes, bytes]:
    """Short and wide identifiers of a text's chunks, in order, each list as one byte string."""
    short, wide, start = [], [], 0
    for end in chunk_ends(data):
        chunk = data[start:end]
        digest = hashlib.blake2b(chunk, digest_size=24).digest()
        short.append(digest[:8])
        wide.append(digest[8:] + zlib.crc32(chunk).to_bytes(4, "little") + (end - start).to_bytes(8, "little"))
        start = end
    return b"".join(short), b"".join(wide)


def _describe(text_col: str, names: list[str]):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 512):
            short, wide, sha = [], [], []
            for text in utf8(batch.column(batch.schema.get_field_index(text_col))):
                data = text.translate(None, _SPACE)
                a, b = recipe_of(data)
                short.append(a)
                wide.append(b)
                sha.append(hashlib.sha256(data).hexdigest())
            yield append_columns(batch, names, {"recipe": pa.array(short, pa.binary()), "wide": pa.array(wide, pa.binary()), "text_sha256": pa.array(sha, pa.string())})

    return run


def chunk_catalogue(recipes: DataFrame) -> DataFrame:
    """One row per short identifier: chunk_id, n_uses, verified (all its chunks agree in the wide identifier)."""
    at = F.explode(F.sequence(F.lit(0), (F.length("recipe") / 8 - 1).cast("int"))).alias("i")
    uses = recipes.where(F.length("recipe") > 0).select("recipe", "wide", at)
    uses = uses.select(
        F.conv(F.hex(F.expr("substring(recipe, i * 8 + 1, 8)")), 16, -10).cast("long").alias("chunk_id"),
        F.hex(F.expr("substring(wide, i * 28 + 1, 28)")).alias("w"),
    )
    found = uses.groupBy("chunk_id").agg(F.count("*").alias("n_uses"), F.min("w").alias("a"), F.max("w").alias("b"))
    return found.select("chunk_id", "n_uses", (F.col("a") == F.col("b")).alias("verified"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, then the columns named in carry.

    Texts are equal when they are identical without white space (space, tab to carriage return). Of equal ones the
    text with the most code points stays, then the smallest id, then any one of rows that are alike. Null texts count
    as empty, and empty texts equal each other. A null id comes after all others. An empty table gives no rows; other
    columns don't matter.
    """
    slim = docs.select(
        F.col(id_col).alias("_id"), nonnull_text(F.col(text_col)).alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), F.char_length(nonnull_text(F.col(text_col))).cast("long").alias("_points")
    )
    names = [c for c in slim.columns if c != "_text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    recipes = slim.mapInArrow(lean(_describe("_text", names), tokenizer), f"{schema}, recipe binary, wide binary, text_sha256 string")
    with small_batches(docs.sparkSession):
        recipes = stage_table(recipes.withColumn("_rid", F.monotonically_increasing_id()))
    clash = not chunk_catalogue(recipes).where("NOT verified").isEmpty()
    rows = recipes.withColumn("_key", F.col("wide" if clash else "recipe")).drop("recipe", "wide")
    best = F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_rid").alias("r")))
    groups = stage_table(rows.groupBy("_key").agg(best.alias("b"), F.count("*").alias("group_size")))
    groups = groups.select(F.col("_key").alias("_group"), F.col("b.id").alias("keep_id"), F.col("b.r").alias("_best"), "group_size")
    out = rows.join(groups, F.col("_key") == F.col("_group"))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_rid") == F.col("_best")).alias("kept"), "text_sha256", *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))
