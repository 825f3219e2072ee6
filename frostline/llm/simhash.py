"""SimHash near-dedup by multi-index hashing.

Fingerprints of 64 bits that differ in at most two bits agree in three of four 16-bit quarters but for at most one bit.
So every fingerprint is stored under four keys, each of which leaves one quarter out, and asked for in the Hamming
ball of radius one around the other 48 bits. What a key can hold is bounded by the 65,536 values of the quarter left
out, however many documents there are; whole distances are verified in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, batches, component_firsts, nonnull_text, small_batches, stage_table, utf8

_QUARTER = [np.uint64(0xFFFF << 16 * q) for q in range(4)]


def fingerprint(data: bytes, size: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 values of the word shingles of data; no words give 0."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(words) - size + 1
    for k in range(0, total, 4096):
        spans = zip(starts[k : min(k + 4096, total)].tolist(), ends[k + size - 1 : min(k + 4096, total) + size - 1].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _fingerprints(text_col: str, names: list[str], size: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1024):
            found = np.array([fingerprint(t, size) for t in utf8(batch.column(batch.schema.get_field_index(text_col)))], np.uint64)
            yield append_columns(batch, names, {"fp": pa.array(found.view(np.int64))})

    return run


def _keys(probe: bool):
    """Rows (key, fp) of a column fp: the four stored keys, or those asked for.

    Two fingerprints that differ in one bit of each of two quarters meet where the later of the two quarters is left
    out and the bit of the earlier is flipped; only the one with that bit clear asks, so that a pair meets once.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 4096):
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, owners, exact = [], [], []
            for q in range(4):
                base = fp & ~_QUARTER[q]
                keys.append(_tagged(base, q))
                owners.append(fp)
                exact.append(np.ones(len(fp), bool))
                for bit in range(16 * q) if probe else ():
                    clear = (fp >> np.uint64(bit)) & np.uint64(1) == 0
                    keys.append(_tagged(base[clear] | np.uint64(1 << bit), q))
                    owners.append(fp[clear])
                    exact.append(np.zeros(clear.sum(), bool))
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.concatenate(keys).view(np.int64)), "fp": pa.array(np.concatenate(owners).view(np.int64)), "exact": pa.array(np.concatenate(exact))})

    return run


def _tagged(base: np.ndarray, quarter: int) -> np.ndarray:
    """The 48 bits beside a quarter, and the quarter's number in the bits it leaves free."""
    low = base & np.uint64((1 << 16 * quarter) - 1)
    high = np.uint64(0) if quarter == 3 else base >> np.uint64(16 * quarter + 16) << np.uint64(16 * quarter)
    return (low | high) | np.uint64(quarter << 48)


def links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in the column fp that differ in one or two bits."""
    stored = fingerprints.select("fp").mapInArrow(_keys(False), "k long, fp long, exact boolean").select("k", F.col("fp").alias("a"))
    asked = fingerprints.select("fp").mapInArrow(_keys(True), "k long, fp long, exact boolean").select(F.col("k").alias("k2"), F.col("fp").alias("b"), "exact")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = F.when(F.col("exact"), (F.col("a") < F.col("b")) & (apart <= 2)).otherwise(apart == 2)
    return stored.join(asked, (F.col("k") == F.col("k2")) & near).select("a", "b")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable by links
    of at most two differing bits), kept (one row of each component), then the columns named in carry.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Equal
    fingerprints are one node, so that a group of copies of any size is no pair. A null id counts after all others: a
    component of nulls only has a null component_id. An empty table gives no rows; other columns don't matter.
    """
    slim = docs.select(F.col(id_col).alias("_id"), nonnull_text(F.col(text_col)).alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    names = [c for c in slim.columns if c != "_text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    with small_batches(docs.sparkSession):
        rows = stage_table(slim.mapInArrow(_fingerprints("_text", names, shingle), f"{schema}, fp long").withColumn("_rid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_rid").alias("r")))
    nodes = stage_table(rows.groupBy(F.col("fp").alias("node")).agg(first.alias("first")))
    classes = component_firsts(nodes, links(nodes.select(F.col("node").alias("fp")))).withColumnRenamed("node", "_node")
    out = rows.join(classes, F.col("fp") == F.col("_node"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("_id").alias(id_col), text.alias("fingerprint"), F.col("best.id").alias("component_id"), (F.col("_rid") == F.col("best.r")).alias("kept"), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))
