"""Near dedup by SimHash fingerprints and by the Jaccard similarity of word shingles.

Candidates share a band of MinHash values and have like sketches: four bits of each value, so that a pair at a
similarity of 0.8 differs in 64 of 640 bits, with a deviation of 12, and unrelated ones in 320. Every link is verified on
the whole shingle sets, which move for candidates only. A group of any size is linked to one random node in each band
first, and only nodes of a band that are still apart after that are compared. Few of them in a band are paired by a
join. Many are dealt over tiles together with their sets: a task compares two tiles and puts out links only, so that a
large group of texts that are nearly similar enough makes no rows of pairs.

Where fingerprints are asked for, texts are linked by those of operation 6 too: at two differing bits or fewer, whatever
their similarity. A component is what both kinds of links reach together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, batches, component_firsts, connected_components, lean, nonnull_text, small_batches, stage_table, utf8
from .simhash import fingerprint
from .simhash import links as fingerprint_links
from .tokens import tokenizer

#: A pair at similarity s meets in no band with probability (1 - s^ROWS)^BANDS: 3 in a million at 0.8.
BANDS, ROWS = 32, 5
LONGS = BANDS * ROWS // 16  # of a sketch
#: A band in which more nodes than this are apart from the main component is compared by tiles.
FEW = 8
#: What a tile holds on average at most: nodes, and bytes of their sets.
TILE_NODES, TILE_BYTES = 1024, 1 << 23
SALTS = 64
#: Standard deviations by which the sketches of a pair at the similarity looked for may differ beyond the mean.
SLACK = 6
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: bytes, size: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 values of the word shingles of data, sorted, each once; a text of fewer words is one shingle."""
    words = data.lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, spans = xxhash.xxh64_intdigest, zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - size + 1))


def least_values(found: np.ndarray) -> np.ndarray:
    """The MinHash values of a shingle set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 1024):
        least = np.minimum(least, (_FACTORS[:, None] * found[None, k : k + 1024] + _SHIFTS[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def sketch(least: np.ndarray) -> np.ndarray:
    """Four mixed bits of each value, sixteen values in a long."""
    bits = (least * _MIX >> np.uint64(60)).reshape(LONGS, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def most_bits(similarity: float) -> int:
    """How many bits the sketches of a pair differ in at most: of each value that isn't the same two of four, on average."""
    apart = 1 - similarity
    n = BANDS * ROWS
    return int(2 * apart * n + SLACK * (n * (5 * apart - 4 * apart * apart)) ** 0.5) + 1


def _unlike(a: Column, b: Column) -> Column:
    """The number of bits in which two sketches differ."""
    return reduce(add, (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(LONGS)))


def _sets(text_col: str, names: list[str], size: int, simhash: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1024):
            texts = list(utf8(batch.column(batch.schema.get_field_index(text_col))))
            found = [shingles(t, size) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64)
            held = [np.unique(s.astype(np.uint32)) for s in found]
            new = {"node": pa.array(node.view(np.int64)), "n": pa.array([len(s) for s in held], pa.int64())}
            least = [least_values(s) if len(s) else None for s in found]
            lists = {name: pa.array([[] if x is None else f(x).view(np.int64) for x in least], pa.list_(pa.int64())) for name, f in (("keys", band_keys), ("sketch", sketch))}
            if simhash:
                lists["fp"] = pa.array(np.array([fingerprint(t, simhash) for t in texts], np.uint64).view(np.int64))
            yield append_columns(batch, names, new | lists | {"held": pa.array([s.tobytes() for s in held], pa.binary())})

    return run


def _similar(least: float):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both / (len(x) + len(y) - both) >= least)
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(near, pa.bool_()))

    return run


def verified(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b), each counted once, whose sets (rows: node, held) are similar enough."""
    pairs = stage_table(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = stage_table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = rows.select("node", "held").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("held").alias("held"))
    left, right = sets.select(F.col("node").alias("a"), F.col("held").alias("x")), sets.select(F.col("node").alias("b"), F.col("held").alias("y"))
    with small_batches(rows.sparkSession):
        return stage_table(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(_similar(similarity)), "a long, b long"))


class _Tile:
    """Nodes of a tile as arrays, and their sets one after the other."""

    def __init__(self, table: pa.Table) -> None:
        def longs(name: str) -> np.ndarray:
            return table.column(name).to_numpy().astype(np.int64)

        def lists(name: str) -> np.ndarray:
            return pc.list_flatten(table.column(name)).to_numpy().astype(np.int64)

        self.node, self.root, self.n = longs("node"), longs("root"), longs("n")
        self.keys = lists("keys").reshape(-1, BANDS)
        self.sketch = lists("sketch").view(np.uint64).reshape(-1, LONGS)
        self.held = np.frombuffer(b"".join(table.column("held").to_pylist()), np.uint32)
        self.start = np.cumsum(self.n) - self.n

    def shared(self, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many values of a sorted set each of the sets at these places has."""
        sizes = self.n[at]
        first = np.cumsum(sizes) - sizes
        values = self.held[np.repeat(self.start[at] - first, sizes) + np.arange(sizes.sum())]
        place = np.minimum(np.searchsorted(found, values), len(found) - 1)
        return np.add.reduceat((found[place] == values).astype(np.int64), first)


def _tile_links(similarity: float, like: int):
    """Links between the two tiles of a cell, or inside one. A pair is verified in the first band that it shares."""

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        key, inside = table.column("k")[0].as_py(), not table.column("across")[0].as_py() and table.column("i")[0] == table.column("j")[0]
        one = _Tile(table.filter(pa.array(left)))
        two = one if inside else _Tile(table.filter(pa.array(~left)))
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(len(one.node)):
            at = np.arange(i + 1 if inside else 0, len(two.node))
            sized = np.minimum(two.n[at], one.n[i]) >= similarity * np.maximum(two.n[at], one.n[i]) - 1e-6
            at = at[sized & (two.root[at] != one.root[i])]
            at = at[np.bitwise_count(two.sketch[at] ^ one.sketch[i]).sum(axis=1) <= like]
            at = at[one.keys[i][np.argmax(two.keys[at] == one.keys[i], axis=1)] == key]
            if len(at):
                both = two.shared(one.held[one.start[i] : one.start[i] + one.n[i]], at)
                at = at[both / (one.n[i] + two.n[at] - both) >= similarity]
                ends.append((np.full(len(at), one.node[i]), two.node[at]))
        a, b = (np.concatenate([e[x] for e in ends] or [np.empty(0, np.int64)]) for x in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def tiled(members: DataFrame, rows: DataFrame, similarity: float, nodes: int, size: int) -> DataFrame:
    """Links (a, b) between nodes of a band that differ in root, unless both have the main one; members has k, node, n,
    root and main.

    Nodes of the main component and others are dealt at random over tiles of their own. A cell is two tiles of others, or
    one of others and one of the main component.
    """
    count, weight = F.ceil(F.count("*") / nodes), F.ceil(F.sum("n") * 4 / size)
    parts = members.groupBy("k", (F.col("root") == F.col("main")).alias("inner")).agg(F.greatest(count, weight).alias("t"))
    parts = parts.groupBy("k").agg(F.max(F.when(~F.col("inner"), F.col("t"))).alias("others"), F.max(F.when(F.col("inner"), F.col("t"))).alias("mains"))
    # a band may hold a third of all nodes, so its row of parts is there for each of SALTS shares of them
    shares = parts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = members.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    dealt = shared.join(shares, ["k", "share"]).drop("share").withColumn("inner", F.col("root") == F.col("main"))
    dealt = dealt.withColumn("t", F.pmod(F.xxhash64("node", "k"), F.when(F.col("inner"), F.col("mains")).otherwise(F.col("others"))))

    def cell(across: bool, i: Column, j: Column, left: Column) -> Column:
        return F.struct(F.lit(across).alias("across"), i.alias("i"), j.alias("j"), left.alias("left"))

    def each(upto: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1), make)

    t = F.col("t")
    of_main = each("others", lambda i: cell(True, i, t, F.lit(False)))
    of_other = F.concat(
        each("others", lambda j: cell(False, F.least(t, j), F.greatest(t, j), t <= j)),
        each("mains", lambda j: cell(True, t, j, F.lit(True))),
    )
    cells = dealt.select("k", "node", "n", "root", F.explode(F.when(F.col("inner"), of_main).otherwise(of_other)).alias("c"))
    wanted = stage_table(members.select("node").distinct())
    sets = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("held").alias("held"))
    whole = cells.select("k", "node", "n", "root", "c.*").join(sets, "node")
    found = whole.groupBy("k", "across", "i", "j").applyInArrow(_tile_links(similarity, most_bits(similarity)), "a long, b long")
    with small_batches(rows.sparkSession):
        return stage_table(found)


def links(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that join all that are linked by a similarity of at least so much; rows has node, n, keys,
    sketch and held. A pair whose ends are joined by others may be missing."""
    like = most_bits(similarity)
    sketches = stage_table(rows.where("n > 0").groupBy("node").agg(F.first("sketch").alias("sketch")))
    other = sketches.select(F.col("node").alias("_other"), F.col("sketch").alias("_sketch"))
    bands = rows.select("node", "n", F.explode("keys").alias("k"))
    ends = bands.groupBy("k").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min_by("node", F.xxhash64("node", "k")).alias("hub")).where("lo <> hi")
    shared = stage_table(bands.join(ends.select("k", "hub"), "k").distinct())
    hubs = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    hubs = hubs.join(sketches, F.col("a") == F.col("node")).join(other, F.col("b") == F.col("_other")).where(_unlike(F.col("sketch"), F.col("_sketch")) <= like)
    first = verified(hubs.select("a", "b"), rows, similarity)
    roots = stage_table(connected_components(first).toDF("node", "root"))
    parted = shared.select("k", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parted = stage_table(parted)
    by = parted.groupBy("k", "root").agg(F.count("*").alias("c"))
    main = by.groupBy("k").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all")).where("all > m.c")
    mixed = stage_table(parted.join(main.select("k", F.col("m.root").alias("main"), (F.col("all") - F.col("m.c") > FEW).alias("many")), "k"))
    here = stage_table(mixed.where("NOT many").join(sketches, "node"))
    small = here.where("root <> main").select("k", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("sketch").alias("_sketch"))
    apart = (F.col("root") != F.col("ra")) & ((F.col("root") == F.col("main")) | (F.col("a") < F.col("node")))
    sized = F.least("n", "na") >= similarity * F.greatest("n", "na") - 1e-6
    near = small.join(here.withColumnRenamed("k", "_k"), (F.col("k") == F.col("_k")) & apart & sized & (_unlike(F.col("sketch"), F.col("_sketch")) <= like))
    paired = verified(near.select("a", F.col("node").alias("b")), rows, similarity)
    return first.unionAll(paired).unionAll(tiled(mixed.where("many"), rows, similarity, TILE_NODES, TILE_BYTES))


def _of_fingerprints(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that join all whose fingerprints are equal or linked: each node with one of its component."""
    made = stage_table(rows.select("node", "fp").distinct())
    roots = stage_table(connected_components(fingerprint_links(made.select("fp").distinct())).toDF("_fp", "root"))
    made = made.join(roots, F.col("fp") == F.col("_fp"), "left").select("node", F.coalesce("root", "fp").alias("root"))
    hubs = made.groupBy("root").agg(F.min("node").alias("hub"))
    return stage_table(made.join(hubs, "root").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, carry: tuple[str, ...] = (), simhash: int = 0
) -> DataFrame:
    """One row per row of docs: id_col, component_id (the smallest id reachable by links of texts whose sets of word
    shingles have at least that Jaccard similarity), kept (one row of each component), then the columns named in carry.
    Shingles are told apart by 32 bits where pairs are verified. With simhash, the words of a shingle for it, texts whose
    SimHash fingerprints differ in two bits or fewer are linked too.

    Null and empty texts, and texts of white space, have the empty set and are equal. Equal sets are one node. A null
    id counts after all others. An empty table gives no rows; other columns don't matter.
    """
    slim = docs.select(F.col(id_col).alias("_id"), nonnull_text(F.col(text_col)).alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    names = [c for c in slim.columns if c != "_text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    found = slim.mapInArrow(lean(_sets("_text", names, shingle, simhash), tokenizer), f"{schema}, node long, n long, keys array<long>, sketch array<long>, {'fp long, ' * bool(simhash)}held binary")
    with small_batches(docs.sparkSession):
        rows = stage_table(found.withColumn("_rid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_rid").alias("r")))
    nodes = stage_table(rows.groupBy("node").agg(first.alias("first")))
    found = links(rows, similarity)
    found = found.unionAll(_of_fingerprints(rows)) if simhash else found
    classes = component_firsts(nodes, found).withColumnRenamed("node", "_node")
    out = rows.join(classes, F.col("node") == F.col("_node"))
    return out.select(F.col("_id").alias(id_col), F.col("best.id").alias("component_id"), (F.col("_rid") == F.col("best.r")).alias("kept"), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))
