"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c are 2 - 2c apart in squared distance. They are rotated to their principal axes, and the
leading axes are dealt over blocks of at most BLOCK_DIMS dimensions; each block has a part of that squared distance as
its budget, in proportion to its variance. Leaving axes out only makes vectors closer, so a pair within the whole
distance is within budget in one block at least. Each block is range-joined: a grid over those of its first axes along
which vectors spread further than the budget's radius brings them to their cell and to the neighbours in reach, where
the block's distances are compared; what is within budget is verified on the whole vectors in double precision. A pair
belongs to the first block that holds it, so that links can be counted where they are found and pairs are never
emitted: a task returns counts and the edges of a spanning forest. A cell's vectors are dealt over tiles of bounded
size, and a task compares two tiles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import component_firsts, stage_table

THRESHOLD = 0.9
BLOCK_DIMS = 12
LEAD = 0.9  # part of the variance that the blocks' axes hold
GRID_AXES = 3
TILE_BYTES = 1 << 23  # of a tile's vectors; a task has two tiles
SAMPLE, SAMPLE_BYTES = 20000, 1 << 26  # vectors that the rotation is fitted on, about, and their bytes as doubles; they affect the cost, not the links
#: Slack in squared distance: of the float32 comparison, and of the rule which block a pair belongs to.
SLACK, OWN_SLACK = 2e-5, 1e-5
_OFFSETS = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) < (0, 0, 0)])


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Block:
    """Columns of the rotated vectors, the budget, and the grid: its columns (none: one cell) and the side of a cell."""

    columns: np.ndarray
    budget: float
    grid: np.ndarray
    side: float

    def cells(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (three numbers, 0 for axes that the grid has not) and the places in them, in sides."""
        at = np.zeros((len(y), GRID_AXES))
        at[:, : len(self.grid)] = y[:, self.grid] / self.side
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def visits(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home): every row in its own cell, and in those before it that hold vectors in reach."""
        cell, at = self.cells(y)
        rows, cells, home = [np.arange(len(y))], [cell], [np.ones(len(y), bool)]
        reach = (self.budget + SLACK) / self.side**2
        for offset in _OFFSETS if len(self.grid) else ():
            if (offset[len(self.grid) :] != 0).any():
                continue
            gap = np.where(offset < 0, at, 1 - at) * (offset != 0)
            near = np.flatnonzero((gap * gap).sum(axis=1) <= reach)
            rows.append(near)
            cells.append(cell[near] + offset)
            home.append(np.zeros(len(near), bool))
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(home)


@dataclass
class Rotation:
    """Rotations by dimension; those not fitted are random but fixed."""

    budget: float
    fitted: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def fit(self, vectors: np.ndarray) -> None:
        x = unit(vectors)
        value, axes = np.linalg.eigh(x.T @ x / len(x) - np.outer(x.mean(axis=0), x.mean(axis=0)))
        self.fitted[x.shape[1]] = axes[:, ::-1].copy(), np.maximum(value[::-1], 0)

    def of(self, dim: int) -> tuple[np.ndarray, list[Block]]:
        """The leading axes and the blocks."""
        if dim not in self.fitted:
            axes = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))[0]
            self.fitted[dim] = axes, np.full(dim, 1.0 / dim)
        axes, value = self.fitted[dim]
        lead = int(np.searchsorted(np.cumsum(value), LEAD * value.sum())) + 1
        lead = min(dim, max(lead, BLOCK_DIMS))
        m = -(-lead // BLOCK_DIMS)
        columns = [np.arange(b, lead, m) for b in range(m)]
        held = np.array([value[c].sum() for c in columns])
        share = np.maximum(held / max(held.sum(), 1e-12), 0.25 / m)
        blocks = []
        for c, budget in zip(columns, self.budget * share / share.sum(), strict=True):
            radius = np.sqrt(budget + SLACK)
            grid = c[:GRID_AXES]
            blocks.append(Block(c, float(budget), grid[np.sqrt(value[grid]) >= radius], float(2 * radius)))
        return axes[:, :lead], blocks


def _by_dim(batch: pa.RecordBatch, kind: str):
    """(rows, vectors) of a batch for each dimension in it."""
    raw = batch.column(batch.schema.get_field_index("embedding"))
    values = np.asarray(raw.flatten().to_numpy(zero_copy_only=False), kind)
    size = raw.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield rows, values[begin[rows][:, None] + np.arange(dim)]


def _where(dim: int, block: int, cells: np.ndarray) -> dict[str, pa.Array]:
    return {"dim": pa.array(np.full(len(cells), dim)), "block": pa.array(np.full(len(cells), block))} | {f"c{i}": pa.array(cells[:, i]) for i in range(GRID_AXES)}


def _count_cells(rotation: Rotation, kind: str):
    def run(source):
        for batch in source:
            for _, x in _by_dim(batch, kind):
                axes, blocks = rotation.of(x.shape[1])
                y = unit(x) @ axes
                for b, block in enumerate(blocks):
                    _, cells, home = block.visits(y)
                    found, at = np.unique(cells, axis=0, return_inverse=True)
                    own = np.bincount(at.ravel(), weights=home, minlength=len(found)).astype(np.int64)
                    every = np.bincount(at.ravel(), minlength=len(found))
                    yield pa.RecordBatch.from_pydict(_where(x.shape[1], b, found) | {"own": pa.array(own), "guests": pa.array(every - own)})

    return run


def _visits(rotation: Rotation, kind: str):
    """A row for each cell that a vector has to be in, with the vector's bytes."""

    def run(source):
        for batch in source:
            node, copies = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("node", "copies"))
            for rows, x in _by_dim(batch, kind):
                axes, blocks = rotation.of(x.shape[1])
                y = unit(x) @ axes
                width = x.shape[1] * x.itemsize
                for b, block in enumerate(blocks):
                    at, cells, home = block.visits(y)
                    for k in range(0, len(at), 4096):
                        part, of = slice(k, k + 4096), rows[at[k : k + 4096]]
                        vectors = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(np.arange(0, (len(of) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x[at[part]]))])
                        yield pa.RecordBatch.from_pydict(_where(x.shape[1], b, cells[part]) | {"home": pa.array(home[part]), "node": pa.array(node[of]), "copies": pa.array(copies[of]), "vector": vectors})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a star for each component of the pairs (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _near(left: np.ndarray, right: np.ndarray | None, budget: float):
    """Pairs of rows (i, j) at a squared distance within budget, in parts; without right, i < j of left alone."""
    other = left if right is None else right
    size = (other * other).sum(axis=1, dtype=np.float32)
    ones = np.ones((len(other), 1), np.float32)
    far = np.ascontiguousarray(np.hstack([-2 * other, ones, size[:, None]]).T)
    size = (left * left).sum(axis=1, dtype=np.float32)
    near = np.hstack([left, size[:, None], np.ones((len(left), 1), np.float32)])
    step = 512
    for k in range(0, len(near), step):
        for c in range(k if right is None else 0, len(other), 4096):
            d = near[k : k + step] @ far[:, c : c + 4096]
            hits = np.flatnonzero(d.ravel() <= budget)
            if len(hits):
                i, j = np.divmod(hits, d.shape[1])
                i, j = i + k, j + c
                yield (i, j) if right is not None else (i[i < j], j[i < j])


def _compare(rotation: Rotation, kind: str, threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, number = key[0].as_py(), key[1].as_py()
        axes, blocks = rotation.of(dim)
        block = blocks[number]
        side, node, copies = (table.column(c).to_numpy() for c in ("side", "node", "copies"))
        x = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(-1, dim))
        y = x @ axes[:, np.concatenate([b.columns for b in blocks[: number + 1]])]
        ends = np.cumsum([len(b.columns) for b in blocks[: number + 1]])
        own = y[:, ends[number] - len(block.columns) :].astype(np.float32)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        counts, edges, held = np.zeros(len(x), np.int64), [], 0
        both = key[5].as_py() == key[6].as_py()
        for i, j in _near(own[left], None if both else own[right], block.budget + SLACK):
            i, j = left[i], (left if both else right)[j]
            for s in range(0, len(i), 1 << 14):
                p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
                linked = (x[p] * x[q]).sum(axis=1) >= threshold
                p, q = p[linked], q[linked]
                if not len(p):
                    continue
                apart = np.add.reduceat((y[p] - y[q]) ** 2, np.concatenate([[0], ends[:-1]]), axis=1)
                within = apart <= np.array([b.budget for b in blocks[: number + 1]]) + OWN_SLACK
                first = within[:, -1] & ~within[:, :-1].any(axis=1)
                p, q = p[first], q[first]
                np.add.at(counts, p, copies[q])
                np.add.at(counts, q, copies[p])
                if len(p):
                    edges.append(_forest(p, q))
                    held += len(edges[-1][0])
                if held > 4 * len(x) + (1 << 16):  # a forest has fewer edges than nodes
                    edges = [_forest(*(np.concatenate(e) for e in zip(*edges, strict=True)))]
                    held = len(edges[0][0])
        if edges:
            edges = [_forest(*(np.concatenate(e) for e in zip(*edges, strict=True)))]
        some = np.flatnonzero(counts)
        a = [node[some]] + [node[e[0]] for e in edges]
        b = [np.full(len(some), -1)] + [node[e[1]] for e in edges]
        n = [counts[some]] + [np.zeros(len(e[0]), np.int64) for e in edges]
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b)), "n": pa.array(np.concatenate(n))})

    return run


def _tasks(visits: DataFrame, cells: DataFrame) -> DataFrame:
    """visits dealt over pairs of tiles (one, other) of their cells, with the side (0, 1) on which they stand there.

    A cell's own vectors are dealt over its tiles, and any two of those meet, each with itself too; its guests are dealt
    over further tiles, which meet the own ones.
    """
    most = F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (4 * F.col("dim"))))
    at_least = F.least(F.lit(3), F.ceil(F.col("own") / 2048))  # so that few large cells are several tasks
    cells = cells.where("own > 0").withColumns({"tiles": F.greatest(F.ceil(F.col("own") / most), at_least).cast("int"), "more": F.ceil(F.col("guests") / most).cast("int")}).drop("own", "guests")
    rows = visits.join(F.broadcast(cells), ["dim", "block", *(f"c{i}" for i in range(GRID_AXES))])  # cells are bounded by the grid, not by rows
    place = F.xxhash64("node")
    mine = F.pmod(place, F.col("tiles")).cast("int")
    meets = lambda one, other, side: F.struct(one.cast("int").alias("one"), other.cast("int").alias("other"), side.cast("int").alias("side"))
    own = F.transform(F.sequence(F.lit(0), F.col("tiles") + F.col("more") - 1), lambda j: meets(F.least(mine, j), F.greatest(mine, j), F.when(j < mine, 1).otherwise(0)))
    guest = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: meets(j, F.col("tiles") + F.pmod(place, F.greatest("more", F.lit(1))), F.lit(1)))
    return rows.select("*", F.inline(F.when(F.col("home"), own).otherwise(guest))).drop("home", "tiles", "more")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: id_col, n_links (other rows linked directly), component_id (the smallest id that is
    reachable), kept (the id is the component's).

    A vector that is null, empty, zero, or has a null or non-finite component links with nothing; so do vectors of
    different lengths. Equal vectors are one node with a number of copies, which link each other. A null id counts
    after all others; with one, kept is false unless its component has nothing else. An empty table gives no rows;
    other columns don't matter.
    """
    rows = stage_table(vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).withColumn("_rid", F.monotonically_increasing_id()))
    kind = "<f4" if "float" in rows.schema["_v"].dataType.simpleString() else "<f8"
    bad = F.exists("_v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("_v").isNotNull() & (F.size("_v") > 0) & ~bad & F.exists("_v", lambda v: v != 0)
    rows = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id")))
    nodes = rows.where("_good").groupBy(F.col("_v").alias("embedding")).agg(F.min("_rid").alias("node"), F.count("*").alias("copies"), first.alias("first"))
    nodes = stage_table(nodes)
    rotation = Rotation(2 - 2 * threshold)
    total, entries = nodes.agg(F.count("*"), F.sum(F.size("embedding").cast("double"))).first()
    share = min(1.0, SAMPLE / max(total, 1), SAMPLE_BYTES / max(8 * (entries or 0), 1))
    few = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1_000_000 * share)).select("embedding").limit(2 * SAMPLE)
    sample = few.toArrow().column("embedding").combine_chunks()
    lengths = pc.list_value_length(sample).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        found = sample.take(pa.array(np.flatnonzero(lengths == dim)))
        if len(found) > dim:
            rotation.fit(found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), dim).astype(kind))
    slim = nodes.select("node", "copies", "embedding")
    place = ["dim", "block", *(f"c{i}" for i in range(GRID_AXES))]
    where = ", ".join(f"{c} long" for c in place)
    cells = slim.mapInArrow(_count_cells(rotation, kind), f"{where}, own long, guests long").groupBy(*place).agg(F.sum("own").alias("own"), F.sum("guests").alias("guests"))
    visits = slim.mapInArrow(_visits(rotation, kind), f"{where}, home boolean, node long, copies long, vector binary")
    tasks = _tasks(visits, stage_table(cells))
    found = tasks.groupBy(*place, "one", "other").applyInArrow(_compare(rotation, kind, threshold), "a long, b long, n long")
    found = stage_table(found)
    classes = component_firsts(nodes.select("node", "first"), found.where("b >= 0").select("a", "b"))
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("n"))
    facts = nodes.join(counts, F.col("node") == F.col("a"), "left").select("embedding", F.col("node").alias("_of"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    facts = stage_table(facts.join(classes, F.col("_of") == F.col("node")).select("embedding", "n_links", F.col("best.id").alias("component_id")))
    linked = rows.where("_good").join(facts, F.col("_v") == F.col("embedding")).select("_id", "n_links", "component_id")
    alone = rows.where("NOT _good").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
