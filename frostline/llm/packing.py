"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths decide, and there are no more of them than tokens in a sequence. So the plan is made from the histogram of
lengths: for the longest left, whatever single length, pair or triple fills its gap exactly is looked up in an index of
sums and consumed as often as there are enough of each; what has no exact complement, and what is shorter than the
length at which that stops to pay, is put where it fits best. Every step uses up a length, so the plan has some thousands of patterns at most, for any number of documents. Pieces then
find their places by their rank among those of their length, which is counted in parts of bounded size.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import append_columns, batches, lean, nonnull_text, small_batches, stage_table, utf8
from .tokens import tokenizer

CAPACITY = 2048
PART = 1 << 18  # pieces of one length that a task ranks, about
STOPS = 16  # lengths down to which complements are consumed, that are tried
Pattern = tuple[int, list[int]]  # how many sequences, lengths in each


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class SumIndex:
    """The lengths left, and under each sum the pairs of them that make it; triples are a length and a pair.

    pairs[s] is how many pairs of lengths that are left make s. It is kept up as lengths run out, which each does once.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.size, self.left = len(counts) - 1, counts.copy()
        here = (self.left > 0).astype(np.int64)
        both = np.zeros(2 * self.size + 1, np.int64)
        for x in np.flatnonzero(here).tolist():  # x as the longer of two; twice x if there are two
            both[x : 2 * x] += here[:x]
            both[2 * x] += self.left[x] > 1
        self.pairs = both[: self.size + 1].copy()

    def take(self, length: int, n: int) -> None:
        before = int(self.left[length])
        self.left[length] = before - n
        if before > 1 >= before - n and 2 * length <= self.size:
            self.pairs[2 * length] -= 1
        if before == n:
            here = self.left[: self.size - length + 1] > 0
            self.pairs[length : length + len(here)] -= here

    def pair(self, gap: int, used: Counter) -> list[int] | None:
        """Two lengths that sum to gap: those of which the most are left beside the used ones."""
        if not self.pairs[gap]:
            return None
        low = np.arange(1, gap // 2 + 1)
        n = np.minimum(self._free(low, used), self._free(gap - low, used))
        if gap % 2 == 0:
            n[-1] = self._free(low[-1:], used)[0] // 2
        best = int(n.argmax()) if len(n) else 0
        return [gap - int(low[best]), int(low[best])] if len(n) and n[best] > 0 else None

    def _free(self, lengths: np.ndarray, used: Counter) -> np.ndarray:
        free = self.left[lengths]
        for x, k in used.items():
            free = free - k * (lengths == x)
        return free

    def complement(self, gap: int, used: Counter) -> list[int] | None:
        """One to three lengths that sum to gap, beside the used ones."""
        if self.left[gap] > used[gap]:
            return [gap]
        if found := self.pair(gap, used):
            return found
        longest = np.arange(gap - 1, 0, -1)
        for x in longest[(self.left[longest] > 0) & (self.pairs[gap - longest] > 0)].tolist():
            if 3 * x < gap:
                break
            if self.left[x] > used[x] and (found := self.pair(gap - x, used + Counter([x]))):
                return [x, *found]
        return None


def n_sequences(plan: list[Pattern]) -> int:
    return sum(times for times, _ in plan)


def plan_sequences(counts: np.ndarray) -> list[Pattern]:
    """Patterns that hold counts[l] pieces of each length l in as few sequences of len(counts) - 1 as it can.

    Exact complements are consumed for lengths from the longest down to some shortest one, and what is left then goes by
    best fit. Short pieces are what best fit lives on, so how far down is best differs; STOPS of them are tried.
    """
    counts = counts.astype(np.int64)
    counts[0] = 0
    size = len(counts) - 1
    stops = sorted({max(1, size * i // STOPS) for i in range(STOPS)} | {int(np.flatnonzero(counts).max(initial=1))}, reverse=True)
    best: list[Pattern] | None = None
    for plan, left in _complements(counts, stops):
        if best is None or n_sequences(plan) + -(-int(left @ np.arange(size + 1)) // size) < n_sequences(best):  # it could be
            whole = plan + _best_fit(left)
            best = whole if best is None or n_sequences(whole) < n_sequences(best) else best
    return best or []


def _complements(counts: np.ndarray, stops: list[int]) -> Iterator[tuple[list[Pattern], np.ndarray]]:
    """From the longest length on: exact complements as often as there are enough of each, after one best fit or more
    where there is none at once. At each of the stops, which fall: the patterns so far, and how many of each length are
    left, those among them that nothing complements."""
    index, size = SumIndex(counts), len(counts) - 1
    over, plan, wanted = np.zeros(size + 1, np.int64), [], set(stops)
    for length in range(size, 0, -1):
        while index.left[length]:
            items, gap, more = Counter([length]), size - length, []
            while gap and not (more := index.complement(gap, items)):
                fits = np.flatnonzero(index._free(np.arange(gap + 1), items) > 0)
                if not len(fits):
                    break
                items[int(fits[-1])] += 1
                gap -= int(fits[-1])
            if gap and not more:
                n = int(index.left[length])
                over[length] += n
                index.take(length, n)
                break
            items += Counter(more if gap else [])
            times = min(int(index.left[x]) // n for x, n in items.items())
            plan.append((times, sorted(items.elements(), reverse=True)))
            for x, n in items.items():
                index.take(x, times * n)
        if length in wanted:
            yield plan[:], over + index.left


def _best_fit(counts: np.ndarray) -> list[Pattern]:
    """Longest first into the fullest open sequences that have room; equal sequences are one entry."""
    size = len(counts) - 1
    gaps: list[int] = []
    open_: dict[int, list[Pattern]] = {}

    def add(times: int, items: list[int], gap: int) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((times, items))

    for length in range(size, 0, -1):
        n = int(counts[length])
        while n:
            gap = next((g for g in gaps if g >= length), None)
            if gap is None:
                per = size // length
                if n >= per:
                    add(n // per, [length] * per, size - per * length)
                if n % per:
                    add(1, [length] * (n % per), size - n % per * length)
                break
            times, items = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.remove(gap)
            used = min(times, n)
            if times > used:
                add(times - used, items, gap)
            add(used, [*items, length], gap - length)
            n -= used
    return [p for group in open_.values() for p in group]


def _slots(plan: list[Pattern]) -> dict[str, np.ndarray]:
    """For pieces in order of (length, rank): from which index on which pattern holds them, and where."""
    rows, first = [], 0
    for times, items in plan:
        offset = 0
        for length, n in sorted(Counter(items).items(), reverse=True):
            rows.append((length, times * n, n, first, offset))
            offset += n * length
        first += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    begins = np.concatenate([[0], np.cumsum(table[:, 1])])[:-1].astype(np.int64)
    return {"length": table[:, 0], "begins": begins, "each": table[:, 2], "first": table[:, 3], "offset": table[:, 4]}


def _pieces(text_col: str, names: list[str], path: str, size: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(path).ids
        for batch in batches(source, 1024):
            rows, out = [], []
            for row, text in enumerate(utf8(batch.column(batch.schema.get_field_index(text_col)))):
                ids = ids_of(text) + bytes(4)
                for start in range(0, len(ids), 4 * size):
                    part = ids[start : start + 4 * size]
                    length = len(part) // 4
                    rows.append(row)
                    out.append((start // (4 * size), start // 4, length, zlib.crc32(part)))
            if rows:
                cols = list(zip(*out, strict=True))
                new = {"piece": pa.array(cols[0], pa.int32())} | {n: pa.array(c, pa.int64()) for n, c in zip(("start", "length", "ids_crc32"), cols[1:], strict=True)}
                yield append_columns(batch.select(names).take(pa.array(rows)), names, new)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = CAPACITY) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and id 0; only one longer than size is cut, into pieces of size tokens and a rest. Null
    and empty texts are the one id 0. Rows with the same id are documents of their own. An empty table gives no rows;
    other columns don't matter. Strings of special tokens in a text become those tokens, as the tokenizer does by
    itself.
    """
    path = path or default_tokenizer()
    slim = docs.select(F.col(id_col).alias("_id"), nonnull_text(F.col(text_col)).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long"
    with small_batches(docs.sparkSession):
        pieces = stage_table(slim.mapInArrow(lean(_pieces("_text", ["_id"], path, size)), schema).withColumn("_rid", F.monotonically_increasing_id()))
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most size rows
        counts[row.length] = row.n
    slots = _slots(plan_sequences(counts))
    ahead = np.concatenate([[0], np.cumsum(counts)])[:-1]
    # A piece's rank among its length: those in the parts before its own, and its place there. A length has a part for
    # each PART of its pieces, so the table of parts has at most size rows and one for each PART pieces.
    lengths = np.flatnonzero(counts)
    parts = docs.sparkSession.createDataFrame(pa.table({"_length": lengths, "parts": -(-counts[lengths] // PART)}))
    pieces = pieces.join(F.broadcast(parts), F.col("length") == F.col("_length")).withColumn("part", F.pmod(F.xxhash64("_rid"), F.col("parts"))).drop("_length", "parts")
    held = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    held = stage_table(held.select(F.col("length").alias("_length"), F.col("part").alias("_part"), (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")))

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = ahead[length] + rank
            slot = np.searchsorted(slots["begins"], at, side="right") - 1
            nth, each = at - slots["begins"][slot], slots["each"][slot]
            new = {"sequence_id": pa.array(slots["first"][slot] + nth // each), "offset": pa.array(slots["offset"][slot] + nth % each * length)}
            yield append_columns(batch, ["_id", "piece", "start", "length", "ids_crc32"], new)

    within = F.row_number().over(W.partitionBy("length", "part").orderBy("_rid")) - 1
    ranked = pieces.withColumn("within", within).join(held, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")))
    ranked = ranked.select("_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))
    out = ranked.mapInArrow(lean(place), f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)
