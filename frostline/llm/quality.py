"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are covered by chunks that overlap by a filter's width less one, so that every window of the
text is seen once. Beside its bytes a window has a second channel: whether it ends an echo, bytes that repeat what stood
right before them, which no filter of a few bytes could tell. What an echo adds to each filter is learned, from a start
that favours neither label, and larger than that of the letters, so that few labels are enough to learn from it. Learned filters run over each chunk and are max-pooled; the mean and the maximum of the chunks'
pools are combined into one probability. Training is on the driver, from a bounded sample of labelled rows; scoring is
one pass over all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import append_columns, batches, free_name, lean, nonnull_text, utf8
from .tokens import tokenizer

WIDTH, FILTERS, STEP = 6, 16, 512  # a chunk is STEP + WIDTH - 1 bytes; STEP is a power of two, WIDTH even
ECHO, LAGS = 12, range(2, 33)  # bytes that must repeat, 8 to 16, and how far before they may stand
PART = 1 << 16  # bytes looked at together for echoes
SAMPLE = 1500  # labelled documents of each label that are learned from, about
MOST_BYTES = 1 << 17  # longer texts are not learned from, which bounds the sample; all are scored whole
STEPS, BATCH, RATE, SEED = 600, 24, 0.01, 7
KEPT_BYTES = 1 << 14  # texts up to so long are taken apart once for all steps
THRESHOLD, FOLDS = 0.3, 5


def echoes(data: bytes) -> np.ndarray:
    """Where the last ECHO bytes equal those some lag before them; a long text in parts, with what they look back on."""
    reach = LAGS[-1] + ECHO
    if len(data) <= PART:
        return _echoes(data)
    return np.concatenate([_echoes(data[max(0, k - reach) : k + PART])[min(k, reach) :] for k in range(0, len(data), PART)])


def _echoes(data: bytes) -> np.ndarray:
    out = np.zeros(len(data), bool)
    if len(data) < LAGS[0] + ECHO:
        return out
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()  # the eight bytes from each place on
    # Of five equal words in a row one stands at a multiple of four: most texts have no echo, and this tells.
    behind = np.concatenate([np.zeros(LAGS[-1], np.uint64), words])
    here = words[::4]
    if not (here[:, None] == np.lib.stride_tricks.as_strided(behind, (len(here), len(LAGS)), (32, 8))).any():
        return out
    for lag in LAGS[: max(0, len(data) - ECHO - LAGS[0] + 1)]:
        same = words[lag:] == words[:-lag]
        if same.any():
            out[lag + ECHO - 1 :] |= same[: len(same) + 8 - ECHO] & same[ECHO - 8 :]
    return out


@dataclass
class Network:
    """table[j, b]: what byte b at place j of a window adds to each filter; echo: what an echo adds."""

    table: np.ndarray
    echo: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    pairs: list[np.ndarray] | None = None

    def padded(self, data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """The bytes of whole chunks, with zeros behind the text, the echoes that windows end, the number of chunks."""
        n = max(1, -(-(len(data) - WIDTH + 1) // STEP))
        x = np.zeros(n * STEP + WIDTH - 1, np.uint8)
        x[: len(data)] = np.frombuffer(data, np.uint8)
        ends = np.zeros(n * STEP, np.float32)
        found = echoes(data)[WIDTH - 1 :]
        ends[: len(found)] = found
        return x, ends, n

    def pools(self, data: bytes) -> np.ndarray:
        """Each chunk's pool of each filter, before the ReLU, with what two neighbouring bytes add looked up at once."""
        if self.pairs is None:
            self.pairs = [(self.table[j][None, :] + self.table[j + 1][:, None]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]
        x, ends, n = self.padded(data)
        pools = np.empty((n, FILTERS), np.float32)
        for k in range(0, n, 8):
            m = min(8, n - k)
            part = x[k * STEP : (k + m) * STEP + WIDTH - 1]
            part = part[:-1] + (part[1:].astype(np.intp) << 8)
            r = self.pairs[0].take(part[: m * STEP], axis=0, mode="clip")
            for j in range(1, WIDTH // 2):
                r += self.pairs[j].take(part[2 * j : 2 * j + m * STEP], axis=0, mode="clip")
            if (here := ends[k * STEP : (k + m) * STEP]).any():
                r += here[:, None] * self.echo
            r, half = r.reshape(m, STEP, FILTERS), STEP // 2
            while half:
                r, half = np.maximum(r[:, :half], r[:, half:]), half // 2
            pools[k : k + m] = r[:, 0]
        return pools

    def combine(self, pools: np.ndarray) -> tuple[float, np.ndarray]:
        active = np.maximum(pools + self.bias, 0)
        z = float(np.concatenate([active.mean(axis=0), active.max(axis=0)]) @ self.weights + self.offset)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), active

    def score(self, data: bytes) -> float:
        return float(self.combine(self.pools(data))[0])


class Batch:
    """The chunks of some texts, one after the other, with the echoes that their windows end."""

    def __init__(self, net: Network, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.net = net
        self.size = np.array([len(x) for x, _ in texts])
        self.first = np.cumsum(self.size) - self.size
        self.x, self.ends = (np.concatenate(c) for c in zip(*texts, strict=True))
        self.pools, self.places = np.empty((len(self.x), FILTERS), np.float32), np.empty((len(self.x), FILTERS), np.int64)
        for k in range(0, len(self.x), 32):
            part = self.x[k : k + 32]
            r = net.table[0][part[:, :STEP]]
            for j in range(1, WIDTH):
                r += net.table[j][part[:, j : j + STEP]]
            r += self.ends[k : k + 32, :, None] * net.echo
            self.places[k : k + 32] = at = r.argmax(axis=1)
            self.pools[k : k + 32] = np.take_along_axis(r, at[:, None], 1)[:, 0]

    def gradients(self, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, for the table, the bias, the weights, the offset and the echoes."""
        net = self.net
        active = np.maximum(self.pools + net.bias, 0)
        top = np.maximum.reduceat(active, self.first)
        found = np.concatenate([np.add.reduceat(active, self.first) / self.size[:, None], top], axis=1)
        d = (1 / (1 + np.exp(-np.clip(found @ net.weights + net.offset, -40, 40))) - labels) / len(labels)
        back = np.repeat(d[:, None] * net.weights[None, :FILTERS] / self.size[:, None], self.size, axis=0)
        for i, (a, n) in enumerate(zip(self.first.tolist(), self.size.tolist(), strict=True)):
            back[a + active[a : a + n].argmax(axis=0), np.arange(FILTERS)] += d[i] * net.weights[FILTERS:]
        back *= active > 0
        rows, filters = np.arange(len(self.x))[:, None], np.arange(FILTERS)[None, :]
        table = [np.bincount((self.x[rows, self.places + j].astype(np.int64) * FILTERS + filters).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)]
        return [np.stack(table), back.sum(axis=0), d @ found, d.sum(keepdims=True), (back * self.ends[rows, self.places]).sum(axis=0)]


def _chunked(net: Network, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's chunks and the echoes of their windows, a row each."""
    x, ends, n = net.padded(text)
    return np.lib.stride_tricks.sliding_window_view(x, STEP + WIDTH - 1)[::STEP], ends.reshape(n, STEP)


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Network:
    """Adam on the log loss, batches drawn evenly from both labels and corrected to their shares; the texts of a batch are
    one array of chunks. One label, or none, gives a network that always answers its share of label 1 (none: a half)."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 3, FILTERS).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    ones, zeros = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(ones) or not len(zeros):
        net.weights[:] = 0
        net.offset = 0.0 if len(ones) == len(zeros) else 6.0 if len(ones) else -6.0
        return net
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.table, net.bias, net.weights, np.zeros(1), net.echo)]
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for step in range(1, steps + 1):
        chosen, parts = np.concatenate([rng.choice(ones, BATCH // 2), rng.choice(zeros, BATCH // 2)]), []
        for i in chosen.tolist():
            text = texts[i]
            if labels[i] == 1 and rng.random() < 0.25 and text:  # a piece of a good text is good, however short
                start = rng.integers(0, len(text))
                parts.append(_chunked(net, text[start : start + int(10 ** rng.uniform(0.5, 3))]))
            else:
                parts.append(seen[i] if i in seen else _chunked(net, text))
                if len(text) <= KEPT_BYTES:
                    seen[i] = parts[-1]
        offset = np.array([net.offset])
        for p, g, (m, v) in zip((net.table, net.bias, net.weights, offset, net.echo), Batch(net, parts).gradients(labels[chosen]), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        net.offset = float(offset[0])
    net.offset += float(np.log(len(ones) / len(zeros)))  # batches were even, the labels are not
    return net


def fold(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network from labelled rows outside the held-out fold, about sample of each label, chosen by hash of the id.

    Labels that are null or not 0 or 1 are left out; an id with several labels has the smallest. Where ids have many
    texts, those that come first by hash of id and text are learned from, so reruns learn the same. A text of over
    MOST_BYTES isn't learned from.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    known = known.withColumn("_place", F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1_000_000)))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # two rows
    share = {k: int(1_000_000 * min(1, sample / n)) for k, n in counts.items()}
    few = known.where(F.col("_place") < F.when(F.col("_label") == 1, share.get(1, 0)).otherwise(share.get(0, 0))).orderBy("_place", "_id").limit(4 * sample)
    rows = docs.select(F.col(id_col).alias("_of"), nonnull_text(F.col(text_col)).alias("_text"))
    rows = rows.where(F.octet_length("_text") <= MOST_BYTES).join(F.broadcast(few), F.col("_of") == F.col("_id"))
    rows = rows.select("_of", "_text", "_label", F.xxhash64("_of", "_text").alias("_hash")).orderBy("_hash", "_of", "_text").limit(4 * sample)
    got = rows.toArrow().sort_by([("_hash", "ascending"), ("_of", "ascending"), ("_text", "ascending")])
    return train(utf8(got.column("_text").combine_chunks()), got.column("_label").to_numpy().astype(np.float64))


def score(docs: DataFrame, net: Network, text_col: str = "text", name: str = "score", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or the columns named in keep, with a column score from 0 to 1, higher where label 1 is likelier, of each whole
    text (null: empty); it replaces a column of that name."""
    names = [c for c in (docs.columns if keep is None else keep) if c != name]
    slim = docs.select(*names, F.col(text_col).alias(free_name(docs, "_scored")))
    schema = StructType([*(f for f in slim.schema if f.name in names), StructField(name, DoubleType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1024):
            texts = utf8(batch.column(len(names)))
            yield append_columns(batch, names, {name: pa.array([net.score(t or b"") for t in texts], pa.float64())})

    return slim.mapInArrow(lean(run, tokenizer), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted.

    Empty and null texts are scored like any other. A null id is not held out. Without labels all scores are a half.
    An empty table gives no rows; other columns don't matter.
    """
    net = learn(docs, labels, id_col, text_col)
    scored = score(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), net, "_text", keep=("_id",))
    held_out = F.col("_id").isNotNull() & (fold(F.col("_id")) == 0)
    return scored.select(F.col("_id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
