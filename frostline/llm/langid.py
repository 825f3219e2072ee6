"""Language identification by averaged hashed subword embeddings.

The subwords of a text are its byte sequences of two to four letters and spaces in lower case, hashed into a table of
embeddings. Their average goes through a linear softmax; both are trained by stochastic gradient descent in numpy on
the driver, from a bounded sample of each language. A threshold on the probability, calibrated on rows kept aside from
training, marks predictions that should be rejected. Scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import append_columns, batches, nonnull_text, stage_table, utf8

BUCKETS, DIM, SIZES = 1 << 14, 16, (2, 3, 4)
SAMPLE, MOST_SAMPLE = 800, 16_000  # documents of each language, and in all, that are learned from, about
MOST_BYTES = 1 << 15  # of a longer text a stretch is learned from, which bounds the sample; all are predicted whole
MOST_BROADCAST, SALTS = 8 << 20, 64  # bytes of the table of languages; parts of a language where it is larger than that
EPOCHS, RATE, SEED = 4, 0.6, 11
FOLDS, HELD = 4, 2
PART = 1 << 15
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the subwords that start in data (bytes), one array for each size."""
    x = _LOWER[data].astype(np.uint32)
    out, h = [], x
    for size in range(2, SIZES[-1] + 1):
        if len(x) < size:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ x[size - 1 :]
        out.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64))
    return out


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    least: float = 0.0  # below this probability a prediction should be rejected

    def probabilities(self, data: bytes) -> np.ndarray:
        total, n = np.zeros(DIM), 0
        x = np.frombuffer(data, np.uint8)
        for k in range(0, len(x), PART):  # parts overlap so that each subword is met once
            found = zip(SIZES, subwords(x[k : k + PART + SIZES[-1] - 1]), strict=False)
            ids = np.concatenate([np.zeros(0, np.int64), *(ids[: min(PART, len(x) - k - size + 1)] for size, ids in found)])
            total += np.bincount(ids, minlength=BUCKETS).astype(np.float32) @ self.embeddings
            n += len(ids)
        return _softmax(self.weights @ (total / max(n, 1)) + self.bias)

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, probability and whether to reject it; und and 0 for a text that is null or has no letter."""
        if not self.languages or text is None or not _has_letter(text):
            return "und", 0.0, True
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def _has_letter(text: bytes) -> bool:
    head = text[:64]
    if head.isascii() and any(65 <= b & 0xDF <= 90 for b in head):
        return True
    return _LETTER.search(text.decode("utf-8", "replace")) is not None


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(texts: list[bytes], names: list[str], seed: int = SEED) -> Model:
    """Stochastic gradient descent, a document at a time; every fifth document is kept aside to calibrate rejection:
    the threshold rejects one in two hundred of the calibration rows that are predicted right, or fewer."""
    languages = sorted(set(names))
    rng = np.random.default_rng(seed)
    model = Model(languages, rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((len(languages), DIM)), np.zeros(len(languages)))
    known = {name: i for i, name in enumerate(languages)}
    seen = []
    for text in texts:
        ids = subwords(np.frombuffer(text, np.uint8))
        seen.append(np.unique(np.concatenate(ids), return_counts=True) if ids else (np.zeros(0, np.int64), np.zeros(0)))
    aside = np.arange(len(texts)) % 5 == 4
    order, step, steps = np.flatnonzero(~aside), 0, EPOCHS * max(1, (~aside).sum())
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            ids, n = seen[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            share = n / n.sum()
            h = share @ model.embeddings[ids]
            d = _softmax(model.weights @ h + model.bias)
            d[known[names[i]]] -= 1
            back = model.weights.T @ d
            model.weights -= rate * np.outer(d, h)
            model.bias -= rate * 0.1 * d
            # The step on an embedding is scaled by its place in the average, which plain descent makes tiny.
            model.embeddings[ids] -= (rate * np.sqrt(share)[:, None] * back).astype(np.float32)
    right = [p.max() for i in np.flatnonzero(aside) if languages[(p := model.probabilities(texts[i])).argmax()] == names[i]]
    if right:
        model.least = float(np.quantile(right, 0.005))
    return model


def fold(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most: int = MOST_SAMPLE) -> Model:
    """A model from rows with a language outside the held-out fold: about sample of each language, fewer where there are
    so many languages that this would be over most in all, but one of each at least. So no language is left out by rank, by
    how rare it is, or for the length of its texts.

    Rows are chosen by hash of id and text, so reruns learn the same, and rows that are alike count once. Of a text of over
    MOST_BYTES the stretch in its middle is learned from that is never longer than that. The driver holds twice most texts
    and one of each language at most.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), nonnull_text(F.col(text_col)).alias("_text"))
    rows = rows.where(F.col("_lang").isNotNull() & (F.col("_id").isNull() | (fold(F.col("_id")) != HELD)))
    hashed = rows.withColumn("_place", F.pmod(F.xxhash64("_id", "_text", F.lit(SEED)), F.lit(1 << 40)))
    counts = hashed.groupBy("_lang").agg(F.count("*").alias("n"), F.min("_place").alias("least"))
    every = F.sum(F.lit(1)).over(W.partitionBy())
    each = F.least(F.lit(float(sample)), F.lit(float(most)) / F.greatest(every, F.lit(1)))
    share = (F.least(F.lit(1.0), each / F.col("n")) * (1 << 40)).cast("long")
    shares = stage_table(counts.select(F.col("_lang").alias("_of"), F.greatest(share, F.col("least") + 1).alias("_share")))  # one row per language
    few = _below_share(hashed, shares).select("_id", "_lang", _stretch(F.col("_text")).alias("_text"), "_place").distinct()
    got = few.orderBy("_place", "_text", "_lang", "_id").limit(2 * most + shares.count()).toArrow()
    return train(utf8(got.column("_text").combine_chunks()), got.column("_lang").to_pylist())


def _stretch(text: Column) -> Column:
    """A text, or the middle of one that is too long, in characters that take four bytes at most each."""
    most = MOST_BYTES // 4
    begin = F.floor((F.char_length(text) - most) / 2).cast("int") + 1
    return F.when(F.octet_length(text) <= MOST_BYTES, text).otherwise(F.substr(text, F.greatest(begin, F.lit(1)), F.lit(most)))


def _below_share(hashed: DataFrame, shares: DataFrame) -> DataFrame:
    """The rows whose place is below their language's share. Texts don't move for that: the languages are broadcast if
    the table is small; otherwise a language is in parts, so that a frequent one isn't one task."""
    size = shares.agg(F.sum(F.octet_length("_of") + 16)).first()[0] or 0
    if size <= MOST_BROADCAST:
        return hashed.join(F.broadcast(shares), F.col("_lang") == F.col("_of")).where("_place < _share")
    parts = shares.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hashed.join(parts, (F.col("_lang") == F.col("_of")) & (F.pmod(F.col("_place"), F.lit(SALTS)) == F.col("_part"))).where("_place < _share")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score, rejected (the probability is under the calibrated
    threshold, or there is no letter).

    A text that is null or has no letter is `und` with score 0. A null id is not held out. Without any language to
    learn from every text is `und`. An empty table gives no rows; other columns don't matter.
    """
    model = learn(docs, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1024):
            found = [model.predict(t) for t in utf8(batch.column(batch.schema.get_field_index("_text")))]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield append_columns(batch, ["_id"], {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

    out = slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    held_out = F.col("_id").isNotNull() & (fold(F.col("_id")) == HELD)
    return out.select(F.col("_id").alias(id_col), held_out.alias("held_out"), "lang_pred", "score", "rejected")
