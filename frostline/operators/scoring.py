"""Pair scores by a pluggable model: column expressions, or an ONNX model in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from .features import HEIGHT, WIDTH

Predict = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pair_scores(pairs: DataFrame, denominator: int, gate: float) -> DataFrame:
    """distance, motion and distinct of thumbnails (thumb, before), by expressions alone."""
    bits = lambda c: P.gradient_bits(F.col(c))
    out = pairs.withColumn("distance", P.hash_distance(bits("before"), bits("thumb"), denominator))
    out = out.withColumn("motion", P.mean_abs(P.difference(F.col("before"), F.col("thumb"))))
    return out.withColumn("distinct", P.gated(F.col("distance"), P.sigmoid(8 * F.col("motion") - 1), gate))


def _rows(column: pd.Series) -> np.ndarray:
    """Arrays as rows of one array; pictures in bytes stay as they are."""
    return column.to_numpy() if isinstance(column.iloc[0], bytes | bytearray) else np.stack(column)


def model_scores(pairs: DataFrame, load: Callable[[], Predict], gate: float, name: str = "distinct") -> DataFrame:
    """pairs (frame_num, before, thumb, distance) with a model's output where the distance is below the gate, else 1;
    an infinite gate lets all pairs through.

    The model is loaded once per task. The gate is inside the batch: a CASE around a Python function would not keep it
    from running.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for rows in batches:
            out, near = np.ones(len(rows)), (rows["distance"] < gate).to_numpy()
            if near.any():
                out[near] = predict(_rows(rows.loc[near, "before"]), _rows(rows.loc[near, "thumb"]))
            yield rows[["frame_num", "distance"]].assign(**{name: out})

    return pairs.select("frame_num", "before", "thumb", "distance").mapInPandas(run, f"frame_num long, distance double, {name} double")


def _session(path: str, threads: int):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    return onnxruntime.InferenceSession(path, options)


def _scaled(pixels: np.ndarray, shape: tuple[int, int] | None) -> np.ndarray:
    """8-bit pixels as 0 to 1; rows of pictures in bytes, or of lists, in the shape (height, width) that the model takes."""
    x = np.stack([np.frombuffer(p, np.uint8) if isinstance(p, bytes | bytearray) else p for p in pixels]).astype(np.float32) / np.float32(255)
    return x.reshape(len(x), *shape) if shape else x


def onnx_model(path: str, threads: int = 2, shape: tuple[int, int] | None = (HEIGHT, WIDTH)) -> Callable[[], Predict]:
    """A loader of an ONNX model that tells how distinct two pictures of 8-bit pixels are: its `input` takes both, scaled
    to 0 to 1, as two channels, [1, 2, height, width], and its `output` is a logit."""

    def load() -> Predict:
        session = _session(path, threads)

        def predict(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            both = np.stack([_scaled(a, shape), _scaled(b, shape)], axis=1)
            logits = [session.run(["output"], {"input": pair[None]})[0].reshape(-1)[0] for pair in both]
            return 1 / (1 + np.exp(-np.array(logits, np.float64)))

        return predict

    return load


def onnx_motion(path: str, threads: int = 3, shape: tuple[int, int] | None = (HEIGHT, WIDTH)) -> Callable[[], Predict]:
    """A loader of an ONNX model of motion: its `input` takes the earlier picture less the later one, each scaled to 0 to
    1, [1, 1, height, width]; the first number of its `output` is the motion."""

    def load() -> Predict:
        session = _session(path, threads)

        def predict(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            change = (_scaled(a, shape) - _scaled(b, shape))[:, None]
            return np.array([session.run(["output"], {"input": x[None]})[0].reshape(-1)[0] for x in change], np.float64)

        return predict

    return load
