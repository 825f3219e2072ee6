"""The chain matcher: a stateful pass over each video's pair scores, with replay.

A run of duplicates, from the frame before it, is a chain once a distinct frame ends it and the motion fits. If there
was too little motion, distinct frames are added until there is enough; if that fails, the matcher goes back to where
it began adding and settles for less. What it carries is the rows since the chain's first frame and the variables
before each of them, a few tens of rows however long the video is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..params import REPAIR, MatcherParams
from .backtracking import History

FIND, COMPENSATE, FAILED = "Find", "Compensate", "Failed"

STEP_SCHEMA = (
    "video_id long, step long, frame_num long, len int, state string, n_additional int, outcome string, chain_motion double, "
    "diff double, end_conf double, chain_i long, frames array<long>, timestamps array<double>"
)
COLUMNS = ("video_id", "frame_num", "ts_s", "hash_distance", "motion", "distinct_conf")


@dataclass(frozen=True)
class Variables:
    """What a replay rolls back."""

    chain_i: int = 0
    chain_motion: float = 0.0
    last_diff: float | None = None
    recent: float | None = None
    slow: float | None = None


def blend(alpha: float, before: float | None, value: float) -> float:
    """The next value of an exponential moving average; the first seeds it."""
    return value if before is None else alpha * value + (1 - alpha) * before


@dataclass
class ChainMatcher:
    """feed() takes a frame's scores and returns the steps that it causes, replayed ones included.

    A score is (frame_num, ts_s, hash_distance, motion, distinct_conf); the last three are None for a frame without a
    predecessor. Only the variables are rolled back by a replay, not the state or the steps told.
    """

    params: MatcherParams
    variables: Variables = field(default_factory=Variables)
    history: History = field(default_factory=History)
    state: str = FIND
    added: int = 0
    told: list[dict] = field(default_factory=list)
    steps: int = 0

    def feed(self, row: tuple) -> list[dict]:
        self.told = []
        self.variables = self.history.feed(row, self.variables, self._step)
        return self.told

    def _step(self, before: Variables, row: tuple, history: History) -> Variables:
        p, length = self.params, len(history)
        frame, _, diff, motion, distinct = row
        step = {"step": self.steps, "frame_num": frame, "len": length, "state": self.state, "n_additional": self.added, "diff": before.last_diff, "end_conf": distinct, "chain_i": None, "frames": None, "timestamps": None}
        self.steps += 1
        self.told.append(step)
        if length == 0 or any(x is None or x != x or abs(x) == float("inf") for x in (diff, motion, distinct)):
            self._restart(history)
            step |= {"outcome": "NoScore", "chain_motion": before.chain_motion}
            return before
        v = replace(before, chain_motion=before.chain_motion + motion)
        outcome = self._check(v, length, distinct)
        step |= {"outcome": outcome, "chain_motion": v.chain_motion}
        slow = v.slow if outcome == "FailDuplicate" else blend(p.slow_motion_mean_alpha, v.slow, motion)
        v = replace(v, slow=slow, last_diff=diff)
        if outcome in ("FailLong", "FailTooMuchMotion") and self.state == COMPENSATE:
            history.backtrack(self.added)
            self.state, self.added = FAILED, 0
            return v
        if outcome == "FailDuplicate":
            return v
        if outcome == "CompensationRequired" and self.state != FAILED:
            self.state, self.added = COMPENSATE, self.added + 1
            return v
        if outcome == "Ok":
            step |= {"chain_i": v.chain_i, "frames": [r[0] for r in history[:]], "timestamps": [r[1] for r in history[:]]}
            v = replace(v, chain_i=v.chain_i + 1)
        self._restart(history)
        return replace(v, chain_motion=0.0, recent=blend(p.recent_motion_mean_alpha, v.recent, motion))

    def _restart(self, history: History) -> None:
        """The current frame becomes the first of the next chain."""
        history.clear()
        self.state, self.added = FIND, 0

    def _check(self, v: Variables, length: int, distinct: float) -> str:
        p = self.params
        if length > p.max_duplicates + 1:
            return "FailLong"
        if 1 - distinct >= p.min_duplicate_confidence:
            return "FailDuplicate"
        if length < p.min_duplicates:
            return "FailShort"
        if length > p.motion_compensate_start:
            threshold = p.motion_compensate_threshold * (p.mul_motion_compensate_threshold_retry if self.state == FAILED else 1)
            if v.chain_motion < (v.recent or 0.0) * (length - 1) * threshold:
                return "CompensationRequired"
        if v.chain_motion > (v.slow or 0.0) * p.max_motion_mul:
            return "FailTooMuchMotion"
        return "Ok"


def _run(batches: Iterator[pd.DataFrame], params: MatcherParams) -> Iterator[pd.DataFrame]:
    """The steps over rows that come by video and frame."""
    video, matcher = None, None
    for rows in batches:
        out = []
        columns = [rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in COLUMNS]
        for v, *row in zip(*columns, strict=True):
            if matcher is None or v != video:
                video, matcher = v, ChainMatcher(params)
            out += [s | {"video_id": v} for s in matcher.feed(tuple(row))]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STEP_SCHEMA.split(", ")])


def match_steps(scores: DataFrame, params: MatcherParams = REPAIR) -> DataFrame:
    """One row per step of the matcher: the outcome log, with the chain where the outcome is Ok.

    Rows are dealt by video and sorted, and a task runs through them as they come: a long video is as little held in
    memory as a short one. Only keys and scores are moved, never pixels.
    """
    slim = scores.select(*COLUMNS)
    return slim.repartition("video_id").sortWithinPartitions("video_id", "frame_num").mapInPandas(lambda rows: _run(rows, params), STEP_SCHEMA)


def match_bucketed(scores: DataFrame, params: MatcherParams = REPAIR) -> DataFrame:
    """The same over a table in buckets by video (sources.bucketed): nothing is moved, and nothing sorted that is so."""
    kinds = to_arrow_schema(StructType.fromDDL(STEP_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _run((b.to_pandas() for b in batches), params):
            yield pa.RecordBatch.from_pandas(out, kinds, preserve_index=False)

    slim = scores.select(*COLUMNS).sortWithinPartitions("video_id", "frame_num")
    return slim.groupBy("video_id").applyInArrow(run, STEP_SCHEMA)


def chains(steps: DataFrame) -> DataFrame:
    """The chains found: frames from the one before the first duplicate on, and the frame that ended it."""
    found = steps.where("outcome = 'Ok'")
    return found.select("video_id", "chain_i", "frames", "timestamps", F.col("frame_num").alias("end_frame"), "state", "n_additional", "chain_motion", "diff", "end_conf")


def duplicates(steps: DataFrame) -> DataFrame:
    """Frames that were seen as duplicates, replays included."""
    return steps.where("outcome = 'FailDuplicate'").select("video_id", "step", "frame_num")
