"""Parameters of the chain matcher."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatcherParams:
    """Defaults are those for repairing a video."""

    min_duplicate_confidence: float = 0.65
    min_duplicates: int = 2  # the frame before the first duplicate counts
    max_duplicates: int = 12
    recent_motion_mean_alpha: float = 0.7
    slow_motion_mean_alpha: float = 0.1
    motion_compensate_threshold: float = 0.75
    mul_motion_compensate_threshold_retry: float = 0.33
    motion_compensate_start: int = 2
    max_motion_mul: float = 7.3
    min_hash_diff: float = 0.018
    diff_hash_resize: int = 70


REPAIR = MatcherParams()
#: For measuring detection against known lags.
VALIDATE = MatcherParams(min_duplicate_confidence=0.5, motion_compensate_start=1)
