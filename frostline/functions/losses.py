"""Training targets, losses and metrics as column functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def motion_target(motion: Column, x: Column, y: Column) -> Column:
    still = F.abs(motion) <= 1e-7
    return F.when(still, F.lit(0.0)).otherwise(0.8 * motion + 0.2 * F.sqrt(x * x + y * y))


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    return (value - mean) / deviation


def denormalised(out: Column, mean: Column, deviation: Column) -> Column:
    return F.greatest(out * deviation + mean, F.lit(0.0))


def binary_cross_entropy(logit: Column, truth: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * truth + F.log1p(F.exp(-F.abs(logit)))


def gaussian_nll(truth: Column, mean: Column, log_variance: Column) -> Column:
    """Negative log likelihood; the log variance is clamped to -3.3 .. 0.55 (fixed values)."""
    clamped = F.least(F.lit(0.55), F.greatest(F.lit(-3.3), log_variance))
    sigma = F.exp(clamped / 2) + 1e-6
    return F.log(sigma) + F.pow((truth - mean) / sigma, F.lit(2)) / 2 + 0.5 * math.log(2 * math.pi)


def smooth_l1(truth: Column, guess: Column, beta: float = 0.65) -> Column:
    d = F.abs(truth - guess)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def squared_error(truth: Column, guess: Column) -> Column:
    return (truth - guess) * (truth - guess)


def absolute_error(truth: Column, guess: Column) -> Column:
    return F.abs(truth - guess)


#: Losses and metrics of (truth, guess) by name; more can be added.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"mse": squared_error, "mae": absolute_error, "smooth_l1": smooth_l1}
