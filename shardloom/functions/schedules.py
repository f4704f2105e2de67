"""Step-indexed scalar functions: learning rate (H9), curriculum stage (B12),
checkpoint steps (B13) and the prediction horizon (H10)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CHECKPOINTS_PER_RUN, HORIZON_FAN_IN


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def learning_rate(step, warmup_steps, max_steps, max_lr, min_lr) -> Column:
    """H9: linear warm-up ``max_lr*(i+1)/w`` for ``i < w``; ``min_lr`` for
    ``i > max_steps``; cosine decay from ``max_lr`` to ``min_lr`` between."""
    i, w, m = _c(step).cast("double"), _c(warmup_steps).cast("double"), _c(max_steps).cast("double")
    hi, lo = _c(max_lr), _c(min_lr)
    ratio = (i - w) / (m - w)
    coeff = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * ratio))
    return (F.when(i < w, hi * (i + F.lit(1.0)) / w)
            .when(i > m, lo)
            .otherwise(lo + coeff * (hi - lo)))


def training_progress(step, max_steps) -> Column:
    return (_c(step) + F.lit(1)).cast("double") / _c(max_steps).cast("double")


def curriculum_stage(step, max_steps) -> Column:
    """Progress ``p=(step+1)/max_steps``; ``p<1/3`` -> 1, ``p<2/3`` -> 2,
    else 3 (double-precision thresholds as in the reference)."""
    p = training_progress(step, max_steps)
    return (F.when(p < F.lit(1 / 3), F.lit(1))
            .when(p < F.lit(2 / 3), F.lit(2))
            .otherwise(F.lit(3)))


def checkpoint_stride(max_steps) -> Column:
    """``max_steps // 20`` floored at 1 (quirk Q14: the reference fails below 20)."""
    per = F.floor(_c(max_steps).cast("double") / F.lit(CHECKPOINTS_PER_RUN)).cast("long")
    return F.greatest(F.lit(1).cast("long"), per)


def is_checkpoint_step(step, max_steps) -> Column:
    """Every stride-th step below ``max_steps`` plus the last one."""
    s, m = _c(step), _c(max_steps)
    return (((s % checkpoint_stride(m)) == 0) | (s == m - F.lit(1))) & (s < m) & (s >= 0)


def horizon(levels: int = 3, fan_in: int = HORIZON_FAN_IN) -> int:
    """Look-ahead of the compressing model, ``fan_in ** levels`` = 64."""
    return int(fan_in ** levels)
