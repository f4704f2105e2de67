"""Configuration objects and fixed values.

Driver-side dataclasses are checked eagerly (the reference asserts the same
conditions before it touches any data).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
SPLIT_LABELS = ("training", "validation", "testing")
SHARD_NAME_FORMAT = "%s_%06d"              # {data_name}_{shard:06d}
DEFAULT_SHARD_TOKENS = 100_000_000         # tokens per shard
TOKEN_LIMIT = 65536                        # token ids must fit in uint16
TOP_K = 5                                  # candidates kept before sampling
GENERATION_SEED = 42
STEP_LOG_FORMAT = ("step %5d | loss: %.6f | lr %.4e | norm: %.4f | "
                   "dt: %.2fms | tok/sec: %.2f")
LOG_NAME_TIME_FORMAT = "yyyy_MM_dd_HH_mm"  # strftime %Y_%m_%d_%H_%M
MAX_LR = 6e-4
MIN_LR = MAX_LR * 0.1
CHECKPOINTS_PER_RUN = 20                   # checkpoint every max_steps // 20
HORIZON_FAN_IN = 4                         # horizon 4 ** 3 = 64 tokens
TOTAL_BATCH_TOKENS = 524288                # tokens per optimiser step
# ---------------------------------------------------------------------------

# Word-mode vocabulary: ids 1..WORD_CAP are words ranked by (count desc, word
# asc); WORD_CAP + 1 is end-of-text.  Any other word is spelled: id 0, then its
# UTF-8 bytes as WORD_CAP + 2 + byte, so that no text is lost.
WORD_CAP = 50255
WORD_SPELL_ID = 0
WORD_EOT_ID = WORD_CAP + 1
WORD_VOCAB_SIZE = WORD_CAP + 2 + 256
BYTE_EOT_ID = 256
BYTE_VOCAB_SIZE = 257


@dataclass(frozen=True)
class DatasetSpec:
    """One text source: a table, the text columns to join, a row filter and
    the column giving document order (a unique integer; without one the rows
    are numbered once, in file and row order).
    """

    path: str
    data_keys: Sequence[str]
    order_col: Optional[str] = "doc_ord"     # None: numbered at ingest, in file and row order
    where: Optional[str] = None
    separator: str = " "
    fmt: str = "parquet"


@dataclass(frozen=True)
class SplitRatio:
    """Train / validation / test share in tenths; must add up to 10."""

    training: int = 8
    validation: int = 1
    testing: int = 1

    def __post_init__(self):
        parts = (self.training, self.validation, self.testing)
        if any(p < 0 for p in parts) or sum(parts) != 10:
            raise ValueError(
                f"split shares are tenths and have to add up to 10: {parts}")


@dataclass(frozen=True)
class PackSpec:
    data_name: str = "corpus"
    shard_tokens: int = DEFAULT_SHARD_TOKENS
    ranges: int = 0             # ranges of order keys for prefix sums (0: by the session's shuffle partitions)

    def __post_init__(self):
        if self.shard_tokens <= 0 or self.ranges < 0:
            raise ValueError("shard_tokens must be positive and ranges not negative")


@dataclass(frozen=True)
class WindowSpec:
    """Loader shape: B sequences of T tokens per micro batch, targets N ahead,
    W ranks."""

    B: int = 8
    T: int = 256
    N: int = 1
    W: int = 1

    def __post_init__(self):
        if min(self.B, self.T, self.N, self.W) <= 0:
            raise ValueError("B, T, N and W must be positive")

    @property
    def batch_tokens(self) -> int:
        return self.B * self.T


def accumulation_steps(total_batch_tokens: int, spec: WindowSpec) -> int:
    """Micro steps per optimiser step; total must divide by B*T*W."""
    per = spec.B * spec.T * spec.W
    if total_batch_tokens % per != 0:
        raise ValueError(f"{total_batch_tokens} tokens per step do not divide into micro batches of {per}")
    return total_batch_tokens // per


@dataclass(frozen=True)
class TelemetrySpec:
    """How raw step records map to ranks and accumulation steps."""

    A: int = 4                  # micro steps per step
    W: int = 2                  # ranks
    warmup_steps: int = 20
    max_lr: float = MAX_LR
    min_lr: float = MIN_LR
    B: int = 8
    T: int = 256


def horizon(levels: int = 3, fan_in: int = HORIZON_FAN_IN) -> int:
    return fan_in ** levels

