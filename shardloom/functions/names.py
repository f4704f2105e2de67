"""Shard naming (A5), split labels on names (A6, A7), split routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SHARD_NAME_FORMAT, SPLIT_LABELS, SplitRatio

_LABEL_SUFFIX = "_(" + "|".join(SPLIT_LABELS) + ")$"


def shard_name(data_name: Column | str, shard_id: Column | str) -> Column:
    """A5: ``{data_name}_{shard_id:06d}``."""
    dn = F.lit(data_name) if isinstance(data_name, str) and not data_name.startswith("`") else data_name
    sid = F.col(shard_id) if isinstance(shard_id, str) else shard_id
    return F.format_string(SHARD_NAME_FORMAT, dn, sid.cast("int"))


def with_split_label(name: Column, split: Column) -> Column:
    """Append the split value (``training`` etc., not the enum's repr)."""
    return F.concat_ws("_", name, split)


def strip_split_label(name: Column) -> Column:
    """Remove a trailing ``_training|_validation|_testing``.  Anchored at the
    end, so a data name that merely contains ``_testing`` stays intact."""
    return F.regexp_replace(name, _LABEL_SUFFIX, "")


def split_of(shard_id: Column, ratio: SplitRatio) -> Column:
    """Routing per shard by ``shard_id mod 10`` in shard order."""
    r = F.pmod(shard_id, F.lit(10))
    return (F.when(r < ratio.training, F.lit(SPLIT_LABELS[0]))
            .when(r < ratio.training + ratio.validation, F.lit(SPLIT_LABELS[1]))
            .otherwise(F.lit(SPLIT_LABELS[2])))
