"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from typing import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, staging_path

#: Rows of one Arrow batch are worked on in slices of about this many text bytes.
SLICE_BYTES = 4 << 20
#: Entries a worker keeps of what it has computed for distinct words.
MEMO_WORDS = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``text`` of the documents table; a null text is empty."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that the cluster names, among those that ``drop_staged_tables`` removes."""
    return staging_path(spark, name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read from there: cuts the lineage, survives lost executors."""
    path = staged_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], text: str, size: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``size`` bytes of ``text`` and at most ``rows`` rows, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + size, "right"))))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def with_columns(df: DataFrame, text: str, fields: list[pa.Field], compute: Callable[[list[str]], list], size: int = SLICE_BYTES) -> DataFrame:
    """``df`` with columns that ``compute`` makes from a list of texts (null: empty), in Arrow batches, slices of about ``size`` bytes at a time.

    Every other column passes through; one of the same name as a new column is replaced.
    """
    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new]
    schema = StructType([df.schema[c] for c in kept] + [StructField(f.name, from_arrow_type(f.type)) for f in fields])

    def run(batches):
        for part in slices(batches, text, size):
            columns = compute([t or "" for t in part.column(text).to_pylist()])
            rest = [part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(rest + [pa.array(c, f.type) for c, f in zip(columns, fields)], names=kept + [f.name for f in fields])

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one) over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd 64-bit base and of its inverse, grown as longer texts come: hashes of any substring from one prefix sum."""

    def __init__(self, base: int):
        self.base = base | 1
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, 2 * len(self.up))
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (self.base, inverse))
        return self.up[: n + 1], self.down[: n + 1]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of bytes times powers; with ``span`` they give the hash of any stretch."""
        up, _ = self(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end], whatever its place; lengths are mixed in."""
        _, down = self(len(prefix))
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths - starts, lengths)


def id_key(doc_id: str = "doc_id") -> Column:
    """``doc_id`` as an order key; a null id comes after all others."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that begins with ``name`` and that ``df`` has in no case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name
