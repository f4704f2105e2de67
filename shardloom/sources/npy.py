"""A2 + A3 as flat files: token shards in the ``.npy`` format the reference's loader reads, one file per shard.

A Python data source, ``token_npy``, for any store pyarrow has a file system for.

* **Reading** splits a shard by byte ranges: a task reads the header's dtype and shape once more and then only its own stretch, so a
  shard of any size spreads over many tasks, and a task reads many small shards one after the other.  Rows are stretches of ``chunk`` tokens with their position.
* **Writing** takes rows ``(file_name, n_tokens, pos, tokens)`` in order of position.  The header needs the length first, which every
  row carries (the manifest knows it), so tokens stream through and no shard is held.  A task writes under ``_temporary``; only the
  driver's commit moves files to their names, and a task that fails, or a job that is aborted, leaves none.

Files are named as the manifest names them: ``{data_name}_{shard:06d}_{split}.npy``; a file without a split label has a null split.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..config import SPLIT_LABELS, TOKEN_LIMIT
from ..session import ship_package

FORMAT = "token_npy"
SCHEMA = "data_name string, split string, shard_id long, pos long, tokens array<int>"
FILE_NAME = re.compile(rf"(?P<data_name>.+)_(?P<shard>\d{{6,}})(?:_(?P<split>{'|'.join(SPLIT_LABELS)}))?\.npy")
#: Tokens of a row, and of a partition, unless the reader's options say otherwise.
CHUNK, PART = 1 << 16, 1 << 22
_TEMPORARY = "_temporary"


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))


def read_header(stream) -> tuple[int, int]:
    """Number of tokens of a ``.npy`` stream, and where they begin; anything but a flat little-endian uint16 array is an error."""
    magic = stream.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    size = struct.unpack("<H", stream.read(2))[0] if magic[6] == 1 else struct.unpack("<I", stream.read(4))[0]
    text = stream.read(size).decode("latin1")
    found = re.fullmatch(r"\{'descr': '([^']*)', 'fortran_order': (?:True|False), 'shape': \((\d+),\), ?\}\s*", text)
    if not found or found[1] != "<u2":
        raise ValueError(f"not a flat uint16 array: {text.strip()}")
    return int(found[2]), stream.tell()


def header(n: int) -> bytes:
    """The ``.npy`` header (version 1) of a flat uint16 array of n tokens."""
    text = f"{{'descr': '<u2', 'fortran_order': False, 'shape': ({n},), }}".encode("latin1")
    text += b" " * (-(len(text) + 11) % 64) + b"\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text


@dataclass
class Stretch(InputPartition):
    path: str
    data_name: str
    split: str | None
    shard: int
    start: int
    end: int


@dataclass
class Stretches(InputPartition):
    """What a task reads: stretches of one shard or of several."""

    each: list[Stretch]


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.data_name = options["path"], options.get("split"), options.get("data_name")
        self.chunk, self.part = int(options.get("chunk", CHUNK)), int(options.get("part", PART))

    def partitions(self) -> list[Stretches]:
        """Byte ranges of the wanted shards, cut at rows, put together up to a partition's tokens; from names and sizes alone."""
        from pyarrow import fs

        store, top = file_system(self.path)
        step = max(1, self.part // self.chunk) * self.chunk
        found, sizes = [], []
        for info in sorted(store.get_file_info(fs.FileSelector(top)), key=lambda i: i.base_name):
            name = FILE_NAME.fullmatch(info.base_name)
            if not info.is_file or not name or self.split not in (None, name["split"]) or self.data_name not in (None, name["data_name"]):
                continue
            # a flat shard's length follows from its size: the header is read where the tokens are
            most = max(1, info.size // 2)
            found += [Stretch(info.path, name["data_name"], name["split"], int(name["shard"]), a, a + step) for a in range(0, most, step)]
            sizes += [min(step, most - a) for a in range(0, most, step)]
        return [Stretches(part) for part in _together(found, sizes, step)] or [Stretches([])]

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        for stretch in partition.each:
            yield from self._read(stretch)

    def _read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        with store.open_input_file(partition.path) as stream:
            n, begin = read_header(stream)
            stream.seek(begin + 2 * min(partition.start, n))
            for pos in range(partition.start, min(partition.end, n), self.chunk):
                size = min(self.chunk, n - pos)
                tokens = np.frombuffer(stream.read(2 * size), "<u2").astype(np.int32)
                if len(tokens) != size:
                    raise ValueError(f"{partition.path} is shorter than its header says")
                one = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(tokens))
                columns = [pa.array([partition.data_name]), pa.array([partition.split], pa.string()), pa.array([partition.shard], pa.int64()), pa.array([pos], pa.int64()), one]
                yield pa.RecordBatch.from_arrays(columns, names=["data_name", "split", "shard_id", "pos", "tokens"])


def _together(found: list[Stretch], sizes: list[int], most: int) -> list[list[Stretch]]:
    """Neighbouring stretches of at most ``most`` tokens in all, one at least."""
    groups, held = [], 0
    for stretch, size in zip(found, sizes):
        if not groups or held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(stretch)
        held += size
    return groups


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # temporary path, name


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterable[pa.RecordBatch]) -> Written:
        store, top = file_system(self.path)
        folder = f"{top}/{_TEMPORARY}/{self.job}"
        store.create_dir(folder, recursive=True)
        done, name, stream, at, n = [], None, None, 0, 0

        def close() -> None:
            nonlocal stream
            if stream is not None:
                stream.close()
                stream = None
                if at != n:
                    raise ValueError(f"shard {name}: {at} of {n} tokens")

        try:
            for batch in iterator:
                names, sizes, places = (batch.column(c).to_pylist() for c in ("file_name", "n_tokens", "pos"))
                lists = batch.column("tokens")
                for k, (file_name, size, pos) in enumerate(zip(names, sizes, places)):
                    if file_name != name:
                        close()
                        if any(file_name == f for _, f in done) or not FILE_NAME.fullmatch(f"{file_name}.npy"):
                            raise ValueError(f"rows of a shard have to come together and under a shard's name: {file_name}")
                        name, at, n = file_name, 0, size
                        done.append((f"{folder}/{uuid.uuid4().hex}", file_name))
                        stream = store.open_output_stream(done[-1][0])
                        stream.write(header(n))
                    tokens = lists[k].values.to_numpy(zero_copy_only=False)
                    if pos != at or size != n:
                        raise ValueError(f"shard {name}: a row at {pos} where {at} was due")
                    if len(tokens) and not (0 <= tokens.min() and tokens.max() < TOKEN_LIMIT):
                        raise ValueError(f"shard {name}: a token does not fit 16 bits")
                    stream.write(tokens.astype("<u2").tobytes())
                    at += len(tokens)
            close()
        except BaseException:
            if stream is not None:
                stream.close()
            self._remove(store, [f for f, _ in done])
            raise
        return Written(done)

    @staticmethod
    def _remove(store, paths: list[str]) -> None:
        for path in paths:
            try:
                store.delete_file(path)
            except OSError:
                pass

    def commit(self, messages: list[Written | None]) -> None:
        """Files take their names; with overwrite, shards of the same data names that were not written go."""
        from pyarrow import fs

        store, top = file_system(self.path)
        moves = [(a, f"{b}.npy") for m in messages if m for a, b in m.files]
        store.create_dir(top, recursive=True)
        there = {i.base_name for i in store.get_file_info(fs.FileSelector(top)) if i.is_file}
        clash = sorted(there & {b for _, b in moves})
        if len({b for _, b in moves}) != len(moves) or (clash and not self.overwrite):
            self.abort(messages)
            raise ValueError(f"shards are there already or written twice: {clash[:3]}")
        for a, b in moves:
            store.move(a, f"{top}/{b}")
        if self.overwrite:
            mine = {FILE_NAME.fullmatch(b)["data_name"] for _, b in moves}
            stale = [b for b in there - {b for _, b in moves} if (m := FILE_NAME.fullmatch(b)) and m["data_name"] in mine]
            self._remove(store, [f"{top}/{b}" for b in stale])
        self._clean(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        store, top = file_system(self.path)
        self._remove(store, [a for m in messages if m for a, _ in m.files])
        self._clean(store, top)

    def _clean(self, store, top: str) -> None:
        from pyarrow import fs

        try:
            store.delete_dir(f"{top}/{_TEMPORARY}/{self.job}")
            if not store.get_file_info(fs.FileSelector(f"{top}/{_TEMPORARY}")):
                store.delete_dir(f"{top}/{_TEMPORARY}")
        except OSError:
            pass


class NpyShards(DataSource):
    """Options: ``path``; for reading also ``split``, ``data_name``, ``chunk`` (tokens a row) and ``part`` (tokens a partition)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(NpyShards)


def write_npy_shards(fragments: DataFrame, manifest: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A2: the fragments ``(shard_id, pos, tokens)`` as one flat file per shard of the manifest ``(shard_id, file_name, n_tokens)``.

    One shuffle brings a shard's fragments together (a fixed number of tokens); a shard's tokens then stream into its file."""
    spark = fragments.sparkSession
    register(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = fragments.select("shard_id", "pos", "tokens").join(manifest.select("shard_id", "file_name", "n_tokens"), "shard_id")
    rows = rows.repartition(parts, "shard_id").sortWithinPartitions("shard_id", "pos").select("file_name", "n_tokens", "pos", "tokens")
    rows.write.format(FORMAT).mode(mode).option("path", path).save()


def read_npy_shards(spark: SparkSession, path: str, split: str | None = None, data_name: str | None = None,
                    chunk: int = CHUNK, widen_to: str = "int") -> DataFrame:
    """A3 + B5: ``(data_name, split, shard_id, pos, tokens)`` of flat shard files, of one split and data name if given."""
    if split is not None and split not in SPLIT_LABELS:
        raise ValueError(f"unknown split {split!r}")
    register(spark)
    reader = spark.read.format(FORMAT).option("path", path).option("chunk", chunk)
    for key, value in (("split", split), ("data_name", data_name)):
        reader = reader if value is None else reader.option(key, value)
    return reader.load().withColumn("tokens", F.col("tokens").cast(f"array<{widen_to}>"))
