"""A8 + I2 over log files that grow: a Python streaming data source, ``growing_logs``.

Spark's file source reads a file once, but a run appends to one log file for hours.  Here the stream's offset is a map from file to
the number of bytes read, so each micro-batch reads what files have gained since.  Only whole lines count: the newest offset of a
file lies behind its last line end, and a line that is cut in two is read when its rest is there.  A gain of many bytes is split by
byte ranges; a range gives the lines that begin in it.

Rows are ``(run, file, value)``: the run comes from the file's name, as in ``read_log_lines``.  Files may lie in folders.  A file that is
shorter than what has been read of it fails the stream, since its lines can't be told apart any more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship_package
from .npy import file_system
from .telemetry import LOG_FILE_PATTERN, parse_step_lines

FORMAT = "growing_logs"
SCHEMA = "run string, file string, value string"
#: Bytes of a range, and bytes read at once.
RANGE, BLOCK = 32 << 20, 1 << 20


@dataclass
class ByteRange(InputPartition):
    path: str
    run: str
    first: int      # where the unread lines of the file begin
    start: int
    end: int


def last_line_end(stream, start: int, size: int) -> int:
    """The place behind the last line end in [start, size), or start."""
    at = size
    while at > start:
        low = max(start, at - BLOCK)
        stream.seek(low)
        found = stream.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


def lines_beginning_in(stream, first: int, start: int, end: int) -> Iterator[bytes]:
    """Whole lines that begin in [start, end); lines begin at ``first`` and behind each line end."""
    at = start
    rest = b""
    if start > first:  # the line that is open here belongs to the range before
        stream.seek(start - 1)
        skipped = _next_line_end(stream)
        at = start - 1 + skipped
    stream.seek(at)
    while at < end:
        block = stream.read(BLOCK)
        if not block:
            return
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if at >= end:
                return
            yield line
            at += len(line) + 1


def _next_line_end(stream) -> int:
    """Bytes up to and with the next line end."""
    read = 0
    while block := stream.read(BLOCK):
        found = block.find(b"\n")
        if found >= 0:
            return read + found + 1
        read += len(block)
    return read


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range", RANGE))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> dict[str, int]:
        from pyarrow import fs

        store, top = file_system(self.path)
        infos = store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        # what writers have not published begins with a dot or an underscore
        return {i.path: i.size for i in infos if i.is_file and re.search(LOG_FILE_PATTERN, i.path) and not re.search(r"/[._]", i.path[len(top):])}

    def latestOffset(self) -> dict:
        """Per file the place behind its last line end; looks back from the end only as far as that lies."""
        store, _ = file_system(self.path)
        found = {}
        for path, size in self._files().items():
            done = self.seen.get(path, 0)
            if size > done:
                with store.open_input_file(path) as stream:
                    found[path] = last_line_end(stream, done, size)
            else:
                found[path] = size if size < done else done
        self.seen = found
        return found

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        parts = []
        for path, to in sorted(end.items()):
            done = start.get(path, 0)
            if to < done:
                raise ValueError(f"{path} has {to} bytes, of which {done} were read: a log may only grow")
            run = re.search(LOG_FILE_PATTERN, path)[1]
            parts += [ByteRange(path, run, done, a, min(a + self.range, to)) for a in range(done, to, self.range)]
        return parts or [ByteRange("", "", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = file_system(self.path)
        with store.open_input_file(partition.path) as stream:
            held: list[str] = []
            for line in lines_beginning_in(stream, partition.first, partition.start, partition.end):
                held.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                if len(held) == 4096:
                    yield self._batch(partition, held)
                    held = []
            if held:
                yield self._batch(partition, held)

    @staticmethod
    def _batch(partition: ByteRange, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([partition.run] * n), pa.array([partition.path] * n), pa.array(lines, pa.string())], names=["run", "file", "value"])

    def commit(self, end: dict) -> None:
        pass


class GrowingLogs(DataSource):
    """Options: ``path`` (a folder of log files) and ``range`` (bytes a task reads)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def growing_log_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """A stream of the lines ``(run, file, value)`` that the log files under a folder have and gain."""
    ship_package(spark)
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format(FORMAT).option("path", path).option("range", range_bytes).load()


def live_log_steps(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """A stream of the step lines of growing logs, as columns."""
    return parse_step_lines(growing_log_lines(spark, path, range_bytes)).drop("file")
