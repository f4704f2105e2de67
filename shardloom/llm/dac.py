"""Operator 6: token ids in files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first.  Level 0 holds the first chunk of every id, level 1 the second chunk of those ids that
have one, and so on.  Each level has a bitmap that tells which of its chunks go on, and a rank directory (set bits before every 512
bits).  The i-th id is read from one byte of each of its levels: its place in the next level is the rank of its place in this one.
No block is decoded.

File (little-endian): segments of at most ``SEGMENT`` ids, so that a writer's memory is bounded however long a document is; then the
footer: for every segment its byte offset, ids and levels, for every document its id, null flag and end; last 16 bytes: footer's
length and ``MAGIC``.  A segment: per level u64 count, chunk bytes, bitmap (u64 words), rank directory (u64 per 8 words).

``write_ids`` deals documents to files by ranges of ``doc_id`` (bounds from one aggregate over that column alone), sorts inside each
and writes one file a range through ``pyarrow.fs`` into the shared folder, under a name of its own for each attempt.  Which files
count is told by a manifest that Spark commits: one of an attempt that failed or was lost is never read.

Defined results: documents with equal ids follow each other in the order of their tokens; null ids come last; an empty text has the
end id only; an empty table makes no files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, shuffle_partitions, slices, staged, staged_folder
from .wordbpe import encoder

MAGIC = b"DACIDS01"
SEGMENT = 1 << 20
_WORDS = 8  # 64-bit bitmap words for each entry of the rank directory


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def encode_segment(ids: np.ndarray) -> tuple[bytes, int]:
    """Bytes of a segment and its number of levels."""
    out, levels, rest = [], 0, ids.astype(np.uint32)
    while True:
        chunk, rest = (rest & 0xFF).astype(np.uint8), rest >> np.uint32(8)
        more = rest > 0
        n = len(chunk)
        words = -(-max(n, 1) // 64)
        bits = np.zeros(words * 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        ones = np.bitwise_count(bits.view("<u8")).astype(np.uint64)
        before = np.cumsum(ones) - ones
        out += [np.uint64(n).tobytes(), chunk.tobytes(), bits.tobytes(), before[::_WORDS].astype("<u8").tobytes()]
        levels += 1
        rest = rest[more]
        if not len(rest):
            return b"".join(out), levels


class DacFile:
    """Random access to the ids of one file; reads only the bytes that it needs."""

    def __init__(self, path: str):
        store, at = _store(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no file of directly addressable codes")
        length = int.from_bytes(tail[:8], "little")
        foot = self.file.read_at(length, size - 16 - length)
        segments, docs = np.frombuffer(foot, "<u8", 2).tolist()
        self.segments = np.frombuffer(foot, "<u8", 3 * segments, 16).reshape(-1, 3).astype(np.int64)
        at = 16 + 24 * segments
        self.doc_id = np.frombuffer(foot, "<i8", docs, at)
        self.end = np.frombuffer(foot, "<i8", docs, at + 8 * docs)
        self.null = np.frombuffer(foot, np.uint8, docs, at + 16 * docs).astype(bool)
        self.first = np.cumsum(self.segments[:, 1]) - self.segments[:, 1]

    def _segment(self, offset: int, levels: int, a: int, b: int) -> np.ndarray:
        """Ids a..b-1 of a segment."""
        out, shift, slot = np.zeros(b - a, np.uint32), 0, None
        for _ in range(levels):
            n = int.from_bytes(self.file.read_at(8, offset), "little")
            words = -(-max(n, 1) // 64)
            bitmap, ranks = offset + 8 + n, offset + 8 + n + 8 * words
            chunk = np.frombuffer(self.file.read_at(b - a, offset + 8 + a), np.uint8).astype(np.uint32) << np.uint32(shift)
            if slot is None:
                out |= chunk
            else:
                out[slot] |= chunk
            group = a // (64 * _WORDS)
            first, last = group * _WORDS, -(-b // 64)
            bits = np.unpackbits(np.frombuffer(self.file.read_at(8 * (last - first), bitmap + 8 * first), np.uint8), bitorder="little")
            before = int.from_bytes(self.file.read_at(8, ranks + 8 * group), "little") + int(bits[: a - 64 * first].sum())
            on = np.flatnonzero(bits[a - 64 * first : b - 64 * first])
            if not len(on):
                break
            slot = on if slot is None else slot[on]
            offset, shift, a, b = ranks + 8 * -(-words // _WORDS), shift + 8, before, before + len(on)
        return out

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the file."""
        parts = []
        while start < stop:
            s = int(np.searchsorted(self.first, start, "right")) - 1
            offset, n, levels = self.segments[s].tolist()
            a = start - int(self.first[s])
            b = min(n, a + stop - start)
            parts.append(self._segment(offset, levels, a, b))
            start += b - a
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.end[k - 1]) if k else 0, int(self.end[k]))


class _Writer:
    """Writes one file; at most a segment and one document's ids are in memory."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.dac"
        store, at = _store(self.path)
        store.create_dir(at.rpartition("/")[0])
        self.out = store.open_output_stream(at)
        self.at, self.held, self.waiting, self.total = 0, [], 0, 0
        self.segments: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, bool]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.docs.append((doc_id or 0, self.total, doc_id is None))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= SEGMENT:
            self._flush(SEGMENT)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held)
        while len(ids) >= max(least, 1):
            data, levels = encode_segment(ids[:SEGMENT])
            self.out.write(data)
            self.segments.append((self.at, len(ids[:SEGMENT]), levels))
            self.at += len(data)
            ids = ids[SEGMENT:]
        self.held, self.waiting = [ids], len(ids)

    def close(self) -> tuple[str, int, int]:
        if self.waiting:
            self._flush(1)
        foot = b"".join([np.array([len(self.segments), len(self.docs)], "<u8").tobytes(), np.array(self.segments, "<u8").tobytes(), *(np.array([d[k] for d in self.docs], kind).tobytes() for k, kind in ((0, "<i8"), (1, "<i8"), (2, np.uint8)))])
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.path, len(self.docs), self.total


def encode_documents(docs: DataFrame, path: str, end_id: int, bounds: list[int]) -> DataFrame:
    """``bucket`` (range of doc_id), ``doc_id`` and ``ids`` (16-bit integers where the vocabulary allows, else 32-bit) with the end id."""

    def run(batches):
        bert = encoder(path)
        kind = "<u2" if len(bert.ends) <= 1 << 16 else "<u4"
        for part in slices(batches, "text"):
            ids, n = bert.encode([t or "" for t in part.column("text").to_pylist()])
            full = np.full(len(ids) + len(n), end_id, kind)
            place = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)
            full[place] = ids
            ends = (np.cumsum(n + 1) * full.itemsize).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[np.int32(0), ends]), pa.py_buffer(full.tobytes())])
            keys = part.column("key").to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(np.array(bounds, np.int64), keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), part.column("key"), part.column("doc_id"), column], names=["bucket", "key", "doc_id", "ids"])

    return docs.select("doc_id", "text", id_key().alias("key")).mapInArrow(run, "bucket int, key long, doc_id long, ids binary")


def range_bounds(docs: DataFrame, parts: int) -> list[int]:
    """``parts - 1`` or fewer keys that cut the documents into ranges of like size: one aggregate over the id column."""
    if parts < 2:
        return []
    share = ", ".join(str(k / parts) for k in range(1, parts))
    row = docs.select(id_key().alias("key")).agg(F.expr(f"percentile_approx(key, array({share}), {max(10_000, 20 * parts)})").alias("b")).first()
    return sorted(set(row["b"] or []))


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str, parts: int | None = None) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) to files under ``folder``; returns the committed manifest: bucket, path, n_docs, n_ids."""
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    bounds = range_bounds(docs, parts)
    wide = "<u2" if len(encoder(path).ends) <= 1 << 16 else "<u4"
    dealt = encode_documents(docs, path, end_id, bounds).repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "key", "ids")

    def run(batches):
        writer, bucket, done = None, None, []
        for part in batches:
            for b, doc_id, ids in zip(part.column("bucket").to_pylist(), part.column("doc_id").to_pylist(), part.column("ids")):
                if b != bucket:
                    if writer:
                        done.append((bucket, *writer.close()))
                    writer, bucket = _Writer(folder), b
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), wide))
        if writer:
            done.append((bucket, *writer.close()))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["bucket", "path", "n_docs", "n_ids"])

    return staged(dealt.mapInArrow(run, "bucket int, path string, n_docs long, n_ids long"), "dac-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document as read back from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The running sum goes over one row a file.
    """
    spark = manifest.sparkSession
    before = F.sum("n_ids").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0))).select("path", "base")

    def documents(path: str, base: int) -> Iterator[pa.RecordBatch]:
        file = DacFile(path)
        rows, k, at, crc, total = [], 0, 0, 0, int(file.end[-1]) if len(file.end) else 0
        while at < total:
            ids = file.tokens(at, min(at + SEGMENT, total)).astype("<u4")
            done = 0
            while k < len(file.end) and file.end[k] <= at + len(ids):
                to = int(file.end[k]) - at
                start = int(file.end[k - 1]) if k else 0
                rows.append((None if file.null[k] else int(file.doc_id[k]), base + start, int(file.end[k]) - start, zlib.crc32(ids[done:to].tobytes(), crc)))
                k, done, crc = k + 1, to, 0
            crc = zlib.crc32(ids[done:].tobytes(), crc)
            at += len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                rows = []

    def run(batches):
        for part in batches:
            for path, base in zip(part.column("path").to_pylist(), part.column("base").to_pylist()):
                yield from documents(path, base)

    return files.repartition(shuffle_partitions(spark), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Files of ``docs`` in a new folder of the shared one, and their manifest."""
    return write_ids(docs, path, end_id, staged_folder(docs.sparkSession, "dac"))
