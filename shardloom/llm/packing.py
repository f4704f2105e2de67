"""Operator 9: shortest-pack-first packing over the length histogram.

Documents are encoded once, ended, cut into pieces of at most ``capacity`` ids and staged in the shared folder with each piece's
running number among the pieces of its length in its task.  The histogram of lengths (``capacity`` rows at most) is all that the
driver sees: it places lengths longest first, each into the packs with the most space left, and opens packs only where none has
room.  What it keeps are patterns (the lengths of a pack) with their counts, never packs: work and memory depend on ``capacity``
alone.  Patterns go back to pieces by rank: the r-th piece of a length takes the r-th slot that the patterns have for it.  Ranks are
the number in the task plus a running count of (task, length) pairs, so a length that a third of all pieces have is no hot group.

Defined results: a null or empty text is its end id alone, one piece of length 1; repeated rows and null ids each give their own
pieces; equal lengths are told apart by task and number; an empty table has no pieces.  Sequences have ``capacity`` ids when padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged
from .wordbpe import encoder

CAPACITY = 4096
#: Bytes of text that are encoded at once: what is made of them is many times that in a worker, which other stages use as well.
ENCODE_BYTES = 1 << 20


def shortest_pack_first(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, from how many pieces there are of each length."""
    open_packs: list[list[list]] = [[] for _ in range(capacity + 1)]  # by space left: [lengths, count]
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left, space = counts[length], capacity
        while left:
            while space >= length and not open_packs[space]:
                space -= 1
            if space < length:  # no pack has room: a new one takes as many of this length as fit
                fit = capacity // length
                for k, n in ((fit, left // fit), (left % fit, 1)):
                    if k and n:
                        open_packs[capacity - k * length].append([(length,) * k, n])
                break
            lengths, n = open_packs[space].pop()
            used = min(n, left)
            if n > used:
                open_packs[space].append([lengths, n - used])
            open_packs[space - length].append([(*lengths, length), used])
            left -= used
            space = max(space, 0)
    return [(tuple(lengths), n) for packs in reversed(open_packs) for lengths, n in packs]


class Slots:
    """Where the r-th piece of a length goes, for all lengths."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for lengths, n in patterns:
            at = 0
            for length in sorted(set(lengths), reverse=True):
                times = lengths.count(length)
                rows.append((length, taken.get(length, 0), times, sequence, at))
                taken[length] = taken.get(length, 0) + times * n
                at += times * length
            sequence += n
        rows.sort()
        self.length, self.first, self.times, self.sequence, self.offset = np.array(rows or np.empty((0, 5)), np.int64).T
        self.key = (self.length << 44) | self.first
        self.sequences = sequence

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        row = np.searchsorted(self.key, (length << 44) | rank, "right") - 1
        slot, times = rank - self.first[row], self.times[row]
        return self.sequence[row] + slot // times, self.offset[row] + slot % times * length


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Staged pieces of ``docs`` (doc_id, text): part (task), number (of its length in the task), doc_id, start, length, doc_tokens, ids_crc32, ids (little-endian 16- or 32-bit)."""
    schema = "part string, number long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"

    def run(batches):
        from pyspark import TaskContext

        # the partition's number: the same input is ranked alike in every run, and a task that runs again replaces its rows
        bert, part_key, seen = encoder(path), f"{TaskContext.get().partitionId():010d}", np.zeros(capacity + 1, np.int64)
        kind = "<u2" if len(bert.ends) <= 1 << 16 else "<u4"
        for part in slices(batches, "text", ENCODE_BYTES):
            ids, n = bert.encode([t or "" for t in part.column("text").to_pylist()])
            full = np.full(len(ids) + len(n), end_id, np.dtype("<u4"))
            full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            n = n + 1
            cuts = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
            length = np.minimum(capacity, n[doc] - start)
            order = np.argsort(length, kind="stable")
            first = np.r_[0, np.flatnonzero(np.diff(length[order])) + 1] if len(order) else order
            number = np.empty_like(length)
            number[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            number += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            ends = np.cumsum(length)
            crc = [zlib.crc32(full[e - k : e].tobytes()) for e, k in zip(ends.tolist(), length.tolist())]
            small = full.astype(kind)
            held = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(np.r_[0, ends * small.itemsize].astype(np.int32)), pa.py_buffer(small.tobytes())])
            rows = pa.array([part_key] * len(doc)), pa.array(number), part.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, n[doc], crc)), held
            yield pa.RecordBatch.from_arrays(list(rows), names=["part", "number", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return staged(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (part, number, length and whatever else) with ``sequence_id`` and ``offset``."""
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    slots = Slots(shortest_pack_first(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("_base"))
    ranked = cut.join(base, ["part", "length"])
    kept = [c for c in cut.columns if c not in ("part", "number", "sequence_id", "offset")]

    def run(batches):
        for part in batches:
            number, base, length = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("number", "_base", "length"))
            sequence, offset = slots.place(length, base + number)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for."""
    cut = pieces(docs, path, end_id, capacity)
    return place(cut if ids else cut.drop("ids"), capacity)


def sequences(placed: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Padded sequences: sequence_id, ids (``capacity`` integers).  A group has at most ``capacity`` pieces."""

    def run(key, part):
        part = part.sort_by("offset")
        out = np.full(capacity, pad_id, np.int64)
        for at, n, held in zip(part["offset"].to_pylist(), part["length"].to_pylist(), part["ids"].to_pylist()):
            out[at : at + n] = np.frombuffer(held, f"<u{len(held) // n}")
        return pa.table({"sequence_id": [key[0].as_py()], "ids": [out]})

    return placed.groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<long>")
