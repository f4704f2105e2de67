"""Operator 10: repeated passages by distributed prefix doubling over sampled positions.

Every byte that lies in a ``LENGTH``-byte string which also starts in a document with a smaller ``doc_id`` is removed.  Matches never
cross documents and are judged on the input.

A suffix array by prefix doubling ranks every position by its first 1, 2, 4 ... bytes and sorts pairs (rank at i, rank at i + n).  A
row for each byte would be many times the input, and most of them are unique after a few bytes.  So positions are sampled so that no
match can be missed: of the ``ANCHOR``-byte strings in a window of ``LENGTH`` bytes, the one with the least hash is the window's
anchor; equal windows have their anchors at the same place.  The rounds, each a shuffle of the positions that are left:

1. rank by ``ANCHOR`` bytes, then by the pair (that rank, rank of the stretch around it that all the anchor's windows cover).  Tasks
   sort the pairs.  A position whose first rank is in one document only is unique and leaves; a position whose pair is in a smaller
   document too is settled, all its windows repeat; the rest go on.
2. the stretches of what is left (first holders of a pair whose anchor has other stretches) are sorted by the pair (rank of the first
   half, rank of the second half) of each of their windows, past the threshold.  They are dealt to tasks by ``SIDE`` bytes that all
   windows of a stretch hold, anchor included.

Then each document gets its settled windows and is cut.  Ranks are 64-bit hashes (their order has no meaning of its own, only
equality counts); a window is removed when both ranks of a pair agree, 128 bits.

Hot passages: a task settles all but the smallest document's rows of a pair by itself before the shuffle, so a passage that a third
of all documents share sends a row for each task and not for each document.  (At the passage's edges the stretches do differ from
document to document; of these about four a document, of some 20 bytes, meet by what they share.)  Rows travel in compressed columns
of about ``CHUNK`` positions.  Long texts are worked on in overlapping pieces.  What is staged lies in the shared folder.

Defined results: null and empty texts and texts below ``LENGTH`` bytes lose nothing; documents with equal ids do not make each other
repeat, whatever their texts, and each row is cut on its own; null ids count as one id greater than all others; other columns pass through untouched; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, NullType, StructField, StructType

from .common import Powers, id_key, mix, ragged, shuffle_partitions, slices, staged

LENGTH, ANCHOR = 50, 16
#: Bytes that every window holds on one side of its anchor, the anchor among them.
SIDE = ANCHOR + (LENGTH - ANCHOR) // 2
#: Bytes of text worked on at once, and sampled positions sent as one record.
PIECE, CHUNK = 1 << 20, 1 << 19
_U64 = np.uint64
_TEXT, _ANCHORS, _SETTLED, _OPEN, _STRETCH = range(5)

_one, _two = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns of integers, each split into byte planes (equal high bytes vanish) and compressed."""
    out = []
    for values in columns.values():
        raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes()
        data = pa.compress(raw, codec="zstd", asbytes=True)
        out += [len(raw).to_bytes(8, "little"), len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def unpack(data: bytes, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, kind in kinds.items():
        raw, n = (int.from_bytes(data[at + k : at + k + 8], "little") for k in (0, 8))
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(pa.decompress(data[at + 16 : at + 16 + n], raw, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
        out[name], at = np.ascontiguousarray(planes.T).reshape(-1).view(kind), at + 16 + n
    return out


#: Columns of the records: who (id and tag of a document), first window and number of windows; ranks.
_WHO = {"key": "<i8", "tag": "<u4", "lo": "<u4", "n": "<u2"}
_RANKED = {"rank": "<u8", "pair": "<u8", **_WHO}
_KINDS = {_ANCHORS: _RANKED, _SETTLED: _WHO, _OPEN: _WHO, _STRETCH: {"rank": "<u8", **_WHO}}

_SCHEMA = StructType([StructField("part", IntegerType()), StructField("kind", IntegerType()), StructField("data", BinaryType()), StructField("more", BinaryType())])


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a long column (the public XXH64 of eight bytes, seed 42)."""
    p1, p2, p3, p4, p5 = (_U64(c) for c in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << _U64(n)) | (v >> _U64(64 - n))
    with np.errstate(over="ignore"):
        h = _U64(42) + p5 + _U64(8) ^ turn(x.astype(np.int64).view(_U64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> _U64(33))) * p2
        h = (h ^ (h >> _U64(29))) * p3
        return (h ^ (h >> _U64(32))).view(np.int64)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return np.mod(spark_hash(key), parts).astype(np.int32)


def record_batch(rows: list[tuple[int, int, bytes, bytes | None]]) -> pa.RecordBatch:
    part, kind, data, more = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()), pa.array(more, pa.binary())], names=["part", "kind", "data", "more"])


def by_part(part: np.ndarray, kind: int, columns: dict[str, np.ndarray]) -> list[tuple[int, int, bytes, None]]:
    """Records of one kind, one for each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    return [(int(part[a]), kind, pack({c: v[order[a:b]] for c, v in columns.items()}), None) for a, b in zip(first, np.r_[first[1:], len(part)])]


def sampled(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rank, pair, first window and number of windows of each anchor of a piece of at least ``LENGTH`` bytes."""
    prefix = _one.prefix(text)
    at = np.arange(len(text) - ANCHOR + 1)
    rank = _one.span(prefix, at, at + ANCHOR)
    width = LENGTH - ANCHOR + 1
    # the least hash and, among equals, the leftmost place, in one integer
    least, size = (rank >> _U64(21) << _U64(21)) | at.astype(_U64), 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & _U64((1 << 21) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    n = np.diff(np.r_[first, len(anchor)])
    place = anchor[first]
    pair = _one.span(prefix, first, first + n + LENGTH - 1) ^ mix((place - first).astype(_U64))
    return rank[place], pair, first, n


def rerank(rows: dict[str, np.ndarray], names: tuple[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows sorted by (rank, pair, key), the order, where a new rank begins and where a new pair begins."""
    a, b = names
    order = np.lexsort((rows["key"], rows[b], rows[a]))
    rows = {c: v[order] for c, v in rows.items()}
    new = np.r_[True, rows[a][1:] != rows[a][:-1]] if len(order) else np.empty(0, bool)
    pair = new | np.r_[True, rows[b][1:] != rows[b][:-1]] if len(order) else new
    return order, rows, new, pair


def least_key(rows: dict[str, np.ndarray], begins: np.ndarray) -> np.ndarray:
    """For rows sorted within runs by key, the least key of each row's run."""
    return rows["key"][np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))]


class _Pieces:
    """Texts as bytes in pieces of at most ``PIECE`` window starts; a piece holds the bytes that its windows need."""

    def __init__(self, part: pa.RecordBatch):
        self.keys = part.column("key").to_numpy(zero_copy_only=False)
        self.tags = part.column("tag").to_numpy(zero_copy_only=False).astype(np.uint32)
        self.texts = part.column("text")

    def __iter__(self):
        for key, tag, text in zip(self.keys.tolist(), self.tags.tolist(), self.texts):
            data = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.empty(0, np.uint8)
            yield key, tag, data


def anchors(batches, parts: int):
    """Round 1, before the shuffle: sampled positions, settled among themselves."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush():
        nonlocal held, count
        if not held:
            return []
        rows = dict(zip(_RANKED, map(np.concatenate, zip(*held))))
        rows = {c: rows[c].astype(kind) for c, kind in _RANKED.items()}
        held, count = [], 0
        _, rows, _, pair = rerank(rows, ("rank", "pair"))
        later = rows["key"] > least_key(rows, pair)
        who = {c: rows[c][later] for c in _WHO}
        first = {c: v[~later] for c, v in rows.items()}
        return by_part(part_of(who["key"], parts), _SETTLED, who) + by_part(np.mod(first["rank"].view(np.int64), parts), _ANCHORS, first)

    for batch in batches:
        for part in slices([batch], "text", PIECE):
            for key, tag, text in _Pieces(part):
                for start in range(0, len(text) - LENGTH + 1, PIECE):
                    rank, pair, lo, n = sampled(text[start : start + PIECE + LENGTH - 1])
                    held.append((rank, pair, np.full(len(lo), key), np.full(len(lo), tag), lo + start, n))
                    count += len(lo)
                    if count >= CHUNK:
                        yield record_batch(flush())
    yield record_batch(flush())


def settle(batches):
    """Round 1, after the shuffle: which positions are unique, settled or still open."""
    found: list[dict[str, np.ndarray]] = []
    for batch in batches:
        through = []
        for part, kind, data in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "data"))):
            if kind == _SETTLED:
                through.append((part, kind, data, None))
            else:
                found.append(unpack(data, _RANKED))
        if through:
            yield record_batch(through)
    if not found:
        return
    rows = {c: np.concatenate([f[c] for f in found]) for c in _RANKED}
    found.clear()
    _, rows, new, pair = rerank(rows, ("rank", "pair"))
    later = rows["key"] > least_key(rows, pair)
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    low, high = np.minimum.reduceat(rows["key"], starts)[run], np.maximum.reduceat(rows["key"], starts)[run]
    others = np.add.reduceat(pair.astype(np.int64), starts)[run] > 1
    still = ~later & others & (high > low)  # other stretches, other documents
    for kind, mask in ((_SETTLED, later), (_OPEN, still)):
        who = {c: rows[c][mask] for c in _WHO}
        if mask.any():
            yield record_batch([(0, kind, pack(who), None)])


def cut_out(text: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches lo .. lo + n + LENGTH - 2 of a text, one after the other, and their lengths."""
    lengths = n.astype(np.int64) + LENGTH - 1
    return text[ragged(lo.astype(np.int64), lengths)], lengths


class _Lookup:
    """Rows of records by document."""

    def __init__(self, found: list[dict[str, np.ndarray]]):
        rows = {c: np.concatenate([f[c] for f in found]) if found else np.empty(0, kind) for c, kind in _WHO.items()}
        order = np.lexsort((rows["lo"], rows["tag"], rows["key"]))
        self.rows = {c: v[order] for c, v in rows.items()}
        new = np.r_[True, (np.diff(self.rows["key"]) != 0) | (np.diff(self.rows["tag"].astype(np.int64)) != 0)] if len(order) else np.empty(0, bool)
        first = np.flatnonzero(new)
        self.where = dict(zip(zip(self.rows["key"][first].tolist(), self.rows["tag"][first].tolist()), zip(first.tolist(), np.r_[first[1:], len(order)].tolist())))

    def __call__(self, key: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.where.get((key, tag), (0, 0))
        return self.rows["lo"][a:b], self.rows["n"][a:b]


def _gathered(batches, kind: int):
    """Records of one kind come first in a sorted partition; yields their lookup with each batch of texts that follows."""
    found, lookup = [], None
    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        k = int((kinds != _TEXT).sum())
        found += [unpack(d, _WHO) for d in batch.column("data").slice(0, k).to_pylist()]
        if k < batch.num_rows:
            if lookup is None:
                lookup = _Lookup(found)
                found = []
            yield lookup, batch.slice(k)


def stretches(batches, parts: int):
    """Round 2, before the shuffle: bytes of the open stretches, dealt by the anchor and what stands beside it."""
    held: list[tuple[np.ndarray, ...]] = []
    bytes_held: list[np.ndarray] = []
    count = 0

    def flush():
        nonlocal held, bytes_held, count
        if not held:
            return []
        rank, key, tag, lo, n = map(np.concatenate, zip(*held))
        data = np.concatenate(bytes_held)
        held, bytes_held, count = [], [], 0
        lengths = n.astype(np.int64) + LENGTH - 1
        offset = np.cumsum(lengths) - lengths
        part = np.mod(rank.view(np.int64), parts)
        out, order = [], np.argsort(part, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
        for a, b in zip(first, np.r_[first[1:], len(order)]):
            at = order[a:b]
            columns = {c: v[at].astype(kind) for (c, kind), v in zip(_KINDS[_STRETCH].items(), (rank, key, tag, lo, n))}
            raw = data[ragged(offset[at], lengths[at])].tobytes()
            out.append((int(part[at[0]]), _STRETCH, pack(columns), len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)))
        return out

    for lookup, batch in _gathered(batches, _OPEN):
        for key, tag, text in _Pieces(batch):
            lo, n = lookup(key, tag)
            for i in range(0, len(lo), CHUNK // 32):
                a, k = lo[i : i + CHUNK // 32], n[i : i + CHUNK // 32]
                data, lengths = cut_out(text, a, k)
                # the anchor again: the least hash of the stretch's first window
                prefix = _one.prefix(data)
                start = np.cumsum(lengths) - lengths
                at = start[:, None] + np.arange(LENGTH - ANCHOR + 1)
                rank = _one.span(prefix, at, at + ANCHOR)
                anchor = (rank >> _U64(21)).argmin(1)
                # windows with the anchor in their left part hold SIDE bytes from it on, the others as many up to its end: by these, and
                # not by the anchor alone, they are dealt, so that a string that is merely frequent does not fill one task
                early = np.clip(anchor - (LENGTH - SIDE), 0, k).astype(np.int64)
                for begin, many, side in ((0 * early, early, start + anchor + ANCHOR - SIDE), (early, k - early, start + anchor)):
                    some = many > 0
                    if some.any():
                        first, many, side = (a + begin)[some], many[some], side[some]
                        held.append((_one.span(prefix, side, side + SIDE), np.full(len(first), key), np.full(len(first), tag), first, many))
                        bytes_held.append(cut_out(text, first, many)[0])
                count += len(data)
                if count >= CHUNK * 16:
                    yield record_batch(flush())
    yield record_batch(flush())


def settle_windows(batches):
    """Round 2, after the shuffle: windows whose bytes start in a smaller document too."""
    found, data = [], []
    for batch in batches:
        for columns, raw in zip(batch.column("data").to_pylist(), batch.column("more").to_pylist()):
            found.append(unpack(columns, _KINDS[_STRETCH]))
            data.append(np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), np.uint8))
    if not found:
        return
    rows = {c: np.concatenate([f[c] for f in found]) for c in _KINDS[_STRETCH]}
    data = np.concatenate(data)
    lengths = rows["n"].astype(np.int64) + LENGTH - 1
    offset = np.cumsum(lengths) - lengths
    group = np.mod(rows["rank"] >> _U64(32), _U64(len(data) // PIECE + 1)).astype(np.int64)  # some anchors at a time
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        part = data[ragged(offset[at], lengths[at])]
        n = rows["n"][at].astype(np.int64)
        start = ragged(np.cumsum(lengths[at]) - lengths[at], n)
        half = LENGTH // 2
        one, two = _one.prefix(part), _two.prefix(part)
        ranked = {"rank": mix(_one.span(one, start, start + half)) ^ _one.span(one, start + half, start + LENGTH), "pair": mix(_two.span(two, start, start + half)) ^ _two.span(two, start + half, start + LENGTH)}
        ranked |= {"key": np.repeat(rows["key"][at], n), "tag": np.repeat(rows["tag"][at], n), "lo": ragged(rows["lo"][at].astype(np.int64), n).astype(np.uint32)}
        _, ranked, _, pair = rerank(ranked, ("rank", "pair"))
        later = ranked["key"] > least_key(ranked, pair)
        if later.any():
            # windows next to each other become one row
            key, tag, lo = (ranked[c][later] for c in ("key", "tag", "lo"))
            order = np.lexsort((lo, tag, key))
            key, tag, lo = key[order], tag[order], lo[order].astype(np.int64)
            new = np.r_[True, (np.diff(key) != 0) | (np.diff(tag.astype(np.int64)) != 0) | (np.diff(lo) > 1)]
            first = np.flatnonzero(new)
            last = lo[np.r_[first[1:], len(lo)] - 1]
            for i in range(0, 1 << 40, 60_000):  # a run's length must fit its column
                left = last - lo[first] - i
                if not (left >= 0).any():
                    break
                m = left >= 0
                who = {"key": key[first][m], "tag": tag[first][m], "lo": (lo[first][m] + i).astype(np.uint32), "n": np.minimum(left[m] + 1, 60_000).astype(np.uint16)}
                yield record_batch([(0, _SETTLED, pack(who), None)])


def dealt_to_documents(records: DataFrame, kind: int, parts: int) -> DataFrame:
    """Records of one kind, each row in the part of its document."""

    def run(batches):
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                rows = unpack(data, _WHO)
                yield record_batch(by_part(part_of(rows["key"], parts), kind, rows))

    return records.where(F.col("kind") == kind).mapInArrow(run, _SCHEMA)


def beside_texts(records: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Records and texts, dealt by document; in each partition the records come first."""
    rest = [c for c in texts.columns if c not in ("part", "kind")]
    left = records.select("part", "kind", "data", *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in rest))
    right = texts.select("part", F.lit(_TEXT).alias("kind"), F.lit(None).cast("binary").alias("data"), *rest)
    return left.unionByName(right).repartitionById(parts, "part").sortWithinPartitions(F.col("kind").desc())


def _each(docs: DataFrame, finish, schema: StructType | str, doc_id: str, text: str, parts: int | None) -> DataFrame:
    """``finish(row, texts, spans)`` for each batch of documents: their other columns as an array of structs, their texts, and for each
    the starts and ends of the bytes to remove, in order and apart."""
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    key = id_key(doc_id)
    repeated = docs.groupBy(key.alias("k")).count().where("count > 1").limit(1).count() > 0
    # rows of one id are told apart by their text
    tag = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 32)) if repeated else F.lit(0).cast("long")
    texts = docs.select(key.alias("key"), tag.alias("tag"), F.col(text).alias("text"), (F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)) if len(docs.columns) > 1 else F.struct(F.lit(None).alias("_"))).alias("row"))
    texts = texts.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    plain = texts.select("part", "key", "tag", "text")

    first = plain.select("key", "tag", "text").mapInArrow(lambda b: anchors(b, parts), _SCHEMA)
    round1 = staged(first.repartitionById(parts, "part").mapInArrow(settle, _SCHEMA), "repeats-anchors")
    open_rows = beside_texts(dealt_to_documents(round1, _OPEN, parts), plain, parts)
    second = open_rows.mapInArrow(lambda b: stretches(b, parts), _SCHEMA)
    round2 = staged(second.repartitionById(parts, "part").mapInArrow(settle_windows, _SCHEMA), "repeats-windows")
    settled = dealt_to_documents(round1, _SETTLED, parts).union(dealt_to_documents(round2, _SETTLED, parts))
    last = beside_texts(settled, texts, parts)

    def run(batches):
        for lookup, batch in _gathered(batches, _SETTLED):
            for part in slices([batch], "text", PIECE * 4):
                spans = []
                for k, t in zip(part.column("key").to_pylist(), part.column("tag").to_pylist()):
                    lo, n = lookup(k, t)
                    lo, end = lo.astype(np.int64), lo.astype(np.int64) + n + LENGTH - 1
                    if len(lo):
                        reach = np.maximum.accumulate(end)
                        new = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
                        lo, end = lo[new], reach[np.r_[new[1:] - 1, len(lo) - 1]]
                    spans.append((lo, end))
                yield finish(part.column("row"), part.column("text"), spans)

    return last.mapInArrow(run, schema)


def _row_type(docs: DataFrame, text: str) -> StructType:
    kept = [docs.schema[c] for c in docs.columns if c != text]
    return StructType(kept or [StructField("_", NullType())])


def removed_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``docs`` (other columns in a struct ``row``) with ``spans``: (start, end) of the bytes to remove, in order and apart."""
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])

    def finish(row, texts, spans):
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([s[k] for s in spans])) for k in (0, 1)], names=["start", "end"])
        ends = np.r_[0, np.cumsum([len(s[0]) for s in spans])]
        return pa.RecordBatch.from_arrays([row, texts, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["row", "text", "spans"])

    schema = StructType([StructField("row", _row_type(docs, text)), StructField("text", docs.schema[text].dataType), StructField("spans", ArrayType(span))])
    return _each(docs, finish, schema, doc_id, text, parts)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``docs`` (doc_id, text)."""

    def finish(row, texts, spans):
        rows = []
        for held, (starts, ends) in zip(texts, spans):
            data = memoryview(held.as_buffer() or b"") if held.is_valid else memoryview(b"")
            rows.append((len(data), int((ends - starts).sum()), len(starts), hashlib.sha256(remaining(data, starts, ends)).hexdigest()))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([row.field("doc_id").cast(pa.int64()), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _each(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "doc_id", "text", None)


def remaining(data, starts, ends) -> bytes:
    """Bytes outside the spans."""
    edges = [0, *(x for pair in zip(starts.tolist(), ends.tolist()) for x in pair), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2]))


def on_characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of UTF-8 bytes drawn in to whole characters; those left empty are dropped."""
    begins = np.r_[(data & 0xC0) != 0x80, True]
    firsts = np.flatnonzero(begins)
    starts = firsts[np.searchsorted(firsts, starts)]
    ends = firsts[np.searchsorted(firsts, ends, "right") - 1]
    return starts[ends > starts], ends[ends > starts]


def cut_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed bytes taken out of the text; a character stays if any byte of it does.  All other columns as they were."""

    def finish(row, texts, spans):
        new = []
        for old, (starts, ends) in zip(texts.to_pylist(), spans):
            if old and len(starts):
                data = old.encode()
                old = remaining(data, *on_characters(np.frombuffer(data, np.uint8), starts, ends)).decode()
            new.append(old)
        return pa.RecordBatch.from_arrays([row, pa.array(new, pa.string())], names=["row", "text"])

    cut = _each(docs, finish, StructType([StructField("row", _row_type(docs, text)), StructField("text", docs.schema[text].dataType)]), doc_id, text, None)
    return cut.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
