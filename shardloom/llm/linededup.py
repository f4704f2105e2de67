"""Operator 11: lines that many documents share, dropped everywhere but in one of them.

A line's key is the line without white space at both ends and with A-Z lower-cased.  A key of at least ``MIN_CHARS`` code points that
``MIN_DOCS`` documents hold loses all its lines except those of its first document in the order of the sort, the largest ``doc_id``.

* **Hashes**: each document gives one row for each of its distinct long keys: a 128-bit hash, the document and the positions of the
  key's lines as bytes.  Texts don't go on.
* **Range partition with secondary sort**: rows are dealt by ranges of (hash, document, text) and sorted by them, documents in
  descending order.  A key with a third of all rows so spreads over many ranges.
* **Streaming first occurrences**: a task walks its sorted rows in batches and holds only the few rows of a key of which it has not
  yet seen ``MIN_DOCS`` documents; those behind the first document are dropped as soon as it has.  A key that reaches a range's edge may go on in the
  next one: its rows are written as open, with a summary for each range (two at most), and the summaries of all ranges (two a
  partition, a number set by the configuration) settle them.
* **Bitmaps**: dropped positions meet by document and give a keep bitmap, a bit a line, deflated.  ``apply_bitmaps`` cuts the texts.

Defined results: a null or empty text is one empty line; rows of one id are one document, and the rows of an id are told apart by their
texts; rows with a null id are one document, that of the smallest id; equal rows have equal bitmaps (and meet in one range, as many as there are); an empty table
gives an empty result; other columns are not looked at by ``keep_bitmaps`` and pass through ``apply_bitmaps``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, staged

MIN_CHARS, MIN_DOCS = 40, 5
_BLANK = b" \t\n\v\f\r"
_NULL_ID = -(1 << 63)
_LATER = re.compile(rb"[\x80-\xbf]")


def _who() -> list[Column]:
    """What tells rows of ``documents`` apart: the id, and the text for those that share one."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")]


def long_keys(text: bytes, min_chars: int = MIN_CHARS) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the places of the lines of every key of at least ``min_chars`` code points."""
    found: dict[bytes, list[int]] = {}
    lines = text.split(b"\n")
    for at, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(_BLANK).lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key) - len(_LATER.findall(key)) >= min_chars):
                found.setdefault(key, []).append(at)
    return len(lines), found


def key_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 (the key's hash), later (~doc: rising as ids fall), text_key, n_lines, places (little-endian unsigned 32-bit) of each document's keys."""

    def run(batches):
        for part in slices(batches, "text"):
            hashes, row, n_lines, places = [], [], [], []
            for k, text in enumerate(part.column("text")):
                n, found = long_keys(text.as_buffer().to_pybytes(), min_chars)
                hashes += map(xxhash.xxh3_128_digest, found)
                row += [k] * len(found)
                n_lines += [n] * len(found)
                places += [at[0].to_bytes(4, "little") if len(at) == 1 else np.array(at, "<u4").tobytes() for at in found.values()]
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), part.column("later").take(of), part.column("text_key").take(of), pa.array(n_lines, pa.int32()), pa.array(places, pa.binary())],
                names=["h1", "h2", "later", "text_key", "n_lines", "places"],
            )

    doc, text_key = _who()
    rows = docs.select(F.bitwise_not(doc).alias("later"), text_key, F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "h1 long, h2 long, later long, text_key long, n_lines int, places binary")


_STREAMED = "kind int, part int, h1 long, h2 long, later long, text_key long, n_lines int, places binary, n_docs long, last long"
#: Kinds of streamed rows: dropped for certain; open, as the key reaches an edge of the range; the summary of such a key.
DROPPED, OPEN, SUMMARY = 0, 1, 2
_ROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("later", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary())])
_OUT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *_ROW, ("n_docs", pa.int64()), ("last", pa.int64())])


def _rows_out(kind: int, part: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    for b in rows.combine_chunks().to_batches():
        fixed = [pa.array(np.full(b.num_rows, v, np.int32)) for v in (kind, part)]
        yield pa.RecordBatch.from_arrays([*fixed, *b.columns, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64())], schema=_OUT)


def stream_drops(batches: Iterable[pa.RecordBatch], part: int, min_docs: int = MIN_DOCS) -> Iterator[pa.RecordBatch]:
    """Dropped and open rows and summaries of one range of sorted key rows.

    The key that a batch ends with is either known by a few numbers (``now``: it has ``min_docs`` documents already or came first in
    the range, so its rows are out) or its rows are held, fewer than ``min_docs`` documents of them.
    """
    held = _ROW.empty_table()
    now = None  # key, first and last document, number of documents, whether it came first in the range
    begun = False

    def summary() -> pa.RecordBatch:
        key, first, last, docs, _ = now
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([SUMMARY, part, *key, first, None, None, None, docs, last], _OUT)], schema=_OUT)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(_ROW)])
        h1, h2, later = (rows.column(c).to_numpy() for c in ("h1", "h2", "later"))
        new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        starts = np.flatnonzero(new_key)
        docs = np.add.reduceat(new_key | np.r_[True, later[1:] != later[:-1]], starts, dtype=np.int64)
        first, left = later[starts].copy(), np.zeros(len(starts), bool)
        if not begun:
            begun, left[0] = True, True
        elif now and now[0] == (h1[0], h2[0]):
            docs[0] += now[3] - (now[2] == later[0])
            first[0], left[0] = now[1], now[4]
        elif now and now[4]:
            yield summary()
        of = np.cumsum(new_key) - 1
        yield from _rows_out(OPEN, part, rows.filter(pa.array(left[of])))
        yield from _rows_out(DROPPED, part, rows.filter(pa.array((docs[of] >= min_docs) & ~left[of] & (later != first[of]))))
        if left[0] and len(starts) > 1:
            now = ((h1[0], h2[0]), first[0], later[starts[1] - 1], docs[0], True)
            yield summary()
        if left[-1] or docs[-1] >= min_docs:
            now, held = ((h1[-1], h2[-1]), first[-1], later[-1], docs[-1], bool(left[-1])), held.slice(0, 0)
        else:
            now, held = None, rows.slice(int(starts[-1]))
    if held.num_rows:
        later = held.column("later").to_numpy()
        yield from _rows_out(OPEN, part, held)
        now = ((held.column("h1")[0].as_py(), held.column("h2")[0].as_py()), later[0], later[-1], len(np.unique(later)), False)
    if now:
        yield summary()


def dropped_rows(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, parts: int | None = None) -> DataFrame:
    """later, text_key, n_lines, places of the lines that go."""
    keys = ["h1", "h2", "later", "text_key"]
    # staged, as finding the ranges reads the keys before the rows are dealt
    ranged = staged(key_rows(docs, min_chars), "line-keys").repartitionByRange(parts or shuffle_partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches):
        from pyspark import TaskContext

        return stream_drops(batches, TaskContext.get().partitionId(), min_docs)

    streamed = staged(ranged.mapInArrow(run, _STREAMED), "line-drops")
    at_edge = Window.partitionBy("h1", "h2").orderBy("part")
    known = streamed.where(F.col("kind") == SUMMARY).select("h1", "h2", "later", "n_docs", (F.lag("last").over(at_edge) == F.col("later")).alias("again"))
    known = known.groupBy("h1", "h2").agg(F.min("later").alias("first"), (F.sum("n_docs") - F.sum(F.coalesce(F.col("again"), F.lit(False)).cast("long"))).alias("total"))
    # two rows a partition at most
    settled = streamed.where(F.col("kind") == OPEN).join(F.broadcast(known.where(F.col("total") >= min_docs)), ["h1", "h2"]).where("later <> first")
    columns = ["later", "text_key", "n_lines", "places"]
    return streamed.where(F.col("kind") == DROPPED).select(*columns).union(settled.select(*columns))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, parts: int | None = None) -> DataFrame:
    """doc_id, text_key (``xxhash64`` of the text), n_lines, n_dropped, keep of ``docs`` (doc_id, text) that lose lines; all others keep all.

    ``keep`` is deflated: a bit a line, the first one highest in its byte, 1 for lines that stay.
    """

    def run(batches):
        for b in batches:
            dropped, keep = [], []
            for n, places in zip(b.column("n_lines").to_pylist(), b.column("places").to_pylist()):
                bits = np.ones(n, bool)
                bits[np.frombuffer(b"".join(places), "<u4")] = False
                dropped.append(n - int(bits.sum()))
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), b.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "text_key", "n_lines", "n_dropped", "keep"])

    by_doc = dropped_rows(docs, min_chars, min_docs, parts).groupBy("later", "text_key").agg(F.first("n_lines").cast("long").alias("n_lines"), F.collect_list("places").alias("places"))
    doc = F.bitwise_not("later")
    named = by_doc.select(F.when(doc != _NULL_ID, doc).alias("doc_id"), "text_key", "n_lines", "places")
    return named.mapInArrow(run, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """What is left of a text, its lines, and how many of them go."""
    if keep is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    left = list(compress(lines, bits.tolist()))
    return b"\n".join(left), len(lines), len(lines) - len(left)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay, n_lines and n_dropped; columns of these two names (in any case) are replaced."""
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(*_who(), F.coalesce("text", F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    doc, _ = _who()
    rows = rows.join(bitmaps.select(doc, "text_key", "keep"), ["doc", "text_key"], "left").select("rest", "text", "keep")

    def run(batches):
        for part in slices(batches, "text"):
            done = [kept_lines(t.as_buffer().to_pybytes(), k) for t, k in zip(part.column("text"), part.column("keep").to_pylist())]
            text = pa.array([d[0] for d in done], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("rest"), text, *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["rest", "text", "n_lines", "n_dropped"])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType([rows.schema["rest"]]).add("text", StringType()).add("n_lines", LongType()).add("n_dropped", LongType())
    cut = rows.mapInArrow(run, schema)
    shown = ["text" if c.lower() == "text" else f"rest.`{c}`" for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return cut.select(*shown, "n_lines", "n_dropped")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without the lines that go, with n_lines (before) and n_dropped."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))


def digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of ``docs`` (doc_id, text)."""
    return drop_lines(docs.select("doc_id", "text"), min_chars, min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
