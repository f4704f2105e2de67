"""Operator 12: phrases of two and three words that occur together more often than their parts would let expect.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and tabs into words.  Everything is
counted by language: a word of two languages is two words, with an id each, and texts don't run into each other.  A candidate has ``MIN_COUNT`` occurrences or more; cutting it in two parts with l and r occurrences gives
``floor(10**6 a a / (l r))``, of which the least counts.  A pair that stands in a candidate of three words with at least half its
occurrences is dropped.

* **Ids by frequency.**  A task turns its texts into blocks: a dictionary of the block's words and an array of places in it.
  Words with ``MIN_COUNT`` occurrences or more are ranked by frequency over all languages; a join by word, one row for each block that knows it, gives
  their ids back to the blocks.  No vocabulary is broadcast, and other words can't be in a candidate.
* **Direct-address tiles.**  Pairs of neighbouring ids lie in tiles of ``TILE`` x ``TILE``.  As ids are ranks, a block's pairs crowd in
  the first tiles: those are counted by ``bincount`` over all cells; pairs of all other tiles are sorted coordinates, counted by runs.
  Each block gives a row a pair; these rows are dealt once, by pair, and a window adds them up.
* **Recursion.**  Pairs with ``MIN_COUNT`` occurrences are ranked by frequency too and become ids: a phrase of three words is the
  pair (id of its first two words, id of its third), counted by the same tiles, where both of its pairs are frequent.

All figures are exact: counts are added as 64-bit numbers and scores divided as 38-digit decimals, for counts below 10**16.

Defined results: a null text is empty, a null language is ``und``; equal scores and counts are ranked by phrase (UTF-8 bytes); repeated
rows count again; texts without words and an empty table give no rows; other columns are not looked at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import row_index
from .common import slices, staged

MIN_COUNT, TOP = 10, 2000
#: Bytes of text in a block, side of a tile, pairs from which a tile is counted cell by cell.
BLOCK_BYTES, TILE_BITS, DENSE = 8 << 20, 10, 1 << 16
TILE = 1 << TILE_BITS
_MAP = bytes.maketrans(b".,;:!?\n\v\f\r\t", b"\n" * 10 + b" ")


class _Words(dict):
    """Places in a block's dictionary of the words of one language; new words are appended."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str]):
        super().__init__({b"\n": -1})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.langs.append(self.lang)
        at = self[word] = len(self.words) - 1
        return at

    def codes(self, text: bytes) -> Iterator[int]:
        """Places of the text's words, with a break (-1) at each separator."""
        return map(self.__getitem__, filter(None, text.lower().translate(_MAP).replace(b"\n", b" \n ").split(b" ")))


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Staged: block, words, langs and counts of its dictionary (a word of two languages is two), codes (int32, -1: break)."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        size, words, langs, by_lang, codes = 0, [], [], {}, array("i")

        def row() -> pa.RecordBatch:
            held = np.frombuffer(codes, np.int32)
            counts = np.bincount(held[held >= 0], minlength=len(words)).astype(np.int64)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([part << 32 | made], pa.int64()), one(pa.array(words, pa.binary()).cast(pa.string())), one(pa.array(langs, pa.string())), one(pa.array(counts)), pa.array([held.astype("<i4").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "words", "langs", "counts", "codes"])

        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                data = text.as_buffer().to_pybytes()
                if lang not in by_lang:
                    by_lang[lang] = _Words(lang, words, langs)
                codes.extend(by_lang[lang].codes(data))
                codes.append(-1)  # behind each text
                size += len(data) + 1
                if size >= block_bytes:
                    yield row()
                    size, words, langs, by_lang, codes, made = 0, [], [], {}, array("i"), made + 1
        if by_lang:
            yield row()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return staged(texts.mapInArrow(run, "block long, words array<string>, langs array<string>, counts array<long>, codes binary"), "word-blocks")


def _packed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """x and y in one number, x above, where both fit into 63 bits; else an error."""
    bits = int(y.max()).bit_length() if len(y) else 1
    if len(x) and int(x.max()).bit_length() + bits > 63:
        raise OverflowError("ids of a pair need more than 63 bits")
    return x << bits | y, bits


def tile_counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (x, y) of ids and how often each occurs: crowded tiles cell by cell, the rest by sorted coordinates."""
    found = []
    # a crowded tile is among the first ones of both axes, as ids are ranks; elsewhere nothing is lost, only sorted
    head = np.flatnonzero((x < 64 * TILE) & (y < 64 * TILE))
    near = (x[head] >> TILE_BITS) * 64 + (y[head] >> TILE_BITS)
    crowded = np.bincount(near, minlength=64 * 64) >= DENSE
    dense = crowded[near]
    sparse = np.ones(len(x), bool)
    sparse[head[dense]] = False
    for t in np.flatnonzero(crowded):
        at = head[near == t]
        cells = np.bincount((x[at] & (TILE - 1)) << TILE_BITS | y[at] & (TILE - 1), minlength=TILE * TILE)
        used = np.flatnonzero(cells)
        found.append(((t // 64) * TILE + (used >> TILE_BITS), (t % 64) * TILE + (used & (TILE - 1)), cells[used]))
    code, bits = _packed(x[sparse], y[sparse])
    code.sort()
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    found.append((code[new] >> bits, code[new] & ((1 << bits) - 1), np.diff(np.r_[new, len(code)])))
    return tuple(np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))


def _ids(row: dict) -> np.ndarray:
    return np.frombuffer(row["ids"], "<i8" if row["wide"] else "<i4").astype(np.int64)


def encoded(held: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Staged: block, wide, ids: the blocks' codes as ids of frequent words, -1 for breaks and other words."""
    entries = held.select("block", F.posexplode(F.arrays_zip("langs", "words")).alias("place", "e")).select("block", "place", F.col("e.langs").alias("lang"), F.col("e.words").alias("word"))
    entries = entries.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), "place", "id")

    def run(left, right):
        place, ident = right.column("place").to_numpy(), right.column("id").to_numpy()
        rows = left.to_pylist()
        for row in rows:
            codes = np.frombuffer(row.pop("codes"), "<i4")
            ids = np.full(int(codes.max(initial=-1)) + 2, -1, np.int64)  # the last one is that of a break
            ids[place] = ident
            row["wide"] = bool(ids.max() >= 1 << 31)
            row["ids"] = ids[codes].astype("<i8" if row["wide"] else "<i4").tobytes()
        return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())]))

    both = held.select("block", "codes").groupBy("block").cogroup(entries.groupBy("of"))
    return staged(both.applyInArrow(run, "block long, wide boolean, ids binary"), "word-ids")


def pairs_of_blocks(ids: DataFrame) -> DataFrame:
    """block, x, y, c of all pairs of neighbouring frequent words."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                w = _ids(row)
                both = (w[:-1] >= 0) & (w[1:] >= 0)
                x, y, c = tile_counts(w[:-1][both], w[1:][both])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), row["block"])), pa.array(x), pa.array(y), pa.array(c)], names=["block", "x", "y", "c"])

    return ids.mapInArrow(run, "block long, x long, y long, c long")


def triples(ids: DataFrame, known: DataFrame) -> DataFrame:
    """p, z, f: how often the pair with id p is followed by the word with id z, for phrases whose two pairs are both frequent;
    ``known`` (block, x, y, p) are the frequent pairs of each block."""
    known = known.select(F.col("block").alias("of"), "x", "y", "p")

    def run(left, right):
        px, py, pp = (right.column(c).to_numpy() for c in ("x", "y", "p"))
        found = [np.empty(0, np.int64)] * 3
        for row in left.to_pylist() if len(pp) else []:
            w = _ids(row)
            bits = int(max(py.max(), w.max())).bit_length()
            order = np.argsort(px << bits | py)
            key, p = (px << bits | py)[order], pp[order]
            here = np.where((w[:-1] >= 0) & (w[1:] >= 0), w[:-1] << bits | w[1:], -1)
            at = np.minimum(np.searchsorted(key, here), len(key) - 1)
            pair = np.where(key[at] == here, p[at], -1)
            follow = (pair[:-1] >= 0) & (pair[1:] >= 0)
            found = tile_counts(pair[:-1][follow], w[2:][follow])
        return pa.table([pa.array(f) for f in found], names=["p", "z", "c"])

    both = ids.groupBy("block").cogroup(known.groupBy("of"))
    return both.applyInArrow(run, "p long, z long, c long").groupBy("p", "z").agg(F.sum("c").alias("f"))


def _ranked(counts: DataFrame, by: list[str], out: str) -> DataFrame:
    """The rows of counts (``by``, f) with their rank, most frequent first."""
    return row_index(counts.withColumn("rare", -F.col("f")), [], ["rare", *by], out).drop("rare")


def score(a: str, left: str, right: str) -> Column:
    """``floor(10**6 a a / (l r))``, exact."""
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all candidates that are not dropped."""
    held = blocks(docs, block_bytes)
    each = held.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("e")).select(F.col("e.langs").alias("lang"), F.col("e.words").alias("word"), F.col("e.counts").alias("c"))
    counts = staged(each.groupBy("lang", "word").agg(F.sum("c").alias("f")), "word-counts")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = staged(_ranked(counts.where(F.col("f") >= min_count), ["lang", "word"], "id"), "vocabulary")
    ids = encoded(held, vocabulary)
    # the pairs of all blocks are dealt once: a window adds them up and leaves each block those that are frequent
    everywhere = F.sum("c").over(Window.partitionBy("x", "y"))
    frequent = staged(pairs_of_blocks(ids).select("block", "x", "y", everywhere.alias("f")).where(F.col("f") >= min_count), "word-pairs")
    ranked = staged(_ranked(frequent.groupBy("x", "y").agg(F.first("f").alias("f")), ["x", "y"], "p"), "pair-ranks")
    known = frequent.select("block", "x", "y").join(ranked.select("x", "y", "p"), ["x", "y"])
    three = staged(triples(ids, known).where(F.col("f") >= min_count), "triples")

    word = lambda at, w, f, *more: vocabulary.select(F.col("id").alias(at), F.col("word").alias(w), F.col("f").alias(f), *more)
    two = staged(ranked.join(word("x", "w1", "f1", "lang"), "x").join(word("y", "w2", "f2"), "y"), "pairs-named")
    second = two.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("p").alias("q"), F.col("f").alias("f23"), F.col("w2").alias("w3"), F.col("f2").alias("f3"))
    first = two.select("lang", "p", "y", "w1", "w2", "f1", F.col("f").alias("f12"))
    whole = staged(three.join(first, "p").join(second, ["y", "z"]), "triples-named")
    inside = whole.select(F.explode(F.array("p", "q")).alias("p"), "f").groupBy("p").agg(F.max("f").alias("longer"))
    two = two.join(inside, "p", "left").where("longer IS NULL OR 100 * longer < 50 * f")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r")).withColumn("score", score("a", "l", "r"))
    cuts = whole.withColumns({"s1": score("f", "f1", "f23"), "s2": score("f", "f12", "f3")})
    at = lambda one, other: F.when(F.col("s1") <= F.col("s2"), F.col(one)).otherwise(F.col(other))
    cuts = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), at("f1", "f12").alias("l"), at("f23", "f3").alias("r"), at("s1", "s2").alias("score"))
    return two.union(cuts.select(two.columns)).join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_phrases(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first ``top`` of ``docs`` (lang, text)."""
    found = phrases(docs, min_count, block_bytes).withColumns({"low": -F.col("score"), "rare": -F.col("a")})
    placed = row_index(found, ["lang"], ["low", "rare", "phrase"], "place").where(F.col("place") < top)
    return placed.select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
