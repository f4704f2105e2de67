"""Pluggable tokenizers (J1), end-of-text prefix (H1), ordinary encoding (H2),
token range check (B4), widening (B5) and vocabulary lookup (C4).

Encoding runs in Arrow-batched UDFs (``arrow_udf``): Spark partitions the
documents and ships them to Python in column batches; inside a batch the work
is Arrow / NumPy compute (split, hash lookup, offsets), never a per-row loop
for the word and byte modes.

Modes
-----
``word``  split on single spaces; ids are word ranks by (count desc, word asc)
          fitted on the corpus by a Spark job and capped at ``WORD_CAP``;
          end-of-text is ``WORD_CAP + 1``.  A word outside the vocabulary is
          spelled: id 0, then one id per UTF-8 byte, so that decoding gives
          back every text.  The capped vocabulary (a proven size bound) is
          broadcast once per executor.
``bytes`` UTF-8 bytes 0..255, end-of-text 256; no vocabulary.
``bpe``   a byte-pair codec built from a user-supplied ranks file (the GPT-2
          vocabulary cannot be downloaded offline); ordinary encoding, so
          special-token text in a document is plain text.
"""

from __future__ import annotations

import base64
import uuid
from typing import Iterator, Optional, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..session import ship_package

TOKENS_TYPE = T.ArrayType(T.IntegerType(), containsNull=False)

# Fixed value: the GPT-2 pre-split pattern (public tiktoken definition).
GPT2_PATTERN = (r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"""
                r"""|\s+(?!\S)|\s+""")
EOT_TEXT = "<|endoftext|>"

# Bytes of text that the word mode splits at once, and those whose words are counted at once.
SLICE_BYTES, COUNT_BYTES = 1 << 20, 1 << 23

# Per Python-worker cache of objects rebuilt from broadcast values.
_WORKER_CACHE: dict = {}


def _prepend(ids: np.ndarray, lengths: np.ndarray, eot: Optional[int]) -> pa.ListArray:
    """Build a list<int32> array from flat ids and per-row lengths, putting
    ``eot`` in front of every row when given."""
    extra = 0 if eot is None else 1
    wide = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths + extra, out=wide[1:], dtype=np.int64)
    if wide[-1] > np.iinfo(np.int32).max:
        raise ValueError("too many tokens in one Arrow batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = wide.astype(np.int32)
    if eot is None:
        values = ids.astype(np.int32, copy=False)
    else:
        values = np.empty(int(offsets[-1]), dtype=np.int32)
        body = np.ones(len(values), dtype=bool)
        body[offsets[:-1]] = False
        values[~body] = eot
        values[body] = ids
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                    pa.array(values, pa.int32()))


def _slices(texts: pa.Array, size: Optional[int] = None) -> Iterator[pa.Array]:
    """The texts in runs of about ``size`` (``SLICE_BYTES``) bytes, one text at least, so that what is made of words is small beside an Arrow batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, done + (size or SLICE_BYTES), "right")))
        yield texts.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def _with_nulls(out: pa.ListArray, source: pa.Array) -> pa.Array:
    if source.null_count == 0:
        return out
    return pc.if_else(pc.is_null(source), pa.scalar(None, out.type), out)


class Tokenizer:
    """Interface: column expressions over a text column."""

    name = "base"
    eot_id: int
    vocab_size: int
    # True when ``count`` is a JVM expression (no Python worker needed)
    jvm_count = False

    def encode(self, text: Column, eot: bool = True) -> Column:   # pragma: no cover
        raise NotImplementedError

    def count(self, text: Column) -> Column:
        """Tokens in a document including end-of-text; JVM-side when the mode
        allows, so offsets and manifests need no Python worker."""
        return F.size(self.encode(text))

    def decode(self, ids: Column) -> Column:   # pragma: no cover
        raise NotImplementedError


class WordTokenizer(Tokenizer):
    name = "word"

    def __init__(self, spark, words: Sequence[str], cap: int = C.WORD_CAP):
        if cap + 258 > C.TOKEN_LIMIT:
            raise ValueError("word cap too large for 16-bit token ids")
        if len(words) > cap:
            raise ValueError("vocabulary longer than its cap")
        self.cap = cap
        self.eot_id = cap + 1
        self.byte_base = cap + 2
        self.vocab_size = cap + 258
        self.words = list(words)
        ship_package(spark)
        self._bc = spark.sparkContext.broadcast(self.words)
        self._key = uuid.uuid4().hex
        self._encode_udf = self._make_encoder()
        self._decode_udf = self._make_decoder()

    # -- fitting -------------------------------------------------------------
    @staticmethod
    def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Word frequencies; words are split and counted by slices of an Arrow
        batch, so no row is made for an occurrence and hot words collapse map-side."""
        ship_package(docs.sparkSession)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _slices(batch.column(0), COUNT_BYTES):
                    found = pc.value_counts(pc.split_pattern(part, " ").flatten())
                    yield pa.RecordBatch.from_arrays(found.flatten(), ["word", "count"])

        found = docs.select(F.col(text_col)).mapInArrow(count, "word string, count long")
        return found.groupBy("word").agg(F.sum("count").alias("count"))

    @classmethod
    def vocabulary(cls, docs: DataFrame, cap: int = C.WORD_CAP,
                   text_col: str = "text") -> DataFrame:
        """C4: the capped vocabulary ``(id, word, count)``.

        No step funnels the distinct words into one task: a histogram of
        frequencies (n words in all have at most sqrt(2 n) different counts,
        so its window is small at any size) gives the count ``t`` of the
        ``cap``-th word.  Words above ``t`` are all in; ties at ``t`` are
        ranked by word with the range-partitioned ``row_index``.  Only the
        final ``<= cap`` rows are numbered by one window."""
        from ..plans.ordering import row_index
        from ..session import stage_table

        counts = stage_table(cls.word_counts(docs, text_col), "word-counts")
        hist = counts.groupBy("count").agg(F.count(F.lit(1)).alias("k"))
        w_desc = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pref = hist.withColumn("above", F.sum("k").over(w_desc) - F.col("k"))
        cut = (pref.where((F.col("above") < cap) & (F.col("above") + F.col("k") >= cap))
               .select("count", "above").collect())                  # one row at most
        chosen = counts                                              # fewer than ``cap`` words
        if cut:
            t, need = int(cut[0]["count"]), cap - int(cut[0]["above"])
            ties = row_index(counts.where(F.col("count") == t), [], ["word"], "_i").where(F.col("_i") < need)
            chosen = counts.where(F.col("count") > t).unionByName(ties.select("word", "count"))
        w = Window.orderBy(F.desc("count"), F.asc("word"))
        return chosen.select(F.row_number().over(w).cast("int").alias("id"), "word", "count")

    @classmethod
    def fit(cls, docs: DataFrame, cap: int = C.WORD_CAP, text_col: str = "text") -> "WordTokenizer":
        vocab = cls.vocabulary(docs, cap, text_col)
        rows = vocab.orderBy("id").select("word").collect()   # at most ``cap`` rows
        return cls(docs.sparkSession, [r.word for r in rows], cap)

    # -- column functions ------------------------------------------------------
    def _make_encoder(self):
        bc, key = self._bc, ("word-enc", self._key)

        byte_base = self.byte_base

        def encode_batch(texts: pa.Array, eot: Optional[int]) -> pa.Array:
            parts = [encode_slice(part, eot) for part in _slices(texts)]
            return pa.concat_arrays(parts) if parts else encode_slice(texts, eot)

        def encode_slice(texts: pa.Array, eot: Optional[int]) -> pa.Array:
            pieces = pc.split_pattern(texts, " ")
            flat = pieces.flatten()
            value_set = _WORKER_CACHE.get((key, str(flat.type)))
            if value_set is None:
                value_set = _WORKER_CACHE[(key, str(flat.type))] = pa.array(bc.value, flat.type)
            idx = pc.index_in(flat, value_set=value_set)
            known = pc.is_valid(idx).to_numpy(zero_copy_only=False)
            word_ids = pc.fill_null(pc.add(idx.cast(pa.int32()), 1), C.WORD_SPELL_ID).to_numpy(zero_copy_only=False)
            size = np.where(known, 0, pc.binary_length(flat).to_numpy(zero_copy_only=False)).astype(np.int64) + 1
            start = np.cumsum(size) - size
            ids = np.empty(int(size.sum()), np.int32)
            is_byte = np.ones(len(ids), bool)
            is_byte[start] = False
            ids[start] = word_ids
            spelled = pc.filter(flat, pa.array(~known))
            ids[is_byte] = np.frombuffer(pc.binary_join(
                pa.ListArray.from_arrays(pa.array([0, len(spelled)], pa.int32()), spelled.cast(pa.binary())), b"")[0]
                .as_buffer() or b"", np.uint8).astype(np.int32) + byte_base
            words = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(words)
            total = np.concatenate([[0], np.cumsum(size)])
            out = _prepend(ids, total[ends] - total[ends - words], eot)
            return _with_nulls(out, texts)

        eot_id = self.eot_id

        @F.arrow_udf(TOKENS_TYPE)
        def word_encode(texts: pa.Array) -> pa.Array:
            return encode_batch(texts, eot_id)

        @F.arrow_udf(TOKENS_TYPE)
        def word_encode_plain(texts: pa.Array) -> pa.Array:
            return encode_batch(texts, None)

        return word_encode, word_encode_plain

    def _make_decoder(self):
        bc, key, eot_id, byte_base = self._bc, ("word-dec", self._key), self.eot_id, self.byte_base

        def spell(run: bytes) -> str:
            """A spelled word; bytes that are no UTF-8 (a made-up sequence) are shown as hex."""
            try:
                return run.decode()
            except UnicodeDecodeError:
                return f"<0x{run.hex().upper()}>"

        def words_of(ids, table) -> list:
            """Words of a token list; id 0 or a byte after a word begins a spelled word."""
            out, run = [], None
            for t in ids:
                if t >= byte_base or t == C.WORD_SPELL_ID:
                    if run is None or t == C.WORD_SPELL_ID:
                        if run is not None:
                            out.append(spell(bytes(run)))
                        run = bytearray()
                    if t >= byte_base:
                        run.append(t - byte_base)
                else:
                    if run is not None:
                        out.append(spell(bytes(run)))
                        run = None
                    out.append(table[t])
            if run is not None:
                out.append(spell(bytes(run)))
            return out

        @F.arrow_udf(T.StringType())
        def word_decode(ids: pa.Array) -> pa.Array:
            table = _WORKER_CACHE.get(key)
            if table is None:
                table = _WORKER_CACHE[key] = dict(enumerate(bc.value, 1)) | {eot_id: EOT_TEXT}
            # a row's ids at a time: as Python integers those of a whole batch take ten times its memory
            return pa.array((" ".join(words_of(row.as_py(), table)) if row.is_valid else None for row in ids), pa.string())

        return word_decode

    def encode(self, text: Column, eot: bool = True) -> Column:
        return (self._encode_udf[0] if eot else self._encode_udf[1])(text)

    def decode(self, ids: Column) -> Column:
        return self._decode_udf(ids)


class ByteTokenizer(Tokenizer):
    name = "bytes"
    jvm_count = True
    eot_id = C.BYTE_EOT_ID
    vocab_size = C.BYTE_VOCAB_SIZE

    def __init__(self, spark=None):
        from pyspark.sql import SparkSession
        ship_package(spark or SparkSession.getActiveSession())

        @F.arrow_udf(TOKENS_TYPE)
        def byte_encode(texts: pa.Array) -> pa.Array:
            return ByteTokenizer._encode_batch(texts, C.BYTE_EOT_ID)

        @F.arrow_udf(TOKENS_TYPE)
        def byte_encode_plain(texts: pa.Array) -> pa.Array:
            return ByteTokenizer._encode_batch(texts, None)

        self._udfs = (byte_encode, byte_encode_plain)

    @staticmethod
    def _encode_batch(texts: pa.Array, eot: Optional[int]) -> pa.Array:
        binary = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type)
                            else pa.binary())
        lengths = pc.fill_null(pc.binary_length(binary), 0).to_numpy(zero_copy_only=False)
        off_type = np.int64 if pa.types.is_large_binary(binary.type) else np.int32
        offsets = np.frombuffer(binary.buffers()[1], dtype=off_type)[
            binary.offset: binary.offset + len(binary) + 1]
        data = binary.buffers()[2]
        raw = (np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
               if data is not None and len(binary) else np.empty(0, np.uint8))
        if binary.null_count:
            keep = np.repeat(~pc.is_null(binary).to_numpy(zero_copy_only=False),
                             np.diff(offsets))
            raw = raw[keep]
        out = _prepend(raw.astype(np.int32), lengths, eot)
        return _with_nulls(out, texts)

    def encode(self, text: Column, eot: bool = True) -> Column:
        return (self._udfs[0] if eot else self._udfs[1])(text)

    def count(self, text: Column) -> Column:
        return (F.octet_length(text) + F.lit(1)).cast("long")

    def decode(self, ids: Column) -> Column:
        body = F.filter(ids, lambda t: t < F.lit(256))
        return F.decode(F.unhex(F.array_join(F.transform(body, lambda t: F.lpad(F.hex(t), 2, "0")), "")),
                        "UTF-8")


def load_bpe_ranks(path: str) -> dict:
    """Read a ranks file: one ``<base64 token> <rank>`` per line."""
    ranks = {}
    with open(path, "rb") as fh:
        for line in fh:
            line = line.strip()
            if line:
                tok, rank = line.split()
                ranks[base64.b64decode(tok)] = int(rank)
    return ranks


class BpeTokenizer(Tokenizer):
    """Byte-pair codec from supplied ranks (tiktoken); the codec object is
    rebuilt once per Python worker from its picklable parts."""

    name = "bpe"

    def __init__(self, mergeable_ranks: dict, pat_str: str = GPT2_PATTERN,
                 eot_id: Optional[int] = None, name: str = "custom-bpe", spark=None):
        from pyspark.sql import SparkSession
        ship_package(spark or SparkSession.getActiveSession())
        eot = len(mergeable_ranks) if eot_id is None else eot_id
        self.eot_id = eot
        self.vocab_size = eot + 1
        if self.vocab_size > C.TOKEN_LIMIT:
            raise ValueError(f"{self.vocab_size} token ids do not fit into 16 bits")
        parts = (name, pat_str, dict(mergeable_ranks), {EOT_TEXT: eot})
        key = ("bpe", name, len(mergeable_ranks), eot)

        def codec():
            enc = _WORKER_CACHE.get(key)
            if enc is None:
                import tiktoken
                enc = _WORKER_CACHE[key] = tiktoken.Encoding(
                    parts[0], pat_str=parts[1], mergeable_ranks=parts[2], special_tokens=parts[3])
            return enc

        def enc_batch(texts: pa.Array, with_eot: bool) -> pa.Array:
            values = texts.to_pylist()
            encoded = codec().encode_ordinary_batch([v or "" for v in values])
            if with_eot:
                encoded = [[eot] + e for e in encoded]
            out = pa.array(encoded, pa.list_(pa.int32()))
            return _with_nulls(out, texts)

        @F.arrow_udf(TOKENS_TYPE)
        def bpe_encode(texts: pa.Array) -> pa.Array:
            return enc_batch(texts, True)

        @F.arrow_udf(TOKENS_TYPE)
        def bpe_encode_plain(texts: pa.Array) -> pa.Array:
            return enc_batch(texts, False)

        @F.arrow_udf(T.StringType())
        def bpe_decode(ids: pa.Array) -> pa.Array:
            return pa.array([None if v is None else codec().decode(v) for v in ids.to_pylist()],
                            pa.string())

        self._udfs = (bpe_encode, bpe_encode_plain, bpe_decode)

    def encode(self, text: Column, eot: bool = True) -> Column:
        return (self._udfs[0] if eot else self._udfs[1])(text)

    def decode(self, ids: Column) -> Column:
        return self._udfs[2](ids)


def get_tokenizer(name: str, docs: Optional[DataFrame] = None, **kwargs) -> Tokenizer:
    """Tokenizer by name.  ``word`` is fitted on ``docs``; ``bpe`` needs
    ``ranks_path`` or ``mergeable_ranks``."""
    if name == "word":
        if docs is None:
            raise ValueError("word tokenizer needs documents to fit on")
        return WordTokenizer.fit(docs, kwargs.get("cap", C.WORD_CAP))
    if name == "bytes":
        return ByteTokenizer()
    if name in ("bpe", "gpt2"):
        ranks = kwargs.get("mergeable_ranks")
        if ranks is None:
            path = kwargs.get("ranks_path")
            if not path:
                raise ValueError("bpe tokenizer needs ranks_path or mergeable_ranks "
                                 "(no vocabulary download offline)")
            ranks = load_bpe_ranks(path)
        return BpeTokenizer(ranks, kwargs.get("pat_str", GPT2_PATTERN), kwargs.get("eot_id"))
    raise ValueError(f"unknown tokenizer {name!r}")


def tokenize_documents(docs: DataFrame, tok: Tokenizer) -> DataFrame:
    """H1 + H2 + B4: ``(source_ord, doc_ord, tokens, n)``; tokens[0] is
    end-of-text, and an id outside the 16-bit range fails the job."""
    encoded = docs.select("source_ord", "doc_ord", tok.encode(F.col("text")).alias("tokens"))
    return check_token_range(encoded).withColumn("n", F.size("tokens").cast("long"))


def in_token_range(tokens: Column, limit: int = C.TOKEN_LIMIT) -> Column:
    return F.forall(tokens, lambda t: (t >= 0) & (t < F.lit(limit)))


def check_token_range(df: DataFrame, col: str = "tokens", limit: int = C.TOKEN_LIMIT) -> DataFrame:
    """B4 (enforcing form): fail the job on a token outside ``[0, limit)``."""
    inside = in_token_range(F.col(col), limit)
    if not df.schema[col].dataType.containsNull:
        # the least and the greatest are found in compiled code, unlike ``forall``
        inside = (F.size(col) == 0) | ((F.array_min(col) >= 0) & (F.array_max(col) < F.lit(limit)))
    return df.withColumn(col, F.when(inside, F.col(col))
                         .otherwise(F.raise_error(F.lit(f"token id outside 0 .. {limit - 1}"))))


def token_range_report(df: DataFrame, col: str = "tokens", limit: int = C.TOKEN_LIMIT) -> DataFrame:
    """B4 (report form): documents and tokens, and how many fall outside."""
    bad = F.size(F.filter(F.col(col), lambda t: (t < 0) | (t >= F.lit(limit))))
    return df.agg(F.count(F.lit(1)).alias("n_docs"),
                  F.sum(F.size(col)).cast("long").alias("n_tokens"),
                  F.sum((bad > 0).cast("long")).alias("n_bad_docs"),
                  F.sum(bad).cast("long").alias("n_bad_tokens"))


def widen(tokens: Column, to: str = "int") -> Column:
    """Stored ids are ``int`` (Spark has no uint16); widen to ``long`` only
    when asked.  Never ``short``: it overflows at 32,768."""
    if to not in ("int", "long", "bigint"):
        raise ValueError("tokens widen to int or long only")
    return tokens.cast(f"array<{to}>")
