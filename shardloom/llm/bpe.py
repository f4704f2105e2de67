"""Operator 1: byte-level BPE encoding and decoding with a rank file.

A text is split by the file's pattern.  Each pre-token takes one of two ways:

* a **minimal perfect hash** over the vocabulary (hash and displace: every vocabulary string has a slot of its own, no slot is
  empty) finds whole pre-tokens that are in the vocabulary; the slot's string is compared, so a stranger never passes;
* the rest are merged: the bytes form a doubly **linked list**, a **heap** holds (rank, place) of adjacent pairs, and the lowest
  rank, leftmost first, is merged until no pair has a rank.  O(n log n) in the pre-token's bytes, however long it is.

A worker keeps the ids of the pre-tokens it has met (once it has ``MEMO_WORDS`` it starts anew with the next slice), so each way is
mostly taken once for a distinct pre-token.  Rows are independent: no shuffle, and a lost task is simply run again.  Decoding needs the
vocabulary's bytes alone, so a decoding worker holds neither hash nor memo; both ways hold about ``SLICE_BYTES`` of text at a time.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows and repeated or null ids each give a row;
extra columns pass through, and a column named like a result column is replaced.  Ids are held as little-endian unsigned 32-bit
integers in a binary column, which the decoder takes.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MEMO_WORDS, mix, ragged, with_columns

_LETTER_LIMIT = 0x180
#: Bytes of text, or of ids, that a worker splits or decodes at once: what is made of them is many times that.
SLICE_BYTES = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's strings by rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    words = [b""] * len(pairs)
    for word, rank in pairs:
        words[int(rank)] = base64.b64decode(word)
    return words


class PerfectHash:
    """Minimal perfect hash of distinct byte strings by hash and displace.

    Strings fall into small buckets by one hash.  From the largest bucket on, each gets the first displacement that sends all its
    strings to free slots; buckets of one string take the slots that are left.  ``slot`` of any string is one of 0..n-1.
    """

    def __init__(self, words: list[bytes], per_bucket: int = 4):
        self.n = n = len(words)
        self.buckets = n // per_bucket + 1
        low, high = self._hashes(words)
        order = np.argsort(low % np.uint64(self.buckets), kind="stable")
        edges = np.searchsorted((low % np.uint64(self.buckets))[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        sizes = np.diff(edges)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] <= 1:
                break
            h, d, tries = high[order[edges[b] : edges[b + 1]]], 0, 16
            while True:  # many displacements at once: late buckets need thousands of tries
                slots = mix(h[:, None] + np.arange(d, d + tries, dtype=np.uint64)) % np.uint64(n)
                fits = free[slots].all(0) & (np.diff(np.sort(slots, 0), axis=0) != 0).all(0)
                if fits.any():
                    at = int(fits.argmax())
                    d, slots = d + at, slots[:, at]
                    break
                d, tries = d + tries, min(8 * tries, 1 << 14)
            free[slots] = False
            self.shift[b] = d
        left = iter(np.flatnonzero(free))
        for b in np.flatnonzero(sizes == 1):
            self.shift[b] = -1 - next(left)  # negative: the slot itself
        self.shifts = self.shift.tolist()
        self.words, self.values = [b""] * n, [0] * n
        for value, word in enumerate(words):
            at = self.slot(word)
            self.words[at], self.values[at] = word, value

    @staticmethod
    def _hash(word: bytes) -> tuple[int, int]:
        import xxhash

        h = xxhash.xxh3_128_intdigest(word)
        return h & 0xFFFFFFFFFFFFFFFF, h >> 64

    def _hashes(self, words):
        both = [self._hash(w) for w in words]
        return np.array([x[0] for x in both], np.uint64), np.array([x[1] for x in both], np.uint64)

    def slot(self, word: bytes) -> int:
        low, high = self._hash(word)
        d = self.shifts[low % self.buckets]
        if d < 0:
            return -1 - d
        x = (high + d) & 0xFFFFFFFFFFFFFFFF  # ``mix`` of one integer
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 31)) % self.n

    def get(self, word: bytes) -> int | None:
        """The value of a string of the vocabulary, None for any other."""
        at = self.slot(word)
        return self.values[at] if self.words[at] == word else None


def merge(word: bytes, rank) -> list[int]:
    """Ids of a byte string by merging linked bytes, lowest rank first, leftmost among equals.

    ``rank(bytes)`` gives the rank of a string or None.  A heap entry names a pair by where it starts and ends; it is stale if its
    first part is gone or the part behind it ends elsewhere by now.
    """
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := rank(word[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := rank(word[p:end])) is not None:
            heappush(heap, (r, p, end))
    return [rank(word[i : after[i]]) for i in range(n) if alive[i]]


def splitter(pattern: str):
    """Finds all pre-tokens of a text.  Letters and digits of texts below U+0180 are spelled out for the faster engine."""
    import unicodedata

    import regex

    full = regex.compile(pattern)
    kind = lambda k: "".join(re.escape(chr(c)) for c in range(_LETTER_LIMIT) if unicodedata.category(chr(c))[0] == k)
    space = "\t-\r \x85\xa0"
    narrow = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{kind('L')}{kind('N')}]").replace(r"\p{L}", f"[{kind('L')}]").replace(r"\p{N}", f"[{kind('N')}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))
    wide = re.compile(rf"[^\0-{chr(_LETTER_LIMIT - 1)}]")
    return lambda text: (full if not text.isascii() and wide.search(text) else narrow).findall(text)


class ByteDecoder:
    """Decoder of a vocabulary."""

    def __init__(self, vocabulary: list[bytes]):
        self.bytes_of = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.length = np.array([len(w) for w in vocabulary], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id outside the vocabulary is an error."""
        if len(ids) and int(ids.max()) >= len(self.length):
            raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {len(self.length)}")
        return self.bytes_of[ragged(self.start[ids], self.length[ids])].tobytes()


class ByteBpe(ByteDecoder):
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = read_ranks(path)
        super().__init__(self.vocabulary)
        self.whole = PerfectHash(self.vocabulary)
        self.ranks = {w: i for i, w in enumerate(self.vocabulary)}
        self.split = splitter(pattern)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, bytes] = {}

    def ids_of(self, word: str) -> bytes:
        """Ids of a pre-token, as little-endian unsigned 32-bit integers."""
        data = word.encode()
        one = self.whole.get(data)
        return np.array([one] if one is not None else merge(data, self.ranks.get), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > MEMO_WORDS:
            self.clear()
        known, ids_of, split = self.known, self.ids_of, [self.split(t) for t in texts]
        for word in set(chain.from_iterable(split)).difference(known):
            known[word] = ids_of(word)
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]


_made: dict[tuple[str, str], ByteBpe] = {}
_decoders: dict[str, ByteDecoder] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """The worker's codec of a file."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBpe(path, pattern)
    return _made[path, pattern]


def decoder(path: str) -> ByteDecoder:
    """The worker's decoder of a file."""
    if path not in _decoders:
        _decoders[path] = ByteDecoder(read_ranks(path))
    return _decoders[path]


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of its texts."""

    def compute(texts):
        ids = codec(path, pattern).encode(texts)
        return [len(x) for x in ids], [x.tobytes() for x in ids]

    return with_columns(df, text, [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary())], compute, SLICE_BYTES)


def decode_documents(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``df`` with ``decoded``: the bytes that its ``ids`` stand for (null: none)."""

    def compute(ids):
        return [[decoder(path).decode(np.frombuffer(x or b"", "<u4")) for x in ids]]

    return with_columns(df, "ids", [pa.field("decoded", pa.binary())], compute, SLICE_BYTES)
