"""Operator 4: token counts by the whole-token shortcut.

Offline, ``prove`` merges every vocabulary string that ends a word and keeps those that come out as the one token they are.  A
pre-token of a text that is in this set counts one, without any merging.  Only the rest are merged: symbols in a linked list, a heap
of adjacent pairs by merge rank.  (Not every vocabulary string passes: some can't be reached by the merges.)  The proven set and the
merges are fixed by the vocabulary file; each worker reads them once.  Rows are independent: no shuffle.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special string inside a text is one token, as by the library's
default; repeated rows and null ids each give a row; extra columns pass through, columns named like results are replaced.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MEMO_WORDS, with_columns
from .wordbpe import SPECIAL, pretokens


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other bytes take the letters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WholeTokens(dict):
    """Token counts of pre-tokens; a missing one is counted and kept."""

    END = "</w>"

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {pair: rank for rank, pair in enumerate(pairs)}
        self.letters = byte_letters()
        self.letter_of = str.maketrans({chr(b): c for b, c in enumerate(self.letters)})
        self.proven = self.prove(model["vocab"])

    def prove(self, vocabulary) -> frozenset[str]:
        """The vocabulary's strings that, standing alone as a pre-token, are one token; without the word end."""
        end = len(self.END)
        words = (s[:-end] for s in vocabulary if s.endswith(self.END) and len(s) > end)
        return frozenset(w for w in words if len(self.merge(w)) == 1)

    def merge(self, word: str) -> list[str]:
        """Tokens of a pre-token spelled in byte letters."""
        part = [*word[:-1], word[-1] + self.END]
        n = len(part)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self.merges.get
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank((part[i], part[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if not alive[i] or part[i] != left or j >= n or part[j] != right:
                continue  # stale: one of the two has grown or gone
            alive[j] = False
            part[i] = left + right
            after[i] = end = after[j]
            if end < n:
                before[end] = i
                if (r := rank((part[i], part[end]))) is not None:
                    heappush(heap, (r, i, part[i], part[end]))
            if (p := before[i]) >= 0 and (r := rank((part[p], part[i]))) is not None:
                heappush(heap, (r, p, part[p], part[i]))
        return [s for s, there in zip(part, alive) if there]

    def __missing__(self, word: str) -> int:
        if word in SPECIAL:
            n = 1
        else:
            spelled = word.encode().decode("latin-1").translate(self.letter_of)
            n = 1 if spelled in self.proven else len(self.merge(spelled))
        self[word] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        return sum(map(self.__getitem__, pretokens(text)))


_made: dict[str, WholeTokens] = {}


def counter(path: str) -> WholeTokens:
    """The worker's counter of a file."""
    if path not in _made:
        _made[path] = WholeTokens(path)
    return _made[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of its texts."""

    def compute(texts):
        n = np.fromiter(map(counter(path).count, texts), np.int64, len(texts))
        return [len(t.encode()) for t in texts], n, n > limit

    return with_columns(df, text, [pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("over_limit", pa.bool_())], compute)
