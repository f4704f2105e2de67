"""Pre-tokens and ids of the lower-casing word-end BPE vocabulary (a ``tokenizers`` .json file).

``pretokens`` gives the pieces that the file's normaliser and splitter give, with compiled patterns: texts whose characters all lie
below U+0180 use explicit letter and digit classes, others the library's own splitter.  ``WordEncoder`` asks the library for the ids of
each distinct pre-token once and gathers the rest from arrays.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain, islice

import numpy as np

from .common import MEMO_WORDS, ragged

#: The special strings of the vocabulary and the file's splitting pattern.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LIMIT = 0x180


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LIMIT) if unicodedata.category(chr(c))[0] == kind)


_SPACE = "\t-\r \x85\xa0"
_NARROW = re.compile(rf"[{_class('L')}]+|'(?:[stmd]|re|ve|ll)|[{_class('N')}]|[^{_SPACE}{_class('L')}{_class('N')}]+")
_WIDE_TEXT = re.compile(rf"[^\0-{chr(_LIMIT - 1)}]")
_SPLIT_SPECIAL = re.compile("|".join(f"({re.escape(s)})" for s in SPECIAL).join(("(?:", ")")))
_wide = None


def _by_library(text: str) -> list[str]:
    """Letters and digits of rarer scripts depend on the library's Unicode version: it splits such texts itself."""
    global _wide
    if _wide is None:
        from tokenizers import Regex, normalizers, pre_tokenizers

        steps = [normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]
        _wide = normalizers.Sequence(steps), pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
    return [word for word, _ in _wide[1].pre_tokenize_str(_wide[0].normalize_str(text))]


def _plain(text: str) -> list[str]:
    if _WIDE_TEXT.search(text):
        return _by_library(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _NARROW.findall(text.lower())


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text; a special string in it is one of them, as by the library's default."""
    if "<|" not in text or not _SPLIT_SPECIAL.search(text):
        return _plain(text)
    out, at = [], 0
    for m in _SPLIT_SPECIAL.finditer(text):
        out += _plain(text[at : m.start()])
        out.append(m[0])
        at = m.end()
    return out + _plain(text[at:])


class _Rows(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        return row


class WordEncoder:
    """Ids of whole texts; each distinct pre-token is encoded by the library once a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.special = {s: vocab[s] for s in SPECIAL if s in vocab}
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index = _Rows()
        self.ids, self.n_ids = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = (np.empty(1 << 16, np.int64) for _ in range(2))

    def learn(self, words: list[str]) -> None:
        """Ids of the last words of the index: joined by spaces in runs, and told apart by their word ends."""
        plain = np.array([w not in self.special for w in words])
        runs = [" ".join(w for w in words[i : i + RUN] if w not in self.special) for i in range(0, len(words), RUN)]
        got = [e.ids for e in self.library.encode_batch_fast(runs, add_special_tokens=False)]
        got = np.fromiter(chain.from_iterable(got), np.uint32)
        ends = np.flatnonzero(self.ends[got]) + 1
        if len(ends) != plain.sum():
            raise ValueError("the library splits a pre-token; its file has another splitting rule")
        got = np.r_[got, np.array(list(self.special.values()), np.uint32)]
        place = {s: len(got) - len(self.special) + k for k, s in enumerate(self.special)}
        first, last, need = len(self.index) - len(words), len(self.index), self.n_ids + len(got)
        while len(self.ids) < need:
            self.ids = np.r_[self.ids, np.empty_like(self.ids)]
        while len(self.start) < last:
            self.start, self.length = (np.r_[x, np.empty_like(x)] for x in (self.start, self.length))
        start, length = self.start[first:last], self.length[first:last]
        start[plain] = np.r_[0, ends[:-1]][: len(ends)] + self.n_ids
        length[plain] = np.diff(ends, prepend=0)
        for k in np.flatnonzero(~plain):
            start[k], length[k] = place[words[k]] + self.n_ids, 1
        self.ids[self.n_ids : need] = got
        self.n_ids = need

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each text has."""
        if len(self.index) > MEMO_WORDS:
            self.clear()
        split = [pretokens(t) for t in texts]
        words = np.fromiter(map(len, split), np.int64, len(split))
        known = len(self.index)
        rows = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(words.sum()))
        if len(self.index) > known:
            self.learn(list(islice(self.index, known, None)))
        lengths = self.length[rows]
        total = np.r_[0, np.cumsum(lengths)]
        ends = np.cumsum(words)
        return self.ids[ragged(self.start[rows], lengths)], total[ends] - total[ends - words]


#: Words that go to the library as one text.
RUN = 64

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a file; what it has learned serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
