"""Operator 7: quality rules as a short-circuit cascade.

``measure_rules`` runs every rule alone on a bounded random sample (``SAMPLE_ROWS``, drawn and measured in tasks; only the rules'
seconds and rejections reach the driver) and ``cascade`` orders the rules by rejections per second.  A document leaves the cascade at
the first rule that rejects it, so costly rules see what the cheap and selective ones leave.  A document is kept if no rule rejects
it, whatever the order: the sample sets the speed and never the verdict.

Rules look at a text alone: rows are independent and nothing is shuffled.

Defined results: a null or empty text has no words and fails the base rule; repeated rows and null ids each give a row; extra columns
pass through, columns named like results are replaced; an empty table or sample leaves the rules in the order in which they are listed.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, with_columns

SAMPLE_ROWS = 2000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
NGRAM = 5


class Text:
    """A text with what rules measure on it, each computed at most once."""

    def __init__(self, text: str):
        self.text = text
        self._kept: dict[str, object] = {}

    def __getattr__(self, name: str):
        kept = self.__dict__["_kept"]
        if name not in kept:
            kept[name] = _MEASURES[name](self)
        return kept[name]


def _repeat_words(t: Text) -> int:
    words = t.words
    windows = list(zip(*(words[k:] for k in range(NGRAM))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:-NGRAM] += hit
    covered[NGRAM:] -= hit
    return int((np.cumsum(covered) > 0).sum())


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


_MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: _WORD.findall(t.text),
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.text) - sum(map(t.text.count, " \t\n\v\f\r")),
    "n_symbols": lambda t: sum(map(t.text.count, _SYMBOLS)),
    "n_lines": lambda t: sum(1 for x in t.text.split("\n") if _WORD.search(x)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_alpha_words": lambda t: sum(1 for w in t.words if any(map(str.isalpha, w))),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which ``rejects`` holds."""

    name: str
    rejects: Callable[[Text], bool]


#: The base rule of the contract: where its measures are asked for it comes first and is not reordered.
BASE = Rule("base", lambda t: t.n_words < 10 or 100 * t.n_repeat_words > 20 * t.n_words)
#: The base's parts as rules of a cascade that needs no base measures.
BASE_RULES = (Rule("few_words", lambda t: t.n_words < 10), Rule("repeat_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words))
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("alpha_words", lambda t: 10 * t.n_alpha_words < 7 * t.n_words),
    Rule("duplicate_lines", lambda t: t.n_lines > 3 and 10 * t.n_dup_lines > 3 * t.n_lines),
)


@dataclass(frozen=True)
class Measured:
    name: str
    rows: int
    rejected: int
    seconds: float

    @property
    def rate(self) -> float:
        """Rejections per second."""
        return self.rejected / max(self.seconds, 1e-9)


def measure_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS, text: str = "text", seed: int = 7) -> list[Measured]:
    """Each rule's cost and selectivity on about ``rows`` random documents, every rule on fresh texts."""
    total = docs.count()
    if not total:
        return []
    sample = docs.select(F.coalesce(text, F.lit("")).alias("text")).sample(min(1.0, rows / total), seed)

    def run(batches):
        for part in slices(batches, "text"):
            texts, out = part.column("text").to_pylist(), []
            for rule in rules:
                began = time.perf_counter()
                rejected = sum(rule.rejects(Text(t)) for t in texts)
                out.append((rule.name, len(texts), rejected, time.perf_counter() - began))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["name", "rows", "rejected", "seconds"])

    sums = sample.mapInArrow(run, "name string, rows long, rejected long, seconds double").groupBy("name").agg(*(F.sum(c).alias(c) for c in ("rows", "rejected", "seconds")))
    return [Measured(r["name"], r["rows"], r["rejected"], r["seconds"]) for r in sums.collect()]  # a row a rule


def cascade(rules: Sequence[Rule], measured: Sequence[Measured]) -> list[Rule]:
    """The rules by rejections per second, highest first; names decide ties."""
    rate = {m.name: m.rate for m in measured}
    return sorted(rules, key=lambda r: (-rate.get(r.name, 0.0), r.name)) if rate else list(rules)


def judge(docs: DataFrame, rules: Sequence[Rule], text: str = "text", full: bool = True, prefix: str = "") -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by`` (the first rule of the cascade that rejects; null if kept), each name after ``prefix``.

    With ``full``, the base rule comes first and its measures are there for every document: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed.  Without, only ``rules`` run, in their order; ``BASE_RULES`` may be among them.
    """
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if full else []

    def compute(texts):
        rows = []
        for s in texts:
            t = Text(s)
            failed = full and BASE.rejects(t)
            by = BASE.name if failed else next((r.name for r in rules if r.rejects(t)), None)
            rows.append([getattr(t, m) for m in measures] + [failed] * full + [by is None, by])
        return list(zip(*rows))

    kinds = {m: pa.int64() for m in measures} | ({"base_failed": pa.bool_()} if full else {}) | {"kept": pa.bool_(), "rejected_by": pa.string()}
    fields = [pa.field(prefix + name, kind) for name, kind in kinds.items()]
    return with_columns(docs, text, fields, compute)
