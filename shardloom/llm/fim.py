"""Operator 13: fill-in-middle transformation by one repeated-capture match a text.

``(unit)*`` of the ``regex`` library keeps every repetition of its group, so a single ``fullmatch`` of a text gives all units at once:
the number of ends is the number of units, and the two cut offsets are two entries of that list.  With the default unit, any one
code point, units are characters; another pattern (``\\S+\\s*``: words) cuts between its matches.

The draws come from the SHA-256 of ``seed:doc_id`` alone, so a document is cut alike in every run and partitioning.  Of its 8-digit
groups the first two give the cuts, the third whether the text stays plain, the fourth the order of the parts.

* ``plain``: the text itself; also for an empty text, one that holds a marker, and one that the units don't cover,
* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

No part holds a marker, and no marker begins as another ends, so ``restored`` finds the parts again by the first place of each marker.

Defined results: a null text is empty; a null id draws from ``seed:`` alone; equal rows give equal rows; an empty table an empty result;
columns of the same name as a new one (in any case) are replaced, all others pass through.  A text is held whole with some 60 bytes a
unit while it is matched, one text at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is one code point, line ends too.
CHARACTER = r"(?s:.)"
#: Of a hundred texts those that are transformed, and of these the ones in the order suffix, prefix, middle.
TRANSFORMED, SUFFIX_FIRST = 90, 20
NEW = [("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType())]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(text: str, doc_id: int | None, units: regex.Pattern, seed: int = 1) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text; ``units`` matches ``(unit)*``."""
    match = units.fullmatch(text)
    ends = match.ends(1) if match else []
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= TRANSFORMED or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = CHARACTER, seed: int = 1) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with n, form, prefix_chars, middle_chars, output."""
    new = {name for name, _ in NEW}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    schema = StructType(kept + [StructField(name, kind) for name, kind in NEW])
    # a column that the result replaces doesn't enter the worker, unless it is the text or the id
    docs = docs.select(*[F.col(f"`{f.name}`") for f in kept])

    def run(batches):
        units = regex.compile(f"({unit})*")
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for part in slices(batches, "text"):
            done = [transform(t or "", i, units, seed) for t, i in zip(part.column("text").to_pylist(), part.column("doc_id").to_pylist())]
            arrays = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def _between(text: Column, after: str, before: str | None) -> Column:
    """What stands between the first places of two markers, or behind the first."""
    start = F.instr(text, after) + F.lit(len(after))
    size = F.instr(text, before) - start if before else F.char_length(text)
    return F.substr(text, start, size)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from an output and its form."""
    out = F.col(output)
    psm = F.concat(_between(out, PREFIX, SUFFIX), _between(out, MIDDLE, None), _between(out, SUFFIX, MIDDLE))
    spm = F.concat(_between(out, PREFIX, MIDDLE), _between(out, MIDDLE, None), _between(out, SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def digests(docs: DataFrame, unit: str = CHARACTER, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of ``docs`` (doc_id, text)."""
    done = fill_in_middle(docs.select("doc_id", "text"), unit, seed)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
