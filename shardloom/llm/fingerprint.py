"""Operator 5: document fingerprints of closed syncmers, in DataFrame functions only.

A text is a sequence of units: runs without white space, and single letters of scripts that are written without spaces, with ``K - 1``
marks before its first and behind its last unit.  Of its k-mers (``K`` units) those are anchors whose least inner s-mer (``S`` units, by
hash) lies at the left or right edge.  Whether a k-mer is one depends on its own units alone, so a stretch that two texts share has the
same anchors in both, wherever it stands.  Of ``K - S`` k-mers in a row one is an anchor, so with the marks every text with a unit has
anchors that cover all its units, at every length by the same rule.

A fingerprint is the anchors in text order: for each a digit, its distance from the one before (the first: from the text's first
k-mer), and its hash in hexadecimal.  So it holds the positions too.

``likeness`` of two fingerprints matches anchors by hash **and** position.  All anchors of both are sorted by hash and position;
neighbours of one hash from different texts are a match, with an offset, the difference of their positions.  The largest number of
matches whose offsets lie within ``SLACK`` units of each other counts (never more than either has anchors), over all anchors of both less that number.  A few
words more or less hardly matter; passages in another order are matched at one of their offsets only.

Defined results: a null or empty text (white space too) has no anchor and the empty fingerprint, and no other text has; likeness of
two empty fingerprints is 1, of an empty and another 0.  Equal texts have equal fingerprints.

The edited text needs the next document in descending ``doc_id``.  Documents are dealt to ranges of ``doc_id`` of like size (bounds
from one aggregate over that column), each range also gets the first document of the range below it, and ``lead`` runs inside a
range: the texts are shuffled once and no task sees more than a range.  Repeated ids are ordered by text, null ids come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, shuffle_partitions

K, S = 8, 2
#: Units by which the offsets of matches may differ.
SLACK = 64
#: Ranges for each shuffle partition, so that their sizes even out.
RANGES = 8
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_UNIT = rf"[{_ALONE}]|[^\s{_ALONE}]+"
#: Marks before and behind the units, all different, so that none of their s-mers are alike.
BEFORE, BEHIND = range(1, K), range(-1, -K, -1)
_NONE = "array<struct<h:bigint,p:int>>"


def _places(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def _marks(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _padded(text: str) -> Column:
    """Hashes of a text column's units with the marks around them; empty without units."""
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_UNIT), F.lit(0)), lambda w: F.xxhash64(w))
    around = lambda h: F.when(F.size(h) > 0, F.concat(_marks(BEFORE), h, _marks(BEHIND))).otherwise(h)
    return F.get(F.transform(F.array(hashes), around), F.lit(0))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the anchors of a text column in text order: h (hash) and p (place of its k-mer).

    Each step is a projection of its own: the arrays are computed once and then read by place.
    """
    inner = K - S + 1
    hashes, inners = f"_{out}_hashes", f"_{out}_inners"
    df = df.withColumn(hashes, _padded(text))
    n = F.size(hashes)
    h, g = F.col(hashes), F.col(inners)
    df = df.withColumn(inners, F.transform(_places(n - (S - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)])))
    edge = lambda i: F.least(F.get(g, i), F.get(g, i + inner - 1)) <= F.least(*[F.get(g, i + j) for j in range(1, inner - 1)])
    anchors = F.transform(F.filter(_places(n - (K - 1)), edge), lambda i: F.struct(F.xxhash64(F.slice(h, i + 1, K)).alias("h"), i.alias("p")))
    return df.withColumn(out, anchors).drop(hashes, inners)


def fingerprint(anchors: str) -> Column:
    before = lambda i: F.coalesce(F.get(F.col(anchors), i - 1)["p"], F.lit(0))
    return F.array_join(F.transform(anchors, lambda x, i: F.concat((x["p"] - before(i)).cast("string"), F.lower(F.hex(x["h"])))), " ")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with the likeness of two columns of anchors; projections in steps, as in ``with_anchors``."""
    both, offsets = f"_{out}_both", f"_{out}_offsets"
    side = lambda x, of: F.transform(x, lambda t: F.struct(t["h"].alias("h"), t["p"].alias("p"), F.lit(of).alias("of")))
    df = df.withColumn(both, F.sort_array(F.concat(side(a, 0), side(b, 1))))
    s = F.col(both)

    def offset(i: Column) -> Column:
        x, y = F.get(s, i), F.get(s, i + 1)
        return F.when((x["h"] == y["h"]) & (x["of"] != y["of"]), (x["p"] - y["p"]) * F.when(x["of"] == 0, 1).otherwise(-1))

    df = df.withColumn(offsets, F.sort_array(F.filter(F.transform(_places(F.size(both) - 1), offset), lambda d: d.isNotNull())))
    d = F.col(offsets)
    # a window over the sorted offsets that grows where its ends lie within SLACK and else moves on: its last size is its largest
    most = F.aggregate(_places(F.size(offsets)), F.lit(0), lambda size, i: size + F.when(F.get(d, i) - F.get(d, i - size) <= SLACK, 1).otherwise(0))
    common = F.least(most, F.size(a), F.size(b))
    either = F.size(a) + F.size(b) - common
    return df.withColumn(out, F.when(either == 0, F.lit(1.0)).otherwise(common.cast("double") / F.greatest(either, F.lit(1)))).drop(both, offsets)


def range_of(key: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    held = F.array(*[F.lit(b) for b in bounds])
    down = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(held, at + step - 1) <= F.col(key)), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), down)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with anchors, and ``next_text`` and ``next_anchors``: those of the next document in descending doc_id; after the last, the first."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    ranges = ranges or RANGES * parts
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    share = ", ".join(str(k / ranges) for k in range(1, ranges)) or "0.5"
    bounds = sorted(set(keyed.agg(F.expr(f"percentile_approx(key, array({share}), {max(10_000, 20 * ranges)})").alias("b")).first()["b"] or []))
    keyed = keyed.withColumn("range", range_of("key", bounds))
    firsts = keyed.groupBy("range").agg(F.max("key").alias("key")).collect()  # a row a range: as many as the parameter says
    if not firsts:
        none = F.array().cast(_NONE)
        return keyed.select("doc_id", "text", none.alias("anchors"), F.col("text").alias("next_text"), none.alias("next_anchors"))
    first = {r["range"]: r["key"] for r in firsts}
    order = sorted(first, reverse=True)
    above = {first[r]: order[k - 1] for k, r in enumerate(order)}  # the range before it; before the first range, the last
    targets = spark.createDataFrame(list(above.items()), "key long, target int")
    guests = keyed.join(F.broadcast(targets), "key").select("doc_id", "text", "key", F.col("target").alias("range"), F.lit(True).alias("guest"))
    dealt = keyed.withColumn("guest", F.lit(False)).unionByName(guests).repartition(parts, "range")
    dealt = with_anchors(dealt, "text", "anchors")
    order = Window.partitionBy("range").orderBy("guest", F.col("key").desc(), "text")
    both = F.lead(F.struct("text", "anchors")).over(order)
    return dealt.withColumn("next", both).where(~F.col("guest")).select("doc_id", "text", "anchors", F.col("next.text").alias("next_text"), F.col("next.anchors").alias("next_anchors"))


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of ``docs`` (doc_id, text)."""
    rows = with_next(docs, ranges).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("next_text").substr(F.lit(1), half)))
    rows = with_likeness(rows, "anchors", "next_anchors", "near_next").select("doc_id", "n_chars", "edited", "anchors", "near_next")
    rows = with_likeness(with_anchors(rows, "edited", "edited_anchors"), "anchors", "edited_anchors", "near_edited")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("anchors").alias("fingerprint"), fingerprint("edited_anchors").alias("edited_fingerprint"), "near_edited", "near_next")
