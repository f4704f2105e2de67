"""Operator 2: near-duplicates by ProbMinHash on weighted shingles, banding and exact verification.

A document is the bag of its shingles (``SHINGLE`` words each, weight: how often it occurs; a text with fewer words is one shingle).
Likeness of two is the probability Jaccard J_P of the bags, which is the plain Jaccard where all weights are 1.

* **Signature**: each element of a bag is a Poisson process with its weight as rate, seeded by the element's hash.  Arrivals fall on
  random registers; a register keeps the element that arrives first.  Two bags have the same element in a register with probability
  J_P.  A bag of total weight W has its registers filled by time about m log m / W: an element stops at its first arrival beyond that
  horizon (early termination), and a bag with a register still empty gets a doubled horizon.
* **Banding**: ``BANDS`` bands of ``ROWS`` registers; documents that agree in a band share a bucket.  At likeness 0.8 a pair shares
  none with probability 5e-5.
* **Verification**: J_P is computed exactly from the two bags.

Equal bags are one vertex: rows of copies never meet.  A vertex is named by its smallest row, by ``doc_id`` and a hash of the text, so
rows of one id with different texts are different documents and none stands for another.  In each bucket all are compared with its smallest id first (a row each), and
links give components by label spreading.  Where a bucket still holds different components, its members are dealt to blocks and every
two blocks meet in a task of their own, which looks only at members of different components whose signatures agree often enough and
gives a spanning forest of the links it finds.  So no link between different texts is lost to the bucket's centre, no task
holds more than two blocks, and no rows for all pairs are made.  What grows with the data stays in Spark.

Result: a row for each row of the documents: doc_id, rep_id (smallest id with the same bag), class_id (smallest id of the component),
class_text (hash of the text of the component's smallest row, as one id may have several texts), n_links (pairs of different bags
that were verified as near to the row's; the spanning links, not all pairs).

Defined results: a text without words has no likeness and is its own class; null ids take no part and have a null class; rows of one
id with different texts are judged each by its own; equal rows each give a row, in one class; an empty table gives an empty result.
Documents are read whole; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Powers, mix, slices, staged

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Documents whose arrivals are held at once.
SKETCH_ROWS = 400
#: Members of a block, and bytes of bags in it, in buckets that the first comparison leaves open.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Agreeing registers from which a pair is verified: four standard deviations below what the threshold gives.
AGREE = int(REGISTERS * THRESHOLD - 4 * (REGISTERS * THRESHOLD * (1 - THRESHOLD)) ** 0.5)
_U64 = np.uint64
#: A vertex: the smallest row of a bag.
VERTEX = "struct<doc:bigint,text:bigint>"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = Powers(0x9E3779B97F4A7C15)
_ODD = [_U64(0xA0761D6478BD642F + 2 * k * 0x1234567) for k in range(SHINGLE)]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (its place in the list), hash and weight of every distinct shingle, sorted by document and hash."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, _U64), np.empty(0, np.int64)
    word = _powers.span(_powers.prefix(data), start, end)
    first_byte = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(first_byte, start, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(n_words) - n_words
    size = np.minimum(n_words, SHINGLE)
    # a shingle starts at every word with enough words behind it
    at = np.flatnonzero(np.arange(len(doc)) - begin[doc] <= n_words[doc] - size[doc])
    who = doc[at]
    value = np.zeros(len(at), _U64)
    for k in range(SHINGLE):
        there = k < size[who]
        value[there] += mix(word[at[there] + k] * _ODD[k] + _U64(k + 1))
    value = mix(value + size[who].astype(_U64))
    order = np.lexsort((value, who))
    who, value = who[order], value[order]
    new = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (value[1:] != value[:-1])])
    return who[new], value[new], np.diff(np.r_[new, len(value)])


def _uniform(x: np.ndarray) -> np.ndarray:
    """A number in (0, 1] from each hash."""
    return ((x >> _U64(11)).astype(np.float64) + 1) / float(1 << 53)


def signatures(n: int, doc: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """n rows of ``REGISTERS`` element hashes; a row of a document without shingles is all 0."""
    out = np.zeros((n, REGISTERS), _U64)
    total = np.bincount(doc, weight, n)
    with np.errstate(divide="ignore"):
        horizon = REGISTERS * (np.log(REGISTERS) + 5) / total
    todo = total > 0
    while todo.any():
        mine = todo[doc]
        d, v, rate = doc[mine], value[mine], weight[mine].astype(np.float64)
        when, arrivals, j = np.zeros(len(d)), [], 0
        while len(d):
            seed = mix(v + _U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            when = when - np.log(_uniform(seed)) / rate
            early = when <= horizon[d]  # later arrivals of this element can't be first anywhere
            d, v, rate, when, seed = d[early], v[early], rate[early], when[early], seed[early]
            register = ((mix(seed ^ _U64(0xD6E8FEB86659FD93)) >> _U64(32)) * _U64(REGISTERS)) >> _U64(32)
            arrivals.append((d * REGISTERS + register.astype(np.int64), when, v))
            j += 1
        slot, when, v = map(np.concatenate, zip(*arrivals))
        best = np.full(n * REGISTERS, np.inf)
        np.minimum.at(best, slot, when)
        won = when == best[slot]
        flat = np.zeros(n * REGISTERS, _U64)
        flat[slot[won]] = v[won]
        full = np.isfinite(best).reshape(n, REGISTERS).all(1) & todo
        out[full] = flat.reshape(n, REGISTERS)[full]
        todo &= ~full
        horizon[todo] *= 2
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two bags (sorted hashes, weights): the sum over common elements of 1 / sum of max(x'/x, y'/y) over all elements."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    if (x == x[0]).all() and (y == y[0]).all():
        r = x[0] / y[0]
        return float(len(x) * x[0] / (only_a + r * only_b + len(x) * x[0]))
    ratio, which = np.unique(x / y, return_inverse=True)
    # by rising x/y: below a ratio r the larger of x and r y is r y, from it on x
    order = np.argsort(x / y, kind="stable")
    ys, xs = np.r_[0, np.cumsum(y[order])], np.r_[0, np.cumsum(x[order])]
    at = np.searchsorted((x / y)[order], ratio)
    whole = only_a + ratio * only_b + ratio * ys[at] + (xs[-1] - xs[at])
    return float((x / whole[which]).sum())


def _bag(hashes: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, "<u8")
    return h, np.frombuffer(weights, "<u4") if weights else np.ones(len(h), np.uint32)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [(t.as_buffer().to_pybytes() if t.is_valid and len(t.as_buffer()) else b"") for t in part.column("text")]


def _by_document(n: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(doc, minlength=n)
    return np.cumsum(size) - size, size


def _row() -> Column:
    """The vertex name of a row of (doc_id, text)."""
    name = F.struct(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    return F.when(F.col("doc_id").isNotNull(), name).alias("row")


def sketches(docs: DataFrame) -> DataFrame:
    """Staged: row (its vertex name; null with a null id), bag_a and bag_b (128 bits that name the bag; null without words), bands (hash of each), marks (a byte of each register)."""

    def run(batches):
        for part in slices(batches, "text", 2 << 20, SKETCH_ROWS):
            n = part.num_rows
            doc, value, weight = shingles(_texts(part))
            sig = signatures(n, doc, value, weight)
            bands = np.empty((n, BANDS), _U64)
            for k in range(BANDS):
                h = np.full(n, k + 1, _U64)
                for r in range(ROWS):
                    h = mix(h * _U64(0x9E3779B97F4A7C15) + sig[:, k * ROWS + r])
                bands[:, k] = h
            bag = []
            for seed in (0x51ED270B, 0x7FB5D329):
                each = mix(value ^ mix(weight.astype(_U64) * _U64(seed)))
                total = np.zeros(n, _U64)
                np.add.at(total, doc, each)
                bag.append(pa.array(total.view(np.int64), mask=np.bincount(doc, minlength=n) == 0))
            held = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
            marks = pa.array([row.tobytes() for row in (sig >> _U64(56)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("row"), *bag, held, marks], names=["row", "bag_a", "bag_b", "bands", "marks"])

    return staged(docs.select(_row(), "text").mapInArrow(run, f"row {VERTEX}, bag_a long, bag_b long, bands array<long>, marks binary"), "sketches")


def bags(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Staged: id, hashes, weights (null: all 1) of the documents in ``ids`` (column id)."""

    def run(batches):
        for part in slices(batches, "text", 2 << 20):
            doc, value, weight = shingles(_texts(part))
            first, size = _by_document(part.num_rows, doc)
            rows = [(value[a : a + n].astype("<u8").tobytes(), None if (weight[a : a + n] == 1).all() else weight[a : a + n].astype("<u4").tobytes()) for a, n in zip(first, size)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))], names=["id", "hashes", "weights"])

    # by merging at any size: the ids grow with the documents
    wanted = docs.select(_row().alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    return staged(wanted.dropDuplicates(["id"]).mapInArrow(run, f"id {VERTEX}, hashes binary, weights binary"), "bags")


def verified(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose likeness reaches the threshold."""

    def run(batches):
        for part in slices(batches, "hashes_b"):
            keep = []
            for ha, wa, hb, wb in zip(*(part.column(c).to_pylist() for c in ("hashes_a", "weights_a", "hashes_b", "weights_b"))):
                keep.append(probability_jaccard(_bag(ha, wa), _bag(hb, wb)) >= threshold)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: bag.select(F.col("id").alias(x), F.col("hashes").alias(f"hashes_{x}"), F.col("weights").alias(f"weights_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, f"a {VERTEX}, b {VERTEX}")


def components(links: DataFrame) -> DataFrame:
    """Staged: id, label (smallest id of its component) of all ids in ``links`` (a < b).

    First the links of a vertex to smaller ones move to the smallest of these, which leaves it one link and merges most of a crowded
    group's.  Then each round a vertex takes the smallest label around it and that label's own label, until none changes.
    """
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = F.when(F.col("a") == F.col("m"), F.struct("m", F.col("b").alias("v"))).otherwise(F.struct("m", F.col("a").alias("v")))
    links = links.join(least, "b").select(moved.alias("l")).select(F.col("l.m").alias("a"), F.col("l.v").alias("b")).distinct()
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = staged(links.select(ways.alias("l")).select("l.a", "l.b"), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("beyond"))
        new = staged(least.join(jump, "next", "left").select("id", F.coalesce("beyond", "next").alias("label"), (F.col("label") != F.coalesce("beyond", "next")).alias("changed")), "labels")
        labels = new.select("id", "label")
        if new.where("changed").limit(1).count() == 0:
            return labels


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, band, id, label, blocks) of buckets that hold three vertices or more and more than one component; of buckets with
    the same members only that of the first band.  (In a bucket of two, both have been compared.)"""
    named = members.join(labels, "id", "left").select("key", "band", "id", F.coalesce("label", "id").alias("label"), "weight")
    buckets = named.groupBy("key", "band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("weight").alias("bytes"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("set_a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("set_b"))
    buckets = buckets.where("low < high AND size > 2").groupBy("set_a", "set_b", "size").agg(F.min_by("key", "band").alias("key"), F.first("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    return named.join(buckets.select("key", blocks.alias("blocks")), "key").select("key", "band", "id", "label", "blocks")


def links_across(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a < b) between the components of a bucket's members, a spanning forest of them for each two blocks, each with the two
    bags (u, v) that were found near.

    Members that share several bands meet in the first of these only: wherever that bucket is not among ``rows``, they have been
    compared or are in one component.
    """
    block = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def run(part):
        label, ident = (np.stack([part[c].combine_chunks().field(k).to_numpy(zero_copy_only=False) for k in ("doc", "text")], 1) for c in ("label", "id"))
        marks = np.frombuffer(b"".join(part["marks"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
        block = part["block"].to_numpy()
        across = bool((block != block[0]).any())  # within a block its own task looks
        group = np.unique(label, axis=0, return_inverse=True)[1].reshape(-1)
        bands, band = np.array(part["bands"].to_pylist(), np.int64), part["band"][0].as_py()
        parent = list(range(int(group.max()) + 1))

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        found, tried, bag = [], [], {}
        for k in range(len(label)):
            same = (marks[k + 1 :] == marks[k]).sum(1)
            mask = (same >= AGREE) & (group[k + 1 :] != group[k])
            if across:
                mask &= block[k + 1 :] != block[k]
            near = np.flatnonzero(mask)
            near = near[(bands[near + k + 1] == bands[k]).argmax(1) == band]
            tried.append(np.stack([same[near], np.full(len(near), k), near + k + 1], 1))
        tried = np.concatenate(tried)
        hashes, weights = part["hashes"], part["weights"]
        get = lambda k: bag.get(k) or bag.setdefault(k, _bag(hashes[k].as_py(), weights[k].as_py()))
        for _, p, q in tried[np.argsort(-tried[:, 0], kind="stable")].tolist():
            a, b = top(int(group[p])), top(int(group[q]))
            if a != b and probability_jaccard(get(p), get(q)) >= threshold:
                parent[a] = b
                found.append((*sorted((tuple(label[p].tolist()), tuple(label[q].tolist()))), tuple(ident[p].tolist()), tuple(ident[q].tolist())))
        vertex = lambda rows: pa.array([{"doc": d, "text": t} for d, t in rows], pa.struct([("doc", pa.int64()), ("text", pa.int64())]))
        return pa.table({name: vertex(x[k] for x in found) for k, name in enumerate("abuv")})

    return rows.groupBy("key", "i", "j").applyInArrow(run, ", ".join(f"{name} {VERTEX}" for name in "abuv"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, rep_id, class_id, class_text, n_links of ``docs`` (doc_id, text)."""
    found = _classes(docs, threshold)
    return found.select("row.doc", "rep.doc", "class.doc", "class.text", "n_links").toDF("doc_id", "rep_id", "class_id", "class_text", "n_links")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """row, rep, class (vertices; null with a null id) and n_links of every row."""
    sketch = sketches(docs)
    same = ["bag_a", "bag_b"]
    reps = staged(sketch.where("row IS NOT NULL AND bag_a IS NOT NULL").groupBy(*same).agg(F.min("row").alias("id"), F.min_by(F.struct("bands", "marks"), "row").alias("s")), "bags-named")
    members = reps.select("id", F.posexplode("s.bands").alias("band", "key"))
    centres = members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    pairs = staged(members.join(centres, "key").where("id > a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    # every member of a bucket of two or more is in a pair
    bag = bags(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    links = staged(verified(pairs, bag, threshold), "links-centre")
    labels = components(links)
    sized = bag.select("id", F.octet_length("hashes").alias("weight"))
    crowded = open_buckets(members.join(sized, "id"), labels)
    marks = reps.select("id", "s.marks", "s.bands")
    rows = crowded.join(marks, "id").join(bag, "id")
    # links across join components, so the second spreading is over these alone
    across = staged(links_across(rows, threshold), "links-across")
    wider = components(across.select("a", "b")).select(F.col("id").alias("label"), F.col("label").alias("wider"))
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("rep"))
    n_links = ends(links).union(ends(across.select(F.col("u").alias("a"), F.col("v").alias("b")))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    # what is known of a bag is put together a row a bag; the rows of many copies then meet it in one join, which Spark may split
    known = reps.select(*same, F.col("id").alias("rep")).join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    known = known.join(wider, "label", "left").join(n_links, "rep", "left")
    known = staged(known.select(*same, "rep", F.coalesce("wider", "label").alias("class"), "n_links"), "bags-known")
    named = sketch.select("row", *same).join(known, same, "left")
    mine = lambda c: F.when(F.col("row").isNotNull(), F.coalesce(c, "row")).alias(c)
    return named.select("row", mine("rep"), mine("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class, its smallest row; rows with a null id stay.

    The row of a class has its id and its text.  Of rows that have both alike and differ in other columns the one of the least hash of all columns
    stays.  Columns of any name pass through.
    """
    first = _classes(docs, threshold).where("row = class").select("row").distinct()
    columns = [f"`{c}`" for c in docs.columns]
    held = docs.select(_row(), F.struct(*columns).alias("all"), F.xxhash64(F.to_json(F.struct(*columns))).alias("tie"))
    order = Window.partitionBy("row").orderBy("tie")
    kept = held.where("row IS NOT NULL").join(first, "row", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return kept.select("all").union(held.where("row IS NULL").select("all")).select("all.*")
