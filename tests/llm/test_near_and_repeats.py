"""Operators 2 and 10 against brute force."""

import collections
import random

import numpy as np
import pytest

from shardloom.llm import neardup, suffixdedup
from shardloom.llm.common import Powers

from .conftest import EDGE, rows, sentence


def bag(text):
    words = [w for w in _split(text)]
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else collections.Counter()


def _split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def jp(a, b):
    """Probability Jaccard by its definition."""
    return sum(1 / sum(max(a[x] / a[k], b[x] / b[k]) for x in a.keys() | b.keys()) for k in a.keys() & b.keys())


def classes(docs, threshold=0.8):
    """Class of each id by comparing all pairs."""
    ids = sorted({i for i, _ in docs if i is not None})
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    bags = [(i, bag(t)) for i, t in docs if i is not None]
    for k, (i, a) in enumerate(bags):
        for j, b in bags[k + 1 :]:
            if a and b and len(a.keys() & b.keys()) * 2 > min(len(a), len(b)) and jp(a, b) >= threshold:
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_exact_likeness():
    rng = random.Random(0)
    for _ in range(200):
        a = collections.Counter(rng.choices("abcdefgh", k=rng.randint(1, 30)))
        b = collections.Counter(rng.choices("defghijk", k=rng.randint(1, 30)))
        pack = lambda c: (np.array(sorted(map(ord, c)), np.uint64), np.array([c[chr(x)] for x in sorted(map(ord, c))], np.uint32))
        assert neardup.probability_jaccard(pack(a), pack(b)) == pytest.approx(jp(a, b))


def test_signatures_estimate_the_likeness():
    rng = random.Random(1)
    base = sentence(300, 1).split()
    texts = [edited(base, n, rng) for n in (0, 3, 6, 12, 25, 50)] + [" ".join(base + base[:150])]
    doc, value, weight = neardup.shingles([t.encode() for t in texts])
    sig = neardup.signatures(len(texts), doc, value, weight)
    bags = [(value[doc == k], weight[doc == k]) for k in range(len(texts))]
    for k in range(len(texts)):
        for j in range(k):
            assert abs((sig[k] == sig[j]).mean() - neardup.probability_jaccard(bags[k], bags[j])) < 0.2
    # alone or with others: the same
    doc, value, weight = neardup.shingles([texts[3].encode()])
    assert (neardup.signatures(1, doc, value, weight)[0] == sig[3]).all()


def test_op2_edges(edge, empty):
    got = rows(neardup.near_duplicates(edge), "doc_id", "rep_id", "class_id")
    known = {r[0]: r[2] for r in got}
    assert len(got) == len(EDGE) and sum(r == (None, None, None) for r in got) == 2
    assert known[6] == known[7] == 6 and all(known[i] == i for i in (1, 2, 3, 4, 5, 8, 9, 10, 11))
    assert neardup.near_duplicates(empty).count() == 0


def test_op2_crowded_group_loses_no_link(spark, monkeypatch):
    """A large group of near copies in which few are near to the smallest id, in small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = random.Random(3)
    docs, base = [], sentence(120, 33).split()
    for k in range(150):
        docs.append((k, edited(base, rng.choice([1, 2, 3, 4, 5, 8]), rng)))
    for k in range(150, 170):
        docs.append((k, sentence(80, k)))
    docs += [(200 + k, docs[k][1]) for k in range(30)] + [(300, "three short words"), (301, "three short words")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == classes(docs)


def test_op2_documents(small, small_rows):
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(small).collect()}
    assert got == classes(small_rows)


def test_op2_keeps_one_of_each(spark):
    docs = [(1, sentence(50, 1), "a"), (2, sentence(50, 1), "b"), (3, sentence(50, 3), "c"), (3, sentence(50, 3), "c"), (None, sentence(50, 1), "d")]
    kept = neardup.one_of_each(spark.createDataFrame(docs, "doc_id long, text string, class_id string"))
    assert rows(kept, "doc_id", "class_id") == [(1, "a"), (3, "c"), (None, "d")]


@pytest.mark.parametrize("order", [1, -1])
def test_op2_rows_of_one_id_with_different_texts(spark, order):
    """No text is lost where ids repeat: one row of each text stays, whatever the order of the rows."""
    a, b, c = sentence(50, 1), sentence(50, 2), sentence(50, 3)
    near = a.rsplit(" ", 1)[0] + " other"
    docs = [(1, a), (5, a), (5, b), (7, b), (9, b), (11, c), (11, near), (11, ""), (11, ""), (12, "")][::order]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert rows(neardup.one_of_each(df), "doc_id", "text") == sorted([(1, a), (5, b), (11, c), (11, ""), (12, "")], key=str)
    got = neardup.near_duplicates(df).collect()
    named = {(r["class_id"], r["class_text"]) for r in got}
    assert len(got) == len(docs) and len(named) == 5
    assert sorted(r["class_id"] for r in got) == [1, 1, 1, 5, 5, 5, 11, 11, 11, 12]


def test_op2_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "_first", "row", "all", "place", "tie", "class"]
    docs = [(1, sentence(50, 1), "a", 1, 2, 3, 4, 5), (2, sentence(50, 1), "b", 1, 2, 3, 4, 5), (3, sentence(50, 3), "c", 6, 7, 8, 9, 10), (3, sentence(50, 3), "c", 6, 7, 8, 9, 11)]
    kept = neardup.one_of_each(spark.createDataFrame(docs, names))
    assert kept.columns == names
    got = sorted(map(tuple, kept.collect()))
    assert got[0] == docs[0] and got[1] in docs[2:] and len(got) == 2


def test_op2_counts_links(spark):
    base = sentence(100, 5).split()
    docs = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["x"])), (3, " ".join(base[:-1] + ["y"])), (4, sentence(60, 9)), (5, " ".join(base))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}
    assert got[1] == got[5] and got[4][1] == 0 and all(1 <= got[i][1] <= 2 for i in (1, 2, 3))


def plain_repeats(docs, length=suffixdedup.LENGTH):
    """Mask of removed bytes of each row, by the definition."""
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in docs:
        data = (t or "").encode()
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s not in first or key(i) < first[s]:
                first[s] = key(i)
    out = []
    for i, t in docs:
        data = (t or "").encode()
        mask = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < key(i):
                mask[k : k + length] = True
        out.append((i, t, mask))
    return out


def check_repeats(spark, docs, partitions=4):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    got = []
    for r in suffixdedup.removed_spans(df).collect():
        mask = np.zeros(len((r["text"] or "").encode()), bool)
        ends = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a < b for a, b in ends) and all(b < c for (_, b), (c, _) in zip(ends, ends[1:]))
        for a, b in ends:
            mask[a:b] = True
        got.append((r["row"]["doc_id"], r["text"], mask.tobytes()))
    want = [(i, t, m.tobytes()) for i, t, m in plain_repeats(docs)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op10_edges(spark, empty):
    check_repeats(spark, [(i, t[:3000] if t else t) for i, t in EDGE])
    assert suffixdedup.removed_spans(empty).count() == 0


def test_op10_random_passages(spark, monkeypatch):
    """Passages of 40 to 120 bytes in few letters, so that chance repeats are many, cut into small pieces and records."""
    rng = random.Random(7)
    passages = ["".join(rng.choice("ab é") for _ in range(rng.randint(40, 120))) for _ in range(30)]
    docs = []
    for k in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(0, 8))]
        docs.append((rng.randint(0, 90), "".join(parts)))
    check_repeats(spark, docs)
    check_repeats(spark, docs[:40] + [(500, docs[3][1] * 3), (501, "ab" * 700), (502, "ab" * 701)], 3)


def test_op10_pieces_of_long_texts():
    """Cut at any place, the anchors still cover every window."""
    text = np.frombuffer(sentence(400, 9).encode(), np.uint8)
    rank, pair, first, n = suffixdedup.sampled(text)
    assert n.sum() == len(text) - suffixdedup.LENGTH + 1 and (first[1:] == first[:-1] + n[:-1]).all()
    whole = Powers(3).prefix(text)
    assert len(whole) == len(text) + 1


def test_op10_texts_stay_valid(spark):
    passage = "é日" * 30
    docs = [(1, "a" + passage + "b", 7), (2, "xyz" + passage[1:] + "ß", 8)]
    got = {r["doc_id"]: (r["text"], r["spans"]) for r in suffixdedup.cut_texts(spark.createDataFrame(docs, "doc_id long, text string, spans int")).collect()}
    assert got[1] == ("a" + passage + "b", 7)
    assert got[2][0].startswith("xyz") and got[2][0].endswith("ß") and len(got[2][0]) < 10 and got[2][1] == 8


def test_op10_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", F.xxhash64("k").alias("h"))
    assert {r["k"]: r["h"] for r in df.collect()} == dict(zip(keys, suffixdedup.spark_hash(np.array(keys)).tolist()))
