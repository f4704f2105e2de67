"""Operators 11, 12 and 13 against plain versions, on edge rows and on rows that cross ranges, batches and blocks."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm import collocations, fim, linededup, queries

from .conftest import EDGE, SF, rows, sentence

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# -- 11: lines -----------------------------------------------------------------


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def plain_lines(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, t in docs:
        me, lines = -(1 << 63) if i is None else i, (t or "").split("\n")
        kept = [x for x in lines if len(holders[key_of(x)]) < min_docs or max(holders[key_of(x)]) == me]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


LINES = [f"  Line number {k} that is long enough to be a key of its own\t" for k in range(60)]


def many_lines(n, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        text = [rng.choice(LINES[:3]) if rng.random() < 0.4 else rng.choice(LINES) for _ in range(rng.randint(0, 9))]
        text = [x.upper() if rng.random() < 0.2 else x for x in text] + [rng.choice(["", "short", "é" * 39, "É" * 40, f"own line of document {i} and of no other, sure"])]
        rng.shuffle(text)
        docs.append((i if rng.random() < 0.95 else rng.choice([None, 3]), "\n".join(text) if rng.random() < 0.97 else None))
    return docs + docs[:3]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_line_dedup_equals_plain(spark, parts):
    docs = many_lines(300, parts)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = linededup.apply_bitmaps(df, linededup.keep_bitmaps(df, parts=parts))
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"])) for r in got.collect()), key=lambda t: tuple((x is None, str(x)) for x in t)) == plain_lines(docs)


def test_line_dedup_edges(spark, edge, empty):
    assert rows(linededup.digests(edge), "doc_id", "n_lines", "n_dropped", "kept_sha256") == plain_lines(EDGE)
    assert linededup.digests(empty).collect() == [] and linededup.keep_bitmaps(empty).collect() == []


def test_line_dedup_keeps_other_columns(spark):
    text = "the very same line in each of the documents\nx"
    df = spark.createDataFrame([(i, text, 7, "k", i, -i) for i in range(6)], "doc_id long, text string, rest int, keep string, text_key long, N_Lines long")
    got = linededup.drop_lines(df)
    assert got.columns == ["doc_id", "text", "rest", "keep", "text_key", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(i, text if i == 5 else "x", 7, "k", i, 2, int(i < 5)) for i in range(6)]


def test_bitmaps_are_small_and_deflated(spark):
    shared = "a line that all of these documents have in common"
    docs = [(i, "\n".join([shared] * 500 + ["own"] * 500)) for i in range(6)]
    found = linededup.keep_bitmaps(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 1, 2, 3, 4]
    for r in found:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8), count=r["n_lines"])
        assert bits.tolist() == [0] * 500 + [1] * 500 and r["n_dropped"] == 500 and len(r["keep"]) < 40


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 12)), max_size=60), st.integers(1, 7), st.lists(st.integers(0, 60), max_size=4))
def test_streaming_over_any_batches_and_ranges(found, size, cuts):
    """However the sorted rows are cut in ranges and batches, the same rows go."""
    found = sorted(set(found))
    cuts = sorted({0, len(found), *(c for c in cuts if c < len(found))})
    dropped, opened, summaries = [], [], defaultdict(list)
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        table = pa.table([pa.array([k[0] for k in found[a:b]], pa.int64()), pa.array([0] * (b - a), pa.int64()), pa.array([k[1] for k in found[a:b]], pa.int64()), pa.array([0] * (b - a), pa.int64()), pa.array([1] * (b - a), pa.int32()), pa.array([b""] * (b - a), pa.binary())], schema=linededup._ROW)
        for out in linededup.stream_drops(table.to_batches(max_chunksize=size), part, 3):
            for r in out.to_pylist():
                {0: dropped, 1: opened}.get(r["kind"], summaries[r["h1"]]).append((r["h1"], r["later"]) if r["kind"] < 2 else r)
    for key, rs in summaries.items():
        total = sum(r["n_docs"] for r in rs) - sum(x["last"] == y["later"] for x, y in zip(rs, rs[1:]))
        if total >= 3:
            dropped += [o for o in opened if o[0] == key and o[1] != min(r["later"] for r in rs)]
    by_key = defaultdict(list)
    for h, d in found:
        by_key[h].append(d)
    assert sorted(dropped) == [(h, d) for h, ds in sorted(by_key.items()) if len(ds) >= 3 for d in ds[1:]]


# -- 12: phrases ---------------------------------------------------------------


def plain_phrases(docs, min_count=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        longer = defaultdict(int)
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in candidates.items():
            if 100 * longer[p] >= 50 * a and len(p) == 2:
                continue
            cut = min((int(Fraction(10**6 * a * a, counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p)))
            found.append((-cut[0], -a, " ".join(p).encode(), counts[p[: cut[1]]], counts[p[cut[1] :]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_docs(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "São", "x\x00y", "İ", "ß", "日本", "don't"]
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n", " new york city "]) for _ in range(rng.randint(0, 40)))
    docs = [(rng.choice(["en", "en", "de", None, "und"]), make()) for _ in range(n)]
    return docs + [(None, None), ("fr", ""), ("fr", " .,\n"), ("en", "the " * 300)] + docs[:5]


@pytest.mark.parametrize("block_bytes", [1, 500, 32 << 20])
def test_phrases_equal_plain(spark, block_bytes):
    docs = phrase_docs(block_bytes)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    got = collocations.top_phrases(df, block_bytes=block_bytes)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plain_phrases(docs)


def test_phrases_equal_sql_row_by_row(spark):
    """The registered query against its statement, all rows and columns, each language's rows by rank."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    name, columns = "op12_collocations", "lang rank phrase a l r n score".split()
    want = con.execute(queries.SQL[name]).df()[columns].values.tolist()
    got = rows(queries.QUERIES[name](spark, SF), *columns)
    assert len(want) > 100 and sorted(got) == sorted(map(tuple, want))
    for lang in {r[0] for r in got}:
        assert sorted(r[1] for r in got if r[0] == lang) == list(range(1, sum(r[0] == lang for r in got) + 1))


def test_phrases_tops_ties_and_columns(spark):
    docs = [("en", "b a. c d. a b; e f! é g") for _ in range(12)]
    df = spark.createDataFrame([(lang, t, 1, "w") for lang, t in docs], "lang string, text string, block int, words string")
    got = [tuple(r[c] for c in COLUMNS) for r in collocations.top_phrases(df, top=3).collect()]
    assert sorted(got) == plain_phrases(docs, top=3) and [g[2] for g in sorted(got)] == ["c d", "e f", "é g"]
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.top_phrases(none).collect() == []
    assert collocations.top_phrases(spark.createDataFrame([("en", "a b")], "lang string, text string")).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200_000), st.sampled_from([3, 900, 5_000, 2_000_000]))
def test_tiles_count_all_pairs(seed, n, most):
    rng = np.random.default_rng(seed)
    x, y = (np.minimum(rng.zipf(1.3, n), most).astype(np.int64) - 1 for _ in range(2))
    got = sorted(zip(*(v.tolist() for v in collocations.tile_counts(x, y))))
    want = Counter(zip(x.tolist(), y.tolist()))
    assert got == sorted((a, b, c) for (a, b), c in want.items())


def test_tiles_dense_and_wide_ids():
    x = np.r_[np.zeros(70_000, np.int64), np.full(5, 1 << 40)]
    y = np.r_[np.arange(70_000, dtype=np.int64) % 7, np.full(5, 3)]
    got = sorted(zip(*(v.tolist() for v in collocations.tile_counts(x, y))))
    assert got == [(0, k, 10_000) for k in range(7)] + [(1 << 40, 3, 5)]
    assert [len(v) for v in collocations.tile_counts(x[:0], y[:0])] == [0, 0, 0]


def test_score_is_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(3 * 10**15, 3 * 10**15 + 1, 3 * 10**15), (7, 7, 7), (1, 3, 1)], "a long, l long, r long")
    assert [r[0] for r in df.select(collocations.score("a", "l", "r")).collect()] == [10**6 * a * a // (b * c) for a, b, c in [(3 * 10**15, 3 * 10**15 + 1, 3 * 10**15), (7, 7, 7), (1, 3, 1)]]


# -- 13: middles ---------------------------------------------------------------


def plain_middle(i, text):
    text, units = text or "", list(text or "")
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return i, n, form, a, b - a, sha(out), sha(text)


MIDDLE = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
MARKED = [(i, t) for i in range(100, 160) for t in ("<P>", "a<S>b", "<M", "<P<S<M<", ">P><", "😀é\r\n" * (i % 7))]


def test_middles_equal_plain(spark, edge, empty):
    docs = EDGE + MARKED
    df = edge.union(spark.createDataFrame(MARKED, "doc_id long, text string"))
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert rows(fim.digests(df), *MIDDLE) == sorted((plain_middle(*d) for d in docs), key=key)
    assert {"plain", "psm", "spm"} == {r[2] for r in rows(fim.digests(df), *MIDDLE)}
    assert fim.digests(empty).collect() == []


def test_middles_other_units_and_columns(spark):
    docs = [(i, sentence(12, i) + (" " if i % 2 else ""), i, "old") for i in range(30)] + [(99, " leading blank", 1, "old")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_extra long, Form string")
    got = fim.fill_in_middle(df, unit=r"\S+\s*")
    assert got.columns == ["doc_id", "text", "n_extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in got.withColumn("back", fim.restored()).collect():
        assert r["back"] == r["text"] and r["n"] == (12 if r["doc_id"] < 99 else 0)
        if r["form"] != "plain":
            cuts = {0, *(m.end() for m in regex.finditer(r"\S+\s*", r["text"]))}
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= cuts
    assert {r["form"] for r in got.where("doc_id = 99").collect()} == {"plain"}


def test_one_match_gives_all_cuts():
    ends = regex.compile(f"({fim.CHARACTER})*").fullmatch("a\n😀\r").ends(1)
    assert ends == [1, 2, 3, 4]
