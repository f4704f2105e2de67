"""Operators 1, 4, 6 and 9 against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shardloom.llm import bpe, dac, packing, queries, tokencount, wordbpe

from .conftest import EDGE, SF, rows

WORD, BYTE, PATTERN = queries.WORD_FILE, queries.BYTE_RANKS, public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={w: i for i, w in enumerate(bpe.read_ranks(BYTE))}, special_tokens={})


def ids_of(library, text, end=None):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids + ([end] if end is not None else []), "<u4")


def test_perfect_hash_is_minimal_and_exact():
    words = bpe.read_ranks(BYTE)
    table = bpe.PerfectHash(words)
    assert sorted(table.slot(w) for w in words) == list(range(len(words)))
    assert all(table.get(w) == i for i, w in enumerate(words))
    assert table.get(b"no such word at all") is None and table.get(b"") is None


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_both_codecs_agree_with_the_libraries(text):
    codec = bpe.codec(BYTE, PATTERN)
    [ids] = codec.encode([text])
    tik = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert ids.tolist() == tik.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()
    library = wordbpe.encoder(WORD).library
    want = library.encode(text, add_special_tokens=False).ids
    assert wordbpe.encoder(WORD).encode([text])[0].tolist() == want
    assert tokencount.counter(WORD).count(text) == len(want)


def test_long_pretokens_merge_like_the_library(tik):
    codec = bpe.codec(BYTE, PATTERN)
    for text in ("x" * 20_000, "ab" * 9_999, " " * 3000 + "a", "é" * 4000):
        assert codec.encode([text])[0].tolist() == tik.encode_ordinary(text)


def test_proven_words_are_one_token(library):
    counter = tokencount.counter(WORD)
    letters = {c: b for b, c in enumerate(counter.letters)}
    spelled = [bytes(letters[c] for c in w) for w in sorted(counter.proven)[::200]]
    texts = [s.decode() for s in spelled if s.isalpha()]
    assert texts and all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in texts)
    assert len(counter.proven) < 49_406


def test_unknown_id_is_an_error():
    with pytest.raises(ValueError):
        bpe.codec(BYTE, PATTERN).decode(np.array([10**6]))


def test_decoding_needs_no_encoder(spark):
    """F-op1: a worker that only decodes holds the vocabulary's bytes, and gets no more text than it asks for."""
    few, words = bpe.decoder(BYTE), bpe.read_ranks(BYTE)
    assert not isinstance(few, bpe.ByteBpe) and not {"whole", "ranks", "known"} & set(vars(few))
    ids = np.arange(0, len(words), 97)
    assert few.decode(ids) == b"".join(words[i] for i in ids)
    with pytest.raises(ValueError):
        few.decode(np.array([len(words)]))
    assert bpe.SLICE_BYTES <= 1 << 20
    df = spark.createDataFrame([(1, np.array([256, 257], "<u4").tobytes()), (2, None), (None, b"")], "doc_id long, ids binary")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode_documents(df, BYTE, PATTERN).collect()}
    assert got == {1: words[256] + words[257], 2: b"", None: b""}


def test_op1_edges(edge, empty, tik):
    back = bpe.decode_documents(bpe.encode_documents(edge, BYTE, PATTERN), BYTE, PATTERN)
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in back.collect()]
    want = [(i, len(x := np.array(tik.encode_ordinary(t or ""), "<u4")), x.tobytes(), (t or "").encode()) for i, t in EDGE]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe.decode_documents(bpe.encode_documents(empty, BYTE, PATTERN), BYTE, PATTERN).count() == 0


def test_clashing_columns_are_replaced_and_others_kept(spark):
    df = spark.createDataFrame([(1, "some text", "old", 9)], "doc_id long, text string, ids string, other int")
    [row] = bpe.encode_documents(df, BYTE, PATTERN).collect()
    assert row["other"] == 9 and isinstance(row["ids"], (bytes, bytearray))
    [row] = tokencount.count_tokens(df.withColumnRenamed("ids", "n_bytes"), WORD).collect()
    assert row["other"] == 9 and row["n_bytes"] == 9


def test_op1_query(spark, small_rows, tik):
    got = rows(queries.QUERIES["op1_byte_bpe"](spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = [(i, len(x := np.array(tik.encode_ordinary(t), "<u4")), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in small_rows]
    assert sorted(got) == want


def test_op4(spark, edge, empty, library, small_rows):
    got = rows(tokencount.count_tokens(edge, WORD), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), n := len(ids_of(library, t)), n > 2048) for i, t in EDGE]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(empty, WORD).count() == 0
    got = rows(queries.QUERIES["op4_token_counts"](spark, SF), "doc_id", "n_tokens")
    assert sorted(got) == [(i, len(ids_of(library, t))) for i, t in small_rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000), st.data())
def test_codes_give_any_stretch(ids, data):
    import tempfile

    folder = tempfile.mkdtemp(prefix="dac-")
    writer = dac._Writer(folder)
    writer.add(3, np.array(ids, np.uint32))
    writer.add(None, np.array([7], np.uint32))
    path, n_docs, n_ids = writer.close()
    file = dac.DacFile(path)
    assert (n_docs, n_ids) == (2, len(ids) + 1) and file.document(0).tolist() == ids and file.document(1).tolist() == [7]
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert file.tokens(a, b).tolist() == ids[a:b]


def test_codes_across_segments(monkeypatch, tmp_path):
    monkeypatch.setattr(dac, "SEGMENT", 1000)
    writer, rng = dac._Writer(str(tmp_path)), np.random.default_rng(0)
    docs = [rng.integers(0, 1 << int(b), n).astype(np.uint32) for b, n in zip(rng.integers(1, 33, 20), rng.integers(0, 4000, 20))]
    for k, d in enumerate(docs):
        writer.add(k, d)
    file = dac.DacFile(writer.close()[0])
    assert all((file.document(k) == d).all() for k, d in enumerate(docs))
    whole = np.concatenate(docs)
    assert (file.tokens(900, 2100) == whole[900:2100]).all()
    with pytest.raises(ValueError):
        (tmp_path / "other").write_bytes(b"x" * 100)
        dac.DacFile(str(tmp_path / "other"))


def test_op6(spark, edge, empty, library):
    got = dac.read_documents(dac.token_files(edge, WORD)).collect()
    order = sorted(EDGE, key=lambda r: (r[0] is None, r[0] or 0, ids_of(library, r[1], 1).astype("<u2").tobytes()))
    start, want = 0, []
    for i, t in order:
        ids = ids_of(library, t, 1)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want
    assert dac.read_documents(dac.token_files(empty, WORD)).count() == 0


def check_pieces(pieces, docs, library, end, capacity):
    """Every id in one piece, sequences gapless and full enough."""
    ends = {}
    for i, t in docs:
        ends.setdefault((i, ids_of(library, t, end).tobytes()), 0)
    by_sequence, seen = {}, []
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.append((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    want = []
    for i, t in docs:
        ids = ids_of(library, t, end)
        want += [(i, a, len(part := ids[a : a + capacity]), zlib.crc32(part.tobytes()), len(ids)) for a in range(0, len(ids), capacity)]
    assert sorted(seen, key=str) == sorted(want, key=str)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_op9(edge, empty, library):
    check_pieces(packing.pack_documents(edge, WORD).collect(), EDGE, library, 2, packing.CAPACITY)
    assert packing.pack_documents(empty, WORD).count() == 0


def test_op9_query_and_sequences(spark, small, small_rows, library):
    pieces = queries.QUERIES["op9_packing"](spark, SF).collect()
    used = check_pieces(pieces, small_rows, library, 2, packing.CAPACITY)
    tokens = sum(r["length"] for r in pieces)
    assert used <= 1.1 * -(-tokens // packing.CAPACITY) + 1
    full = packing.sequences(packing.pack_documents(small, WORD, capacity=512, ids=True), pad_id=0, capacity=512).collect()
    assert all(len(r["ids"]) == 512 for r in full)
    assert sum(x == 2 for r in full for x in r["ids"]) >= len(small_rows)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_hold_every_piece_once(counts):
    patterns = packing.shortest_pack_first(counts, 64)
    held = {}
    for lengths, n in patterns:
        assert sum(lengths) <= 64 and n > 0
        for x in lengths:
            held[x] = held.get(x, 0) + n
    assert held == counts
    slots = packing.Slots(patterns)
    taken = set()
    for length, n in counts.items():
        sequence, offset = slots.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            new = {(s, k) for k in range(o, o + length)}
            assert not taken & new and o + length <= 64
            taken |= new
    # as good as placing piece by piece: no two sequences fit into one more often than by halves
    fill = [sum(lengths) for lengths, n in patterns for _ in range(n)]
    assert sum(1 for f in fill if f <= 32) <= 1
