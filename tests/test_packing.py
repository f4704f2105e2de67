"""Packing, offsets and manifest against a flat-list expectation (randomised),
plus the edge cases of FIXTURES section 4."""

import random

import pytest
from pyspark.sql import functions as F

from shardloom.config import BYTE_EOT_ID, PackSpec, SplitRatio
from shardloom.operators.packing import doc_offsets, pack_fragments, shard_manifest, split_counts
from shardloom.operators.tokenize import ByteTokenizer
from shardloom.sources.corpus import union_sources


def make_docs(spark, texts, source_ord=0, parts=3):
    rows = [(source_ord, i * 7 + 3, t) for i, t in enumerate(texts)]   # sparse, unique order keys
    return spark.createDataFrame(rows, "source_ord int, doc_ord long, text string").repartition(parts)


def flat_stream(sources):
    flat = []
    for texts in sources:
        for t in texts:
            flat.append(BYTE_EOT_ID)
            flat.extend(t.encode("utf-8"))
    return flat


def rebuild(frags):
    shards = {}
    for r in frags:
        shards.setdefault(r.shard_id, []).append((r.pos, list(r.tokens)))
    out = {}
    for sid, parts in shards.items():
        parts.sort()
        seq = []
        for pos, toks in parts:
            assert pos == len(seq), "fragments must tile the shard"
            seq.extend(toks)
        out[sid] = seq
    return out


def random_texts(rng, n, max_len):
    alphabet = "ab cdé€"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, max_len))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pack_equals_flat_slices(spark, seed):
    rng = random.Random(seed)
    texts = random_texts(rng, rng.randint(5, 40), 30)
    S = rng.choice([1, 2, 7, 16, 50])
    spec = PackSpec("t", shard_tokens=S, ranges=rng.choice([1, 2, 3, 5]))
    tok = ByteTokenizer(spark)
    docs = make_docs(spark, texts)
    frags = pack_fragments(docs, tok, spec).collect()
    flat = flat_stream([texts])
    got = rebuild(frags)
    want = {i // S: flat[i - i % S: i - i % S + S] for i in range(0, len(flat), S)}
    assert got == want
    man = {r.shard_id: (r.n_tokens, r.n_docs) for r in shard_manifest(doc_offsets(docs, tok, spec), spec).collect()}
    assert {k: v[0] for k, v in man.items()} == {k: len(v) for k, v in want.items()}
    assert sum(v[1] for v in man.values()) == len(frags)


def test_union_of_sources_keeps_order(spark):
    a, b = ["xx", "y"], ["zzz", "", "w"]
    docs = union_sources([make_docs(spark, b, 1), make_docs(spark, a, 0)])
    spec = PackSpec("u", shard_tokens=4, ranges=2)
    got = rebuild(pack_fragments(docs, ByteTokenizer(spark), spec).collect())
    flat = flat_stream([a, b])
    assert [t for k in sorted(got) for t in got[k]] == flat


def test_edge_documents(spark):
    # exact fit of a shard, one-token documents (empty text), a document longer than three shards
    texts = ["abcd", "", "", "x" * 20, "q"]
    spec = PackSpec("e", shard_tokens=5, ranges=2)
    got = rebuild(pack_fragments(make_docs(spark, texts), ByteTokenizer(spark), spec).collect())
    flat = flat_stream([texts])
    assert [t for k in sorted(got) for t in got[k]] == flat
    assert all(len(v) == 5 for k, v in got.items() if k != max(got))


def test_zero_documents(spark):
    docs = make_docs(spark, [])
    spec = PackSpec("z", shard_tokens=5)
    assert pack_fragments(docs, ByteTokenizer(spark), spec).count() == 0


def test_result_independent_of_partitioning(spark):
    rng = random.Random(9)
    texts = random_texts(rng, 30, 20)
    spec = PackSpec("p", shard_tokens=11, ranges=4)
    tok = ByteTokenizer(spark)
    one = sorted(map(tuple, pack_fragments(make_docs(spark, texts, parts=1), tok, spec)
                     .select("shard_id", "pos", F.array_join("tokens", ",")).collect()))
    many = sorted(map(tuple, pack_fragments(make_docs(spark, texts, parts=7), tok, spec)
                      .select("shard_id", "pos", F.array_join("tokens", ",")).collect()))
    assert one == many


def test_split_routing_and_counts(spark):
    texts = ["a" * 9] * 20          # 10 tokens each -> 20 shards of 10
    spec = PackSpec("s", shard_tokens=10)
    docs = make_docs(spark, texts)
    man = shard_manifest(doc_offsets(docs, ByteTokenizer(spark), spec), spec, SplitRatio(8, 1, 1))
    got = {r.shard_id: r.split for r in man.collect()}
    for sid, split in got.items():
        r = sid % 10
        assert split == ("training" if r < 8 else "validation" if r < 9 else "testing")
    counts = {r.split: r.n_shards for r in split_counts(man).collect()}
    assert counts == {"training": 16, "validation": 2, "testing": 2}
    names = {r.shard_id: (r.shard_name, r.file_name) for r in man.collect()}
    assert names[3] == ("s_000003", "s_000003_training")


def test_resplit_without_moving_data(spark, tmp_dir):
    from shardloom.sources.shards import read_shards, read_split_by_manifest, resplit_manifest, write_shards
    from shardloom.operators.packing import label_splits
    texts = ["b" * 9] * 20
    spec = PackSpec("r_testing", shard_tokens=10)
    docs = make_docs(spark, texts)
    tok = ByteTokenizer(spark)
    man = shard_manifest(doc_offsets(docs, tok, spec), spec, SplitRatio(8, 1, 1))
    write_shards(label_splits(pack_fragments(docs, tok, spec), SplitRatio(8, 1, 1)), man, f"{tmp_dir}/s", spec.data_name)
    from shardloom.sources.shards import read_manifest
    new = resplit_manifest(read_manifest(spark, f"{tmp_dir}/s"), SplitRatio(6, 2, 2))
    names = {r.shard_id: (r.split, r.file_name) for r in new.collect()}
    assert names[7] == ("validation", "r_testing_000007_validation")   # data name keeps its '_testing'
    df = read_split_by_manifest(spark, f"{tmp_dir}/s", new, "testing")
    got = {r.shard_id for r in df.collect()}
    assert got == {8, 9, 18, 19}
    old = {r.shard_id for r in read_shards(spark, f"{tmp_dir}/s", "testing").collect()}
    assert old == {9, 19}


@pytest.mark.parametrize("seed", [11, 12])
def test_offsets_equal_running_sum(spark, seed):
    from shardloom.plans.ordering import with_offsets
    rng = random.Random(seed)
    rows = []
    for src in range(3):
        ords = rng.sample(range(-50, 5000), rng.randint(0, 60))     # sparse, negative keys too
        rows += [(src, o, rng.randint(1, 40)) for o in ords]
    df = spark.createDataFrame(rows, "source_ord int, doc_ord long, n long").repartition(5)
    got = {(r.source_ord, r.doc_ord): r.g for r in with_offsets(df, "n", rng.choice([1, 2, 7])).collect()}
    run, want = 0, {}
    for src, o, n in sorted(rows):
        want[(src, o)] = run
        run += n
    assert got == want


def test_catalog_matches_data_name_exactly(spark):
    from shardloom.sources.shards import shard_catalog
    tok = ByteTokenizer(spark)
    docs = make_docs(spark, ["x" * 30])
    parts = []
    for name in ("a", "a_b"):
        spec = PackSpec(name, shard_tokens=10)
        parts.append(shard_manifest(doc_offsets(docs, tok, spec), spec))
    both = parts[0].unionByName(parts[1])
    got = {(r.data_name, r.shard_name) for r in shard_catalog(both, data_name="a").collect()}
    assert got == {("a", "a_000000"), ("a", "a_000001"), ("a", "a_000002"), ("a", "a_000003")}


def test_offsets_recurse_on_sparse_keys(spark):
    from shardloom.plans.ordering import with_offsets
    rng = random.Random(5)
    ords = rng.sample(range(0, 1 << 62), 300)                        # sparse 62-bit keys
    rows = [(i % 2, o, rng.randint(1, 9)) for i, o in enumerate(ords)]
    df = spark.createDataFrame(rows, "source_ord int, doc_ord long, n long").repartition(4)
    got = {(r.source_ord, r.doc_ord): r.g for r in with_offsets(df, "n", 8).collect()}
    run, want = 0, {}
    for src, o, n in sorted(rows):
        want[(src, o)] = run
        run += n
    assert got == want


def test_null_and_repeated_order_keys_fail(spark):
    import pytest

    from shardloom.plans.ordering import with_offsets
    kind = "source_ord int, doc_ord long, n long"
    for rows in ([(0, 1, 5), (0, None, 7), (0, 2, 3)], [(0, 1, 5), (0, 1, 7)], [(0, None, 1)]):
        with pytest.raises(Exception, match="order key"):
            with_offsets(spark.createDataFrame(rows, kind), "n").collect()
    assert with_offsets(spark.createDataFrame([], kind), "n").count() == 0


def test_offsets_of_sparse_and_crowded_keys(spark):
    from shardloom.plans.ordering import with_offsets
    keys = [-(2 ** 62), -5, *range(1000, 1400), 2 ** 40, 2 ** 62]
    rows = [(s, k, (k % 7 + 7) % 7) for s in (0, 1) for k in keys]
    got = {(r.source_ord, r.doc_ord): r.g for r in with_offsets(
        spark.createDataFrame(rows[::-1], "source_ord int, doc_ord long, n long").repartition(5), "n", 16).collect()}
    at = 0
    for s, k, n in sorted(rows):
        assert got[s, k] == at
        at += n


def test_offsets_are_gapless_when_quantiles_come_out_differently(spark):
    """Approximate quantiles depend on the order of rows, which differs each time the input is read; offsets must not."""
    import numpy as np
    import pyarrow as pa

    from shardloom.plans.ordering import with_offsets

    def dealt(batches):
        rows = pa.Table.from_batches(list(batches))
        yield from rows.take(pa.array(np.random.default_rng().permutation(len(rows)))).to_batches()

    df = spark.range(0, 300_000, 1, 2).selectExpr("0 AS source_ord", "id * 7 AS doc_ord", "id % 5 AS n")
    df = df.mapInArrow(dealt, df.schema)
    got = with_offsets(df, "n", 16).toPandas().sort_values("doc_ord")
    assert len(got) == 300_000 and (got.g == got.n.cumsum() - got.n).all()
