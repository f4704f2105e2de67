"""Registered queries against DuckDB, and the pipeline against plain versions of its stages."""

import duckdb
import pytest

import corpus_pipeline
from shardloom.llm import quality, queries, suffixdedup
from shardloom.llm.common import staged
from shardloom.session import read_table

from .conftest import SF
from .test_near_and_repeats import classes, plain_repeats


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns[0]]
    a, b = (x[sorted(want.columns)].sort_values(order).reset_index(drop=True) for x in (got, want))
    assert a.values.tolist() == b.values.tolist()


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "suffix_array_dedup", "packing"]
    docs = read_table(spark, SF, "documents")
    kept, columns = docs, docs.columns
    seen = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        kept = staged(stage(spark, kept, SF), f"test-{name}")
        seen[name] = kept.collect()
        assert name == "packing" or kept.columns == columns
    rejected = {r["doc_id"] for r in seen["documents"]} - {r["doc_id"] for r in seen["toxicity"]}
    assert len(rejected) < 0.3 * len(seen["documents"])
    good = lambda t: not quality.BASE.rejects(quality.Text(t or "")) and not any(r.rejects(quality.Text(t or "")) for r in quality.RULES)
    assert {r["doc_id"] for r in seen["quality_rules"]} == {r["doc_id"] for r in seen["toxicity"] if good(r["text"])}
    found = classes([(r["doc_id"], r["text"]) for r in seen["quality_rules"]])
    assert {r["doc_id"] for r in seen["near_dedup"]} == set(found.values())
    texts = {r["doc_id"]: r for r in seen["suffix_array_dedup"]}
    for i, t, mask in plain_repeats([(r["doc_id"], r["text"]) for r in seen["near_dedup"]]):
        data = t.encode()
        left = bytes(b for b, m in zip(data, mask) if not m)
        assert texts[i]["n_chars"] == len(texts[i]["text"])
        # whole characters: at most one at each end of a removed run stays beside the bytes that are left
        assert len(left) <= len(texts[i]["text"].encode()) <= len(left) + 6 * (1 + int(mask.sum()) // suffixdedup.LENGTH)
        assert mask.any() or texts[i]["text"] == t
    assert {r["doc_id"] for r in seen["packing"]} == set(texts)
    for r in seen["packing"]:
        assert 0 < r["length"] <= 4096


def test_pipeline_on_awkward_rows(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (None, "word " * 40, "en", None, 200), (3, "one two three four five six seven eight nine ten eleven", "en", "b", 55), (3, "one two three four five six seven eight nine ten eleven", "en", "b", 55)]
    schema = read_table(spark, SF, "documents").schema
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF), f"awkward-{name}")
        docs.count()
