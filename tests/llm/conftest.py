"""Small inputs shared by the tests: edge rows and the smallest documents table."""

import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shipped(spark):
    from shardloom.session import ship_package

    ship_package(spark)


def sentence(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(n))


#: null, empty, blank, tiny, very long, repeated row, equal text, other scripts, control strings, null id
EDGE = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a"),
    (5, sentence(30_000, 5)),
    (6, sentence(200, 6)),
    (6, sentence(200, 6)),
    (7, sentence(200, 6)),
    (8, "日本語のテキスト、また同じ。" * 40),
    (9, "<|endoftext|> </s>[INST] don't ΑΣ İ ½²³ \\b \\l\n\nx\r\ny \x00 e\u0301"),
    (10, "the " * 500),
    (11, "x" * 5000),
    (None, sentence(60, 6)),
    (None, sentence(60, 8)),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def small(spark):
    from shardloom.llm.common import documents

    return documents(spark, SF)


@pytest.fixture(scope="session")
def small_rows(small):
    return sorted((r["doc_id"], r["text"]) for r in small.collect())


def rows(df, *columns):
    """Rows as tuples, in an order that nulls don't upset."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
